"""Page-drift detection and selector-based extraction as Spark jobs."""

from driftloom.params import DriftParams, RegistryParams

__all__ = ["DriftParams", "RegistryParams"]
