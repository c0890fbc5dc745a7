"""Operators over tables of page visits."""
