"""Columns of Arrow batches as Python values, without a scalar object for each value on the way."""

from __future__ import annotations

import pyarrow as pa


def values(column: pa.Array) -> list:
    """``to_pylist``; lists and maps by their flat contents, plain columns in one step."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        ends = column.offsets.to_pylist()
        low, high = ends[0], ends[-1]
        if pa.types.is_map(kind):
            flat = list(zip(*(values(part.slice(low, high - low)) for part in (column.keys, column.items))))
        else:
            flat = values(column.values.slice(low, high - low))
        known = column.is_valid().to_pylist()
        return [flat[a - low : b - low] if ok else None for a, b, ok in zip(ends, ends[1:], known)]
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)
    if pa.types.is_string(kind) or (plain and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()
