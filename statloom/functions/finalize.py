"""Bridges from aggregates to kernels: one Arrow UDF over as many rows as there are groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import kernels

_TYPES = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def fields_of(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))]


def record(null: np.ndarray, fields: dict, schema: str) -> pa.StructArray:
    """Records of a schema from arrays and scalars, NULL where ``null``."""
    n, cols, kinds = len(null), [], fields_of(schema)
    for name, kind in kinds:
        v = fields[name]
        if isinstance(v, str):
            cols.append(pa.array([v] * n, kind))
            continue
        v = np.broadcast_to(np.asarray(v), (n,))
        if kind == pa.int64():
            v = np.where(null | np.isnan(v.astype(float)), 0, v).astype(np.int64)
        cols.append(pa.array(v.astype(bool) if kind == pa.bool_() else v, kind))
    return pa.StructArray.from_arrays(cols, fields=[pa.field(a, b) for a, b in kinds], mask=pa.array(null))


def floats(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def moment_udf(record_of: str, kernel: Callable, **options):
    """A UDF from sufficient statistics (doubles) to the record of statistic ``record_of``."""
    schema = kernels.SCHEMAS[record_of]

    def run(*arrays: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return record(*kernel(*map(floats, arrays), **options), schema)

    return F.arrow_udf(run, f"struct<{_sql(schema)}>")


def from_moments(record_of: str, kernel: Callable, *cols: Column, **options) -> Column:
    """The record of statistic ``record_of`` by a kernel over columns of sufficient statistics."""
    return moment_udf(record_of, kernel, **options)(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in cols])


def _sql(schema: str) -> str:
    return ", ".join(f"`{name}`:{kind}" for name, kind in (f.split() for f in schema.split(", ")))


def list_udf(record_of: str, kernel: Callable, of: Callable, *, strings: int = 0, pairs: bool = False, **options):
    """A UDF from collected lists to the record of statistic ``record_of``: ``of`` reduces a group's values to what the kernel takes.

    The first columns are lists (of structs x, y if ``pairs``), the last ``strings`` of their fields are texts; columns
    that are no lists are passed on as numbers.
    """
    schema = kernels.SCHEMAS[record_of]

    def value(v):
        if not isinstance(v, list):
            return [v]
        if not pairs:
            return [np.array(v, object if strings else float)]
        x, y = [r["x"] for r in v], [r["y"] for r in v]
        return [np.array(x, object if strings > 1 else float), np.array(y, object if strings else float)]

    def run(*arrays: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            rows = [of(*[x for v in row for x in value(v)]) for row in zip(*(a.to_pylist() for a in arrays))]
            return record(*kernel(*(np.array([np.nan if v is None else v for v in c], float) for c in zip(*rows)), **options), schema) if rows else record(np.zeros(0, bool), {n: np.zeros(0) for n, _ in fields_of(schema)}, schema)

    return F.arrow_udf(run, f"struct<{_sql(schema)}>")


def from_lists(record_of: str, kernel: Callable, of: Callable, *cols: Column, **options) -> Column:
    """The record of statistic ``record_of`` over collected lists; see list_udf()."""
    return list_udf(record_of, kernel, of, **options)(*cols)
