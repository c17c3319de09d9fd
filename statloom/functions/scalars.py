"""Distribution functions and other scalars as Columns; invalid parameters and NaN results are NULL, never an error.

The normal and exponential densities and the exponential functions are built from JVM functions; what needs special
functions runs in vectorised Arrow UDFs. ``register(spark)`` makes all of them callable from SQL, with every number of
arguments that they take.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from statloom.functions import kernels, special, validate
from statloom.functions.finalize import floats


def _num(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast("double")


def _vector(f: Callable):
    def run(*arrays: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            out = f(*map(floats, arrays))
        return pa.array(out, pa.float64(), from_pandas=True)

    return F.arrow_udf(run, "double")


def _native(name: str, x: Column, *more: Column) -> Column | None:
    """A form in JVM functions, where there is one."""
    finite = lambda ok, v: F.when(ok & ~F.isnan(x), F.nanvl(v, F.lit(None).cast("double")))
    if name == "dnorm":
        mean, sd = [*more, *map(F.lit, (0.0, 1.0)[len(more) :])]
        z = F.try_divide(x - mean, sd)
        return finite(sd > 0, F.try_divide(F.exp(-z * z / 2), sd * math.sqrt(2 * math.pi)))
    if name in ("dexp", "pexp", "qexp"):
        (rate,) = more or (F.lit(1.0),)
        if name == "dexp":
            return finite(rate > 0, F.when(x < 0, 0.0).otherwise(rate * F.exp(-rate * x)))
        if name == "pexp":
            return finite(rate > 0, F.when(x < 0, 0.0).otherwise(-F.expm1(-rate * x)))
        ends = F.when(x == 1, float("inf")).otherwise(F.try_divide(-F.log1p(-x), rate))
        return finite((rate > 0) & (x >= 0) & (x <= 1), ends)
    return None


def distribution(name: str, *args) -> Column:
    """``name`` (dnorm, pt, qbeta, ...) of columns or numbers."""
    if name not in special.DISTRIBUTIONS:
        raise ValueError(f"unknown distribution function '{name}'")
    f, least, most = special.DISTRIBUTIONS[name]
    if not least <= len(args) <= most:
        raise TypeError(f"{name} takes {least} to {most} arguments")
    cols = [_num(a) for a in args]
    native = _native(name, *cols)
    return native if native is not None else _vector(f)(*cols)


def _named(name: str) -> Callable[..., Column]:
    def f(*args) -> Column:
        return distribution(name, *args)

    f.__name__, f.__doc__ = name, f"{name} of columns or numbers; see distribution()."
    return f


globals().update({name: _named(name) for name in special.DISTRIBUTIONS})


def _lists(a: pa.Array) -> list:
    """Lists of floats, also from the decimals that SQL literals are."""
    return a.cast(pa.list_(pa.float64())).to_pylist()


def _adjust(p: pa.Array, method: pa.Array) -> pa.Array:
    return pa.array([None if v is None or m is None else kernels.adjust_p(v, validate.adjust_method(m)) for v, m in zip(_lists(p), method.to_pylist())], pa.list_(pa.float64()))


def adjust_p(p: Column | str, method: str | Column) -> Column:
    """Adjusted p-values of an array column; the method may differ by row. Names are case-sensitive."""
    if isinstance(method, str):
        validate.adjust_method(method)
        method = F.lit(method)
    return F.arrow_udf(_adjust, "array<double>")((F.col(p) if isinstance(p, str) else p).cast("array<double>"), method)


def _poibin(p: pa.Array, k: pa.Array) -> pa.Array:
    return pa.array([None if v is None or n is None else kernels.poibin_cdf(v, n) for v, n in zip(_lists(p), k.to_pylist())], pa.float64())


def poibin_cdf(p: Column | str, k) -> Column:
    """P(at most k successes) for an array of probabilities; NULL if one is NULL or no probability."""
    k = F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k
    return F.arrow_udf(_poibin, "double")((F.col(p) if isinstance(p, str) else p).cast("array<double>"), k.cast("long"))


def _label(x: pa.Array, edges: pa.Array) -> pa.Array:
    """``edges`` repeat for all rows of a table as a rule, so their texts are made once for each list."""
    made: dict = {}
    out = []
    for v, e in zip(x.cast(pa.float64()).to_pylist(), _lists(edges)):
        if v is None or v != v or e is None or len(e) < 2 or None in e or not e[0] <= v <= e[-1]:
            out.append(None)
            continue
        key = tuple(e)
        if key not in made:
            made[key] = [f"[{a:g}, {b:g}{']' if i == len(e) - 2 else ')'}" for i, (a, b) in enumerate(zip(e, e[1:]))]
        out.append(made[key][min(max(int(np.searchsorted(e, v, "right")) - 1, 0), len(e) - 2)])
    return pa.array(out, pa.string())


def bin_label(x, edges: Column | str) -> Column:
    """The label ``[lo, hi)`` of the bin that holds x, the last one closed; NULL outside and for NaN."""
    return F.arrow_udf(_label, "string")(_num(x), (F.col(edges) if isinstance(edges, str) else edges).cast("array<double>"))


def register(spark: SparkSession) -> None:
    """All scalars as SQL functions of this session."""
    for name, (f, _, _) in special.DISTRIBUTIONS.items():
        spark.udf.register(name, _vector(f))
    spark.udf.register("adjust_p", F.arrow_udf(_adjust, "array<double>"))
    spark.udf.register("poibin_cdf", F.arrow_udf(_poibin, "double"))
    spark.udf.register("bin_label", F.arrow_udf(_label, "string"))
