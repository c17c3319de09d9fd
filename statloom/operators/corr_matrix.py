"""Correlation matrices in long form: one row for each ordered pair of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators import aggs, frames

METHODS = ("pearson", "spearman", "kendall")


def table_of(data: DataFrame | str) -> DataFrame:
    return data if isinstance(data, DataFrame) else SparkSession.active().table(data)


def corr_matrix(data: DataFrame | str, variables: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """row_var, col_var, coef, p_value, n for all pairs in the order of ``variables`` (all numeric columns if not given).

    Pairs are complete cases of two columns each. Pearson takes one pass over the table for all pairs; only half the
    matrix is computed, the rest mirrored. The result is NULL where the test is not defined.
    """
    df = table_of(data)
    if not isinstance(method, str) or method.lower() not in METHODS:
        raise ValueError(f"corr_matrix: unknown method '{method}' (expected 'pearson', 'spearman', or 'kendall')")
    method = method.lower()
    if variables is None:
        variables = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if any(v is None for v in variables):
        raise ValueError("corr_matrix: list entries must not be NULL")
    if len(variables) < 2:
        raise ValueError("corr_matrix: 'variables' must contain at least 2 columns")
    kinds = {f.name: f.dataType for f in df.schema}
    for v in variables:
        if v not in kinds:
            raise ValueError(f"corr_matrix: column '{v}' not found")
        if not isinstance(kinds[v], T.NumericType):
            raise ValueError(f"corr_matrix: column '{v}' is not numeric")
    pairs = [(i, j) for i in range(len(variables)) for j in range(i, len(variables))]
    name = {"pearson": "r", "spearman": "rho", "kendall": "tau"}[method]
    col = [F.col(f"`{v}`") for v in variables]
    if method != "pearson":
        # ranks are of each pair's complete cases, so each pair has its own; none meets in one task
        test = frames.spearman_test if method == "spearman" else frames.kendall_test
        one = [test(df, col[i], col[j]).select(F.lit(i).alias("i"), F.lit(j).alias("j"), "r") for i, j in pairs]
        tests = reduce(DataFrame.unionByName, one)
    else:
        row = df.agg(*[aggs.pearson_test(col[i], col[j]).alias(f"t{k}") for k, (i, j) in enumerate(pairs)])
        tests = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"t{k}").alias("r")) for k, (i, j) in enumerate(pairs)])).alias("s")).select("s.*")
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    names = F.array(*map(F.lit, variables))
    spread = tests.select(F.explode(F.array_distinct(both)).alias("p"), "r")
    return spread.orderBy("p.i", "p.j").select(
        F.get(names, F.col("p.i")).alias("row_var"), F.get(names, F.col("p.j")).alias("col_var"), F.col(f"r.{name}").alias("coef"), F.col("r.p_value").alias("p_value"), F.col("r.n").alias("n")
    )
