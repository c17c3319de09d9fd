"""Descriptive "Table 1" summaries in long form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions import kernels
from statloom.operators import frames
from statloom.operators.corr_matrix import table_of

SCHEMA = "variable string, level string, statistic string, stratum string, display string, p_value double"


def _checked(df: DataFrame, data, variables, by, force_categorical, force_numerical) -> tuple[list[str], list[str], dict[str, bool]]:
    if data is None:
        raise ValueError("table_one: 'data' (source table name) is required")
    if variables is None:
        raise ValueError("table_one: 'variables' list is required")
    if not variables:
        raise ValueError("table_one: 'variables' must not be empty")
    kinds = {f.name: f.dataType for f in df.schema}
    name = data if isinstance(data, str) else "data"
    for v in variables:
        if v not in kinds:
            raise ValueError(f"table_one: column '{v}' not found in table '{name}'")
    for b in by:
        if b not in kinds:
            raise ValueError(f"table_one: 'by' column '{b}' not found in table '{name}'")
    for kind, own, other in (("force_categorical", force_categorical, force_numerical), ("force_numerical", force_numerical, ())):
        for v in own:
            if v in other:
                raise ValueError(f"table_one: '{v}' is listed in both force_categorical and force_numerical")
            if v not in variables:
                raise ValueError(f"table_one: {kind} entry '{v}' is not in 'variables'")
    return list(variables), list(by), {v: v in force_numerical or (v not in force_categorical and isinstance(kinds[v], T.NumericType)) for v in variables}


def _numeric(df: DataFrame, names: list[str], keys: list[str], by_names: list[str]):
    """Summaries by variable and stratum, and ANOVA p-values by variable. A stratum of None is all rows."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").cast("double").alias("v")) for v in names])).alias("s")).select(*keys, "s.*")
    found = {(r.name, None): r.r for r in frames.summary_stats(long, "v", by=["name"]).collect()}
    sizes = {(r.name, None): r.n for r in long.groupBy("name").agg(F.count("*").alias("n")).collect()}
    p: dict[str, float | None] = {}
    if keys:
        whole = long.dropna(subset=keys)
        for r in frames.summary_stats(whole, "v", by=["name", *keys]).collect():
            found[r.name, tuple(r[k] for k in keys)] = r.r
        for r in whole.groupBy("name", *keys).agg(F.count("*").alias("n")).collect():
            sizes[r.name, tuple(r[k] for k in keys)] = r.n
        # the tuple itself is the group, its label could be that of another
        tests = frames.anova_oneway(whole.select("name", "v", F.to_json(F.array(*keys)).alias("g")), "v", "g", by=["name"])
        p = {r.name: r.r and r.r.p_value for r in tests.collect()}
    return found, sizes, p


def _categorical(df: DataFrame, names: list[str], keys: list[str]) -> dict[str, list]:
    """Counts by variable, level and stratum; as many rows as the result has."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").cast("string").alias("level")) for v in names])).alias("s")).select(*keys, "s.*")
    out: dict[str, list] = {v: [] for v in names}
    for r in long.groupBy("name", "level", *keys).agg(F.count("*").alias("n")).collect():
        out[r.name].append((r.level, tuple(r[k] for k in keys), r.n))
    return out


def _chisq_p(cells: list, strata: list[tuple]) -> float | None:
    levels = sorted({level for level, key, _ in cells if level is not None and None not in key})
    if len(levels) < 2 or len(strata) < 2:
        return None
    grid = np.zeros((len(levels), len(strata)))
    at = {s: j for j, s in enumerate(strata)}
    for level, key, n in cells:
        if level is not None and None not in key:
            grid[levels.index(level), at[key]] += n
    grid = grid[:, grid.sum(0) > 0]
    if grid.shape[1] < 2:
        return None
    want = grid.sum(1, keepdims=True) * grid.sum(0, keepdims=True) / grid.sum()
    one = lambda v: np.array([float(v)])
    null, r = kernels.chisq_independence(one(((grid - want) ** 2 / want).sum()), one(grid.sum()), one(grid.shape[0]), one(grid.shape[1]))
    return None if null[0] else float(r["p_value"][0])


def table_one(data: DataFrame | str, variables: Sequence[str] | None = None, by: Sequence[str] = (), force_categorical: Sequence[str] = (), force_numerical: Sequence[str] = ()) -> DataFrame:
    """variable, level, statistic, stratum, display, p_value: summaries overall and by each observed combination of ``by``.

    Numeric variables give n, missing, mean (sd), median [q1, q3] and min, max; others each level and ``Missing`` as
    n (%). The p-value of a variable across strata is of an analysis of variance or a chi-square test. Rows with a NULL
    in ``by`` count in Overall only.
    """
    df = table_of(data) if data is not None else None
    names, by, numeric = _checked(df, data, variables, by or (), force_categorical or (), force_numerical or ())
    keys = [f"__by{i}" for i in range(len(by))]
    df = df.withColumns({k: F.col(f"`{b}`").cast("string") for k, b in zip(keys, by)}) if by else df
    strata = sorted(tuple(r) for r in df.dropna(subset=keys).select(*keys).distinct().collect()) if by else []
    numbers = [v for v in names if numeric[v]]
    found, sizes, p_values = _numeric(df, numbers, keys, by) if numbers else ({}, {}, {})
    cells = _categorical(df, [v for v in names if not numeric[v]], keys) if len(numbers) < len(names) else {}
    rows: list[tuple] = []
    for v in names:
        p = None
        if len(strata) >= 2:
            p = p_values.get(v) if numeric[v] else _chisq_p(cells[v], strata)
        levels = [] if numeric[v] else sorted({level for level, _, _ in cells[v] if level is not None})
        for key in [None, *strata]:
            label = "Overall" if key is None else " / ".join(key)
            if numeric[v]:
                s, size = found.get((v, key)), sizes.get((v, key), 0)
                shown = [
                    ("n", str(s.n if s else 0)),
                    ("missing", str(s.n_missing if s else size)),
                    ("mean (sd)", f"{s.mean:.1f} ({s.sd:.1f})" if s else "."),
                    ("median [q1, q3]", f"{s.median:.1f} [{s.q1:.1f}, {s.q3:.1f}]" if s else "."),
                    ("min, max", f"{s.min:.1f}, {s.max:.1f}" if s else "."),
                ]
                rows += [(v, None, name, label, text, p) for name, text in shown]
                continue
            count: dict = {}
            for level, k, n in cells[v]:
                if key is None or k == key:
                    count[level] = count.get(level, 0) + n
            total = sum(count.values())
            for level in [*levels, None]:
                n = count.get(level, 0)
                rows.append((v, (level or None) if level is not None else "Missing", "n (%)", label, f"{n:.0f} ({100 * n / total:.1f}%)" if total else "0 (0.0%)", p))
    return df.sparkSession.createDataFrame(rows, SCHEMA)
