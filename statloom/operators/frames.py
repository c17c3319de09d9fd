"""Rank and count statistics for groups of any size, as DataFrame functions.

Values are compressed to distinct values with counts first, a hash aggregate with partial results. What then needs an
order is a running sum over distinct values. With ``by`` it is a window per group. Without, or with ``split=True`` for
groups that one task should not hold, values are cut at approximate quantiles into as many ranges as there are shuffle
partitions: sums run within ranges, and a range's start is the sum of the ranges before it. The cut points only balance
work; the result is exact for any.

Each function returns one row per combination of ``by`` (one in all without it) with the struct ``r``, NULL where the
statistic is not defined, as the Column forms in ``statloom.operators.aggs`` give it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import kernels, special, validate
from statloom.functions.finalize import floats, from_moments
from statloom.operators import aggs
from statloom.operators.aggs import num, text, valid


def _match(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL like any other value; without keys, b is a single row."""
    if not on:
        return a.join(F.broadcast(b), how="cross") if how == "inner" else a.join(F.broadcast(b), F.lit(True), how)
    b = b.withColumnsRenamed({c: f"__{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return a.join(b, cond, how).drop(*[f"__{c}" for c in on])


def keyed(f):
    """Gives the columns of ``by`` names inside that clash with nothing."""

    @wraps(f)
    def run(df: DataFrame, *args, by: Sequence[str] = (), **options) -> DataFrame:
        hidden = [f"__by{i}" for i in range(len(by))]
        out = f(df.withColumns(dict(zip(hidden, map(F.col, by)))) if by else df, *args, by=hidden, **options)
        return out.withColumnsRenamed(dict(zip(hidden, by)))

    return run


def ranged(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``df`` with __range, the place of ``value`` among approximate quantiles of its group, as many as shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / n) for i in range(1, n)] or [F.lit(0.5)]), F.lit(1000)).alias("__cuts"))
    return _match(df, cuts, by).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def running(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], split: bool | None = None, keep: bool = False) -> DataFrame:
    """``df`` (one row per ``by`` and ``value``) with, for each column of ``sums``, its sum over smaller values under the name given.

    With ``keep``, __range stays, by which the work was split; it is 0 where it was not.
    """
    ordered = lambda *more: Window.partitionBy(*by, *more).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    if by and not split:
        out = df.withColumns({name: F.coalesce(F.sum(c).over(ordered()), zero) for c, name in sums.items()})
        return out.withColumn("__range", F.lit(0)) if keep else out
    cut = ranged(df, by, value)
    local = cut.withColumns({name: F.coalesce(F.sum(c).over(ordered("__range")), zero) for c, name in sums.items()})
    # as many rows as ranges
    whole = cut.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{name}") for c, name in sums.items()])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*by, "__range", *[F.coalesce(F.sum(f"__{name}").over(before), zero).alias(f"__{name}") for name in sums.values()])
    joined = _match(local, starts, [*by, "__range"])
    return joined.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums.values()}).drop(*[] if keep else ["__range"], *[f"__{n}" for n in sums.values()])


def _finish(df: DataFrame, by: Sequence[str], stats: DataFrame, record: Column) -> DataFrame:
    """A row for each group of ``df``, also those without any value."""
    made = stats.select(*by, record.alias("r"))
    if not by:
        return made
    return _match(df.groupBy(*by).agg(F.lit(1).alias("__one")).drop("__one"), made, by, "left")


def _two(df: DataFrame, x, y, by: Sequence[str]) -> DataFrame:
    """by, v, cx, cy: distinct values of both columns, each without its NULLs, with their counts."""
    both = df.select(*by, F.explode(F.array(F.struct(num(x).alias("v"), F.lit(1).alias("cx"), F.lit(0).alias("cy")), F.struct(num(y).alias("v"), F.lit(0).alias("cx"), F.lit(1).alias("cy")))).alias("s"))
    return both.select(*by, "s.*").where(F.col("v").isNotNull()).groupBy(*by, "v").agg(F.sum("cx").alias("cx"), F.sum("cy").alias("cy"))


@keyed
def mann_whitney_u(df: DataFrame, x, y, alternative: str = "two-sided", continuity: bool = False, *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    options = dict(alternative=validate.alternative(alternative), continuity=validate.flag(continuity, "continuity"))
    d = running(_two(df, x, y, by).withColumn("c", F.col("cx") + F.col("cy")), by, "v", {"c": "before"}, split)
    c = F.col("c").cast("double")
    rank = F.col("before") + (c + 1) / 2
    poison = F.when(F.isnan("v"), float("nan")).otherwise(0.0)
    s = d.groupBy(*by).agg(F.sum("cx").alias("n1"), F.sum("cy").alias("n2"), F.sum(F.col("cx") * rank + poison).alias("ranks"), F.sum(c * c * c - c + poison).alias("ties"))
    return _finish(df, by, s, from_moments("mann_whitney_u", kernels.mann_whitney_u, "n1", "n2", "ranks", "ties", **options))


@keyed
def wilcoxon_signed_rank(df: DataFrame, x, y, alternative: str = "two-sided", continuity: bool = False, *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    options = dict(alternative=validate.alternative(alternative), continuity=validate.flag(continuity, "continuity"))
    d = df.select(*by, (num(x) - num(y)).alias("d")).where("d != 0").groupBy(*by, F.abs("d").alias("v")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count("d").alias("c"))
    d = running(d, by, "v", {"c": "before"}, split)
    c = F.col("c").cast("double")
    poison = F.when(F.isnan("v"), float("nan")).otherwise(0.0)
    s = d.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("up") * (F.col("before") + (c + 1) / 2) + poison).alias("w"), F.sum(c * c * c - c + poison).alias("ties"))
    return _finish(df, by, s, from_moments("wilcoxon_signed_rank", kernels.wilcoxon_signed_rank, "n", "w", "ties", **options))


@keyed
def spearman_test(df: DataFrame, x, y, alpha: float = 0.05, alternative: str = "two-sided", *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    options = dict(alpha=validate.alpha(alpha, True), alternative=validate.alternative(alternative), name="rho", label="Spearman Correlation")
    pairs = df.select(*by, valid(num(x)).alias("x"), valid(num(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    for side in "xy":
        ranks = running(pairs.groupBy(*by, side).agg(F.sum("c").alias("k")), by, side, {"k": "before"}, split)
        pairs = _match(pairs, ranks.select(*by, side, (F.col("before") + (F.col("k") + 1) / 2).alias(f"r{side}")), [*by, side])
    total = pairs.groupBy(*by).agg(F.sum("c").alias("n"))
    d = _match(pairs, total, by)
    gap = {s: F.col(f"r{s}") - (F.col("n") + 1) / 2 for s in "xy"}
    s = d.groupBy(*by).agg(F.sum("c").alias("m"), *[F.sum(F.col("c") * gap[a] * gap[b]).alias(f"s{a}{b}") for a, b in ("xx", "yy", "xy")])
    return _finish(df, by, s, from_moments("spearman_test", kernels.correlation, "m", "sxx", "syy", "sxy", **options))


@keyed
def kendall_test(df: DataFrame, x, y, alternative: str = "two-sided", *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    """A group's pairs meet in one task, where they are counted in O(n log n); without keys, or with ``split``, in as many as there are ranges.

    Both columns are cut into ranges. Pairs that differ in both ranges are counted from the numbers of rows by ranges, a
    small table; pairs of one range of x in its task, and pairs of one range of y but different ranges of x in that one's.
    """
    if by and not split:
        return df.groupBy(*by).agg(aggs.kendall_test(x, y, alternative).alias("r"))
    a, b = num(x), num(y)
    both = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    d = df.select(*by, F.when(both, a).alias("x"), F.when(both, b).alias("y")).where("x IS NOT NULL").groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    d = ranged(ranged(d, by, "x").withColumnRenamed("__range", "rx"), by, "y").withColumnRenamed("__range", "ry")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*by).schema] + ["s double"])

    def counted(first: str, second: str, apart: str | None):
        def run(rows: pa.Table) -> pa.Table:
            v = [rows.column(c).to_numpy() for c in (first, second)]
            s = kernels.concordance(*v, rows.column("c").to_numpy().astype(float), rows.column(apart).to_numpy() if apart else None)
            return pa.table([*[rows.column(c)[:1] for c in by], pa.array([float(s)])], [*by, "s"])

        return run

    # a range of one value of x has no pair that counts, however many rows it has
    within = d.groupBy(*by, "rx").applyInArrow(counted("x", "y", None), schema)
    across = d.groupBy(*by, "ry").applyInArrow(counted("x", "y", "rx"), schema)
    grid = d.groupBy(*by, "rx", "ry").agg(F.sum("c").alias("c"))
    apart = grid.groupBy(*by).applyInArrow(counted("rx", "ry", None), schema) if by else grid.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(counted("rx", "ry", None), schema)
    s = within.unionByName(across).unionByName(apart).groupBy(*by).agg(F.sum("s").alias("s"))
    ties = None
    for v in "xy":
        t = d.groupBy(*by, v).agg(F.sum("c").cast("double").alias("t"))
        t = t.groupBy(*by).agg(F.sum("t").alias(f"n{v}"), F.sum(F.expr("t * (t - 1) * (2 * t + 5)")).alias(f"v{v}"), F.sum(F.expr("t * (t - 1)")).alias(f"{v}1"), F.sum(F.expr("t * (t - 1) * (t - 2)")).alias(f"{v}2"))
        ties = t if ties is None else _match(ties, t, by)
    found = _match(ties, s, by)
    pairs = F.expr("nx * (nx - 1) / 2")
    record = from_moments("kendall_test", kernels.kendall, "nx", "s", pairs - F.col("x1") / 2, pairs - F.col("y1") / 2, "vx", "vy", "x1", "y1", "x2", "y2", alternative=validate.alternative(alternative))
    return _finish(df, by, found, record)


def _scores(before: pa.Array, count: pa.Array, n: pa.Array) -> pa.Array:
    sums, squares = kernels.score_sums(floats(before), floats(count), floats(n))
    return pa.StructArray.from_arrays([pa.array(sums), pa.array(squares)], ["m", "mm"])


@keyed
def shapiro_wilk(df: DataFrame, x, most: int | None = 5000, *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    """Groups of more than ``most`` values have no result. With 5000, as the method was fitted, they are counted first and never collected.

    Other limits, or none, take Royston's formulas beyond what they were fitted to; nothing is collected then.
    """
    if most == 5000:
        v = df.select(*by, valid(num(x)).alias("v"))
        small = v.groupBy(*by).agg(F.count("v").alias("n")).where("n <= 5000").drop("n") if by else None
        held = _match(v, small.withColumn("__small", F.lit(True)), by).drop("__small") if by else v
        return _finish(df, by, held.groupBy(*by).agg(aggs.shapiro_wilk("v").alias("s")), F.col("s"))
    d = _placed(df, x, by, split).withColumn("s", F.arrow_udf(_scores, "m double, mm double")("before", "c", "n"))
    v, n, upto, gap = F.col("v"), F.col("n"), F.col("before") + F.col("c"), F.col("v") - F.col("mean")
    ends = [F.min(v).alias("low"), F.min(F.when(upto >= 2, v)).alias("low2"), F.max(F.when(F.col("before") <= n - 2, v)).alias("high2"), F.max(v).alias("high")]
    sums = [F.sum("s.mm").alias("squares"), F.sum(gap * F.col("s.m")).alias("product"), F.sum(F.col("c") * gap * gap).alias("ss")]
    s = d.groupBy(*by).agg(F.first("n").alias("n"), *sums, *ends)
    size = F.col("n") if most is None else F.when(F.col("n") <= most, F.col("n"))
    return _finish(df, by, s, from_moments("shapiro_wilk", kernels.shapiro_sums, size, "squares", "product", "ss", "low", "low2", "high2", "high"))


@keyed
def anova_oneway(df: DataFrame, value, group, *, by: Sequence[str] = ()) -> DataFrame:
    plain = df.select(*by, valid(num(value)).alias("v"), text(group).alias("g")).where("v IS NOT NULL AND g IS NOT NULL")
    each = plain.groupBy(*by, "g").agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    whole = each.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    d = _match(each, whole, by)
    s = d.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("s")).alias("ssw"))
    return _finish(df, by, s, from_moments("anova_oneway", kernels.anova_oneway, "k", "total", "ssb", "ssw"))


@keyed
def chisq_independence(df: DataFrame, row, col, continuity: bool = False, *, by: Sequence[str] = ()) -> DataFrame:
    validate.flag(continuity, "continuity")
    cells = df.select(*by, text(row).alias("a"), text(col).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").groupBy(*by, "a", "b").agg(F.count("*").cast("double").alias("o"))
    sides = {s: cells.groupBy(*by, s).agg(F.sum("o").alias(f"t{s}")) for s in "ab"}
    d = _match(_match(cells, sides["a"], [*by, "a"]), sides["b"], [*by, "b"])
    s = d.groupBy(*by).agg(F.sum(F.col("o") ** 2 / (F.col("ta") * F.col("tb"))).alias("s"), F.sum("o").alias("n"))
    for x in "ab":
        s = _match(s, sides[x].groupBy(*by).agg(F.count("*").alias(f"k{x}"), F.sum(1 / F.col(f"t{x}")).alias(f"i{x}")), by)
    chi = F.col("n") * (F.col("s") - 1)
    if continuity:
        inverse = F.col("n") * F.col("ia") * F.col("ib")
        yates = F.greatest(F.sqrt(F.greatest(chi, F.lit(0.0)) / inverse) - 0.5, F.lit(0.0)) ** 2 * inverse
        chi = F.when((F.col("ka") == 2) & (F.col("kb") == 2), yates).otherwise(chi)
    return _finish(df, by, s, from_moments("chisq_independence", kernels.chisq_independence, F.greatest(chi, F.lit(0.0)), "n", "ka", "kb"))


@keyed
def chisq_goodness_of_fit(df: DataFrame, category, *, by: Sequence[str] = ()) -> DataFrame:
    cells = df.select(*by, text(category).alias("a")).where("a IS NOT NULL").groupBy(*by, "a").agg(F.count("*").cast("double").alias("o"))
    s = cells.groupBy(*by).agg(F.sum(F.col("o") ** 2).alias("s"), F.sum("o").alias("n"), F.count("*").alias("k"))
    return _finish(df, by, s, from_moments("chisq_goodness_of_fit", kernels.chisq_goodness_of_fit, "s", "n", "k"))


def _placed(df: DataFrame, x, by: Sequence[str], split: bool | None) -> DataFrame:
    """by, v, c, before, n, mean, sd, z of each distinct value."""
    d = df.select(*by, valid(num(x)).alias("v")).where("v IS NOT NULL")
    moments = d.groupBy(*by).agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    placed = running(d.groupBy(*by, "v").agg(F.count("*").alias("c")), by, "v", {"c": "before"}, split)
    return _match(placed, moments, by).withColumn("z", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")))


def _tails(z: pa.Array) -> pa.Array:
    low, high = kernels.log_tails(floats(z))
    return pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["low", "high"])


@keyed
def anderson_darling(df: DataFrame, x, *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    d = _placed(df, x, by, split).withColumn("t", F.arrow_udf(_tails, "low double, high double")("z"))
    b, e, n = F.col("before").cast("double"), (F.col("before") + F.col("c")).cast("double"), F.col("n")
    # the weights 2i-1 and 2(n-i)+1 of a value's ranks, summed over its ties
    term = (e * e - b * b) * F.col("t.low") + ((n - b) ** 2 - (n - e) ** 2) * F.col("t.high")
    s = d.groupBy(*by).agg(F.first("n").alias("n"), F.first("sd").alias("sd"), F.sum(term).alias("total"))
    return _finish(df, by, s, from_moments("anderson_darling", kernels.anderson_darling, "n", "sd", "total"))


def _phi(z: pa.Array) -> pa.Array:
    return pa.array(special.pnorm(floats(z)), pa.float64())


@keyed
def ks_test_1samp(df: DataFrame, x, *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    d = _placed(df, x, by, split).withColumn("f", F.arrow_udf(_phi, "double")("z"))
    gap = F.greatest(F.abs(F.col("f") - F.col("before") / F.col("n")), F.abs(F.col("f") - (F.col("before") + F.col("c")) / F.col("n")))
    s = d.groupBy(*by).agg(F.first("n").alias("n"), F.first("sd").alias("sd"), F.max(gap).alias("d"))
    return _finish(df, by, s, from_moments("ks_test_1samp", kernels.ks_test_1samp, "n", "sd", "d"))


@keyed
def ks_test_2samp(df: DataFrame, x, y, *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    two = _two(df, valid(num(x)), valid(num(y)), by)
    d = _match(running(two, by, "v", {"cx": "bx", "cy": "by_"}, split), two.groupBy(*by).agg(F.sum("cx").alias("nx"), F.sum("cy").alias("ny")), by)
    gap = F.abs(F.try_divide(F.col("bx") + F.col("cx"), F.col("nx")) - F.try_divide(F.col("by_") + F.col("cy"), F.col("ny")))
    s = d.groupBy(*by).agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.max(gap).alias("d"))
    return _finish(df, by, s, from_moments("ks_test_2samp", kernels.ks_test_2samp, "nx", "ny", "d"))


@keyed
def summary_stats(df: DataFrame, x, bias_correction: bool = True, quantile_type: int = 7, *, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    validate.flag(bias_correction, "bias_correction"), validate.quantile_type(quantile_type)
    d = df.select(*by, valid(num(x)).alias("v"))
    n = F.count("v").cast("double")
    power = lambda a, b, v: F.coalesce(a, F.lit(0.0)) * v * b
    m = d.groupBy(*by).agg(n.alias("n"), (F.count(F.lit(1)) - n).alias("missing"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"), F.min("v").alias("low"), F.max("v").alias("high"))
    counts = running(d.where("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("c")), by, "v", {"c": "before"}, split)
    placed = _match(counts, m.select(*by, "n"), by)
    upto, values = F.col("before") + F.col("c"), []
    for q in (0.25, 0.5, 0.75):
        at = F.least(F.greatest(F.col("n") * q + 0.5 if quantile_type == 5 else 1 + q * (F.col("n") - 1), F.lit(1.0)), F.col("n"))
        k = F.floor(at)
        low, high = F.min(F.when(upto >= k, F.col("v"))), F.min(F.when(upto >= F.least(k + 1, F.col("n")), F.col("v")))
        values += [low.alias(f"a{q}"), high.alias(f"b{q}"), F.first(at - k).alias(f"f{q}")]
    quantiles = placed.groupBy(*by).agg(*values)
    # groups by frequency are few; the highest names the modes
    modes = counts.groupBy(*by, "c").agg(F.min("v").alias("mode"), F.count("*").alias("modes")).groupBy(*by).agg(F.max("c").alias("top"), F.max_by("mode", "c").alias("mode"), F.max_by("modes", "c").alias("modes"))
    s = _match(_match(m, quantiles, by, "left"), modes, by, "left")
    m2 = F.col("n") * F.col("var")
    at = {q: F.col(f"`a{q}`") + F.col(f"`f{q}`") * (F.col(f"`b{q}`") - F.col(f"`a{q}`")) for q in (0.25, 0.5, 0.75)}
    cols = ["n", "missing", "mean", m2, power(F.col("g1"), F.pow("var", F.lit(1.5)), F.col("n")), F.coalesce(F.col("g2") + 3, F.lit(0.0)) * F.col("n") * F.pow("var", F.lit(2)), "low", *at.values(), "high", "mode", "top", "modes"]
    return s.select(*by, from_moments("summary_stats", kernels.summary, *cols, bias_correction=bias_correction).alias("r"))


def adjust_p(df: DataFrame, p: str, method: str, *, by: Sequence[str] = (), name: str = "p_adjusted", split: bool | None = None) -> DataFrame:
    """``df`` with the p-values of a whole column adjusted within ``by``; NULL and NaN stay NULL and do not count.

    Equal p-values are adjusted alike, so it is done for distinct ones. Without keys, or with ``split``, the running
    extremes go by ranges, each with the extreme of the ranges before or behind it.
    """
    method = "BH" if validate.adjust_method(method) == "fdr" else method
    keys = [f"__by{i}" for i in range(len(by))]
    d = df.withColumns({**dict(zip(keys, map(F.col, by))), "__p": valid(num(p))})
    counts = d.where("__p IS NOT NULL").groupBy(*keys, "__p").agg(F.count("*").alias("__c"))
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    placed = _match(running(counts, keys, "__p", {"__c": "__b"}, split, keep=True), total, keys)
    v, n, last = F.col("__p"), F.col("__n"), F.col("__b") + F.col("__c")
    term = {"none": v, "bonferroni": v * n, "holm": v * (n - F.col("__b")), "hochberg": v * (n - last + 1), "BH": v * n / last, "BY": v * n / last}[method]
    if method == "BY":
        # the harmonic number, by its expansion where that is exact to the last places
        h = F.when(n <= 1000, F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / k))
        term = term * h.otherwise(F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n))
    t = placed.withColumn("__t", term)
    if method in ("holm", "hochberg", "BH", "BY"):
        best, pick, order = (F.max, F.greatest, F.asc) if method == "holm" else (F.min, F.least, F.desc)
        local = Window.partitionBy(*keys, "__range").orderBy(order("__p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = t.groupBy(*keys, "__range").agg(best("__t").alias("__e"))  # as many rows as ranges
        before = Window.partitionBy(*keys).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
        carried = whole.select(*keys, "__range", best("__e").over(before).alias("__e"))
        t = _match(t.withColumn("__t", best("__t").over(local)), carried, [*keys, "__range"]).withColumn("__t", pick("__t", "__e"))
    done = t.select(*keys, "__p", F.least("__t", F.lit(1.0)).alias(name))
    return _match(d, done, [*keys, "__p"], "left").drop(*keys, "__p")
