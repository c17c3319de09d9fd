"""Statistics as Columns: use them in ``groupBy().agg()``, in ``select`` over a whole table, or over a window (``over=``).

Moment statistics are built-in aggregates, merged from partial ones, with a finalizer over one row per group: their
memory does not grow with a group. Rank statistics have to see a group's values in order; as Columns they collect them,
which suits groups that fit a task. For groups of any size use ``statloom.operators.frames``.
Each returns one struct, NULL where the statistic is not defined; select its fields afterwards.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from statloom.functions import kernels, validate
from statloom.functions.finalize import floats, from_lists, from_moments


def num(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def valid(c: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(c), c)


def _over(over: WindowSpec | None):
    return (lambda a: a.over(over)) if over is not None else (lambda a: a)


def ttest_1samp(x, mu: float = 0.0, alpha: float = 0.05, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """One-sample t-test of the mean against ``mu``. NaN values make the result NaN."""
    w, v = _over(over), num(x)
    options = dict(mu=validate.number(mu, "mu"), alpha=validate.alpha(alpha), alternative=validate.alternative(alternative))
    return from_moments("ttest_1samp", kernels.ttest_one, w(F.count(v)), w(F.avg(v)), w(F.var_samp(v)), **options)


def ttest_paired(x, y, alpha: float = 0.05, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """Paired t-test: the one-sample test on x - y; a pair with a NULL is left out."""
    w, v = _over(over), num(x) - num(y)
    options = dict(alpha=validate.alpha(alpha), alternative=validate.alternative(alternative), label="Paired")
    return from_moments("ttest_paired", kernels.ttest_one, w(F.count(v)), w(F.avg(v)), w(F.var_samp(v)), **options)


def ttest_2samp(x, y, equal_var: bool = False, alpha: float = 0.05, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """Two-sample t-test of two columns, each without its NULLs: Welch's, or Student's if ``equal_var``."""
    w = _over(over)
    options = dict(equal_var=validate.flag(equal_var, "equal_var"), alpha=validate.alpha(alpha), alternative=validate.alternative(alternative))
    cols = [w(f(v)) for v in (num(x), num(y)) for f in (F.count, F.avg, F.var_samp)]
    return from_moments("ttest_2samp", kernels.ttest_2samp, *cols, **options)


def _pair(x, y) -> tuple[Column, Column]:
    a, b = valid(num(x)), valid(num(y))
    whole = a.isNotNull() & b.isNotNull()
    return F.when(whole, a), F.when(whole, b)


def pearson_test(x, y, alpha: float = 0.05, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """Pearson correlation with its t-test and Fisher interval."""
    w, (a, b) = _over(over), _pair(x, y)
    options = dict(alpha=validate.alpha(alpha, True), alternative=validate.alternative(alternative))
    return from_moments("pearson_test", kernels.correlation, w(F.count(a)), w(F.regr_sxx(b, a)), w(F.regr_syy(b, a)), w(F.regr_sxy(b, a)), **options)


def jarque_bera(x, *, over: WindowSpec | None = None) -> Column:
    """Jarque-Bera test of normality."""
    w, v = _over(over), valid(num(x))
    return from_moments("jarque_bera", kernels.jarque_bera, w(F.count(v)), w(F.skewness(v)), w(F.kurtosis(v)))


def sign_test_1samp(x, mu: float = 0.0, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """Exact sign test of the median against ``mu``."""
    return _signs("sign_test_1samp", valid(num(x)) - validate.number(mu, "mu"), alternative, over, "Sign Test (1-sample)")


def sign_test_paired(x, y, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """Exact sign test on x - y."""
    return _signs("sign_test_paired", valid(num(x)) - valid(num(y)), alternative, over, "Sign Test (paired)")


def _signs(name: str, d: Column, alternative: str, over, label: str) -> Column:
    w, d = _over(over), valid(d)
    return from_moments(name, kernels.sign_test, w(F.count_if(d > 0)), w(F.count_if(d < 0)), w(F.count_if(d == 0)), alternative=validate.alternative(alternative), label=label)


def edges_udf(method: str):
    """A UDF from count, minimum, maximum, standard deviation and interquartile range to edges."""

    def run(*arrays: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return pa.array(kernels.bin_edges(*map(floats, arrays), method), pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def bin_edges(x, method: str = "sturges", *, over: WindowSpec | None = None) -> Column:
    """Edges of bins of equal width by a rule for their number."""
    method, w, v = validate.bin_method(method), _over(over), valid(num(x))
    if method in ("fd", "auto"):
        q = w(F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))))
        iqr = F.get(q, F.lit(1)) - F.get(q, F.lit(0))
    else:
        iqr = F.lit(0.0)
    return edges_udf(method)(w(F.count(v)).cast("double"), w(F.min(v)), w(F.max(v)), w(F.stddev_samp(v)), iqr)


def _list(c: Column, over) -> Column:
    return _over(over)(F.collect_list(c))


def _pairs(x: Column, y: Column, over) -> Column:
    return _list(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))), over)


def mann_whitney_u(x, y, alternative: str = "two-sided", continuity: bool = False, *, over: WindowSpec | None = None) -> Column:
    """Mann-Whitney U test of two columns, normal approximation with tie correction. NaN makes the result NaN."""
    options = dict(alternative=validate.alternative(alternative), continuity=validate.flag(continuity, "continuity"))
    return from_lists("mann_whitney_u", kernels.mann_whitney_u, kernels.of_mann_whitney, _list(num(x), over), _list(num(y), over), **options)


def wilcoxon_signed_rank(x, y, alternative: str = "two-sided", continuity: bool = False, *, over: WindowSpec | None = None) -> Column:
    """Wilcoxon signed-rank test on x - y, normal approximation with tie correction. NaN makes the result NaN."""
    options = dict(alternative=validate.alternative(alternative), continuity=validate.flag(continuity, "continuity"))
    return from_lists("wilcoxon_signed_rank", kernels.wilcoxon_signed_rank, kernels.of_wilcoxon, _pairs(num(x), num(y), over), pairs=True, **options)


def spearman_test(x, y, alpha: float = 0.05, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """Spearman rank correlation with its t-test and Fisher interval."""
    options = dict(alpha=validate.alpha(alpha, True), alternative=validate.alternative(alternative), name="rho", label="Spearman Correlation")
    return from_lists("spearman_test", kernels.correlation, kernels.of_spearman, _pairs(*_pair(x, y), over), pairs=True, **options)


def kendall_test(x, y, alternative: str = "two-sided", *, over: WindowSpec | None = None) -> Column:
    """Kendall's tau-b with its normal test, in O(n log n)."""
    return from_lists("kendall_test", kernels.kendall, kernels.of_kendall, _pairs(*_pair(x, y), over), pairs=True, alternative=validate.alternative(alternative))


def anova_oneway(value, group, *, over: WindowSpec | None = None) -> Column:
    """One-way analysis of variance."""
    return from_lists("anova_oneway", kernels.anova_oneway, kernels.of_anova, _pairs(valid(num(value)), text(group), over), pairs=True, strings=1)


def chisq_independence(row, col, continuity: bool = False, *, over: WindowSpec | None = None) -> Column:
    """Chi-square test of independence; Yates' correction applies to 2 x 2 tables only."""
    of = partial(kernels.of_table, yates=validate.flag(continuity, "continuity"))
    return from_lists("chisq_independence", kernels.chisq_independence, of, _pairs(text(row), text(col), over), pairs=True, strings=2)


def chisq_goodness_of_fit(category, *, over: WindowSpec | None = None) -> Column:
    """Chi-square test of equal shares."""
    return from_lists("chisq_goodness_of_fit", kernels.chisq_goodness_of_fit, kernels.of_counts, _list(text(category), over), strings=1)


def anderson_darling(x, *, over: WindowSpec | None = None) -> Column:
    """Anderson-Darling test of normality, mean and variance estimated."""
    return from_lists("anderson_darling", kernels.anderson_darling, kernels.of_anderson, _list(valid(num(x)), over))


def ks_test_1samp(x, *, over: WindowSpec | None = None) -> Column:
    """Kolmogorov-Smirnov test against the fitted normal."""
    return from_lists("ks_test_1samp", kernels.ks_test_1samp, kernels.of_ks, _list(valid(num(x)), over))


def ks_test_2samp(x, y, *, over: WindowSpec | None = None) -> Column:
    """Two-sample Kolmogorov-Smirnov test of two columns."""
    return from_lists("ks_test_2samp", kernels.ks_test_2samp, kernels.of_ks2, _list(valid(num(x)), over), _list(valid(num(y)), over))


def _of_shapiro(n, x):
    found = kernels.shapiro(x) if 3 <= n <= 5000 and len(x) == n else None
    return (n, *found) if found else (n, np.nan, np.nan)


def _shapiro(n, w, p):
    return np.isnan(w), {"test_type": "Shapiro-Wilk", "w_statistic": w, "p_value": p, "n": n}


def shapiro_wilk(x, *, over: WindowSpec | None = None) -> Column:
    """Shapiro-Wilk test of normality for 3 to 5000 values; larger groups keep no more than 5001 of them."""
    v = valid(num(x))
    return from_lists("shapiro_wilk", _shapiro, _of_shapiro, _over(over)(F.count(v)), F.slice(_list(v, over), 1, 5001))


def summary_stats(x, bias_correction: bool = True, quantile_type: int = 7, *, over: WindowSpec | None = None) -> Column:
    """Descriptive statistics; NULL and NaN count as missing."""
    w, v = _over(over), valid(num(x))
    of = partial(kernels.of_summary, kind=validate.quantile_type(quantile_type))
    return from_lists("summary_stats", kernels.summary, of, _list(v, over), w(F.count(F.lit(1))), bias_correction=validate.flag(bias_correction, "bias_correction"))
