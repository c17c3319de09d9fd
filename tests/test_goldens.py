"""Published values of the statistics on small samples."""

import math

import pytest
from pyspark.sql import functions as F

from statloom.functions import kernels, special
from statloom.functions import scalars as S
from statloom.operators import aggs as A
from statloom.operators import frames as R

SLEEP = [(0.7, 1.9), (-1.6, 0.8), (-0.2, 1.1), (-1.2, 0.1), (-0.1, -0.1), (3.4, 4.4), (3.7, 5.5), (0.8, 1.6), (0.0, 4.6), (2.0, 3.4)]


def xy(spark, rows):
    return spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b)) for a, b in rows], "x double, y double")


def one(spark, rows, column):
    return xy(spark, rows).agg(column.alias("r")).first().r


def col(spark, values, column):
    return one(spark, [(v, None) for v in values], column)


def near(value, want, places=4):
    assert value == pytest.approx(want, abs=0.51 * 10**-places), (value, want)


def test_one_sample_t(spark):
    r = col(spark, [2, 4, 6, 8, 10], A.ttest_1samp("x"))
    for f, want in dict(t_statistic=4.2426, df=4, p_value=0.0132, mean_diff=6, ci_lower=2.0735, ci_upper=9.9265, cohens_d=1.8974).items():
        near(r[f], want)
    assert (r.test_type, r.alternative) == ("One-sample", "two-sided")
    near(col(spark, [2, 4, 6, 8, 10], A.ttest_1samp("x", 5.0)).p_value, 0.5185)
    near(col(spark, [2, 4, 6, 8, 10], A.ttest_1samp("x", 0.0, 0.01)).ci_lower, -0.5112)
    greater = col(spark, [2, 4, 6, 8, 10], A.ttest_1samp("x", 0.0, 0.05, "greater"))
    near(greater.p_value, 0.0066)
    assert greater.ci_upper == math.inf
    near(col(spark, [2, 4, 6, 8, 10], A.ttest_1samp("x", alternative="less")).p_value, 0.9934)
    assert col(spark, [1], A.ttest_1samp("x")) is None
    assert math.isnan(col(spark, [1, 2, math.nan], A.ttest_1samp("x")).t_statistic)
    # a tail too small for one minus the other side
    assert 0 < col(spark, [50 + i % 2 for i in range(60)], A.ttest_1samp("x")).p_value < 1e-100


def test_two_sample_and_paired_t(spark):
    rows = [(1, 3), (2, 4), (3, 5), (4, 6), (5, 7)]
    r = one(spark, rows, A.ttest_2samp("x", "y"))
    for f, want in dict(t_statistic=-2, df=8, p_value=0.0805, ci_lower=-4.306, ci_upper=0.306, cohens_d=-1.2649).items():
        near(r[f], want)
    assert r.test_type == "Welch Two-sample"
    assert one(spark, rows, A.ttest_2samp("x", "y", True)).test_type == "Student Two-sample"
    near(one(spark, [(1, 10), (2, 20), (3, 30), (None, 40)], A.ttest_2samp("x", "y")).df, 3.0479)
    r = one(spark, SLEEP, A.ttest_paired("x", "y"))
    for f, want in dict(t_statistic=-4.0621, df=9, ci_lower=-2.4599, ci_upper=-0.7001, cohens_d=-1.2846).items():
        near(r[f], want)
    near(r.p_value, 0.002833, 6)


def test_ranks_and_signs(spark):
    r = one(spark, SLEEP, A.wilcoxon_signed_rank("x", "y"))
    near(r.z_statistic, -2.6679), near(r.p_value, 0.0076)
    near(one(spark, SLEEP, A.wilcoxon_signed_rank("x", "y", continuity=True)).p_value, 0.0091)
    assert one(spark, [(3, 0), (-1, 0), (2, 0)], A.wilcoxon_signed_rank("x", "y")).w_statistic == 5
    r = one(spark, SLEEP, A.sign_test_paired("x", "y"))
    assert (r.m_statistic, r.n_pos, r.n_neg, r.n_zero, r.n) == (-4.5, 0, 9, 1, 10)
    near(r.p_value, 0.0039)
    apart = [(i, i + 5) for i in range(1, 6)]
    r = one(spark, apart, A.mann_whitney_u("x", "y"))
    assert (r.u_statistic, r.rank_biserial) == (0, 1)
    near(r.z_statistic, -2.6112), near(r.p_value, 0.009)
    near(one(spark, apart, A.mann_whitney_u("x", "y", "less")).p_value, 0.0045)
    near(one(spark, apart, A.mann_whitney_u("x", "y", continuity=True)).p_value, 0.0122)
    assert one(spark, [(i, i + 2) for i in range(1, 6)], A.mann_whitney_u("x", "y")).u_statistic == 4.5


def test_correlation(spark):
    tied = [(1, 1), (2, 2), (2, 3), (3, 4), (4, 5)]
    r = one(spark, tied, A.spearman_test("x", "y"))
    near(r.rho, 0.9747), near(r.t_statistic, 7.5498), near(r.p_value, 0.0048)
    near(one(spark, tied, A.kendall_test("x", "y")).tau, 0.9487)
    near(one(spark, [(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)], A.kendall_test("x", "y")).tau, 0.6)
    assert one(spark, [(i, 2 * i) for i in range(4)], A.pearson_test("x", "y")).t_statistic == math.inf
    assert one(spark, [(1, i) for i in range(4)], A.pearson_test("x", "y")) is None


def test_normality(spark):
    r = col(spark, [1.5, -1.5, 1, -1, 0.5, -0.5, 0, 0, 0.3, -0.3, 0.7, -0.7], A.jarque_bera("x"))
    near(r.jb_statistic, 0.247), near(r.excess_kurtosis, -0.7029), near(r.p_value, 0.8838)
    r = col(spark, range(1, 11), A.anderson_darling("x"))
    near(r.a_squared, 0.1411), near(r.a_squared_adjusted, 0.1549), near(r.p_value, 0.9567)
    for values, w, p in (([0, 0, 1, 1], 0.72863, 0.0239), (range(1, 6), 0.98676, 0.9672), (range(1, 21), 0.96038, 0.5514), ([0, 1, 2], 1, 1), ([0, 0, 1], 0.75, 0), ([5] * 4, 1, 1)):
        r = col(spark, values, A.shapiro_wilk("x"))
        near(r.w_statistic, w), near(r.p_value, p)
    r = col(spark, range(1, 21), A.ks_test_1samp("x"))
    near(r.d_statistic, 0.076564, 6), near(r.p_value, 0.999635, 6)
    r = one(spark, [(i, i + 2) for i in range(1, 11)], A.ks_test_2samp("x", "y"))
    near(r.d_statistic, 0.2), near(r.p_value, 0.974789)
    # far from normal: the tail formula must not turn
    far = xy(spark, [(float(i < 3) * 1e6, None) for i in range(4000)])
    assert R.anderson_darling(far, "x").first().r.p_value < 1e-20
    assert R.shapiro_wilk(spark.range(5001).select(F.col("id").alias("x")), "x").first().r is None


def test_groups(spark):
    rows = [(v, g) for g, own in (("1", range(2, 7)), ("2", range(10, 15)), ("3", range(20, 25))) for v in own]
    d = spark.createDataFrame([(float(v), g) for v, g in rows], "v double, g string")
    r = R.anova_oneway(d, "v", "g").first().r
    near(r.f_statistic, 162.6667), near(r.eta_squared, 0.9644), near(r.ss_within, 30)
    table = [("a", "p", 30), ("a", "q", 10), ("b", "p", 15), ("b", "q", 25)]
    d = spark.createDataFrame([(a, b) for a, b, n in table for _ in range(n)], "r string, c string")
    near(R.chisq_independence(d, "r", "c").first().r.chi_square, 11.4286), near(R.chisq_independence(d, "r", "c", True).first().r.chi_square, 9.9556)
    d = spark.createDataFrame([(c,) for c, n in zip("ABCD", (40, 30, 20, 10)) for _ in range(n)], "c string")
    near(R.chisq_goodness_of_fit(d, "c").first().r.chi_square, 20), near(R.chisq_goodness_of_fit(d, "c").first().r.p_value, 0.0002)


def test_summary_and_bins(spark):
    r = col(spark, [1, 2, 3, 4], A.summary_stats("x"))
    assert (r.q1, r.q3, r.n_missing, r.mode_frequency) == (1.75, 3.25, 0, 0) and math.isnan(r["mode"])
    r = col(spark, [1, 2, 3, 4], A.summary_stats("x", False, 5))
    assert (r.q1, r.q3) == (1.5, 3.5)
    near(r.kurtosis, -1.36)
    r = one(spark, [(1, 1), (1, 1), (2, 1), (2, 1), (math.nan, 1), (None, 1)], A.summary_stats("x"))
    assert (r.n, r.n_missing, r["mode"], r.mode_frequency, r.is_multimodal) == (4, 2, 1, 2, True)
    counts = dict(sturges=7, fd=4, scott=4, sqrt=6, rice=7, auto=7)
    for method, k in counts.items():
        assert len(col(spark, range(1, 21), A.bin_edges("x", method))) == k or len(col(spark, range(1, 21), A.bin_edges("x", method))) == k + 1
    assert col(spark, [3, 3], A.bin_edges("x")) == [3, 3] and col(spark, [3], A.bin_edges("x")) is None
    labels = spark.createDataFrame([(1.0,), (4.8,), (20.0,), (21.0,), (math.nan,)], "x double").select(S.bin_label("x", F.array(*map(F.lit, (1.0, 4.8, 16.2, 20.0)))).alias("b"))
    assert [r.b for r in labels.collect()] == ["[1, 4.8)", "[4.8, 16.2)", "[16.2, 20]", None, None]


def test_distributions():
    for value, want in (
        (special.dnorm(0), 0.39894228), (special.qt(0.975, 5), 2.5706), (special.qchisq(0.95, 3), 7.8147), (special.qf(0.95, 2, 10), 4.1028),
        (special.qgamma(0.5, 3), 2.674060), (special.qbeta(0.5, 2, 5), 0.264450), (special.qexp(0.5), 0.693147),
    ):
        near(float(value), want)
    assert math.isnan(special.pnorm(0, 0, -1)) and special.qnorm(0) == -math.inf and math.isnan(special.qnorm(1.5))
    near(float(special.betainc(3e5, 3e5, 0.5)), 0.5, 9), near(float(special.gammainc(5e4, 5e4)[0]), 0.500595, 6)
    assert special.dchisq(0, 1) == math.inf and special.dchisq(0, 2) == 0.5 and special.dbeta(1, 2, 1) == 2


def test_adjusted_p_and_poisson_binomial():
    p8 = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    assert [round(v, 4) for v in kernels.adjust_p(p8, "holm")] == [0.008, 0.056] + [0.234] * 6
    assert [round(v, 4) for v in kernels.adjust_p(p8, "hochberg")] == [0.008, 0.056] + [0.148] * 5 + [0.205]
    assert [round(v, 4) for v in kernels.adjust_p(p8, "BH")] == [0.008, 0.032, 0.0672, 0.0672, 0.0672, 0.08, 0.0846, 0.205]
    assert kernels.adjust_p([0.5, None, math.nan], "bonferroni") == [0.5, None, None]
    near(kernels.poibin_cdf([0.1, 0.2, 0.3, 0.4, 0.5], 2), 0.85, 2), near(kernels.poibin_cdf([0.3] * 4, 1), 0.6517)
    assert kernels.poibin_cdf([0.5, 2.0], -1) is None and kernels.poibin_cdf([], 0) == 1.0


@pytest.mark.parametrize(
    "make, text",
    [
        (lambda: A.ttest_1samp("x", alpha=1.5), "alpha must be between 0 and 1"),
        (lambda: A.pearson_test("x", "y", alpha=0.0), r"alpha must be in the open interval \(0, 1\)"),
        (lambda: A.mann_whitney_u("x", "y", "both"), "alternative must be 'two-sided', 'less', or 'greater'"),
        (lambda: A.mann_whitney_u("x", "y", continuity=1), "continuity must be a constant boolean"),
        (lambda: A.summary_stats("x", quantile_type=6), "quantile_type must be 5"),
        (lambda: A.bin_edges("x", "best"), "unknown method"),
        (lambda: A.bin_edges("x", None), "'method' must not be NULL"),
        (lambda: S.adjust_p("p", "bh"), "unknown method"),
    ],
)
def test_messages(spark, make, text):
    with pytest.raises((ValueError, TypeError), match=text):
        make()
