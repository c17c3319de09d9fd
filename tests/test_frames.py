"""Both forms of each rank and count statistic agree, however rows are dealt and keys are split."""

import random

import numpy as np
import pytest

from statloom.operators import aggs as A
from statloom.operators import frames as R

CASES = {
    "mann_whitney_u": ("x", "y"), "wilcoxon_signed_rank": ("x", "y"), "spearman_test": ("x", "y"), "kendall_test": ("x", "y"), "shapiro_wilk": ("x",), "anova_oneway": ("x", "g"),
    "chisq_independence": ("g", "c"), "chisq_goodness_of_fit": ("g",), "anderson_darling": ("x",), "ks_test_1samp": ("x",), "ks_test_2samp": ("x", "y"), "summary_stats": ("x",),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    some = lambda v: None if rng.random() < 0.1 else v
    data = [(rng.choice(["a", "b", None]), some(round(rng.gauss(0, 2), 1)), some(round(rng.gauss(0.3, 2), 1)), rng.choice("uvw"), rng.choice("pq")) for _ in range(300)]
    data += [("empty", None, None, None, None)] * 2
    # columns named like the inner ones of the operators
    return spark.createDataFrame([(*r, 1, 2, 3) for r in data], "k string, x double, y double, g string, c string, n int, v int, before int").cache()


def same(a, b):
    if a is None or b is None:
        return a is b
    return all(p == q or (isinstance(p, float) and (abs(p - q) <= 1e-9 * max(1, abs(p)) or (p != p and q != q))) for p, q in zip(a, b))


@pytest.mark.parametrize("name", CASES)
def test_forms_agree(rows, name):
    args, frame, column = CASES[name], getattr(R, name), getattr(A, name)
    want = {r.k: r.r for r in rows.groupBy("k").agg(column(*args).alias("r")).collect()}
    for options in ({}, {"split": True}) if "split" in frame.__wrapped__.__kwdefaults__ else ({},):
        got = {r.k: r.r for r in frame(rows.repartition(7), *args, by=["k"], **options).collect()}
        assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want), (got, want)
    assert same(frame(rows, *args).first().r, rows.agg(column(*args).alias("r")).first().r)
    empty = frame(rows.limit(0), *args).collect()
    assert len(empty) == 1 and empty[0].r is None


SQL_ARGS = {"mann_whitney_u": "x, y, 'less', true", "spearman_test": "x, y, 0.1", "chisq_independence": "g, c", "anova_oneway": "x, g", "summary_stats": "x, false, 5"}


def test_sql_takes_frames(spark, rows):
    """Plain GROUP BY statements never collect a group; others keep the aggregates; both give the same."""
    from statloom.plans.session import StatsSession

    rows.createOrReplaceTempView("framed")
    s = StatsSession(spark)
    for name, args in CASES.items():
        call = f"{name}({SQL_ARGS.get(name, ', '.join(args))})"
        fast, slow = s.sql(f"SELECT k, {call} AS r FROM framed WHERE n = 1 GROUP BY k"), s.sql(f"SELECT k, {call} AS r FROM framed WHERE n = 1 GROUP BY k ORDER BY k")
        plan = fast._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan or name in ("kendall_test", "shapiro_wilk")
        got, want = ({r.k: r.r for r in x.collect()} for x in (fast, slow))
        assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want), name
    one = s.sql("SELECT (kendall_test(x, y)).tau, (spearman_test(x, y)).p_value AS p FROM framed").first()
    assert one.tau == pytest.approx(rows.agg(A.kendall_test("x", "y").alias("r")).first().r.tau) and 0 <= one.p <= 1


@pytest.mark.parametrize("method", ["holm", "hochberg", "BH", "BY", "bonferroni", "none"])
def test_adjust_p_ranges(spark, method):
    """Adjusted columns by ranges, by groups and as lists agree, ties and missing values included."""
    from statloom.functions import kernels

    rng = random.Random(8)
    p = [(i, i % 2, rng.choice([None, float("nan"), round(rng.random() ** 3, 2)])) for i in range(400)]
    df = spark.createDataFrame(p, "i int, k int, p double").repartition(5)
    for by in ([], ["k"]):
        for split in (None, True):
            got = {r.i: r.q for r in R.adjust_p(df, "p", method, by=by, name="q", split=split).collect()}
            for group in ((0,), (1,)) if by else ((0, 1),):
                own = [(i, v) for i, k, v in p if k in group]
                want = kernels.adjust_p([v for _, v in own], method)
                assert all((w is None and got[i] is None) or abs(got[i] - w) < 1e-12 for (i, _), w in zip(own, want))


@pytest.mark.parametrize("split", [None, True])
def test_shapiro_wilk_of_any_size(spark, split):
    """Without a limit, by ranks of distinct values: as by sorted lists up to 5,000 values, and a result beyond."""
    from statloom.functions import kernels

    rng = random.Random(3)
    groups = {0: [1.0, 2.0], 1: [1.0, 2.0, 4.0], 2: [0.0, 0.0, 1.0, 1.0], 3: [5.0] * 4, 4: [1.0, 2.0, 3.0, 4.0, 9.0], 5: [7.0, 1.0, 1.0, 3.0, 8.0, 8.0]}
    groups |= {6: [round(rng.gauss(1e6, 3), 1) for _ in range(11)], 7: [rng.gauss(0, 1) for _ in range(3000)], 8: [float(round(rng.gauss(50, 9))) for _ in range(5000)], 9: [None, 1.0]}
    df = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k int, v double").repartition(3)
    got = {r.k: r.r for r in R.shapiro_wilk(df, "v", most=None, by=["k"], split=split).collect()}
    for k, own in groups.items():
        want = kernels.shapiro(np.array([v for v in own if v is not None]))
        assert (got[k] is None) == (want is None), k
        assert want is None or ((got[k].w_statistic, got[k].p_value) == pytest.approx(want, abs=1e-10) and got[k].n == len(own)), k
    # fifty copies of a sample of normal scores stay near to normal
    large = spark.createDataFrame([(v,) for v in groups[7]], "v double").crossJoin(spark.range(50))
    found = R.shapiro_wilk(large, "v", most=None).first().r
    assert found.n == 150_000 and 0.998 < found.w_statistic < 1
    assert R.shapiro_wilk(large, "v").first().r is None and R.shapiro_wilk(large, "v", most=149_999).first().r is None
