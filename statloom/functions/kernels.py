"""Finalizers: sufficient statistics of many groups in, result records out, all as numpy arrays.

Each kernel returns (null, fields): where the whole record is NULL, and the fields by name; scalars are broadcast.
``SCHEMAS`` has the record type of each statistic.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from statloom.functions import special as sp

_T = "test_type string, t_statistic double, df double, p_value double, alternative string, mean_diff double, ci_lower double, ci_upper double, cohens_d double"
SCHEMAS = {
    "ttest_1samp": _T,
    "ttest_paired": _T,
    "ttest_2samp": _T,
    "mann_whitney_u": "test_type string, u_statistic double, z_statistic double, p_value double, alternative string, rank_biserial double",
    "wilcoxon_signed_rank": "test_type string, w_statistic double, z_statistic double, p_value double, alternative string, effect_size_r double",
    "pearson_test": "test_type string, r double, t_statistic double, df double, p_value double, alternative string, ci_lower double, ci_upper double, n long",
    "spearman_test": "test_type string, rho double, t_statistic double, df double, p_value double, alternative string, ci_lower double, ci_upper double, n long",
    "kendall_test": "test_type string, tau double, z_statistic double, p_value double, alternative string, n long",
    "anova_oneway": "test_type string, f_statistic double, df_between double, df_within double, p_value double, ss_between double, ss_within double, eta_squared double, n_groups long, n long",
    "chisq_independence": "test_type string, chi_square double, df double, p_value double, n long, n_rows long, n_cols long",
    "chisq_goodness_of_fit": "test_type string, chi_square double, df double, p_value double, n long, n_categories long",
    "jarque_bera": "test_type string, jb_statistic double, skewness double, excess_kurtosis double, df double, p_value double, n long",
    "anderson_darling": "test_type string, a_squared double, a_squared_adjusted double, p_value double, n long",
    "shapiro_wilk": "test_type string, w_statistic double, p_value double, n long",
    "ks_test_1samp": "test_type string, d_statistic double, p_value double, n long",
    "ks_test_2samp": "test_type string, d_statistic double, p_value double, n_x long, n_y long",
    "sign_test_1samp": "test_type string, m_statistic double, n_pos long, n_neg long, n_zero long, p_value double, alternative string, n long",
    "summary_stats": "n long, n_missing long, mean double, sd double, variance double, min double, q1 double, median double, q3 double, max double, iqr double, skewness double, kurtosis double, mode double, mode_frequency long, is_multimodal boolean",
}
SCHEMAS["sign_test_paired"] = SCHEMAS["sign_test_1samp"]


def two_tails(upper, lower, alternative: str):
    """p-value from both tails at the statistic."""
    return {"less": lower, "greater": upper}.get(alternative, np.minimum(1.0, 2 * np.minimum(upper, lower)))


def _p_t(t, df, alternative):
    return two_tails(sp.st(t, df), sp.pt(t, df), alternative)


def _p_z(z, alternative):
    return two_tails(sp.snorm(z), sp.snorm(-z), alternative)


def _t_record(label, n_ok, diff, se, df, d, alpha, alternative):
    t = diff / se
    q = sp.qt(1 - (alpha / 2 if alternative == "two-sided" else alpha), df)  # once for each distinct df
    low = np.full(np.shape(diff), -np.inf) if alternative == "less" else diff - q * se
    high = np.full(np.shape(diff), np.inf) if alternative == "greater" else diff + q * se
    names = ("test_type", "t_statistic", "df", "p_value", "alternative", "mean_diff", "ci_lower", "ci_upper", "cohens_d")
    return ~n_ok, dict(zip(names, (label, t, df, _p_t(t, df, alternative), alternative, diff, low, high, d)))


def ttest_one(n, mean, var, *, mu=0.0, alpha=0.05, alternative="two-sided", label="One-sample"):
    sd = np.sqrt(var)
    return _t_record(label, n >= 2, mean - mu, sd / np.sqrt(n), n - 1, (mean - mu) / sd, alpha, alternative)


def ttest_2samp(n1, m1, v1, n2, m2, v2, *, equal_var=False, alpha=0.05, alternative="two-sided"):
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    a, b = v1 / n1, v2 / n2
    if equal_var:
        label, se, df = "Student Two-sample", np.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2
    else:
        label, se, df = "Welch Two-sample", np.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return _t_record(label, (n1 >= 2) & (n2 >= 2), m1 - m2, se, df, (m1 - m2) / np.sqrt(pooled), alpha, alternative)


def mann_whitney_u(n1, n2, rank_sum, ties, *, alternative="two-sided", continuity=False):
    n = n1 + n2
    u, mean = rank_sum - n1 * (n1 + 1) / 2, n1 * n2 / 2
    sigma = np.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = _z(u - mean, sigma, continuity)
    return ~((n1 >= 2) & (n2 >= 2)), {
        "test_type": "Mann-Whitney U",
        "u_statistic": u,
        "z_statistic": z,
        "p_value": _p_z(z, alternative),
        "alternative": alternative,
        "rank_biserial": 1 - 2 * u / (n1 * n2),
    }


def _z(gap, sigma, continuity):
    if continuity:
        gap = np.sign(gap) * np.maximum(np.abs(gap) - 0.5, 0)
    return np.where(sigma > 0, gap / np.where(sigma > 0, sigma, 1), np.where(np.isnan(sigma), np.nan, 0.0))


def wilcoxon_signed_rank(n, w, ties, *, alternative="two-sided", continuity=False):
    sigma = np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = _z(w - n * (n + 1) / 4, sigma, continuity)
    return ~(n >= 2), {"test_type": "Wilcoxon Signed-Rank", "w_statistic": w, "z_statistic": z, "p_value": _p_z(z, alternative), "alternative": alternative, "effect_size_r": z / np.sqrt(n)}


def correlation(n, sxx, syy, sxy, *, alpha=0.05, alternative="two-sided", name="r", label="Pearson Correlation"):
    null = ~((n >= 3) & (sxx > 0) & (syy > 0))
    r = np.clip(sxy / np.sqrt(sxx * syy), -1, 1)
    df = n - 2
    t = np.where(np.abs(r) == 1, np.copysign(np.inf, r), r * np.sqrt(df / (1 - r * r)))
    half = NormalDist().inv_cdf(1 - alpha / 2) / np.sqrt(n - 3)
    known = (n >= 4) & (np.abs(r) < 1)
    low, high = (np.where(known, np.tanh(np.arctanh(np.where(known, r, 0)) + s * half), np.nan) for s in (-1, 1))
    names = ("test_type", name, "t_statistic", "df", "p_value", "alternative", "ci_lower", "ci_upper", "n")
    return null, dict(zip(names, (label, r, t, df, _p_t(t, df, alternative), alternative, low, high, n)))


def kendall(n, s, x_only, y_only, vt, vu, t1, u1, t2, u2, *, alternative="two-sided"):
    """s: concordant less discordant pairs; x_only and y_only: n(n-1)/2 less ties in y, in x; the rest: tie sums."""
    denom = np.sqrt(x_only * y_only)
    v0 = n * (n - 1) * (2 * n + 5)
    var = (v0 - vt - vu) / 18 + t1 * u1 / (2 * n * (n - 1)) + t2 * u2 / (9 * n * (n - 1) * (n - 2))
    z = np.where(var > 0, s / np.sqrt(np.where(var > 0, var, 1)), 0)
    return ~((n >= 3) & (denom > 0)), {"test_type": "Kendall tau-b", "tau": s / denom, "z_statistic": z, "p_value": _p_z(z, alternative), "alternative": alternative, "n": n}


def anova_oneway(k, n, ssb, ssw):
    msb, msw = ssb / (k - 1), ssw / (n - k)
    f = np.where(msw > 0, msb / np.where(msw > 0, msw, 1), np.where(ssb > 0, np.inf, 0.0))
    p = np.where(msw > 0, sp.sf(np.where(msw > 0, f, 1), k - 1, n - k), np.where(ssb > 0, 0.0, 1.0))
    total = ssb + ssw
    names = ("test_type", "f_statistic", "df_between", "df_within", "p_value", "ss_between", "ss_within", "eta_squared", "n_groups", "n")
    return ~((k >= 2) & (n - k > 0)), dict(zip(names, ("One-way ANOVA", f, k - 1, n - k, p, ssb, ssw, np.where(total > 0, ssb / np.where(total > 0, total, 1), 0.0), k, n)))


def chisq_independence(chi, n, rows, cols):
    df = (rows - 1) * (cols - 1)
    return ~((rows >= 2) & (cols >= 2)), {"test_type": "Chi-square Independence", "chi_square": chi, "df": df, "p_value": sp.schisq(chi, df), "n": n, "n_rows": rows, "n_cols": cols}


def chisq_goodness_of_fit(squares, n, k):
    chi = squares * k / n - n
    return ~(k >= 2), {"test_type": "Chi-square Goodness-of-Fit (uniform)", "chi_square": chi, "df": k - 1, "p_value": sp.schisq(chi, k - 1), "n": n, "n_categories": k}


def jarque_bera(n, skew, kurt):
    jb = n / 6 * (skew**2 + kurt**2 / 4)
    return ~((n >= 4) & ~np.isnan(skew)), {"test_type": "Jarque-Bera", "jb_statistic": jb, "skewness": skew, "excess_kurtosis": kurt, "df": 2.0, "p_value": np.exp(-jb / 2), "n": n}


def anderson_p(a):
    """p by the adjusted statistic; the tail formula turns upward far out, so it ends at its value for 10."""
    exps = [
        (a < 0.2, lambda v: 1 - np.exp(-13.436 + 101.14 * v - 223.73 * v * v)),
        ((a >= 0.2) & (a < 0.34), lambda v: 1 - np.exp(-8.318 + 42.796 * v - 59.938 * v * v)),
        ((a >= 0.34) & (a < 0.6), lambda v: np.exp(0.9177 - 4.279 * v - 1.38 * v * v)),
        ((a >= 0.6) & (a < 10), lambda v: np.exp(1.2937 - 5.709 * v + 0.0186 * v * v)),
        (a >= 10, lambda v: np.full(v.shape, 3.7e-24)),
    ]
    return np.clip(np.select([c for c, _ in exps], [f(a) for _, f in exps], np.nan), 0, 1)


def log_tails(z):
    """Logs of the lower and the upper tail of the standard normal, also far out."""
    z = np.asarray(z, float)

    def lower(v):
        far = v < -30
        near = np.log(np.maximum(sp.snorm(-np.where(far, 0, v)), 1e-320))
        w = np.where(far, v, -40.0)
        return np.where(far, -w * w / 2 - np.log(-w) - math.log(2 * math.pi) / 2 + np.log1p(-1 / (w * w)), near)

    return lower(z), lower(-z)


def anderson_darling(n, sd, total):
    """total: the sum over ranks of (2i-1) ln lower + (2(n-i)+1) ln upper."""
    a = -n - total / n
    adjusted = a * (1 + 0.75 / n + 2.25 / n**2)
    return ~((n >= 8) & (sd > 0)), {"test_type": "Anderson-Darling", "a_squared": a, "a_squared_adjusted": adjusted, "p_value": anderson_p(adjusted), "n": n}


def ks_p(d, en):
    return sp.kolmogorov((np.sqrt(en) + 0.12 + 0.11 / np.sqrt(en)) * d)


def ks_test_1samp(n, sd, d):
    return ~((n >= 3) & (sd > 0)), {"test_type": "Kolmogorov-Smirnov (one-sample, fitted normal)", "d_statistic": d, "p_value": ks_p(d, n), "n": n}


def ks_test_2samp(nx, ny, d):
    return ~((nx >= 1) & (ny >= 1)), {"test_type": "Kolmogorov-Smirnov (two-sample)", "d_statistic": d, "p_value": ks_p(d, nx * ny / np.maximum(nx + ny, 1)), "n_x": nx, "n_y": ny}


def sign_test(pos, neg, zero, *, alternative="two-sided", label="Sign Test (1-sample)"):
    m = pos + neg
    upper = np.where(pos <= 0, 1.0, sp.betainc(np.maximum(pos, 1), m - pos + 1, 0.5))
    lower = np.where(pos >= m, 1.0, sp.betainc(np.maximum(m - pos, 1), pos + 1, 0.5))
    names = ("test_type", "m_statistic", "n_pos", "n_neg", "n_zero", "p_value", "alternative", "n")
    return ~(m >= 1), dict(zip(names, (label, (pos - neg) / 2, pos, neg, zero, two_tails(upper, lower, alternative), alternative, m + zero)))


def summary(n, missing, mean, m2, m3, m4, low, q1, median, q3, high, mode, frequency, modes, *, bias_correction=True):
    """m2, m3, m4: sums of powers of deviations; mode: smallest value of the highest frequency; modes: how many have it."""
    var = np.where(n >= 2, m2 / np.maximum(n - 1, 1), 0.0)
    varied = m2 > 0
    pop = np.where(varied, m2, 1) / n
    g1, g2 = m3 / n / pop**1.5, m4 / n / pop**2 - 3
    if bias_correction:
        g1 = np.sqrt(n * (n - 1)) / np.where(n > 2, n - 2, np.nan) * g1
        g2 = (n - 1) / np.where(n > 3, (n - 2) * (n - 3), np.nan) * ((n + 1) * g2 + 6)
    distinct = (n > 1) & (frequency == 1)
    return ~(n >= 1), {
        "n": n, "n_missing": missing, "mean": mean, "sd": np.sqrt(var), "variance": var, "min": low, "q1": q1, "median": median, "q3": q3, "max": high, "iqr": q3 - q1,
        "skewness": np.where((n >= 3) & varied, g1, np.nan), "kurtosis": np.where((n >= 4) & varied, g2, np.nan),
        "mode": np.where(distinct, np.nan, mode), "mode_frequency": np.where(distinct, 0, frequency), "is_multimodal": ~distinct & (modes > 1),
    }


def bin_edges(n, low, high, sd, iqr, method: str) -> list[list[float] | None]:
    out: list[list[float] | None] = []
    for n_, a, b, s, q in zip(n, low, high, sd, iqr):
        if not n_ >= 2:
            out.append(None)
            continue
        if not b > a:
            out.append([float(a), float(a)])
            continue
        n_ = float(n_)
        sturges = max(1, math.ceil(math.log2(n_) + 1))
        by_width = lambda w: max(1, math.ceil((b - a) / w)) if w > 0 else sturges  # noqa: E731, B023
        fd = by_width(2 * q * n_ ** (-1 / 3))
        k = {"sturges": sturges, "fd": fd, "scott": by_width(3.5 * s * n_ ** (-1 / 3)), "sqrt": max(1, math.ceil(math.sqrt(n_))), "rice": max(1, math.ceil(2 * n_ ** (1 / 3))), "auto": max(sturges, fd)}[method]
        out.append([float(a + j * (b - a) / k) for j in range(k)] + [float(b)])
    return out


# statistics of one group's values, the second way to what the DataFrame forms compute with windows -----------------------


def midranks(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mid-rank of each value and the sizes of groups of ties."""
    _, back, count = np.unique(v, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return ((2 * last - count + 1) / 2)[back], count


def _cubes(t: np.ndarray) -> float:
    t = t.astype(float)
    return float((t**3 - t).sum())


def of_mann_whitney(x, y):
    if np.isnan(x).any() or np.isnan(y).any():
        return len(x), len(y), np.nan, np.nan
    ranks, ties = midranks(np.concatenate([x, y]))
    return len(x), len(y), ranks[: len(x)].sum(), _cubes(ties)


def of_wilcoxon(x, y):
    d = x - y
    d = d[d != 0]
    if np.isnan(d).any():
        return len(d), np.nan, np.nan
    ranks, ties = midranks(np.abs(d))
    return len(d), ranks[d > 0].sum(), _cubes(ties)


def of_moments(x, y):
    if not len(x):
        return 0, np.nan, np.nan, np.nan
    dx, dy = x - x.mean(), y - y.mean()
    return len(x), (dx * dx).sum(), (dy * dy).sum(), (dx * dy).sum()


def of_spearman(x, y):
    return of_moments(midranks(x)[0], midranks(y)[0]) if len(x) else (0, np.nan, np.nan, np.nan)


def inversions(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j], bottom-up by merging sorted halves with searchsorted."""
    v, total, width = np.unique(v, return_inverse=True)[1].astype(np.int64), 0, 1
    n = len(v)
    span = int(v.max(initial=0)) + 1
    while width < n:
        block = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        keyed = v + block * span
        lows = keyed[left]  # sorted within blocks, blocks ascending
        right, of = keyed[~left], block[~left]
        upto = np.searchsorted(lows, right, "right")
        ends = np.searchsorted(lows, (of + 1) * span, "left")
        total += int((ends - upto).sum())
        v = np.sort(keyed) - block * span
        width *= 2
    return total


def concordance(x, y, weight, apart=None) -> float:
    """Concordant less discordant pairs of weighted points, ties in either out; with ``apart``, which rises with x, only pairs that differ in it.

    Points are gone over in the order of x, in halves as when merging: each right half's points are placed among the
    left half's y, whose weights are summed below and above.
    """
    order = np.lexsort((y, x))
    x, y, weight = x[order], y[order], weight[order]
    group = np.unique(x if apart is None else apart[order], return_inverse=True)[1]
    total, starts = 0.0, np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rank = np.unique(y, return_inverse=True)[1]
    stack = [(0, len(starts))]
    edge = np.r_[starts, len(x)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        stack += [(lo, mid), (mid, hi)]
        left, right = slice(edge[lo], edge[mid]), slice(edge[mid], edge[hi])
        at = np.argsort(rank[left], kind="stable")
        low, sums = rank[left][at], np.r_[0.0, np.cumsum(weight[left][at])]
        under, upto = sums[np.searchsorted(low, rank[right], "left")], sums[np.searchsorted(low, rank[right], "right")]
        total += float((weight[right] * (under - (sums[-1] - upto))).sum())
    return total


def of_kendall(x, y):
    n = len(x)
    if n < 2:
        return n, *[np.nan] * 9
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    t, u = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    both = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1].astype(float)
    pairs, tx, ty, txy = n * (n - 1) / 2, (t * (t - 1)).sum() / 2, (u * (u - 1)).sum() / 2, (both * (both - 1)).sum() / 2
    s = pairs - tx - ty + txy - 2 * inversions(y)
    f = lambda c: ((c * (c - 1) * (2 * c + 5)).sum(), (c * (c - 1)).sum(), (c * (c - 1) * (c - 2)).sum())
    (vt, t1, t2), (vu, u1, u2) = f(t), f(u)
    return n, s, pairs - tx, pairs - ty, vt, vu, t1, u1, t2, u2


def of_anova(v, g):
    n, k = len(v), len(set(g))
    if not n:
        return 0, 0, np.nan, np.nan
    _, back, count = np.unique(np.array(g, object).astype(str), return_inverse=True, return_counts=True)
    mean = np.bincount(back, v) / count
    return k, n, (count * (mean - v.mean()) ** 2).sum(), ((v - mean[back]) ** 2).sum()


def of_table(r, c, yates=False):
    n = len(r)
    if not n:
        return np.nan, 0, 0, 0
    a, b = (np.unique(np.array(v, object).astype(str), return_inverse=True)[1] for v in (r, c))
    cells = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(cells, (a, b), 1)
    want = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / n
    gap = np.abs(cells - want)
    if yates and cells.shape == (2, 2):
        gap = np.maximum(gap - 0.5, 0)
    return (gap**2 / want).sum(), n, *cells.shape


def of_counts(c):
    count = np.array(list(np.unique(np.array(c, object).astype(str), return_counts=True)[1]) if len(c) else [], float)
    return (count**2).sum(), len(c), len(count)


def of_anderson(x):
    n = len(x)
    sd = x.std(ddof=1) if n > 1 else 0.0
    if not sd > 0:
        return n, sd, np.nan
    i = np.arange(1, n + 1)
    low, high = log_tails((np.sort(x) - x.mean()) / sd)
    return n, sd, ((2 * i - 1) * low + (2 * (n - i) + 1) * high).sum()


def of_ks(x):
    n = len(x)
    sd = x.std(ddof=1) if n > 1 else 0.0
    if not sd > 0:
        return n, sd, np.nan
    cdf, i = sp.pnorm((np.sort(x) - x.mean()) / sd), np.arange(n)
    return n, sd, np.maximum(np.abs(cdf - i / n), np.abs(cdf - (i + 1) / n)).max()


def of_ks2(x, y):
    if not len(x) or not len(y):
        return len(x), len(y), np.nan
    v = np.union1d(x, y)
    return len(x), len(y), np.abs(np.searchsorted(np.sort(x), v, "right") / len(x) - np.searchsorted(np.sort(y), v, "right") / len(y)).max()


def quantile(v: np.ndarray, q: float, kind: int) -> float:
    """Of sorted values, linear between neighbours, types 5 and 7."""
    n = len(v)
    at = min(max(q * n + 0.5 if kind == 5 else 1 + q * (n - 1), 1.0), float(n))
    k = int(at)
    return float(v[k - 1] + (at - k) * (v[min(k, n - 1)] - v[k - 1]))


def of_summary(x, rows, kind=7):
    """x: values without NULL and NaN; rows: how many there were."""
    n = len(x)
    if not n:
        return 0, rows, *[np.nan] * 12
    x = np.sort(x)
    d = x - x.mean()
    v, count = np.unique(x, return_counts=True)
    top = count.max()
    return n, rows - n, x.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum(), x[0], *(quantile(x, q, kind) for q in (0.25, 0.5, 0.75)), x[-1], v[count.argmax()], top, (count == top).sum()


_ROYSTON = {  # polynomials, highest power first
    "last": (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0),
    "next": (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0),
    "mean_small": (-6.714e-4, 0.025054, -0.39978, 0.544),
    "sd_small": (-0.0020322, 0.062767, -0.77857, 1.3822),
    "mean_large": (0.0038915, -0.083751, -0.31082, -1.5861),
    "sd_large": (0.0030302, -0.082676, -0.4803),
    "gamma": (0.459, -2.273),
}


def _shapiro_weights(n: int, squares: float) -> tuple[float, float, float]:
    """Of the largest value and the next (0: its normal score counts), and the divisor of the scores of the others."""
    m1, m2 = sp.qnorm((np.array([n, n - 1]) - 0.375) / (n + 0.25))
    u = 1 / math.sqrt(n)
    last = np.polyval(_ROYSTON["last"], u) + m1 / math.sqrt(squares)
    if n <= 5:
        return last, 0.0, math.sqrt((squares - 2 * m1**2) / (1 - 2 * last**2))
    second = np.polyval(_ROYSTON["next"], u) + m2 / math.sqrt(squares)
    return last, second, math.sqrt((squares - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * second**2))


def _shapiro_p(w: float, n: int) -> float:
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = np.polyval(_ROYSTON["gamma"], n)
        if y >= gamma:
            return 1e-19
        y, mu, sigma = -math.log(gamma - y), np.polyval(_ROYSTON["mean_small"], n), math.exp(np.polyval(_ROYSTON["sd_small"], n))
    else:
        mu, sigma = np.polyval(_ROYSTON["mean_large"], math.log(n)), math.exp(np.polyval(_ROYSTON["sd_large"], math.log(n)))
    return float(sp.snorm((y - mu) / sigma))


def _shapiro_three(gap: float, ss: float) -> tuple[float, float]:
    w = min(1.0, max(0.75, gap**2 / 2 / ss))
    return w, min(1.0, max(0.0, 1 - 6 / math.pi * math.acos(math.sqrt(w))))


def shapiro(x: np.ndarray) -> tuple[float, float] | None:
    """W and p by Royston's algorithm AS R94; None outside 3 <= n <= 5000."""
    n = len(x)
    if not 3 <= n <= 5000:
        return None
    x = np.sort(x)
    if x[0] == x[-1]:
        return 1.0, 1.0
    ss = ((x - x.mean()) ** 2).sum()
    if n == 3:
        return _shapiro_three(x[2] - x[0], ss)
    m = sp.qnorm((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    last, second, divisor = _shapiro_weights(n, (m * m).sum())
    a = m / divisor
    if second:
        a[-2], a[1] = second, -second
    a[-1], a[0] = last, -last
    w = min(1.0, max(0.0, float((a * x).sum() ** 2 / ss)))
    return w, _shapiro_p(w, n)


def score_sums(before: np.ndarray, count: np.ndarray, n: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the normal scores, and of their squares, of the ``count`` ranks behind ``before``, for each value."""
    ends = np.cumsum(count)
    sums, squares = np.zeros(len(n)), np.zeros(len(n))
    for start in range(0, int(ends[-1]) if len(n) else 0, step):
        i = np.arange(start, min(start + step, int(ends[-1])))
        at = np.searchsorted(ends, i, side="right")
        m = sp.qnorm((i - (ends - count - before)[at] + 0.625) / (n[at] + 0.25))
        sums += np.bincount(at, m, len(n))
        squares += np.bincount(at, m * m, len(n))
    return sums, squares


def shapiro_sums(n, squares, product, ss, low, low2, high2, high):
    """shapiro() from sums over a group's values of any number: of scores squared, scores times values, squares from the mean; and the values at both ends."""
    w, p = np.full(len(n), np.nan), np.full(len(n), np.nan)
    for k in np.flatnonzero(n >= 3):
        if low[k] == high[k]:
            w[k] = p[k] = 1.0
        elif n[k] == 3:
            w[k], p[k] = _shapiro_three(high[k] - low[k], ss[k])
        else:
            last, second, divisor = _shapiro_weights(int(n[k]), squares[k])
            m1, m2 = sp.qnorm((np.array([n[k], n[k] - 1]) - 0.375) / (n[k] + 0.25))
            total = product[k] / divisor + (last - m1 / divisor) * (high[k] - low[k])
            if second:
                total += (second - m2 / divisor) * (high2[k] - low2[k])
            w[k] = min(1.0, max(0.0, total**2 / ss[k]))
            p[k] = _shapiro_p(w[k], int(n[k]))
    return np.isnan(w), {"test_type": "Shapiro-Wilk", "w_statistic": w, "p_value": p, "n": n}


def adjust_p(p: list, method: str) -> list:
    """Adjusted p-values in the order of the input; NULL and NaN stay NULL and do not count."""
    at = [i for i, v in enumerate(p) if v is not None and v == v]
    v = np.array([p[i] for i in at], float)
    n = len(v)
    out: list = [None] * len(p)
    if not n:
        return out
    order = np.argsort(v, kind="stable")
    s, i = v[order], np.arange(n)
    falling = lambda q: np.minimum.accumulate(q[::-1])[::-1]
    done = {
        "none": lambda: s,
        "bonferroni": lambda: s * n,
        "holm": lambda: np.maximum.accumulate(s * (n - i)),
        "hochberg": lambda: falling(s * (n - i)),
        "BH": lambda: falling(s * n / (i + 1)),
        "BY": lambda: falling(s * n / (i + 1) * (1 / (i + 1)).sum()),
    }["BH" if method == "fdr" else method]()
    for k, q in zip(order.tolist(), np.minimum(done, 1).tolist()):
        out[at[k]] = q
    return out


def poibin_cdf(p: list, k: int) -> float | None:
    """P(at most k successes) of independent trials with probabilities p."""
    if any(v is None or not 0 <= v <= 1 for v in p):
        return None
    if k < 0:
        return 0.0
    if k >= len(p):
        return 1.0
    mass = np.ones(1)
    for v in p:
        mass = np.convolve(mass, [1 - v, v])
    return float(min(1.0, mass[: k + 1].sum()))
