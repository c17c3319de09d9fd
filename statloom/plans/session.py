"""A SQL front end: statistics, table functions, file names as tables, COPY TO and VISUALIZE in one ``sql()``.

Statements are rewritten into plain Spark SQL and handed to the session. Statistics become built-in aggregates below a
registered finalizer; their optional parameters are constants. Table functions and files become temporary views.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import partial
from itertools import count
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import kernels, scalars, validate
from statloom.functions.finalize import list_udf, moment_udf
from statloom.operators import aggs, frames
from statloom.operators.corr_matrix import corr_matrix
from statloom.operators.table_one import table_one
from statloom.plans import chart
from statloom.sources.model import FORMATS
from statloom.sources.statfile import read_stat, read_stat_metadata, write_stat

_NUMBER = count()
_READY: WeakSet[SparkSession] = WeakSet()  # sessions that have the functions
_D = "CAST({} AS DOUBLE)".format
_S = "CAST({} AS STRING)".format


def _ok(x: str) -> str:
    return f"nullif({_D(x)}, double('NaN'))"


def _alt(v) -> str:
    return validate.alternative(v)


def _whole(x: str, y: str) -> tuple[str, str]:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"


def _list(x: str) -> str:
    return f"collect_list({x})"


def _pairs(x: str, y: str) -> str:
    return f"collect_list(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN named_struct('x', {x}, 'y', {y}) END)"


def _moments(x: str) -> list[str]:
    return [f"count({x})", f"avg({x})", f"var_samp({x})"]


def _signs(d: str) -> list[str]:
    return [f"count_if({d} {op} 0)" for op in (">", "<", "=")]


# name: (columns, (parameter, default, check) ..., build): build gets the columns' texts and the checked parameters by
# name, and returns the aggregates' texts and the finalizer
def _ttest(record: str, kernel: Callable, aggregates: Callable, **fixed):
    return lambda *x, **o: (aggregates(*x), moment_udf(record, kernel, **fixed, **o))


def _pearson(x, y, **o):
    a, b = _whole(_ok(x), _ok(y))
    return [f"count({a})", *(f"regr_{s}({b}, {a})" for s in ("sxx", "syy", "sxy"))], moment_udf("pearson_test", kernels.correlation, **o)


def _lists(record: str, kernel: Callable, of: Callable, aggregates: Callable, **fixed):
    return lambda *x, **o: (aggregates(*x), list_udf(record, kernel, of, **fixed, **o))


_MU, _ALPHA, _ALT = ("mu", 0.0, partial(validate.number, name="mu")), ("alpha", 0.05, validate.alpha), ("alternative", "two-sided", _alt)
_OPEN, _CC = ("alpha", 0.05, partial(validate.alpha, interval=True)), ("continuity", False, partial(validate.flag, name="continuity"))
STATISTICS: dict[str, tuple] = {
    "ttest_1samp": (1, (_MU, _ALPHA, _ALT), _ttest("ttest_1samp", kernels.ttest_one, lambda x: _moments(_D(x)))),
    "ttest_paired": (2, (_ALPHA, _ALT), _ttest("ttest_paired", kernels.ttest_one, lambda x, y: _moments(f"({_D(x)} - {_D(y)})"), label="Paired")),
    "ttest_2samp": (2, (("equal_var", False, partial(validate.flag, name="equal_var")), _ALPHA, _ALT), _ttest("ttest_2samp", kernels.ttest_2samp, lambda x, y: _moments(_D(x)) + _moments(_D(y)))),
    "mann_whitney_u": (2, (_ALT, _CC), _lists("mann_whitney_u", kernels.mann_whitney_u, kernels.of_mann_whitney, lambda x, y: [_list(_D(x)), _list(_D(y))])),
    "wilcoxon_signed_rank": (2, (_ALT, _CC), _lists("wilcoxon_signed_rank", kernels.wilcoxon_signed_rank, kernels.of_wilcoxon, lambda x, y: [_pairs(_D(x), _D(y))], pairs=True)),
    "pearson_test": (2, (_OPEN, _ALT), _pearson),
    "spearman_test": (2, (_OPEN, _ALT), lambda x, y, **o: ([_pairs(_ok(x), _ok(y))], list_udf("spearman_test", partial(kernels.correlation, name="rho", label="Spearman Correlation"), kernels.of_spearman, pairs=True, **o))),
    "kendall_test": (2, (_ALT,), _lists("kendall_test", kernels.kendall, kernels.of_kendall, lambda x, y: [_pairs(_ok(x), _ok(y))], pairs=True)),
    "anova_oneway": (2, (), _lists("anova_oneway", kernels.anova_oneway, kernels.of_anova, lambda x, g: [_pairs(_ok(x), _S(g))], pairs=True, strings=1)),
    "chisq_independence": (2, (_CC,), lambda r, c, continuity: ([_pairs(_S(r), _S(c))], list_udf("chisq_independence", kernels.chisq_independence, partial(kernels.of_table, yates=continuity), pairs=True, strings=2))),
    "chisq_goodness_of_fit": (1, (), _lists("chisq_goodness_of_fit", kernels.chisq_goodness_of_fit, kernels.of_counts, lambda c: [_list(_S(c))], strings=1)),
    "jarque_bera": (1, (), lambda x: ([f"count({_ok(x)})", f"skewness({_ok(x)})", f"kurtosis({_ok(x)})"], moment_udf("jarque_bera", kernels.jarque_bera))),
    "shapiro_wilk": (1, (), _lists("shapiro_wilk", aggs._shapiro, aggs._of_shapiro, lambda x: [f"count({_ok(x)})", f"slice({{}}, 1, 5001)|{_list(_ok(x))}"])),
    "anderson_darling": (1, (), _lists("anderson_darling", kernels.anderson_darling, kernels.of_anderson, lambda x: [_list(_ok(x))])),
    "ks_test_1samp": (1, (), _lists("ks_test_1samp", kernels.ks_test_1samp, kernels.of_ks, lambda x: [_list(_ok(x))])),
    "ks_test_2samp": (2, (), _lists("ks_test_2samp", kernels.ks_test_2samp, kernels.of_ks2, lambda x, y: [_list(_ok(x)), _list(_ok(y))])),
    "sign_test_1samp": (1, (_MU, _ALT), lambda x, mu, alternative: (_signs(f"({_ok(x)} - {mu!r}D)"), moment_udf("sign_test_1samp", kernels.sign_test, alternative=alternative))),
    "sign_test_paired": (2, (_ALT,), lambda x, y, **o: (_signs(f"({_ok(x)} - {_ok(y)})"), moment_udf("sign_test_paired", kernels.sign_test, label="Sign Test (paired)", **o))),
    "summary_stats": (
        1,
        (("bias_correction", True, partial(validate.flag, name="bias_correction")), ("quantile_type", 7, validate.quantile_type)),
        lambda x, bias_correction, quantile_type: ([_list(_ok(x)), "count(1)"], list_udf("summary_stats", kernels.summary, partial(kernels.of_summary, kind=quantile_type), bias_correction=bias_correction)),
    ),
    "bin_edges": (1, (("method", "sturges", validate.bin_method),), lambda x, method: ([f"count({_ok(x)})", f"min({_ok(x)})", f"max({_ok(x)})", f"stddev_samp({_ok(x)})", f"({{0}})[1] - ({{0}})[0]|percentile({_ok(x)}, array(0.25D, 0.75D))"], aggs.edges_udf(method))),
}


#: statistics whose aggregate form collects a group's values: plain GROUP BY statements take the form that no group is too large for
FRAMES = {
    name: getattr(frames, name)
    for name in ("mann_whitney_u", "wilcoxon_signed_rank", "spearman_test", "kendall_test", "anova_oneway", "chisq_independence", "chisq_goodness_of_fit", "shapiro_wilk", "anderson_darling", "ks_test_1samp", "ks_test_2samp", "summary_stats")
}


# -- reading SQL text ---------------------------------------------------------------------------------------------------

_SKIP = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_CALL = re.compile(r"[A-Za-z_]\w*(?=\s*\()")


def close_of(sql: str, open_: int) -> int:
    """Place of the parenthesis that closes the one at ``open_``."""
    depth, k = 0, open_
    while k < len(sql):
        if m := _SKIP.match(sql, k):
            k = m.end()
            continue
        depth += (sql[k] in "([") - (sql[k] in ")]")
        if depth == 0:
            return k
        k += 1
    raise ValueError("Unbalanced parentheses in input")


def arguments(text: str) -> list[str]:
    """The arguments of a call, cut at its own commas."""
    out, depth, start, k = [], 0, 0, 0
    while k < len(text):
        if m := _SKIP.match(text, k):
            k = m.end()
            continue
        depth += (text[k] in "([") - (text[k] in ")]")
        if text[k] == "," and depth == 0:
            out.append(text[start:k].strip())
            start = k + 1
        k += 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


def constant(text: str):
    """A literal as a Python value."""
    t = text.strip()
    low = t.lower()
    if low in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[low]
    if t[:1] == "[" and t[-1:] == "]" or low.startswith("array(") and t[-1:] == ")":
        return [constant(x) for x in arguments(t[t.index("[" if t[0] == "[" else "(") + 1 : -1])]
    if len(t) >= 2 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    try:
        v = ast.literal_eval(t.rstrip("dD") if re.fullmatch(r"[-+]?[\d.eE+-]+[dD]", t) else t)
    except (ValueError, SyntaxError):
        raise TypeError(f"Parameter must be a constant value: {t}") from None
    if isinstance(v, (int, float)):
        return v
    raise TypeError(f"Parameter must be a constant value: {t}")


def clauses(sql: str) -> dict[str, str] | None:
    """select, from (all up to GROUP BY) and group of ``SELECT ... FROM ... [GROUP BY ...]``; None for any other statement."""
    marks, depth, k = [], 0, 0
    while k < len(sql):
        if m := _SKIP.match(sql, k):
            k = m.end()
            continue
        depth += (sql[k] in "([") - (sql[k] in ")]")
        m = _CLAUSE.match(sql, k) if depth == 0 and (k == 0 or not (sql[k - 1].isalnum() or sql[k - 1] in "_.`")) else None
        if m:
            marks.append((re.sub(r"\s+", " ", m[0].lower()), m.start(), m.end()))
            k = m.end()
        else:
            k += 1
    names = [n for n, *_ in marks]
    if names not in (["select", "from"], ["select", "from", "group by"]) or marks[0][1]:
        return None
    cut = [sql[e : b] for (_, _, e), (_, b, _) in zip(marks, [*marks[1:], ("", len(sql), 0)])]
    return {"select": cut[0].strip(), "from": cut[1].strip(), "group": cut[2].strip() if len(cut) > 2 else ""}


_CLAUSE = re.compile(r"(?:with|select|from|group\s+by|having|order\s+by|sort\s+by|cluster\s+by|distribute\s+by|limit|offset|window|union|intersect|except|lateral)\b", re.I)


class StatsSession:
    """``StatsSession(spark).sql(statement)``; the session's catalog and tables stay the session's."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if spark in _READY:
            return
        _READY.add(spark)
        scalars.register(spark)
        for mark in chart.MARKS.values():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ggsql_mark_v1_{mark.name}() RETURNS STRING RETURN '{mark.describe()}'")

    def sql(self, statement: str) -> DataFrame:
        if (text := chart.claimed(statement)) is not None:
            return chart.visualize(self.spark, text)
        text = statement.strip().rstrip(";")
        if m := re.match(r"copy\s+(\(|[\w.`]+)", text, re.I):
            return self._copy(text, m)
        framed = self._framed(text)
        return self.spark.sql(self.expand(text)) if framed is None else framed

    def _framed(self, text: str) -> DataFrame | None:
        """The statement by functions of ``frames``, where it selects keys and statistics of which one would collect its groups."""
        parts = clauses(text)
        if parts is None or re.match(r"distinct\b|all\b", parts["select"], re.I):
            return None
        keys = arguments(parts["group"]) if parts["group"] else []
        plain = lambda x: re.sub(r"\s+", " ", x).strip().lower()
        items, asked = [], {}
        for item in arguments(parts["select"]):
            m = re.fullmatch(r"(.*?)(?:\s+as\s+(`[^`]+`|\w+))?", item, re.I | re.S)
            body, name = m[1].strip(), (m[2] or "").strip("`")
            if plain(body) in map(plain, keys):
                items.append((f"__k{[plain(k) for k in keys].index(plain(body))}", name or body.split(".")[-1].strip("`")))
                continue
            call = re.fullmatch(r"\(?\s*(\w+)\s*\((.*)\)\s*(\)\s*\.\s*(\w+|\*))?", body, re.S)
            if not call or call[1].lower() not in STATISTICS or (call[3] is None) != (body[0] != "(") or call[4] == "*" or close_of(f"({call[2]})", 0) != len(call[2]) + 1:
                return None
            key = (call[1].lower(), tuple(arguments(call[2])))
            asked.setdefault(key, f"__r{len(asked)}")
            items.append((asked[key] + (f".{call[4]}" if call[4] else ""), name or call[4] or call[1].lower()))
        if any(re.fullmatch(r"\d+", k) for k in keys) or not any(name in FRAMES for name, _ in asked) or not all(name in FRAMES for name, _ in asked):
            return None
        columns, jobs = [f"{self.expand(k)} AS __k{i}" for i, k in enumerate(keys)], []
        for (name, args), made in asked.items():
            wide, params, _ = STATISTICS[name]
            if not wide <= len(args) <= wide + len(params):
                raise TypeError(f"{name} takes {wide} to {wide + len(params)} arguments")
            options = {key: check(constant(args[wide + i])) if wide + i < len(args) else check(default) for i, (key, default, check) in enumerate(params)}
            columns += [f"{self.expand(a)} AS {made}_{i}" for i, a in enumerate(args[:wide])]
            jobs.append((FRAMES[name], [f"{made}_{i}" for i in range(wide)], options, made))
        rows, by = self.spark.sql(f"SELECT {', '.join(columns)} FROM {self.expand(parts['from'])}"), [f"__k{i}" for i in range(len(keys))]
        out = None
        for f, cols, options, made in jobs:
            one = f(rows, *cols, **options, by=by).withColumnRenamed("r", made)
            out = one if out is None else frames._match(out, one, by)
        return out.select(*[F.col(c).alias(n) for c, n in items])

    def layers(self, statement: str) -> dict[str, DataFrame]:
        """The data of each layer of a VISUALIZE statement; statistics and table functions work in it too."""
        _, sqls = chart.compile_chart(chart.parse(chart.claimed(statement) or statement))
        return {name: self.sql(sql) for name, sql in sqls.items()}

    def _view(self, df: DataFrame) -> str:
        name = f"statloom_view_{next(_NUMBER)}"
        df.createOrReplaceTempView(name)
        return name

    def _copy(self, text: str, m: re.Match) -> DataFrame:
        if m[1] == "(":
            end = close_of(text, m.start(1))
            df, rest = self.spark.sql(self.expand(text[m.end(1) : end])), text[end + 1 :]
        else:
            df, rest = self.spark.table(m[1]), text[m.end(1) :]
        to = re.fullmatch(r"\s*to\s+'((?:[^']|'')*)'\s*(?:\((.*)\))?\s*", rest, re.I | re.S)
        if not to:
            raise ValueError("Expected TO '<path>' (<options>) in COPY")
        options = {}
        for part in arguments(to[2] or ""):
            key, _, value = part.partition(" ")
            options[key.lower()] = constant(value) if re.match(r"\s*['\d]", value) else value.strip().lower()
        path = to[1].replace("''", "'")
        n = df.count()
        write_stat(df, path, options.pop("format", None), **options)
        return self.spark.createDataFrame([(n,)], "Count long")

    def expand(self, sql: str) -> str:
        """The statement in plain Spark SQL."""
        out, k = "", 0
        while k < len(sql):
            if m := _SKIP.match(sql, k):
                file = re.fullmatch(rf"'([^']+\.(?:{'|'.join(FORMATS)}))'", m[0], re.I)
                if file and re.search(r"\b(?:from|join)\s*$", out, re.I):
                    out += self._view(read_stat(self.spark, file[1]))
                else:
                    out += m[0]
                k = m.end()
            elif (m := _CALL.match(sql, k)) and not re.search(r"[\w.`]$", out):
                open_ = sql.index("(", m.end())
                close = close_of(sql, open_)
                name, args = m[0].lower(), sql[open_ + 1 : close]
                k = close + 1
                if name in STATISTICS:
                    over = re.match(r"\s*over\s*(\(|\w+)", sql[k:], re.I)
                    frame = ""
                    if over:
                        stop = close_of(sql, k + over.start(1)) + 1 if over[1] == "(" else k + over.end(1)
                        frame, k = " " + sql[k:stop].strip(), stop
                    out += self._statistic(name, [self.expand(a) for a in arguments(args)], frame)
                elif name in ("table_one", "corr_matrix", "read_stat", "read_stat_metadata"):
                    out += self._view(self._table(name, arguments(args)))
                else:
                    out, k = out + m[0], m.end()
            elif sql[k] == "[" and not re.search(r"[\w)\]`]\s*$", out):
                close = close_of(sql, k)
                out += f"array({self.expand(sql[k + 1 : close])})"
                k = close + 1
            elif star := re.match(r"\(\s*(\w+)\s*\)\.\*", sql[k:]):
                out += star[1] + ".*"
                k += star.end()
            else:
                out += sql[k]
                k += 1
        return out

    def _statistic(self, name: str, args: list[str], frame: str) -> str:
        columns, params, build = STATISTICS[name]
        if not columns <= len(args) <= columns + len(params):
            raise TypeError(f"{name} takes {columns} to {columns + len(params)} arguments")
        options = {key: check(constant(args[columns + i])) if columns + i < len(args) else check(default) for i, (key, default, check) in enumerate(params)}
        texts, udf = build(*[f"({a})" for a in args[:columns]], **options)
        made = f"statloom_fin_{next(_NUMBER)}"
        self.spark.udf.register(made, udf)
        cast = "{}" if "collect_list" in " ".join(texts) else "CAST({} AS DOUBLE)"
        cols = []
        for t in texts:
            # an aggregate inside an expression is written expression|aggregate
            outer, bar, inner = t.partition("|")
            cols.append(cast.format(outer.format(inner + frame) if bar else t + frame))
        return f"{made}({', '.join(cols)})"

    def _table(self, name: str, args: list[str]) -> DataFrame:
        plain, named = [], {}
        for a in args:
            key = re.match(r"(\w+)\s*(?::=|=>)\s*", a)
            if key:
                named[key[1].lower()] = constant(a[key.end() :])
            else:
                plain.append(constant(a))
        if name == "table_one":
            return table_one(*(plain or [None]), **named)
        if name == "corr_matrix":
            return corr_matrix(*plain, **named)
        return (read_stat if name == "read_stat" else read_stat_metadata)(self.spark, *plain, **named)
