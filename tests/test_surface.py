"""Charts, SQL front end, tables, files, streams, and the driver's entry points."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from statloom.operators.corr_matrix import corr_matrix
from statloom.operators.table_one import table_one
from statloom.plans import chart
from statloom.plans.session import StatsSession, arguments, constant
from statloom.sources import spss, statfile, xpt

HEAD = '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json",'
X, Y = '"x":{"field":"x","type":"quantitative"}', '"y":{"field":"y","type":"quantitative"}'


@pytest.mark.parametrize(
    "text, spec, layers",
    [
        ("VISUALIZE a AS x, b AS y FROM t DRAW point", f'"data":{{"name":"layer_0"}},"mark":"point","encoding":{{{X},{Y}}}}}', ["SELECT a AS x, b AS y FROM t"]),
        ("-- note\nvisualize a * 2 AS x, b AS y from t draw line;", f'"data":{{"name":"layer_0"}},"mark":"line","encoding":{{{X},{Y}}}}}', ["SELECT * FROM (SELECT a * 2 AS x, b AS y FROM t) ORDER BY x"]),
        (
            "VISUALIZE s AS x, b AS y FROM t DRAW bar FACET BY s ROWS",
            f'"data":{{"name":"layer_0"}},"facet":{{"row":{{"field":"facet","type":"nominal"}}}},"spec":{{"mark":"bar","encoding":{{"x":{{"field":"x","type":"ordinal"}},{Y}}}}}}}',
            ["SELECT x, facet, SUM(y) AS y FROM (SELECT s AS x, b AS y, s AS facet FROM t) GROUP BY x, facet ORDER BY x"],
        ),
        (
            "WITH c AS (SELECT 1, 2) , d AS (SELECT 3) VISUALIZE a AS x FROM d DRAW histogram DRAW density SCALE y LABEL 'a \"b\"' TITLE 'It''s' SUBTITLE 's'",
            '"layer":[{"data":{"name":"layer_0"},"mark":"bar","encoding":{"x":{"field":"x","type":"quantitative","bin":true},"y":{"aggregate":"count","type":"quantitative","axis":{"title":"a \\"b\\""}}}},'
            '{"data":{"name":"layer_1"},"transform":[{"density":"x"}],"mark":"area","encoding":{"x":{"field":"value","type":"quantitative"},"y":{"field":"density","type":"quantitative","axis":{"title":"a \\"b\\""}}}}],'
            '"title":{"text":"It\'s","subtitle":"s"}}',
            ["WITH c AS (SELECT 1, 2) , d AS (SELECT 3) SELECT a AS x FROM d"] * 2,
        ),
        (
            "VISUALIZE a AS x:temporal, b AS y, s AS color FROM t DRAW regression SCALE x DOMAIN 0 1.50 SCALE x ZERO false SCALE shape TO v",
            '"data":{"name":"layer_0"},"transform":[{"regression":"y","on":"x","groupby":["color"]}],"mark":"line","encoding":{"x":{"field":"x","type":"temporal","scale":{"domain":[0,1.50],"zero":false}},'
            + Y
            + ',"color":{"field":"color","type":"nominal"}}}',
            ["SELECT a AS x, b AS y, s AS color FROM t"],
        ),
    ],
)
def test_charts(text, spec, layers):
    got, sqls = chart.compile_chart(chart.parse(chart.claimed(text)))
    assert got == HEAD + spec and list(sqls.values()) == layers


@pytest.mark.parametrize(
    "text, message",
    [
        ("VISUALIZE FROM t DRAW point", "Expected expression after VISUALIZE"),
        ("VISUALIZE a x FROM t DRAW point", "Expected 'AS' before aesthetic 'x'"),
        ("VISUALIZE AS x FROM t DRAW point", "Empty expression before 'AS'"),
        ("VISUALIZE a AS x:odd FROM t DRAW tick", "Invalid aesthetic type 'odd'"),
        ("VISUALIZE a AS x FROM t DRAW point", "'point' requires 'y' aesthetic"),
        ("VISUALIZE a AS x FROM t DRAW pie", "unknown mark 'pie'"),
        ("VISUALIZE f(a AS x FROM t DRAW tick", "Unbalanced parentheses"),
        ("VISUALIZE 'a AS x FROM t DRAW tick", "Unterminated string literal"),
        ("VISUALIZE a AS x FROM t", "At least one 'DRAW <mark>' clause is required"),
        ("VISUALIZE a AS x FROM t DRAW tick SUBTITLE 'x'", "SUBTITLE requires a preceding TITLE"),
        ("VISUALIZE a AS x FROM t DRAW tick SCALE x OVER 1", "Unknown SCALE operator 'OVER'"),
    ],
)
def test_chart_errors(text, message):
    with pytest.raises(chart.ChartError, match=message.replace("(", r"\(")):
        chart.compile_chart(chart.parse(text))


def test_claims_and_marks():
    assert chart.claimed("with visualize_me as (select 1) select * from visualize_me") is None
    assert chart.claimed("/* x */ WITH a AS (SELECT 'visualize') VISUALIZE 1 AS x FROM a DRAW tick")
    assert chart.MARKS["point"].describe() == '{"name":"point","required_aesthetics":["x","y"]}'
    chart.register_mark("Spark", ["x"], lambda c, sql: ({"mark": "line", "encoding": chart.encoding(c)}, sql))
    assert '"mark":"line"' in chart.compile_chart(chart.parse("VISUALIZE a AS x FROM t DRAW spark"))[0]
    del chart.MARKS["spark"]


PATIENTS = [(54.2, "F", 24.5, "A"), (61.0, "F", 28.1, "A"), (45.7, "M", 22.3, "A"), (58.3, "M", None, "A"), (67.1, "F", 31.2, "B"), (52.9, "M", 26.0, "B"), (49.8, "F", 23.9, "B"), (None, "M", 27.4, "B")]


def test_table_one(spark):
    d = spark.createDataFrame(PATIENTS, "age double, sex string, bmi double, arm string")
    rows = table_one(d, ["age", "sex", "bmi"], by=["arm"]).collect()
    shown = {(r.variable, r.level, r.statistic, r.stratum): r.display for r in rows}
    assert shown["age", None, "mean (sd)", "Overall"] == "55.6 (7.2)" and shown["age", None, "median [q1, q3]", "Overall"] == "54.2 [51.3, 59.6]"
    assert shown["sex", "F", "n (%)", "A"] == "2 (50.0%)" and shown["sex", "Missing", "n (%)", "Overall"] == "0 (0.0%)" and shown["age", None, "missing", "B"] == "1"
    p = {r.variable: r.p_value for r in rows}
    assert p["age"] == pytest.approx(0.774647, abs=1e-6) and p["bmi"] == pytest.approx(0.391848, abs=1e-6) and p["sex"] == pytest.approx(1)
    p = {r.variable: r.p_value for r in table_one(d, ["age", "bmi"], by=["arm", "sex"]).collect()}
    assert p["age"] == pytest.approx(0.872123, abs=1e-6) and p["bmi"] == pytest.approx(0.673101, abs=1e-6)
    assert {r.p_value for r in table_one(d, ["age"]).collect()} == {None}
    for options, text in (({"variables": []}, "must not be empty"), ({"variables": ["z"]}, "'z' not found"), ({"variables": ["age"], "force_categorical": ["sex"]}, "not in 'variables'")):
        with pytest.raises(ValueError, match=text):
            table_one(d, **options)


def test_corr_matrix(spark):
    d = spark.createDataFrame([(float(a), float(b), None if a == 3 else float(a * b)) for a, b in zip(range(8), (3, 1, 4, 1, 5, 9, 2, 6))], "a double, b double, c double")
    for method in ("pearson", "spearman", "Kendall"):
        rows = {(r.row_var, r.col_var): (r.coef, r.n) for r in corr_matrix(d, method=method).collect()}
        assert len(rows) == 9 and rows["a", "c"] == rows["c", "a"] and rows["a", "c"][1] == 7 and rows["a", "a"][0] == pytest.approx(1)
    with pytest.raises(ValueError, match="at least 2 columns"):
        corr_matrix(d, ["a"])


@pytest.mark.parametrize("name, options", [("a.xpt", {}), ("b.xpt", {"version": 8}), ("c.sav", {}), ("d.sav", {"compression": "rows"}), ("e.zsav", {}), ("f.por", {})])
def test_files(spark, tmp_path, name, options):
    rows = [
        ("ab", 1.1, 1, dt.date(2018, 5, 6), dt.datetime(2018, 5, 6, 10, 10, 10), True, "w" * 700),
        ("éü", -0.001, 2, dt.date(1880, 1, 1), dt.datetime(1960, 1, 1), False, ""),
        (None, None, None, None, None, None, None),
        ("", 1e10, -7, dt.date(1583, 1, 1), dt.datetime(2050, 12, 31, 23, 59, 59), True, "x"),
    ]
    d = spark.createDataFrame(rows, "s string, x double, i int, d date, ts timestamp_ntz, b boolean, w string")
    d = d.withColumn("s", F.col("s").alias("s", metadata={"comment": "a label"}))
    path = str(tmp_path / name)
    statfile.write_stat(d, path, label="File", **options)
    back = statfile.read_stat(spark, path, partitions=2)
    want = [tuple((x or "") if k in (0, 6) else None if x is None else float(x) if k in (2, 5) else x for k, x in enumerate(r)) for r in rows]
    assert [tuple(r) for r in back.collect()] == want
    assert back.schema[0].metadata["comment"] == "a label" and back.schema[3].dataType.simpleString() == "date"
    assert statfile.read_stat_metadata(spark, path).first().label == "a label"
    statfile.write_stat(d.limit(0), path, **options)
    assert statfile.read_stat(spark, path).count() == 0


def test_file_errors(spark, tmp_path):
    d = spark.range(1)
    bad = tmp_path / "x.xpt"
    bad.write_text("<html>not found</html>")
    with pytest.raises(ValueError, match="Failed to read"):
        statfile.read_stat(spark, str(bad))
    for path, options, text in (("y.txt", {}, "Cannot detect file format"), ("y.por", {"version": 8}, "VERSION is only valid for XPT"), ("y.xpt", {"compression": "rows"}, "COMPRESSION is only valid"), ("y.sav", {"colour": 1}, "Unrecognized")):
        with pytest.raises(ValueError, match=text):
            statfile.write_stat(d, str(tmp_path / path), **options)
    with pytest.raises(ValueError, match="longer than 8"):
        statfile.write_stat(d.select(F.lit(1).alias("much_too_long")), str(tmp_path / "y.xpt"))
    with pytest.raises(ValueError, match="unsupported type"):
        statfile.write_stat(d.select(F.array(F.lit(1)).alias("a")), str(tmp_path / "y.sav"))


def pieces(path, monkeypatch, **sizes):
    """Rows of a file of numbers by its reader's tasks: their number, the rows, and the most bytes that a task asked for at once."""
    asked = []
    read = statfile.Stored.read
    monkeypatch.setattr(statfile.Stored, "read", lambda self, start, n: asked.append(n) or read(self, start, n))
    monkeypatch.setattr(statfile.Stored.__init__, "__defaults__", (8192,))
    for name, n in sizes.items():
        monkeypatch.setattr(spss if name == "POR_BLOCK" else statfile, name, n)
    reader = statfile.StatFileReader({"path": path}, statfile.spark_schema(statfile.parse(path, header_only=True)))
    tasks = reader.partitions()
    return len(tasks), [tuple(r.values()) for task in tasks for b in reader.read(task) for r in b.to_pylist()], max(asked)


def numbers(n):
    import random

    rng = random.Random(5)
    kinds = [lambda: float(rng.randint(-(10**6), 10**6)), lambda: rng.uniform(-1, 1), lambda: math.nan, lambda: float(rng.randint(10**15, 10**18)), lambda: 0.0]
    return [[rng.choices(kinds, (9, 1, 2, 1, 2))[0]() for _ in range(n)] for _ in range(3)]


VARIABLES = [spss.Variable(n, "DOUBLE", "F8.2") for n in "ABC"]


def told(columns):
    return [tuple(None if x != x else x for x in row) for row in zip(*columns)]


@pytest.mark.parametrize("lines", ["as written", "short lines", "a line a block"])
def test_portable_file_in_pieces(tmp_path, monkeypatch, lines):
    """Tasks read parts of a portable file, whatever lies on their bounds; all rows come once and in order."""
    import numpy as np

    size = 600 if lines == "a line a block" else 15_000
    columns = numbers(size)
    data = b"".join(spss.write_por(VARIABLES, [spss.por_block(VARIABLES, [np.array(c[k : k + 700]) for c in columns]) for k in range(0, size, 700)], size))
    if lines == "short lines":
        data = b"\n".join(x.rstrip() for x in data.split(b"\r\n"))
    path = tmp_path / "a.por"
    path.write_bytes(data)
    n, rows, most = pieces(str(path), monkeypatch, POR_BLOCK=82 if lines == "a line a block" else 8200, BATCH=1000)
    assert rows == told(columns) and n > len(data) / 20_000 and most <= 1 << 16
    path.write_bytes(data[: len(data) // 82 * 41])
    with pytest.raises(ValueError, match="Failed to read.*ends within a row"):
        pieces(str(path), monkeypatch)


def test_xpt_file_in_pieces(tmp_path, monkeypatch):
    """Tasks read their own rows of a transport file, never the whole; numbers are packed at once as one by one."""
    import numpy as np

    columns = [[math.inf, -0.0, 5e-324, 1e300, *c[4:]] for c in numbers(9000)]
    arrays = [np.array(c) for c in columns]
    assert all(xpt.floats_to_ibm(a) == b"".join(map(xpt.float_to_ibm, c)) for a, c in zip(arrays, columns))
    path = tmp_path / "a.xpt"
    path.write_bytes(b"".join(xpt.write(VARIABLES, [xpt.block(VARIABLES, arrays)], 9000)))
    n, rows, most = pieces(str(path), monkeypatch, TASK=24 * 500, BATCH=24 * 100)
    assert n == 18 and len(rows) == 9000 and most <= 8192
    assert [r for r in rows[4:]] == [tuple(None if x is None else pytest.approx(x, rel=1e-15) for x in r) for r in told(columns)[4:]]
    assert rows[:4] == [(None,) * 3, (0.0,) * 3, (None,) * 3, (None,) * 3]


@pytest.mark.parametrize("told_cases", [True, False])
def test_sav_file_in_pieces(tmp_path, monkeypatch, told_cases):
    """Tasks read their own rows of a plain system file, also where its header does not tell how many there are."""
    import numpy as np

    columns = numbers(9000)
    path = tmp_path / "a.sav"
    path.write_bytes(b"".join(spss.write_sav(VARIABLES, [spss.sav_block(VARIABLES, [np.array(c) for c in columns])], 9000 if told_cases else -1)))
    n, rows, most = pieces(str(path), monkeypatch, TASK=24 * 500, BATCH=24 * 100)
    assert n == 18 and rows == told(columns) and most <= 8192


def test_numbers_survive():
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(500):
        x = rng.choice([rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30), float(rng.randint(-(10**6), 10**6))])
        p = spss._Portable.__new__(spss._Portable)
        p.text, p.at = spss.base30(x).encode(), 0
        assert p.number() == x
        assert xpt.ibm_to_float(np.frombuffer(xpt.float_to_ibm(x), np.uint8).reshape(1, 8))[0] == pytest.approx(x, rel=1e-15)
    assert math.isnan(xpt.ibm_to_float(np.frombuffer(xpt.float_to_ibm(math.nan), np.uint8).reshape(1, 8))[0])


def test_sql(spark, tmp_path):
    s = StatsSession(spark)
    spark.createDataFrame([("A", 2.0, 3.0), ("A", 4.0, 1.0), ("A", 6.0, 5.0), ("B", 8.0, 9.0), ("B", 10.0, 8.0)], "g string, v double, w double").createOrReplaceTempView("t5")
    r = s.sql("SELECT (r).* FROM (SELECT ttest_1samp(v, 0.0, 0.05, 'greater') AS r FROM t5) -- ttest_1samp(").first()
    assert r.p_value == pytest.approx(0.0066, abs=1e-4)
    assert s.sql("SELECT g, (summary_stats(v)).n AS n FROM t5 GROUP BY g HAVING (summary_stats(v)).n > 2").collect() == [("A", 3)]
    assert s.sql("SELECT adjust_p([0.01, 0.04], 'bonferroni') AS a, ggsql_mark_v1_bar() AS m, 'ttest_1samp(x)' AS t").first() == ([0.02, 0.08], '{"name":"bar","required_aesthetics":["x","y"]}', "ttest_1samp(x)")
    assert s.sql("SELECT count(*) FROM corr_matrix('t5', variables := ['v', 'w'])").first()[0] == 4
    path = tmp_path / "o.sav"
    assert s.sql(f"COPY (SELECT g, v FROM t5) TO '{path}' (FORMAT sav, COMPRESSION 'rows')").first()[0] == 5
    assert s.sql(f"SELECT sum(v) FROM '{path}'").first()[0] == 30 and s.sql(f"SELECT count(*) FROM read_stat_metadata('{path}')").first()[0] == 2
    assert s.layers("VISUALIZE g AS x, v AS y FROM t5 DRAW bar")["layer_0"].collect() == [("A", 12.0), ("B", 18.0)]
    assert arguments("a, f(b, c), 'x,y', [1, 2]") == ["a", "f(b, c)", "'x,y'", "[1, 2]"] and constant("['a', 'b''c']") == ["a", "b'c"]
    with pytest.raises(TypeError, match="constant"):
        s.sql("SELECT ttest_1samp(v, w) FROM t5")


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    from statloom import queries as q

    for name, sql in q.oracle_sql().items():
        df, want = q.queries()[name](spark, SF), con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        cols = sorted(df.columns)
        key = lambda row: repr([round(x, 5) if isinstance(x, float) else x for x in row])
        a = sorted(key([r[c] for c in cols]) for r in df.collect())
        b = sorted(key([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())
        assert a == b, (name, [x for x in zip(a, b) if x[0] != x[1]][:3])


def test_every_listed_format():
    from statloom.sources import model

    for names, want in ((model.DATES, "date"), (model.TIMESTAMPS, "timestamp"), (model.TIMES, "time")):
        assert {model.temporal("xpt", n) for n in names} == {want} and {model.temporal("sav", n + ".") for n in names if "." not in n} == {want}
    assert [model.temporal("xpt", f) for f in ("IS8601DA", "B8601DN", "HHMMSS", "DTDATE", "DATETIME23.2", "DATE9.", "MMDDYY10.", "TIME8.2")] == ["date", "timestamp", "time", "date", "timestamp", "date", "date", "time"]
    assert [model.temporal("xpt", f) for f in ("BEST12.", "F8.2", "COMMA10.2", "$20.", "", "DOLLAR8.")] == [None] * 6
    assert [model.temporal("dta", f) for f in ("%td", "%tc", "%tcHH:MM:SS", "%d", "%9.0g")] == ["date", "timestamp", "time", "date", None]


def test_quotes_inside_parentheses():
    from statloom.plans import chart

    for text, x in (
        ("VISUALIZE regexp_replace(a, ')', '') AS x, b AS y FROM t DRAW point", "regexp_replace(a, ')', '')"),
        ("VISUALIZE concat(a, '(') AS x, b AS y FROM t DRAW point", "concat(a, '(')"),
        ("VISUALIZE a AS x, b AS y FROM (SELECT ')' AS k, a, b FROM t) DRAW point", "a"),
        ("VISUALIZE f('it''s; (', \"q)\") AS x, b AS y FROM t DRAW point", "f('it''s; (', \"q)\")"),
    ):
        assert chart.parse(text).mappings == [(x, "x"), ("b", "y")]
    with pytest.raises(chart.ChartError, match="Unbalanced"):
        chart.parse("VISUALIZE f(a AS x, b AS y FROM t DRAW point")
    with pytest.raises(chart.ChartError, match="Unterminated"):
        chart.parse("VISUALIZE f(a, ') AS x, b AS y FROM t DRAW point")


def test_remote_targets(spark, tmp_path):
    """A store that Arrow knows by its scheme; here one that ends in a folder."""
    from statloom.sources import model

    model.write_bytes(f"file://{tmp_path}/a.bin", [b"ab", b"c"])
    assert model.read_bytes(f"file://{tmp_path}/a.bin") == b"abc"
