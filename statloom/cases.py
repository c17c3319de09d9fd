"""Statements and what they must compile to, and quantiles from published tables. The queries are held against them."""

_HEAD = '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json",'
_XY = '"x":{"field":"x","type":"quantitative"},"y":{"field":"y","type":"quantitative"}'
_ONE = _HEAD + '"data":{"name":"layer_0"},"mark":"'
_BILLS = "SELECT bill_len AS x, bill_dep AS y FROM penguins"


def _layer(k: int, mark: str) -> str:
    return f'{{"data":{{"name":"layer_{k}"}},"mark":"{mark}","encoding":{{{_XY}}}}}'


#: (statement, specification, SQL of each layer)
CHARTS: list[tuple[str, str, list[str]]] = [
    ("VISUALIZE bill_len AS x, bill_dep AS y FROM penguins DRAW point", _ONE + f'point","encoding":{{{_XY}}}}}', [_BILLS]),
    ("VISUALIZE bill_len AS x, bill_dep AS y FROM penguins DRAW area", _ONE + f'area","encoding":{{{_XY}}}}}', [f"SELECT * FROM ({_BILLS}) ORDER BY x"]),
    ("VISUALIZE bill_len AS x, bill_dep AS y FROM penguins DRAW point DRAW line", _HEAD + f'"layer":[{_layer(0, "point")},{_layer(1, "line")}]}}', [_BILLS, f"SELECT * FROM ({_BILLS}) ORDER BY x"]),
    (
        "VISUALIZE species AS x, mass AS y, species AS color FROM penguins DRAW bar",
        _ONE + 'bar","encoding":{"x":{"field":"x","type":"ordinal"},"y":{"field":"y","type":"quantitative"},"color":{"field":"color","type":"nominal"}}}',
        ["SELECT x, SUM(y) AS y FROM (SELECT species AS x, mass AS y, species AS color FROM penguins) GROUP BY x ORDER BY x"],
    ),
    ("VISUALIZE bill_len AS x FROM penguins DRAW histogram", _ONE + 'bar","encoding":{"x":{"field":"x","type":"quantitative","bin":true},"y":{"aggregate":"count","type":"quantitative"}}}', ["SELECT bill_len AS x FROM penguins"]),
    ("VISUALIZE 40 AS x FROM penguins DRAW rule", _ONE + 'rule","encoding":{"x":{"field":"x","type":"quantitative"}}}', ["SELECT 40 AS x FROM penguins"]),
    ("VISUALIZE 18 AS y FROM penguins DRAW rule", _ONE + 'rule","encoding":{"y":{"field":"y","type":"quantitative"}}}', ["SELECT 18 AS y FROM penguins"]),
    ("VISUALIZE x AS x, y AS y, label AS text FROM labels DRAW text", _ONE + f'text","encoding":{{{_XY},"text":{{"field":"text","type":"nominal"}}}}}}', ["SELECT x AS x, y AS y, label AS text FROM labels"]),
    (
        "VISUALIZE bill_len AS x, bill_dep AS y, bill_len AS color FROM penguins DRAW heatmap SCALE color TO viridis",
        _ONE + 'rect","encoding":{"x":{"field":"x","type":"ordinal"},"y":{"field":"y","type":"ordinal"},"color":{"field":"color","type":"quantitative","scale":{"scheme":"viridis"}}}}',
        ["SELECT bill_len AS x, bill_dep AS y, bill_len AS color FROM penguins"],
    ),
    *(
        (f"VISUALIZE group_id AS x, lo AS y, hi AS y2 FROM measurements DRAW {mark}", _ONE + f'{mark}","encoding":{{{_XY},"y2":{{"field":"y2","type":"quantitative"}}}}}}', [sql])
        for mark, sql in (("errorbar", "SELECT group_id AS x, lo AS y, hi AS y2 FROM measurements"), ("errorband", "SELECT * FROM (SELECT group_id AS x, lo AS y, hi AS y2 FROM measurements) ORDER BY x"))
    ),
    ("VISUALIZE group_id AS x, mean AS y FROM measurements DRAW boxplot", _ONE + f'boxplot","encoding":{{{_XY}}}}}', ["SELECT group_id AS x, mean AS y FROM measurements"]),
    ("VISUALIZE bill_len AS x, bill_dep AS y FROM penguins DRAW point FACET BY species", _HEAD + f'"data":{{"name":"layer_0"}},"facet":{{"field":"facet","type":"nominal"}},"spec":{{"mark":"point","encoding":{{{_XY}}}}}}}', ["SELECT bill_len AS x, bill_dep AS y, species AS facet FROM penguins"]),
    (
        "VISUALIZE species AS x, bill_dep AS y FROM penguins DRAW bar FACET BY species",
        _HEAD + '"data":{"name":"layer_0"},"facet":{"field":"facet","type":"nominal"},"spec":{"mark":"bar","encoding":{"x":{"field":"x","type":"ordinal"},"y":{"field":"y","type":"quantitative"}}}}',
        ["SELECT x, facet, SUM(y) AS y FROM (SELECT species AS x, bill_dep AS y, species AS facet FROM penguins) GROUP BY x, facet ORDER BY x"],
    ),
    (
        "VISUALIZE bill_len AS x, bill_dep AS y FROM penguins DRAW point DRAW line FACET BY species",
        _HEAD + f'"facet":{{"field":"facet","type":"nominal"}},"spec":{{"layer":[{_layer(0, "point")},{_layer(1, "line")}]}}}}',
        ["SELECT bill_len AS x, bill_dep AS y, species AS facet FROM penguins", "SELECT * FROM (SELECT bill_len AS x, bill_dep AS y, species AS facet FROM penguins) ORDER BY x"],
    ),
    (
        "VISUALIZE bill_len AS x, bill_dep AS y FROM penguins DRAW point TITLE 'Bill dimensions' SUBTITLE 'Source: Palmer Station LTER'",
        _ONE + f'point","encoding":{{{_XY}}},"title":{{"text":"Bill dimensions","subtitle":"Source: Palmer Station LTER"}}}}',
        [_BILLS],
    ),
    ("VISUALIZE bill_len AS x, bill_dep AS y, year AS color:ordinal FROM penguins DRAW point", _ONE + f'point","encoding":{{{_XY},"color":{{"field":"color","type":"ordinal"}}}}}}', ["SELECT bill_len AS x, bill_dep AS y, year AS color FROM penguins"]),
    (
        "WITH d AS (SELECT * FROM penguins WHERE species != 'Chinstrap') VISUALIZE bill_len AS x, bill_dep AS y FROM d DRAW line",
        _ONE + f'line","encoding":{{{_XY}}}}}',
        ["SELECT * FROM (WITH d AS (SELECT * FROM penguins WHERE species != 'Chinstrap') SELECT bill_len AS x, bill_dep AS y FROM d) ORDER BY x"],
    ),
    ("VISUALIZE bill_len AS x, (SELECT max(bill_dep) FROM penguins) AS y FROM penguins DRAW point", _ONE + f'point","encoding":{{{_XY}}}}}', ["SELECT bill_len AS x, (SELECT max(bill_dep) FROM penguins) AS y FROM penguins"]),
    ("VISUALIZE bill_len AS x, bill_dep AS y, bill_len > 40 AS color FROM penguins DRAW point", _ONE + f'point","encoding":{{{_XY},"color":{{"field":"color","type":"nominal"}}}}}}', ["SELECT bill_len AS x, bill_dep AS y, bill_len > 40 AS color FROM penguins"]),
    ("VISUALIZE regexp_replace(a, ')', '') AS x, concat(b, '(') AS y FROM t DRAW point;", _ONE + f'point","encoding":{{{_XY}}}}}', ["SELECT regexp_replace(a, ')', '') AS x, concat(b, '(') AS y FROM t"]),
]

#: the statement over the sample tables: two layers, facets, two scales and a title
ORDERS = "VISUALIZE o_orderpriority AS x, o_totalprice AS y, o_orderstatus AS color FROM orders DRAW point DRAW line FACET BY o_orderstatus SCALE color TO viridis SCALE y LABEL 'Price' TITLE 'Orders'"
_PRICE = '"encoding":{"x":{"field":"x","type":"quantitative"},"y":{"field":"y","type":"quantitative","axis":{"title":"Price"}},"color":{"field":"color","type":"nominal","scale":{"scheme":"viridis"}}}}'
ORDERS_SPEC = _HEAD + '"facet":{"field":"facet","type":"nominal"},"spec":{"layer":[{"data":{"name":"layer_0"},"mark":"point",' + _PRICE + ',{"data":{"name":"layer_1"},"mark":"line",' + _PRICE + ']},"title":{"text":"Orders"}}'
_ORDERS_SQL = "SELECT o_orderpriority AS x, o_totalprice AS y, o_orderstatus AS color, o_orderstatus AS facet FROM orders"
ORDERS_SQL = {"layer_0": _ORDERS_SQL, "layer_1": f"SELECT * FROM ({_ORDERS_SQL}) ORDER BY x"}

#: (function, arguments, value): quantiles of printed tables to six places
QUANTILES: list[tuple[str, tuple[float, ...], float]] = [
    ("qnorm", (0.5,), 0.0), ("qnorm", (0.75,), 0.67449), ("qnorm", (0.9,), 1.281552), ("qnorm", (0.975,), 1.959964), ("qnorm", (0.995,), 2.575829), ("qnorm", (0.001,), -3.090232),
    ("qt", (0.975, 5.0), 2.570582), ("qt", (0.975, 4.0), 2.776445), ("qt", (0.95, 10.0), 1.812461), ("qt", (0.995, 30.0), 2.749996), ("qt", (0.025, 1.0), -12.706205), ("qt", (0.975, 120.0), 1.97993),
    ("qchisq", (0.95, 1.0), 3.841459), ("qchisq", (0.95, 3.0), 7.814728), ("qchisq", (0.99, 10.0), 23.209251), ("qchisq", (0.05, 10.0), 3.940299),
    ("qf", (0.95, 2.0, 10.0), 4.102821), ("qf", (0.95, 5.0, 20.0), 2.71089), ("qf", (0.99, 1.0, 10.0), 10.044289),
    ("qgamma", (0.5, 3.0), 2.67406), ("qbeta", (0.5, 2.0, 5.0), 0.26445), ("qexp", (0.5,), 0.693147),
]
