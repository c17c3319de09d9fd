"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed base rules fail a document outright. Beyond them, each rule has a measure and a fixed grid of cutoffs; a document
fails a rule if its measure is over the cutoff chosen for its stratum (its language, ``und`` if null). Every labelled
document is a holdout: the grids are set before any label is seen. In each stratum, rule and cutoff the labelled good
documents (quality 1) that pass the base rules are counted, n, and of them those that the cutoff would reject, k. A
cutoff passes its test if k or fewer rejections of n have a probability of at most DELTA / tests when the true rate is
RISK / rules: the exact binomial tail at that rate, equal to an exact upper confidence bound below it. ``tests`` is the
number of strata times rules. Within one of these, cutoffs are tested in a fixed sequence from the loosest to the first
that fails, which needs no further correction: a false certificate takes a false first rejection. So with probability
1 - DELTA all certified cutoffs hold, and by summing over rules at most RISK of the good documents of a stratum are
rejected. The lowest certified cutoff is taken; where none is certified, the rule rejects nothing, nor does any rule in
an unlabelled stratum. With the defaults and four languages, a cutoff needs 1,495 good documents of its language.

Defined results: null text has no words and fails the base rules; null quality and null doc_id teach nothing; a doc_id
with several labels counts with the highest; repeated rows are judged each; a text of any length is counted whole; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import written

RISK, DELTA = 0.02, 0.05
#: a table of cutoffs for up to so many strata, a few hundred bytes each, is broadcast
STRATA = 20_000
_SPACE = r"[\x20\x09-\x0D]+"

#: name: (measure over base columns, cutoffs from low to high)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / n_words", [x / 20 for x in range(1, 21)]),
    "long_words": ("word_chars / n_words", [x / 2 for x in range(10, 31)]),
    "short_words": ("-word_chars / n_words", [-x / 4 for x in range(20, 3, -1)]),
    "dup_lines": ("n_dup_lines / n_lines", [x / 20 for x in range(1, 20)]),
    "repeat_words": ("n_repeat_words / n_words", [x / 20 for x in range(1, 10)]),
}


def base(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base counts of each whole text, and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = plain.select("doc_id", "lang", F.array_remove(F.split("t", _SPACE), "").alias("w"), lines.alias("l"), (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).alias("n_symbols"))
    # in a lambda only the element and columns that are already there: an expression would run for each element
    hashed = cut.select(
        "doc_id",
        "lang",
        F.size("w").alias("n_words"),
        F.char_length(F.array_join("w", "")).alias("word_chars"),
        "n_symbols",
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>")).alias("h"),
    )
    # windows of a text that repeats some: sorted by hash, neighbours compared, the places of equal ones merged
    ordered = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    sorted_ = hashed.withColumn("o", ordered).drop("h")
    n = F.size("o") - 1
    pairs = F.zip_with(F.slice("o", F.lit(1), n), F.slice("o", F.lit(2), n), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    found = sorted_.withColumn("p", F.when(F.col("o").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    repeat = F.when(F.size("p") > 0, F.aggregate(steps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    out = found.select("doc_id", "lang", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")], repeat.cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lgamma(x: Column) -> Column:
    """Log gamma for x >= 1: Stirling's series seven places up."""
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    low = F.log(x * (x + 1) * (x + 2)) + F.log((x + 3) * (x + 4)) + F.log((x + 5) * (x + 6))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - low


def binomial_tail(k: Column, n: Column, p: float, terms: int = 4000) -> Column:
    """P(X <= k) for X binomial (n, p) where k < n p, 1 elsewhere.

    Summed down from k; beyond ``terms`` terms the rest is bounded from above by a geometric series, so the result is
    exact or, for very large counts, larger by less than rounding shows.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j + 1) * odds / (n - k + j)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(float(terms))).cast("int"))).otherwise(F.array().cast("array<int>"))
    left = k - terms
    ratio = left * odds / (n - left + 1)
    total = F.aggregate(steps, start, add, lambda s: s["total"] + F.when(left > 0, s["term"] * ratio / (1 - ratio)).otherwise(0.0))
    return F.when(k < n * p, F.least(top * total, F.lit(1.0))).otherwise(1.0)


def measures() -> Column:
    return F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(f"CASE WHEN n_words > 0 AND n_lines > 0 THEN double({m}) END").alias("value")) for name, (m, _) in RULES.items()])


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """lang, rule, cutoff: the lowest certified cutoff; strata and rules without one are left out."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("quality")).where("quality = 1")
    held = found.where("NOT base_failed").join(good, F.col("doc_id") == F.col("id")).select("lang", F.explode(measures()).alias("m")).select("lang", "m.*")
    grid = F.create_map(*[x for name, (_, g) in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, g)))])
    # for each value the number of cutoffs below it: a count per place replaces a row per cutoff
    place = F.size(F.filter(grid[F.col("rule")], lambda c: c < F.col("value")))
    seen = held.withColumn("over", place).groupBy("lang", "rule", "over").count()
    stratum = seen.groupBy("lang", "rule").agg(F.sum("count").alias("n"), F.collect_list(F.struct("over", "count")).alias("by"))
    each = stratum.select("lang", "rule", "n", "by", F.posexplode(grid[F.col("rule")]).alias("at", "cutoff"))
    rejected = F.aggregate(F.filter("by", lambda b: b["over"] > F.col("at")), F.lit(0).cast("long"), lambda s, b: s + b["count"])
    tried = each.select("lang", "rule", "n", "cutoff", rejected.alias("k"))
    strata = stratum.agg(F.count_distinct("lang").alias("n")).first().n
    tests = max(1, strata) * len(RULES)
    checked = tried.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= delta / tests)
    stop = checked.groupBy("lang", "rule").agg(F.max(F.when(~F.col("ok"), F.col("cutoff"))).alias("stop"), F.collect_list(F.when(F.col("ok"), F.col("cutoff"))).alias("passed"))
    return stop.select("lang", "rule", F.array_min(F.filter("passed", lambda c: F.col("stop").isNull() | (c > F.col("stop")))).alias("cutoff")).where("cutoff IS NOT NULL")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the base counts, base_failed, failed (names of the rules failed beyond the base), kept."""
    found = written(base(docs))
    chosen = written(cutoffs(found, labels, risk, delta).groupBy(F.col("lang").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("c")))
    # a language may hold most rows, so its cutoffs go to where they are, unless the names of languages are millions
    joined = found.join(F.broadcast(chosen) if chosen.count() <= STRATA else chosen, F.col("lang") == F.col("of"), "left")
    failed = F.transform(F.filter(measures(), lambda m: F.coalesce(m["value"] > F.col("c")[m["rule"]], F.lit(False))), lambda m: m["rule"])
    judged = joined.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
