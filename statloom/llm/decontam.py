"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's window is ``width`` consecutive words of it (all words, if it has fewer, but not none). A document can only
hold a window if it holds every shingle of it, so one shingle is a sufficient prefix: the rarest in a global order
(fewest places in the documents, then most characters, then hash). One pass over the documents finds the places of all
shingles that the benchmark has; they are written, counted over the whole corpus, and joined to the prefixes by hash. A
window with a shingle that no document has is dropped. Where a window would start follows from the shingle's place in it
(positional bound), and it must lie within the document (length bound). Candidates are verified word by word.

The benchmark's shingles and prefixes are broadcast up to BROADCAST_BYTES, which is measured first; larger tables are
shuffled, and adaptive execution splits frequent shingles.

Words are runs of digits, letters a-z after A-Z are lower-cased, and all characters beyond ASCII.

Defined results: null or wordless text has no words, so nothing hits it; null or wordless items have no window; equal
items, windows or rows count once each per item_id; rows that repeat a doc_id, or have none, are judged each by its own
text; a text of any length is searched whole; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import free, written

WIDTH, SHINGLE = 10, 3
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; lower() and A-Z are the same for ASCII text, and faster."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _hash(array: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(array, i + k) for k in range(n)])


def shingles(array: Column, n: int) -> Column:
    """Hashes of the ``n`` words at each place where as many are left."""
    return F.when(F.size(array) >= n, F.transform(F.sequence(F.lit(0), F.size(array) - n), lambda i: _hash(array, i, n))).otherwise(F.array().cast("array<long>"))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, window (array of words): each distinct window of each item."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(width)).alias("window")).distinct()


def spread(found: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """window, owners, n, h, at, chars: each shingle of n words of each distinct window, its place there and its length; owners are the items that have the window."""
    one = found.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("owners")).withColumn("n", F.least(F.size("window"), F.lit(shingle)))
    place = lambda n: F.transform(shingles(F.col("window"), n), lambda h, i: F.struct(h.alias("h"), i.alias("at"), F.char_length(F.concat_ws(" ", F.slice("window", i + 1, F.lit(n)))).alias("chars")))
    each = F.coalesce(*[F.when(F.col("n") == n, place(n)) for n in range(1, shingle + 1)])
    return one.select("window", "owners", "n", F.explode(each).alias("s")).select("window", "owners", "n", "s.*")


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows take BROADCAST_BYTES at most."""
    sized = {"string": lambda c: F.octet_length(c), "array<string>": lambda c: F.octet_length(F.concat_ws(" ", c)) + 16 * F.size(c)}
    size = sum((sized.get(t, lambda c: F.lit(0))(F.col(c)) for c, t in df.dtypes), F.lit(24 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long")).alias("bytes")).first().bytes or 0) <= BROADCAST_BYTES else df


def prefixes(every: DataFrame, places: DataFrame) -> DataFrame:
    """h, n, at, window, owners: for each window the shingle with fewest places in the documents. Windows of which they lack one are left out."""
    seen = places.groupBy("n", "h").agg(F.count("*").alias("often"))
    order = F.struct(F.coalesce("often", F.lit(0)).alias("often"), (-F.col("chars")).alias("chars"), "h", "at")
    rarest = every.join(seen, ["n", "h"], "left").groupBy("window").agg(F.first("owners").alias("owners"), F.min("n").alias("n"), F.min(order).alias("s"))
    return rarest.where("s.often > 0").select("s.h", "n", "s.at", "window", "owners")


def _row(docs: DataFrame) -> DataFrame:
    """doc_id, text, and k, which tells rows of one doc_id apart by their texts."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.withColumn("k", F.xxhash64("text"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text`` of ``docs`` with k, n_words, and hit: the occurrences {start, length, owners} of windows (null: none)."""
    every, plain = written(spread(windows(benchmark, width), shingle)), _row(docs)
    split = plain.select("doc_id", "k", words(F.col("text")).alias("w"))
    places = None
    for n in sorted(r["n"] for r in every.select("n").distinct().collect()):  # at most as many rows as a shingle has words
        keys = small(every.where(F.col("n") == n).select("h").distinct())
        own = split.select("doc_id", "k", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), n)).alias("p", "h")).join(keys, "h").withColumn("n", F.lit(n))
        places = own if places is None else places.unionByName(own)
    if places is None:
        return plain.select("doc_id", "text", "k", F.size(words(F.col("text"))).alias("n_words"), F.lit(None).cast("array<struct<start:int,length:int,owners:array<string>>>").alias("hit"))
    places = written(places)
    some = places.join(small(written(prefixes(every, places))), ["n", "h"]).where((F.col("p") >= F.col("at")) & (F.col("p") - F.col("at") + F.size("window") <= F.col("size")))
    near = some.groupBy(F.col("doc_id").alias("id"), F.col("k").alias("of")).agg(F.collect_set(F.struct((F.col("p") - F.col("at")).alias("start"), "window", "owners")).alias("near"))
    joined = plain.join(near, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("of")), "left").withColumn("w", words(F.col("text")))
    right = F.filter("near", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["window"])) == c["window"])
    return joined.select("doc_id", "text", "k", F.size("w").alias("n_words"), F.transform(right, lambda c: F.struct(c["start"].alias("start"), F.size(c["window"]).alias("length"), c["owners"].alias("owners"))).alias("hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items (long), items (array of item_id as strings, sorted), spans (array of {start, length} in words), contaminated."""
    found = hits(docs, benchmark, width, shingle)
    spans = F.transform(F.col("hit"), lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hit", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda h: h["owners"]))))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.when(F.size("hit") > 0, covered).otherwise(0).cast("long").alias("n_hit"),
        F.coalesce(items, F.array().cast("array<string>")).alias("items"),
        F.coalesce(spans, F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    ).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """The documents, all columns, without those in which a benchmark window occurs."""
    key, of = free(docs, "gone"), free(docs, "gone_of")
    found = hits(docs, benchmark, width, shingle).where(F.size("hit") > 0).select(F.col("doc_id").alias(key), F.col("k").alias(of)).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(of)), "left_anti")
