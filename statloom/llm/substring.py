"""Substring dedup by sliding sentence spans.

A run begins at each sentence and takes as many sentences as it needs: ``width`` at least, and more until it has
``min_words`` words, so no sentence is too short to be in one. Every run is hashed (128 bits) over its words, lower case,
punctuation kept. Of each run, the first occurrence over the corpus is the one in the smallest doc_id, there the
earliest; every other occurrence is a repeat, and each sentence that a repeat covers is removed.

A repeated passage need not begin and end with sentences. So windows of ``SPAN`` words across sentences are spans too, if
``LONG`` or more of their words are in one sentence; of any ``STEP`` windows in a row, the one of smallest hash is kept.
Every repeat of SPAN + STEP - 1 such words has a window, at most STEP - 1 words from either end of it, and the words of
repeated windows are removed. Where sentences are shorter, runs leave less than LONG words at either end of a passage.

Spans are shuffled once, by hash, for the smallest doc_id of each. Before that, a task compares the spans of CHUNK at a
time: what stands in a larger doc_id than another of the same hash, or again in its document, is known to repeat and goes
by doc_id, not by hash. So a span that all documents hold is one row of its hash for each chunk, not for each document.

A sentence ends after ``.``, ``!`` or ``?`` before white space, after the full stops of Chinese and Japanese, or at a line
break. In scripts without blanks two characters count as a word. Only what has fewer than ``min_words`` words up to the
end of its document is no run; a window that overlaps its own last place in the document is none.

Defined results: null text has no sentence and stays null; a document of fewer than ``width`` sentences has no run;
rows without a doc_id are neither compared nor changed; rows that repeat a doc_id count as one document; a text of any
length is cut whole, by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import documents_of, free, text_rows, trim

WIDTH, MIN_WORDS = 3, 10
SPAN, LONG, STEP, CHUNK = 20, 13, 10, 200_000
_WORD = re.compile(r"\s*\S+\s*")
_CUT = re.compile(r"((?<=[.!?])[^\S\n]+|\s*\n\s*|(?<=[。！？｡])(?=[^\s。！？｡]))")
_DENSE = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def sentences(text: str) -> list[str]:
    """The text cut into sentences, each with the white space behind it; joined they are the text."""
    cut = _CUT.split(text)
    out = [a + b for a, b in zip(cut[::2], [*cut[1::2], ""])]
    return [x for x in out if x]


def windows(words: list[list[str]]) -> list[tuple[int, bytes]]:
    """(-1 - place of the first word, 16-byte hash) of each window kept, of the words of sentences."""
    ends = np.cumsum([len(x) for x in words]).tolist()
    if not ends or ends[-1] < SPAN or max(map(len, words)) < LONG:
        return []
    flat = [w for x in words for w in x]
    usable = np.zeros(len(flat) - SPAN + 1, bool)
    for own, end in zip(words, ends):
        if len(own) >= LONG:
            usable[max(0, end - len(own) - SPAN + LONG) : end - LONG + 1] = True
    if not usable.any():
        return []
    h, factor, size = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat)), 0x9E3779B97F4A7C15, 1
    sums, total, done = h, None, 0
    while True:  # sums of 1, 2, 4, ... words put together to SPAN
        if SPAN & size:
            total = sums if total is None else total[: len(flat) - done - size + 1] * np.uint64(pow(factor, size, 1 << 64)) + sums[done:]
            done += size
        if done == SPAN:
            break
        sums = sums[:-size] * np.uint64(pow(factor, size, 1 << 64)) + sums[size:]
        size *= 2
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    step = min(STEP, len(total))
    kept = np.unique(np.lib.stride_tricks.sliding_window_view(total, step).argmin(axis=1) + np.arange(len(total) - step + 1))
    out, last = [], {}
    for i in kept[usable[kept]].tolist():
        key = xxhash.xxh3_128_digest(" ".join(flat[i : i + SPAN]))
        if i - last.get(key, -SPAN) >= SPAN:
            out.append((-1 - i, key))
        last[key] = i
    return out


def ends(words: list[list[str]], width: int = WIDTH, min_words: int = MIN_WORDS) -> list[int]:
    """Where the run that begins at each of the sentences ends; those that begin later have too few words left."""
    size = [len(w) if all(map(str.isascii, w)) else max(len(w), len(_DENSE.findall("".join(w))) // 2) for w in words]
    before, out, j = [0, *np.cumsum(size).tolist()], [], 0
    for i in range(len(words) - width + 1):
        j = max(j, i + width)
        while j < len(words) and before[j] - before[i] < min_words:
            j += 1
        if before[j] - before[i] < min_words:
            break
        out.append(j)
    return out


def runs(text: str | None, width: int = WIDTH, min_words: int = MIN_WORDS) -> tuple[list[tuple[int, bytes]], int]:
    """(position of the first sentence, 16-byte hash) of each run, and the number of sentences. Blank sentences are in no run.

    Windows follow, with negative positions.
    """
    cut = sentences(text or "")
    words = [w for x in cut if (w := x.lower().split())]
    keys = list(map(" ".join, words))
    found = [(k, xxhash.xxh3_128_digest("\n".join(keys[k:j]))) for k, j in enumerate(ends(words, width, min_words))]
    return found + windows(words), len(cut)


def occurrences(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """h1, h2, doc_id, pos, sure: each run and window; ``sure`` if it is known to repeat one, and then h1 and h2 only spread the rows.

    pos counts non-blank sentences, or words as windows() does.
    """

    def told(hashes: list[bytes], ids: list[int], places: list[int], again: list[bool]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2).copy()
        doc, pos, sure = np.array(ids, np.int64), np.array(places, np.int32), np.array(again, bool)
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        new = np.r_[True, (np.diff(h[order], axis=0) != 0).any(axis=1)]
        least = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        sure[order] |= doc[order] != least
        h[sure, 0], h[sure, 1] = doc[sure] * 0x9E3779B1, pos[sure]
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc), pa.array(pos), pa.array(sure)], ["h1", "h2", "doc_id", "pos", "sure"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, places, again = [], [], [], []
        for doc_id, text in text_rows(batches):
            seen = set()
            for pos, h in runs(text, width, min_words)[0]:
                hashes.append(h), ids.append(doc_id), places.append(pos), again.append(h in seen)
                seen.add(h)
            if len(ids) > CHUNK:
                yield told(hashes, ids, places, again)
                hashes, ids, places, again = [], [], [], []
        if ids:
            yield told(hashes, ids, places, again)
        trim()

    return documents_of(docs.where(F.col("doc_id").isNotNull())).mapInArrow(run, "h1 long, h2 long, doc_id long, pos int, sure boolean")


def repeats(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, places: the positions of all runs and windows of the document that are not the first of the corpus."""
    first = F.min(F.when(~F.col("sure"), F.col("doc_id"))).over(Window.partitionBy("h1", "h2"))
    found = occurrences(docs, width, min_words).withColumn("first", first).where("sure OR doc_id > first")
    return found.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))


def cleaned(text: str, places: list[int], width: int = WIDTH, min_words: int = MIN_WORDS) -> tuple[str, int, int]:
    """The text without what runs and windows at ``places`` cover, the number of sentences, and of those removed, in whole or in part."""
    cut = sentences(text)
    real = [i for i, x in enumerate(cut) if x.strip()]
    stop = ends([cut[i].split() for i in real], width, min_words) if places else []
    # a place without a run is of another row of this doc_id
    gone = {real[j] for p in places if 0 <= p < len(stop) for j in range(p, stop[p])}
    covered = {-1 - p + j for p in places if p < 0 for j in range(SPAN)}
    parts, at = {}, 0
    for i in real if covered else ():
        pieces = _WORD.findall(cut[i])
        left = [x for k, x in enumerate(pieces, at) if k not in covered]
        at += len(pieces)
        if len(left) < len(pieces) and i not in gone:
            parts[i] = "".join(left)
    return "".join(parts.get(i, x) for i, x in enumerate(cut) if i not in gone), len(real), len(gone) + len(parts)


def dedup(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all columns, with ``text`` cleaned, and n_sentences and n_removed (long) after them.

    Where ``docs`` has columns of these two names, the new ones get an underscore more.
    """
    key, places = free(docs, "of"), free(docs, "places")
    found = repeats(docs, width, min_words).select(F.col("doc_id").alias(key), F.col("places").alias(places))
    joined = docs.join(found, docs["doc_id"].cast("long") == F.col(key), "left").select(*[docs[c] for c in docs.columns], places)
    at, names = docs.columns.index("text"), [*docs.columns, free(docs, "n_sentences"), free(docs, "n_removed")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                got = [(t, 0, 0) if t is None else cleaned(t, p or [], width, min_words) for t, p in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                cols = list(part.columns[:-1])
                cols[at] = pa.array([x[0] for x in got], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names)
        trim()

    more = [T.StructField(c, T.LongType()) for c in names[-2:]]
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
