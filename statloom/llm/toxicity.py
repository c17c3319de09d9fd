"""Toxicity: a linear classifier over character n-grams, each feature scaled by its naive Bayes log-count ratio.

Features are whether an n-gram of 3 to 6 characters of the lower-cased text occurs, hashed to 2**20 places. A feature's
scale is the log of the ratio of its smoothed document frequencies in toxic and other texts, shrunk towards zero by
``Z`` standard errors of it, so that n-grams without evidence have no weight at all. Logistic regression with a quadratic
penalty finds a factor for each scaled feature. Both classes weigh the same in it, however few texts are toxic.

The classifier learns from a bounded sample of labelled rows: at most ``MOST`` of either class, those of smallest hash of
doc_id, equal texts once. Their features are written to the shared folder; each step of the regression sums gradients
where the rows are, and the driver holds counts and weights only. Scores cover every whole text.

Defined results: null text is empty and scores as such; a doc_id with both labels is toxic; null labels teach nothing;
without any labelled text all scores are 0, with one class they are its smoothed share; null doc_id and repeated rows
are scored each; an empty table has no scores; long texts are gone over in pieces that overlap by an n-gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import documents_of, text_rows, written

BITS, SIZES, ALPHA, Z, MOST, CHUNK = 20, (3, 4, 5, 6), 1.0, 4.0, 12_000, 1 << 19
_LANES = 1 << 16


def _places(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the place of the n-gram at each position of the lower-case texts laid end to end, and where texts begin.

    Texts are parted by as many zeros as no n-gram spans.
    """
    gap = "\0" * max(SIZES)
    laid = gap.join(texts) + gap
    a = np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0] + [len(x) + len(gap) for x in texts[:-1]])
    h = a * np.uint32(0x01000193)
    for n in range(2, max(SIZES) + 1):
        h = (h[:-1] + a[n - 1 :]) * np.uint32(0x01000193) ^ (h[:-1] >> np.uint32(15))
        if n in SIZES:
            yield ((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), starts


def _chunks(rows: Iterable[tuple[int | None, str | None]]) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for key, text in rows:
        keys.append(key), texts.append(text or "")
        size += len(texts[-1]) + 8
        if size > CHUNK:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in lower case, those longer than CHUNK in overlapping pieces, about CHUNK characters at a time; and the row of each."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        low = text.lower()
        for i in range(0, max(1, len(low)), CHUNK):
            rows.append(row), held.append(low[i : i + CHUNK + max(SIZES) - 1])
            size += len(held[-1])
            if size >= CHUNK:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _present(texts: list[str], used: np.ndarray | None) -> np.ndarray:
    """row * 2**BITS + place of each feature that occurs in each text, once; of places that are ``used`` if that is given."""
    found = [np.zeros(0, np.int64)]
    for rows, held in _pieces(texts):
        own, row = [], np.array(rows, np.int64)
        for places, starts in _places(held):
            at = np.arange(len(places)) if used is None else np.flatnonzero(used[places])
            own.append((row[np.searchsorted(starts, at, "right") - 1] << BITS) | places[at].astype(np.int64))
        found.append(_distinct(np.concatenate(own)))
    return _distinct(np.concatenate(found)) if len(found) > 2 else found[-1]


def _distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; sorting beats the hash table of np.unique() where most are distinct."""
    a.sort()
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def sample(docs: DataFrame, labels: DataFrame, learn: Column | None, most: int = MOST) -> DataFrame:
    """toxic, text, h: the rows learned from, with a hash of their text. ``learn`` is a condition on the labels' doc_id."""
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    named = (named if learn is None else named.where(learn)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = None
    for c in (0, 1):
        own = named.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    # at most 2 * most rows of two numbers
    plain = documents_of(docs)
    rows = plain.join(F.broadcast(picked), plain.doc_id == picked.id).select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"])


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Document frequency of each place, by class (0, 1), and the numbers of documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int32)
        for own, texts in _chunks(text_rows(batches)):
            own = np.array(own)
            found = _present(texts, None)
            for c in (0, 1):
                n[c] += (own == c).sum()
                sums[c] += np.bincount(found[own[found >> BITS] == c] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        if n.any():
            lanes = range((1 << BITS) // _LANES)
            yield pa.RecordBatch.from_arrays([pa.array([*lanes, -1], pa.int32()), pa.array([*(sums[:, k * _LANES : (k + 1) * _LANES].tobytes() for k in lanes), n.tobytes()], pa.binary())], ["lane", "n"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32) for x in rows.column("n"))
        return pa.table([rows.column("lane")[:1], pa.array([total.astype(np.int32).tobytes()], pa.binary())], ["lane", "n"])

    got = {r.lane: np.frombuffer(r.n, np.int32).reshape(2, -1) for r in rows.select("toxic", "text").mapInArrow(count, "lane int, n binary").groupBy("lane").applyInArrow(add, "lane int, n binary").collect()}
    if not got:
        return np.zeros((2, 1 << BITS)), np.zeros(2)
    return np.concatenate([got[k] for k in range((1 << BITS) // _LANES)], axis=1), got[-1][:, 0]


def ratios(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log-count ratio of each place, shrunk by Z standard errors."""
    p, q = counts[1] + ALPHA, counts[0] + ALPHA
    r = np.log(p / (docs[1] + 2 * ALPHA)) - np.log(q / (docs[0] + 2 * ALPHA))
    return np.sign(r) * np.maximum(np.abs(r) - Z * np.sqrt(1 / p + 1 / q), 0)


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 40, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """A minimum of a smooth convex function by L-BFGS. ``value`` gives the function and its gradient."""
    f, g = value(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < tolerance:
            break
        way, told = g.copy(), []
        for s, y in reversed(moves):
            a = (s @ way) / (s @ y)
            told.append(a)
            way -= a * y
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(moves, reversed(told)):
            way += s * (a - (y @ way) / (s @ y))
        rate, drop = 1.0, way @ g
        while rate > 1e-6:
            to = x - rate * way
            f_to, g_to = value(to)
            if f_to <= f - 1e-4 * rate * drop:
                break
            rate /= 2
        else:
            break
        if (to - x) @ (g_to - g) > 1e-12:
            moves = [*moves, (to - x, g_to - g)][-memory:]
        done = f - f_to < 1e-9 * max(1.0, abs(f))
        x, f, g = to, f_to, g_to
        if done:
            break
    return x


def _gradient(rows: DataFrame, x: np.ndarray, v: np.ndarray, share: tuple[float, float]) -> tuple[float, np.ndarray]:
    """The logistic loss of the rows and its gradient, at factors v[:-1] of features worth ``x`` and bias v[-1]; a row of class c weighs share[c]."""
    xv, width = x * v[:-1], len(x)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, loss, slope = None, 0.0, np.zeros(width + 1)
        for batch in batches:
            y, places = batch.column(1).to_numpy(), [np.frombuffer(p, np.int32) for p in batch.column(2).to_pylist()]
            key = batch.column(0)[0].as_py() if key is None and len(y) else key
            n, own = np.array([len(p) for p in places], np.int64), np.concatenate([*places, np.zeros(0, np.int32)])
            z = np.bincount(np.repeat(np.arange(len(n)), n), xv[own], len(n)) + v[-1]
            weight = np.where(y > 0, share[1], share[0])
            loss += float((weight * (np.logaddexp(0, z) - y * z)).sum())
            e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            slope[:-1] += np.bincount(own, np.repeat(e, n), width)
            slope[-1] += e.sum()
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], ["h", "loss", "slope"])

    got = sorted((r.h, r.loss, bytes(r.slope)) for r in rows.mapInArrow(run, "h long, loss double, slope binary").collect())  # a row a task; the order must not change the sums
    slope = sum((np.frombuffer(s) for *_, s in got), np.zeros(width + 1))
    slope[:-1] *= x
    return sum(f for _, f, _ in got), slope


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = MOST, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """The weight of each place, and the bias."""
    rows = written(sample(docs, labels, learn, most))
    counts, n = _counts(rows)
    if not n.all():
        return np.zeros(1 << BITS, np.float32), -1e9 if not n.any() else float(np.log((n[1] + 1) / (n[0] + 1)))
    r = ratios(counts, n)
    used = r != 0
    number = np.cumsum(used) - 1

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, y = batch.column(0), batch.column(1)
            for own, texts in _chunks(enumerate(batch.column(2).to_pylist())):
                found = _present(texts, used)
                cut = np.searchsorted(found >> BITS, np.arange(len(texts) + 1))
                places = number[found & ((1 << BITS) - 1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([h.take(pa.array(own)), y.take(pa.array(own)), pa.array([places[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["h", "y", "places"])

    parts = max(1, int(n.sum()) // 2000)
    dealt = rows.select("h", "toxic", "text").repartition(parts, "h").sortWithinPartitions("h", "toxic")
    found = written(dealt.mapInArrow(features, "h long, y int, places binary"))
    share = 0.5 / n[0], 0.5 / n[1]
    # features scaled to a common curvature
    x = r[used] / np.sqrt((counts[0, used] * share[0] + counts[1, used] * share[1]) * r[used] ** 2 + 1e-3)

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = _gradient(found, x, v, share)
        slope[:-1] += penalty * v[:-1]
        return loss + penalty / 2 * float(v[:-1] @ v[:-1]), slope

    v = minimise(value, np.zeros(len(x) + 1))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x * v[:-1]
    return weights, float(v[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score of each whole text."""
    weights, bias = model
    used = weights != 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(text_rows(batches)):
            found = _present(texts, used)
            z = np.bincount(found >> BITS, weights[found & ((1 << BITS) - 1)], len(texts)) + bias
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p)], ["doc_id", "score"])

    return documents_of(docs).mapInArrow(run, "doc_id long, score double")
