"""Language ID by rank-order profiles: the out-of-place distance between a document's and each language's most frequent n-grams.

N-grams are one to three characters of the lower-cased text, of which every run without letters is one blank. A
language's profile is its ``k`` most frequent n-grams over all learning rows, counted in Spark; at most ``k`` rows a
language reach the driver. Ties of frequency go by code points, ties of distance to the smaller language name.

Defined results: null text or text without a letter is ``und`` with score 0, as is everything if nothing was learned;
rows without a language teach nothing; a null doc_id is kept; repeated rows count and are scored each time; a text of any
length is counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import documents_of, short_batches, text_rows, trim

UND = "und"
_BREAK = re.compile(r"[\W\d_]+")
_HELD = 1 << 19


def gram_codes(text: str | None) -> np.ndarray | None:
    """A number for each n-gram occurrence, or None if there is no letter. Each character takes 21 bits."""
    s = _BREAK.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, s)):
        return None
    a = np.frombuffer(f" {s} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (a[:-1] << 21) | a[1:]
    return np.concatenate([a[a != 32], two, (two[:-1] << 21) | a[2:]])


def top_grams(codes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` most frequent codes, most frequent first, ties by code."""
    codes = np.sort(codes)
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    n = np.diff(np.r_[at, len(codes)])
    kept = np.arange(len(n))
    if len(n) > k:
        kept = np.flatnonzero(n >= np.partition(n, len(n) - k)[len(n) - k])
    return codes[at[kept[np.argsort(-n[kept], kind="stable")[:k]]]]


def fit(docs: DataFrame, learn: Column | None = None, k: int = 400) -> dict[str, np.ndarray]:
    """Profiles by language from the rows with ``lang`` and text, those for which ``learn`` holds if it is given."""
    rows = short_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = (rows if learn is None else rows.where(learn)).select(F.col("lang").cast("string"), F.col("text").cast("string"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def close(lang: str) -> None:
            codes, n = np.unique(np.concatenate(open_.pop(lang)), return_counts=True)
            if lang in sums:
                codes, at = np.unique(np.concatenate([sums[lang][0], codes]), return_inverse=True)
                n = np.bincount(at, np.concatenate([sums[lang][1], n])).astype(np.int64)
            sums[lang] = codes, n
            size[lang] = 0

        for lang, text in text_rows(batches):
            if (codes := gram_codes(text)) is not None:
                open_.setdefault(lang, []).append(codes)
                size[lang] = size.get(lang, 0) + len(codes)
                if size[lang] > _HELD:
                    close(lang)
        for lang in list(open_):
            close(lang)
        for lang, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n, pa.int64())], ["lang", "code", "n"])
        trim()

    counted = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    found: dict[str, list] = {}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= k).select("lang", "code", "rank").collect():
        found.setdefault(r.lang, []).append((r.rank, r.code))
    return {lang: np.array([c for _, c in sorted(x)], np.int64) for lang, x in sorted(found.items())}


class Profiles:
    """Profiles laid out to score one document against all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], k: int):
        self.langs, self.k = sorted(profiles), k
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.int64)]))
        self.ranks = np.full((len(profiles), len(self.codes)), -1)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = gram_codes(text) if self.langs else None
        if codes is None:
            return UND, 0.0
        top = top_grams(codes, self.k)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        there = self.ranks[:, at[known]]
        far = np.where(there < 0, self.k, np.abs(there - np.flatnonzero(known))).sum(axis=1) + self.k * int((~known).sum())
        best = int(far.argmin())
        return self.langs[best], 1 - float(far[best]) / (self.k * len(top))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], k: int = 400) -> DataFrame:
    """doc_id, lang_pred, score for each document; only the text is looked at."""
    model = Profiles(profiles, k) if profiles else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text) if model else (UND, 0.0) for _, text in text_rows([batch])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])
        trim()

    return documents_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], k: int = 400, min_score: float = 0.0) -> DataFrame:
    """The documents, all columns, without those whose language can't be told (``und``) or that score less than ``min_score``."""
    model, at = Profiles(profiles, k) if profiles else None, docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text) if model else (UND, 0.0) for _, text in text_rows([batch.select([at, at])])]
            yield batch.filter(pa.array([lang != UND and score >= min_score for lang, score in found], pa.bool_()))
        trim()

    return short_batches(docs).mapInArrow(run, docs.schema)
