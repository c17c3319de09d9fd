"""Suffix-array dedup, only as deep as it needs to be: which 50-byte strings of a document also start in an earlier one.

The order of suffixes matters only through ``length`` bytes, and only where a string repeats. Suffixes are therefore
sorted most significant digit first, and whatever is alone is dropped after each digit.

Digit 1, over the whole corpus, is not the string's first bytes, which would have few and very unequal values: every string holds an anchor, the 16-byte gram of smallest hash in it, and equal strings
hold it at the same place. Blocks of documents send 32 hash bits of their distinct anchors to buckets; a bucket answers
with one bit, whether another document has the anchor too. Neighbouring strings share anchors, so this is about one
short number per 18 bytes of text.

Digits 2 to 8, within a bucket: for the anchors left, blocks send the bytes around them once per distinct surroundings,
with the smallest doc_id that has them. Strings of one anchor are sorted by 8 bytes at a time; groups that stay together
through all ``length`` bytes are exactly the repeated strings. The smallest doc_id of each goes back to the blocks, which
remove a string where that is smaller than the document's own. However many documents hold a passage, a block sends it
once. Blocks are written to the shared folder once, and every step starts from there. The number of buckets follows the
number of blocks, so a bucket stays as large whatever the input.

Defined results: null text is empty; text of fewer bytes than ``length`` is kept whole; rows without a doc_id are
neither compared nor changed; rows that share a doc_id are one document, none earlier than the other; a text of any
length that Spark holds is a block of its own if it is longer than one, and is gone over in slabs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import documents_of, grouped, partitions, raw_rows, written

LENGTH, GRAM, BLOCK = 50, 16, 4 << 20
#: strings whose anchors are found together: few enough for arrays of 8 bytes each to stay in a processor's cache
SLAB = 1 << 16
_PLACE = (1 << 31) - 1


def _pack(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=(1 << 31) - 1)


def blocks(docs: DataFrame) -> DataFrame:
    """block, docs: documents packed, about BLOCK bytes of text in each row, written to the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            data = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
            with pa.ipc.new_stream(sink, data.schema) as w:
                w.write_batch(data)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_pack(sink.getvalue().to_pybytes(), 3)], pa.binary())], ["block", "docs"])

        for doc_id, text in raw_rows(batches):
            if ids and len(text or b"") > BLOCK:
                yield out()
                n, size, ids, texts = n + 1, 0, [], []
            ids.append(doc_id), texts.append(text or b"")
            size += len(texts[-1])
            if size > BLOCK:
                yield out()
                n, size, ids, texts = n + 1, 0, [], []
        if ids:
            yield out()

    return written(documents_of(docs).mapInArrow(run, "block long, docs binary"))


class Block:
    """Documents end to end, and the anchors of their strings: for each, the first of the run of strings that hold it."""

    def __init__(self, packed: bytes, buckets: int, length: int):
        rows = pa.ipc.open_stream(_open(packed)).read_all()
        self.ids = rows.column("doc_id").to_pylist()
        texts = rows.column("text").to_pylist()
        self.data = b"".join(texts)
        self.cut = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
        self.doc = np.array([x or 0 for x in self.ids], np.int64)
        own = np.array([x is not None for x in self.ids], bool)
        starts = max(0, len(self.data) - length + 1)
        # anchors of a slab of strings at a time: a long text takes little beside itself
        found = [self._slab(i, min(i + SLAB, starts), own, length) for i in range(0, starts, SLAB)]
        empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        self.first, self.many, self.at, self.row, self.key = (np.concatenate(x) for x in zip(empty, *found))
        self.bucket = ((self.key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    def _slab(self, lo: int, hi: int, own: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """first, many, at, row, key of the anchors of the strings that start at lo to hi."""
        size = hi - lo + length - 1
        at8 = np.ndarray((size - 7,), "<u8", self.data, offset=lo, strides=(1,))
        h = at8[: size - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += at8[8 : size - GRAM + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        low = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        wide, span = length - GRAM + 1, 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        place = (low & np.uint64(_PLACE)).astype(np.int64)
        # strings that cross documents, or are of rows without doc_id, are no strings
        first = np.clip(self.cut[:-1], lo, hi)
        count = np.where(own, np.maximum(np.clip(self.cut[1:] - length + 1, lo, hi) - first, 0), 0)
        row = np.repeat(np.arange(len(count)), count)
        s = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))
        p = place[s - lo]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (row[1:] != row[:-1])]) if len(s) else np.zeros(0, np.int64)
        key = h[p[new]] * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        return s[new], np.diff(np.r_[new, len(s)]) if len(s) else new, p[new] + lo, row[new], key

    def _dealt(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, hash bits of its distinct anchors in order, its anchors, each one's place in that order)."""
        bits = (self.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        if not len(bits):
            return
        order = np.argsort(self.bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.bucket[order])) + 1):
            seen, back = np.unique(bits[part], return_inverse=True)
            yield int(self.bucket[part[0]]), seen, part, back

    def anchors(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, hash bits of its distinct anchors in order, whether several documents here have it, its anchors, each one's place in that order)."""
        for bucket, seen, part, back in self._dealt():
            doc = self.doc[self.row[part]]
            least, most = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), np.iinfo(np.int64).min)
            np.minimum.at(least, back, doc)
            np.maximum.at(most, back, doc)
            yield bucket, seen, least != most, part, back

    def entries(self, flags: dict[int, bytes], length: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, distinct surroundings of its repeated anchors, smallest doc_id of each, anchors, each anchor's surroundings)."""
        for bucket, seen, part, back in self._dealt():
            flag = np.unpackbits(np.frombuffer(flags.get(bucket, b""), np.uint8), count=len(seen)).astype(bool)
            part = part[flag[back]]
            if not len(part):
                continue
            found: dict[bytes, int] = {}
            data, which = self.data, np.empty(len(part), np.int64)
            for i, (a, n, p) in enumerate(zip(self.first[part].tolist(), self.many[part].tolist(), self.at[part].tolist())):
                which[i] = found.setdefault(bytes((p - a,)) + data[a : a + n + length - 1], len(found))
            least = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(least, which, self.doc[self.row[part]])
            yield bucket, list(found), least, part, which


def _same(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a) - 1


def least_docs(entries: list[bytes], docs: np.ndarray, length: int, most: int = 1 << 20) -> list[np.ndarray]:
    """For each entry (place of its anchor, then bytes) the smallest doc_id of each of its strings, by most-significant-digit passes."""
    grams: dict[bytes, list[int]] = {}
    for i, e in enumerate(entries):
        grams.setdefault(e[1 + e[0] : 1 + e[0] + GRAM], []).append(i)
    many = np.array([len(e) - length for e in entries], np.int64)
    out: list[np.ndarray] = [np.full(n, d) for n, d in zip(many.tolist(), docs.tolist())]
    todo: list[int] = []
    gram: list[int] = []
    for k, own in enumerate(grams.values()):
        if len(own) > 1:
            todo += own
            gram += [k] * len(own)
            if sum(many[own]) > most or len(todo) * length > most:
                _sort(entries, docs, many, np.array(todo), np.array(gram), length, out)
                todo, gram = [], []
    if todo:
        _sort(entries, docs, many, np.array(todo), np.array(gram), length, out)
    return out


def _sort(entries: list[bytes], docs: np.ndarray, many: np.ndarray, own: np.ndarray, gram: np.ndarray, length: int, out: list[np.ndarray]) -> None:
    data = b"".join([entries[i][1:] for i in own]) + bytes(8)
    n = many[own]
    base = np.r_[0, np.cumsum(n + length - 1)][:-1]
    e = np.repeat(np.arange(len(own)), n)
    t = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    start, doc = base[e] + t, docs[own][e]
    least = doc.copy()
    # equal strings have the anchor at the same place in them
    group = gram[e] * (length + 1) + np.array([entries[i][0] for i in own])[e] - t
    digits = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    live = np.arange(len(e))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        digit = digits[start[live] + at].astype(np.uint64)
        order = np.lexsort((digit, group[live]))
        live, g, d = live[order], group[live][order], digit[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]
        group[live] = _same(new)
        alone = new & np.r_[new[1:], True]
        live = live[~alone]
        if not len(live):
            break
    if len(live):
        g = group[live]
        new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        least[live] = np.repeat(np.minimum.reduceat(doc[live], new), np.diff(np.r_[new, len(live)]))
    for i, x in zip(own.tolist(), np.split(least, np.cumsum(n)[:-1])):
        out[i] = x


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept (binary), spans (array of {start, end} in bytes of the input)."""
    if not GRAM + 8 <= length < 128:
        raise ValueError(f"length must be from {GRAM + 8} to 127")
    packed = blocks(docs)
    buckets = partitions(docs.sparkSession, packed.count() * BLOCK)
    batch = pa.RecordBatch.from_arrays

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(k, _pack(seen.tobytes() + np.packbits(several).tobytes())) for k, seen, several, _, _ in Block(data.as_py(), buckets, length).anchors()]
                sizes = pa.array([k for k, _ in rows], pa.int32())
                yield batch([pa.array([block] * len(rows), pa.int64()), sizes, pa.array([x for _, x in rows], pa.binary())], ["block", "bucket", "asked"])

    def repeated(rows: pa.Table) -> pa.Table:
        data = [_open(x.as_py()) for x in rows.column("asked")]
        # n numbers of 4 bytes and n bits: 33 n bits, rounded up to bytes
        n = [8 * len(x) // 33 for x in data]
        seen = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(data, n)])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, -1, 4 * k), count=k) for x, k in zip(data, n)])
        _, back, count = np.unique(seen, return_inverse=True, return_counts=True)
        flag = (count > 1) | (np.bincount(back, several) > 0)
        out = [np.packbits(x).tobytes() for x in np.split(flag[back], np.cumsum(n)[:-1])]
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "flags"])

    def opened(rows: pa.Table, column: str) -> dict[int, bytes]:
        return dict(zip(rows.column("bucket").to_pylist(), rows.column(column).to_pylist()))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        flags, rows = opened(right, "flags"), []
        for block, data in zip(left.column("block").to_pylist(), left.column("docs")):
            for k, found, least, _, _ in Block(data.as_py(), buckets, length).entries(flags, length):
                sizes = np.fromiter(map(len, found), np.uint32, len(found))
                rows.append((block, k, _pack(np.uint32(len(found)).tobytes() + sizes.tobytes() + least.tobytes() + b"".join(found), 3)))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "bucket", "sent"])

    def sort(rows: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        least: list[np.ndarray] = []
        which = []
        for x in rows.column("sent"):
            data = _open(x.as_py())
            n = int(np.frombuffer(data, np.uint32, 1)[0])
            ends = 4 + 12 * n + np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)
            least.append(np.frombuffer(data, np.int64, n, 4 + 4 * n))
            starts = [4 + 12 * n, *ends[:-1].tolist()]
            which.append(np.array([known.setdefault(data[i:j], len(known)) for i, j in zip(starts, ends.tolist())], np.int64))
        docs_ = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(docs_, np.concatenate(which), np.concatenate(least))
        found = least_docs(list(known), docs_, length)
        out = [_pack(np.concatenate([found[i] for i in w]).tobytes()) for w in which]
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "least"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        has = right.column("kind").to_pylist()
        flags = opened(right.filter(pa.array([k == 0 for k in has], pa.bool_())), "data")
        least = opened(right.filter(pa.array([k == 1 for k in has], pa.bool_())), "data")
        out: list[list] = [[], [], [], [], [], []]
        for data in left.column("docs"):
            block = Block(data.as_py(), buckets, length)
            # a string starts and one ends at each place at most, and length is below 128
            edge = np.zeros(len(block.data) + 1, np.int8)
            for k, found, _, part, which in block.entries(flags, length):
                docs_ = np.frombuffer(_open(least[k]), np.int64)
                base = np.r_[0, np.cumsum([len(x) - length for x in found])]
                n = block.many[part]
                a = np.repeat(np.arange(len(part)), n)
                t = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                s = (block.first[part][a] + t)[docs_[base[which[a]] + t] < block.doc[block.row[part]][a]]
                edge[s] += np.int8(1)
                edge[s + length] -= np.int8(1)
            gone = np.cumsum(edge[:-1], dtype=np.int8) > 0
            raw = np.frombuffer(block.data, np.uint8)
            for doc_id, i, j in zip(block.ids, block.cut[:-1].tolist(), block.cut[1:].tolist()):
                own = gone[i:j]
                turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                spans = [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]
                kept = block.data[i:j] if not spans else raw[i:j][~own].tobytes()
                for c, x in zip(out, (doc_id, j - i, j - i - len(kept), len(spans), kept, spans)):
                    c.append(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)

    by = lambda df: grouped(df, "block", buckets)
    flags = written(grouped(packed.mapInArrow(ask, "block long, bucket int, asked binary"), "bucket", buckets).applyInArrow(repeated, "block long, bucket int, flags binary"))
    least = grouped(by(packed).cogroup(by(flags)).applyInArrow(send, "block long, bucket int, sent binary"), "bucket", buckets).applyInArrow(sort, "block long, bucket int, least binary")
    told = flags.select("block", "bucket", F.lit(0).alias("kind"), F.col("flags").alias("data")).unionByName(least.select("block", "bucket", F.lit(1).alias("kind"), F.col("least").alias("data")))
    return by(packed).cogroup(by(told)).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
