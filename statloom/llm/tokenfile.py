"""Token ids as files of byte planes.

Documents are range-partitioned by doc_id, so file order is doc_id order. A file part holds whole documents, about
PART ids; within a part, ids end to end are cut into blocks of BLOCK ids. A block's ids are transposed into four byte
planes (the lowest bytes of all ids, then the next, ...), and each plane is compressed with zstandard. A block's row is
also its entry in the chunk index: part, block, number of ids, and the documents that start in it, each with its place
in the part. Rows are written by Spark's Parquet writer, so the files can be in any store, a lost task is written anew,
and half a file is never seen. Where a part starts in the whole follows from the index alone.

Defined results: null text is empty, only its end id is written; rows without a doc_id come first; rows that share a
doc_id are written each, in the order of their texts. An empty table has no file part and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.bpe import _CHUNK, _ODD, _WORD, WordEncoder, chunks_of, kept
from statloom.llm.common import documents_of, text_rows, trim

BLOCK, PART, MEMO, WORDS = 1 << 13, 1 << 22, 400_000, 900_000
#: texts that are encoded together: as many, or of as many characters
TEXTS, CHARS = 1000, 4 << 20
_CUT, _NONE = re.compile(_WORD.pattern + "|\n"), (1 << 32) - 1
_LINE = _NONE.to_bytes(4, "little")
FORMAT = "part long, block int, n_ids int, planes array<binary>, docs array<struct<doc_id:long,start:long,n_tokens:long>>"


class Memo:
    """Ids of white-space chunks, kept between tasks in a worker.

    The first MEMO chunks and WORDS words stay; frequent ones come early, so what is met later is rare and is encoded
    again where it occurs. That changes no result. Many texts are encoded together: Arrow cuts them and finds their
    distinct chunks, each is looked up once, and a chunk is cut into words only when it is new.
    """

    def __init__(self, definition: str):
        self.encoder, self.ids, self.words = WordEncoder.load(definition), {}, {}

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        whole = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(whole, _ODD.pattern)
        # texts without odd characters have no white space but blanks, tabs and line ends, and lower case letter by letter
        plain = pc.ascii_split_whitespace(pc.utf8_lower(whole.filter(pc.invert(odd))))
        cut = [chunks_of(x) for x, o in zip(texts, odd.to_pylist()) if o]
        flat = pa.array([c for own in cut for c in own], pa.string())
        own = iter(self._texts(plain.flatten(), plain.offsets.to_numpy(), end)), iter(self._texts(flat, np.r_[0, np.cumsum(list(map(len, cut)), dtype=np.int64)], end))
        return [next(own[o]) for o in odd.to_pylist()]

    def _texts(self, chunks: pa.Array, offsets: np.ndarray, end: bytes) -> list[bytes]:
        """Ids, and ``end``, of texts whose chunks are those between two offsets."""
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.ids.get, distinct))
        holes = [k for k, x in enumerate(found) if x is None]
        new = self._encoded([distinct[k] for k in holes])
        for k, x in zip(holes, new.values()):
            found[k] = x
        if len(self.ids) < MEMO:
            self.ids.update(new)
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, places, data = ids.buffers()
        if not len(ids):
            return [end] * (len(offsets) - 1)
        at, raw = np.frombuffer(places, np.int64)[offsets].tolist(), memoryview(data) if data else memoryview(b"")
        return [bytes(raw[i:j]) + end for i, j in zip(at, at[1:])]

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks, in their order."""
        own = [c for c in chunks if c[:1] != _CHUNK]
        # a line end after each chunk, which no word has
        words = _CUT.findall("\n".join([*own, ""])) if own else []
        distinct = {*words, *(c for c in chunks if c[:1] == _CHUNK)} - {"\n"}
        ids = {w: x for w in distinct if (x := self.words.get(w)) is not None}
        rare = list(distinct.difference(ids))
        fresh = dict(zip(rare, self.encoder.encode_raw(rare)))
        if len(self.words) < WORDS:
            self.words.update(fresh)
        ids |= fresh
        ids["\n"] = _LINE
        raw = b"".join(map(ids.__getitem__, words))
        ends = 4 * np.flatnonzero(np.frombuffer(raw, "<u4") == _NONE)
        cut = dict(zip(own, (raw[i:j] for i, j in zip([0, *(ends + 4).tolist()], ends.tolist()))))
        return {c: cut[c] if c[:1] != _CHUNK else ids[c] for c in chunks}


def planes(ids: bytes) -> list[bytes]:
    """Compressed byte planes of little-endian unsigned 32-bit ids."""
    packer = zstandard.ZstdCompressor(level=3)
    return [packer.compress(p.tobytes()) for p in np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T)]


def ids_of(packed: list[bytes], n: int) -> bytes:
    """The inverse of planes()."""
    opener = zstandard.ZstdDecompressor()
    return np.ascontiguousarray(np.stack([np.frombuffer(opener.decompress(p, max_output_size=n), np.uint8) for p in packed]).T).tobytes()


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Writes the ids of each whole document and ``end_id`` behind them to ``path``."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("memo-" + hashlib.sha256(definition.encode()).hexdigest(), lambda: Memo(definition))
        part, block, size, held, starts = TaskContext.get().partitionId() << 24, 0, 0, bytearray(), []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, starts
            cut = 0
            while len(held) - cut >= 4 * BLOCK or (last and cut < len(held)):
                ids = bytes(held[cut : cut + 4 * BLOCK])
                first, stop = block * BLOCK, block * BLOCK + len(ids) // 4
                here = [s for s in starts if s[1] < stop]
                starts = starts[len(here) :]
                row = {"part": part, "block": block, "n_ids": stop - first, "planes": planes(ids), "docs": [dict(zip(("doc_id", "start", "n_tokens"), s)) for s in here]}
                yield pa.RecordBatch.from_pylist([row], _ARROW)
                block, cut = block + 1, cut + len(ids)
            del held[:cut]

        waiting: list[tuple[int | None, str]] = []

        def put() -> None:
            nonlocal size
            for (doc_id, _), ids in zip(waiting, memo.encode([t for _, t in waiting], end)):
                starts.append((doc_id, size, len(ids) // 4))
                held.extend(ids)
                size += len(ids) // 4
            waiting.clear()

        chars = 0
        for doc_id, text in text_rows(batches):
            chars += len(text or "")
            if waiting and (len(waiting) == TEXTS or chars > CHARS):
                put()
                yield from out(size >= PART)
                if size >= PART:
                    part, block, size = part + 1, 0, 0
                chars = len(text or "")
            waiting.append((doc_id, text or ""))
        put()
        yield from out(True)
        trim()

    dealt = documents_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, FORMAT).write.option("compression", "uncompressed").parquet(path)


_ARROW = pa.schema(
    [
        ("part", pa.int64()),
        ("block", pa.int32()),
        ("n_ids", pa.int32()),
        ("planes", pa.list_(pa.binary())),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))),
    ]
)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of each document, read from the files.

    With ``digest``, ids_crc32 (long, over the bytes of the ids) stands for the ids.
    """
    files = spark.read.schema(FORMAT).parquet(path)
    # a row for each part, at least PART ids: few beside documents
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    last, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        ids = memoryview(b"".join(ids_of(p, n) for p, n in zip(rows.column("planes").to_pylist(), rows.column("n_ids").to_pylist())))
        found = [d for own in rows.column("docs").to_pylist() for d in own]
        part = rows.column("part")[0].as_py()
        own = (ids[4 * d["start"] : 4 * (d["start"] + d["n_tokens"])] for d in found)
        cols = [pa.array([part] * len(found), pa.int64()), *(pa.array([d[c] for d in found], pa.int64()) for c in ("doc_id", "start", "n_tokens")), pa.array([zlib.crc32(x) if digest else x.tobytes() for x in own], kind)]
        return pa.table(cols, ["part", "doc_id", "start", "n_tokens", last])

    each = files.groupBy("part").applyInArrow(join, f"part long, doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")
    return each.join(base, F.col("part") == F.col("of")).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", last)
