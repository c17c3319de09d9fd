"""BPE encoding and decoding through a distinct-word table.

Documents are dealt into blocks of a few megabytes. Each block names its distinct words; they meet by a hash of the word
in as many buckets as there are shuffle partitions, where every distinct word of the corpus is encoded once. The ids go
back to the blocks that asked, and a block joins them to its words by position. So only distinct words, packed and
compressed, and the compressed blocks are shuffled, never a row per word. Decoding joins ids to the vocabulary's pieces,
a table of fixed size.

A word is a piece of the tokenizer's own pre-tokenization. For plain Latin text that is a regular expression here; any
other text is cut at white space only, which no step of the tokenizer crosses, and each chunk, special tokens included,
goes through the whole tokenizer. Blocks are formed from the order of rows in a partition; if a recomputed partition
comes in another order, a word that the table then lacks is encoded where it is missed, so the result never depends on it.

Defined results: null text is the empty text, with no ids; a null doc_id and repeated rows are kept as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import documents_of, free, grouped, partitions, short_batches, text_rows, trim

BLOCK = 4 << 20
# Characters that the regular expression below treats as the tokenizer does: letters whose lower case is one letter, and
# signs; all stay as they are under NFC unless a combining mark follows, which is none of them.
_UPPER = "A-Z\xc0-\xd6\xd8-\xde\u0100-\u012f\u0132-\u0148\u014a-\u017e\u0400-\u042f"
_LOWER = "a-z\xdf-\xf6\xf8-\xff\u0131\u0430-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
_SIGN = "!-/:-@\\[-`{-~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_LETTER = _LOWER + "\u0101-\u012f\u0132-\u0148\u014a-\u017e"
_ODD = re.compile(f"[^\t\n\r 0-9{_UPPER}{_LOWER}{_SIGN}]|<\\|")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
_BLANK = re.compile("[ \t\n\r]+")
_CHUNK = "\0"


def kept(key: str, make: Callable[[], Any]) -> Any:
    """``make()`` once per Python process; workers live through many tasks."""
    held = sys.modules.setdefault("_statloom_kept", types.ModuleType("_statloom_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def chunks_of(text: str) -> list[str]:
    """The chunks between white space, in lower case; those for the whole tokenizer as they are, marked by a leading zero character."""
    if _ODD.search(text) is None:
        return text.lower().split()
    return [_CHUNK + x if _ODD.search(x) else x.lower() for x in _BLANK.split(text) if x]


def cut_chunk(chunk: str) -> list[str]:
    """The words of a chunk in order."""
    return [chunk] if chunk[0] == _CHUNK else _WORD.findall(chunk)


def words_of(text: str) -> list[str]:
    """The words of a text in order."""
    if _ODD.search(text) is None:
        return _WORD.findall(text.lower())
    return [w for c in chunks_of(text) for w in cut_chunk(c)]


class WordEncoder:
    """Ids of single words of one tokenizer file of the word-end kind (byte-level letters, ``</w>``)."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(definition)
        if spec["model"].get("end_of_word_suffix") != "</w>" or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer is not of the kind that words can be encoded one by one for")
        self.whole = Tokenizer.from_str(definition)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.pieces = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = piece
        self.ends = np.array([p.endswith("</w>") for p in self.pieces])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in plain)} | {32: " "}

    @staticmethod
    def load(definition: str) -> WordEncoder:
        return kept("encoder-" + hashlib.sha256(definition.encode()).hexdigest(), lambda: WordEncoder(definition))

    def encode_raw(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if w[0] != _CHUNK]
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            joined = " ".join([words[i] for i in some]).encode().decode("latin1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(some):
                raise AssertionError("a word's last piece is not marked")
            raw = ids.tobytes()
            for i, a, b in zip(some, [0, *cut], cut):
                out[i] = raw[a:b]
        if len(plain) < len(words):
            for i, w in enumerate(words):
                if w[0] == _CHUNK:
                    out[i] = np.array(self.whole.encode(w[1:], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (unsigned 32-bit)."""
        return [np.frombuffer(x, np.uint32) for x in self.encode_raw(words)]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], list[str]]]:
    """(block number, doc_ids, texts) of at most about BLOCK characters."""
    base, n, size = TaskContext.get().partitionId() << 32, 0, 0
    ids, texts = [], []
    for doc_id, text in text_rows(batches):
        if ids and len(text or "") > BLOCK:
            yield base + n, ids, texts
            n, size, ids, texts = n + 1, 0, [], []
        ids.append(doc_id), texts.append(text or "")
        size += len(texts[-1])
        if size > BLOCK:
            yield base + n, ids, texts
            n, size, ids, texts = n + 1, 0, [], []
    if ids:
        yield base + n, ids, texts


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, binary) of each whole document.

    ``tokenizer`` is the path of the tokenizer's file on the driver; its content travels with the tasks.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    docs = documents_of(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions(docs.sparkSession, size)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            words: set[str] = set()
            for text in texts:
                words.update(words_of(text))
            dealt: dict[int, list[bytes]] = {}
            for w in map(str.encode, words):
                dealt.setdefault(zlib.crc32(w) % buckets, []).append(w)
            rows = [(k, _pack(b"\n".join(sorted(x)))) for k, x in dealt.items()]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "bucket", "words"])
        trim()

    def answer(rows: pa.Table) -> pa.Table:
        encoder = WordEncoder.load(definition)
        asked = [_open(x.as_py()).decode().split("\n") for x in rows.column("words")]
        distinct = list(set().union(*asked))
        ids = dict(zip(distinct, encoder.encode(distinct)))
        out = []
        for words in asked:
            own = [ids[w] for w in words]
            out.append(_pack(np.fromiter(map(len, own), np.uint32, len(own)).tobytes() + np.concatenate(own).astype(np.uint32).tobytes()))
        del asked, distinct, ids
        trim()
        return pa.table([rows.column("block"), rows.column("words"), pa.array(out, pa.binary())], ["block", "words", "ids"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            sink = pa.BufferOutputStream()
            data = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
            with pa.ipc.new_stream(sink, data.schema) as w:
                w.write_batch(data)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_pack(sink.getvalue().to_pybytes())], pa.binary())], ["block", "docs"])
        trim()

    def put(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.load(definition)
        ids: dict[str, bytes] = {}
        for words, packed in zip(right.column("words"), right.column("ids")):
            words, data = _open(words.as_py()).decode().split("\n"), np.frombuffer(_open(packed.as_py()), np.uint32)
            ids.update(zip(words, (x.tobytes() for x in np.split(data[len(words) :], np.cumsum(data[: len(words)])[:-1]))))
        for packed in left.column("docs"):
            out: tuple[list, list[bytes]] = ([], [])
            for doc_id, text in text_rows(pa.ipc.open_stream(_open(packed.as_py())).read_all().to_batches()):
                words = words_of(text)
                if missing := list({w for w in words if w not in ids}):
                    ids.update(zip(missing, encoder.encode_raw(missing)))
                out[0].append(doc_id), out[1].append(b"".join(map(ids.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([len(x) // 4 for x in out[1]], pa.int64()), pa.array(out[1], pa.binary())], schema=_SCHEMA)
        ids.clear()
        trim()

    answered = grouped(docs.mapInArrow(ask, "block long, bucket int, words binary"), "bucket", buckets).applyInArrow(answer, "block long, words binary, ids binary")
    packed = docs.mapInArrow(pack, "block long, docs binary")
    both = grouped(packed, "block", buckets).cogroup(grouped(answered, "block", buckets))
    return both.applyInArrow(lambda a, b: pa.Table.from_batches(list(put(a, b)), _SCHEMA), "doc_id long, n_tokens long, ids binary")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded``, all columns, and ``decoded``: the text that the tokenizer decodes from the binary column ``ids``.

    Each id is joined with its piece, and the pieces of a row are joined by blanks, as this kind of tokenizer has no
    decoder of its own; special tokens are kept. An id that the vocabulary lacks raises an error.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    encoded, name = short_batches(encoded), free(encoded, "decoded")
    at, fields = encoded.columns.index(ids), [*encoded.schema.fields, T.StructField(name, T.StringType())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept("pieces-" + hashlib.sha256(definition.encode()).hexdigest(), lambda: pa.array(WordEncoder.load(definition).pieces, pa.large_string()))
        for batch in batches:
            sizes = np.fromiter((len(x) if x is not None else 0 for x in batch.column(at).to_pylist()), np.int64, batch.num_rows)
            # at most about 4 M ids at a time, and at least a row
            cut, i = np.cumsum(sizes) // (16 << 20), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(cut, cut[i], "right")))
                raw = [x or b"" for x in batch.column(at)[i:j].to_pylist()]
                found = pieces.take(pa.array(np.frombuffer(b"".join(raw), "<u4")))
                ends = np.r_[0, np.cumsum(np.array([len(x) // 4 for x in raw], np.int64))]
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), found), pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, text.cast(pa.string())], [f.name for f in fields])
                i = j

    return encoded.mapInArrow(run, T.StructType(fields))


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from the ids."""
    return decode(encode(docs, tokenizer), tokenizer)
