"""SimHash near-duplicates by a binary trie self-join, and the components that the links form.

``near_duplicates`` links 64-bit fingerprints of 3-word shingles that differ in at most 3 bits.

Fingerprints are made once and written; equal fingerprints collapse to one row before anything is compared, so a group
of exact copies of any size is a single row. The join follows a binary trie: two nodes of equal depth are walked
together, differing bits add up, and a pair of nodes is left as soon as they exceed the error budget. To spread the trie
over a cluster it is rooted four times, each time with another 16-bit block of the fingerprint on top: of four blocks at
least one is free of errors if at most three bits differ, so each rooted trie only walks pairs below the same top node.
A top node with very many fingerprints is rooted again in the same way by one of four 12-bit blocks of the rest. No
pair is lost and none is capped. Of a group, only a spanning forest of its links leaves the task.

``similar`` links documents of a given Jaccard similarity, by default 0.8 over 5-word shingles, which lie some 10 bits of
64 apart: no block of bits is free of errors, and a trie with that budget visits nearly all pairs of nodes. So its tries
are rooted by bands of MinHash values instead, the budget is held against 256 bits (``differing``), and a trie that is
too large for a task is cut into cells after its members that are near its first one are linked to that one.

Defined results: null or blank text has fingerprint 0, linked like any other; a null doc_id keeps its row and never
names a component, unless no row of the component has one, when component_id is null; repeated rows stay repeated; a text
of any length is hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import documents_of, free, raw_rows, trim, written

#: A rooted subtree of more fingerprints than this is rooted once more.
HOT = 20_000
#: A band's trie of more members than this is cut into cells.
CELL = 50_000
#: Words of a sketch; bands, and MinHash values in each: at similarity 0.8 two documents share a band in 99.8 % of cases.
WORDS, BANDS, TOGETHER = 4, 12, 4
#: Documents that this many at least share a trie with are compared with its first members before it is walked.
_DENSE = 64
_ROWS = 1 << 14


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, as a signed integer: a bit is 1 if set in over half of the shingles' XXH64."""
    votes, n = np.zeros(64, np.int64), 0
    for some in _digests(text, width, seed):
        bits = np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def _digests(text: bytes | None, width: int, seed: int) -> Iterator[bytes]:
    """The shingles' XXH64 digests, 8 bytes each, in blocks."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < width:
        yield digest(joined, seed)
        return
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for k in range(0, len(first), _ROWS):
        yield b"".join([digest(joined[i:j], seed) for i, j in zip(first[k : k + _ROWS], last[k : k + _ROWS])])


def _mixed(x: np.ndarray, step: int) -> np.ndarray:
    """Another 64 bits from each of ``x``, by the finalizer of SplitMix64."""
    x = x + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: bytes | None, width: int = 5) -> tuple[list[int], list[int]]:
    """Four signed words, a SimHash of 256 bits of the set of shingles, and the keys of BANDS bands of MinHash values."""
    found = list(_digests(text, width, 42))
    h = np.unique(np.frombuffer(b"".join(found), ">u8").astype(np.uint64))
    votes, least = np.zeros((WORDS, 64), np.int64), np.full(BANDS * TOGETHER, (1 << 64) - 1, np.uint64)
    factors = _mixed(np.arange(len(least), dtype=np.uint64), 7) | np.uint64(1)
    for k in range(0, len(h), _ROWS // 4):
        some = h[k : k + _ROWS // 4]
        for w in range(WORDS):
            votes[w] += np.unpackbits(_mixed(some, w + 1).astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (some[:, None] * factors).min(axis=0))
    words = np.packbits(2 * votes > len(h), axis=1).view(">i8").ravel().tolist()
    keys = [xxhash.xxh64_intdigest(least[b * TOGETHER : (b + 1) * TOGETHER].tobytes(), b) for b in range(BANDS)]
    return words, [x - (1 << 64) if x >> 63 else x for x in keys]


def differing(similarity: float, bits: int = 64 * WORDS) -> int:
    """How many of ``bits`` may differ: one and a half standard deviations above the mean at this Jaccard similarity.

    Sets of equal size and Jaccard similarity s have cosine 2s / (1 + s); a bit differs with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + 1.5 * math.sqrt(bits * p * (1 - p)))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp: the signed 64-bit fingerprint of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fps = [], []
        for doc_id, text in raw_rows(batches):
            ids.append(doc_id)
            fps.append(fingerprint(text, width))
            if len(ids) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])
                ids, fps = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        trim()

    return documents_of(docs).mapInArrow(run, "doc_id long, fp long")


def trie_links(values: np.ndarray, groups: np.ndarray, budget: int, depth: int = 64, most: int = 1 << 18, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``values`` (unsigned, sorted within ascending ``groups``) of one group that differ in at most ``budget`` bits.

    Walks node pairs depth first in slabs of at most about ``most`` pairs, so memory does not depend on how many match.
    Where ``known`` names a component of each position, pairs of nodes that lie in one component need not be walked.
    """
    n = len(values)
    if n < 2:
        return
    cut = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    lo, hi = cut[:-1], cut[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    ones: dict[int, np.ndarray] = {}
    turns = None if known is None else np.cumsum(np.r_[False, known[1:] != known[:-1]])
    stack = [(depth - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > most:
            for k in range(0, len(alo), most // 4):
                stack.append((bit, *(x[k : k + most // 4] for x in (alo, ahi, blo, bhi, err))))
            continue
        if turns is not None:
            open_ = (turns[alo] != turns[ahi - 1]) | (turns[blo] != turns[bhi - 1]) | (known[alo] != known[blo])
            alo, ahi, blo, bhi, err = (x[open_] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        small = (ahi - alo) * (bhi - blo) <= 16
        if bit < 0:
            small[:] = True
        if small.any():
            yield from _leaves(values, alo[small], ahi[small], blo[small], bhi[small], budget)
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1))].astype(np.int64)
        c = ones[bit]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same, other = alo == blo, err < budget
        also = other & ~same
        parts = [
            (alo, am, blo, bm, err),
            (am, ahi, bm, bhi, err),
            tuple(x[other] for x in (alo, am, bm, bhi, err + np.int8(1))),
            tuple(x[also] for x in (am, ahi, blo, bm, err + np.int8(1))),
        ]
        al, ah, bl, bh, er = (np.concatenate(x) for x in zip(*parts))
        live = (ah > al) & (bh > bl) & ~((al == bl) & (ah - al < 2))
        stack.append((bit - 1, al[live], ah[live], bl[live], bh[live], er[live]))


def _leaves(values: np.ndarray, alo, ahi, blo, bhi, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small node pairs, compared in full."""
    many, wide = (ahi - alo) * (bhi - blo), bhi - blo
    at = np.repeat(np.arange(len(alo)), many)
    k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    i, j = alo[at] + k // wide[at], blo[at] + k % wide[at]
    ok = (i < j) | (alo[at] != blo[at])
    i, j = i[ok], j[ok]
    near = np.bitwise_count(values[i] ^ values[j]) <= budget
    yield i[near], j[near]


def _forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """Smallest position of each position's component; ``root`` holds what is known of them."""
    root = np.arange(n) if root is None else root.copy()
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def near_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (u, v), u > v, between distinct fingerprints ``fp``; they span all links of at most ``budget`` (3) bits."""
    if budget != 3:
        raise ValueError("the rooted tries are laid out for a budget of 3 differing bits")
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    turned = F.array(*[F.struct(F.lit(r).alias("r"), F.shiftleft("fp", 16 * r).bitwiseOR(low(F.shiftrightunsigned("fp", 64 - 16 * r), 16 * r)).alias("v") if r else F.col("fp").alias("v")) for r in range(4)])
    rooted = fps.select("fp", F.explode(turned).alias("t")).select("fp", (F.shiftrightunsigned("t.v", 48) * 4 + F.col("t.r")).alias("k"), F.col("t.v").alias("v"))
    size = rooted.groupBy("k").count().where(F.col("count") > HOT).select("k", F.lit(True).alias("hot"))
    rest = low(F.col("v"), 48)
    again = [
        F.struct(
            (F.col("k") * 5 + 1 + s).alias("k"),
            low(F.shiftrightunsigned(rest, 36 - 12 * s), 12).alias("top"),
            F.shiftleft(rest, 16 + 12 * s).bitwiseOR(F.shiftleft(low(F.shiftrightunsigned(rest, 48 - 12 * s), 12 * s), 16) if s else F.lit(0).cast("long")).alias("v"),
        )
        for s in range(4)
    ]
    once = F.array(F.struct((F.col("k") * 5).alias("k"), F.lit(0).cast("long").alias("top"), F.shiftleft(rest, 16).alias("v")))
    laid = rooted.join(size, "k", "left").select("fp", F.explode(F.when(F.col("hot"), F.array(*again)).otherwise(once)).alias("t"))
    laid = laid.select("fp", (F.col("t.k") * 4096 + F.col("t.top")).alias("k"), F.col("t.v").alias("v"))
    # unsigned order of v: shift right by one bit, the lowest is always free
    dealt = laid.select("k", F.shiftrightunsigned("v", 1).alias("v"), "fp").repartition("k").sortWithinPartitions("k", "v")

    def walk(rows: np.ndarray) -> np.ndarray:
        return _forest(len(rows), trie_links(rows[:, 1].view(np.uint64).copy(), rows[:, 0], budget, 63))

    return dealt.mapInArrow(_by_tries(walk), "u long, v long").where("u != v").distinct()


def _by_tries(walk):
    """Runs ``walk`` (rows to component of each) over whole tries of rows (key, value, node, ...) that come in order; edges of nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            root = walk(rows)
            at = np.flatnonzero(root != np.arange(len(rows)))
            u, v = rows[at, 2], rows[root[at], 2]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            cut = np.flatnonzero(rows[:, 0] == rows[-1, 0])[0]  # the last group may go on
            if cut or (held and held[-1][-1, 0] != rows[-1, 0]):
                yield edges(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield edges(np.concatenate(held))
        held = rows = batch = None  # or trim() would find them in use
        trim()

    return run


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, w (four words) and bands of each row that has a doc_id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(ids, words, bands):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "w", "bands"])

        ids, words, bands = [], [], []
        for doc_id, text in raw_rows(batches):
            w, b = sketch(text, width)
            ids.append(doc_id)
            words.append(w)
            bands.append(b)
            if len(ids) == 4096:
                yield batch(ids, words, bands)
                ids, words, bands = [], [], []
        yield batch(ids, words, bands)
        trim()

    return documents_of(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, w array<long>, bands array<long>")


def _first_links(rows: np.ndarray, limit: int, rounds: int = 16) -> np.ndarray:
    """Components that large tries' members form with a few of their own, each in turn the first that is linked to none."""
    root = np.arange(len(rows))
    cut = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi - lo < _DENSE:
            continue
        left = np.arange(lo, hi)
        for _ in range(rounds):
            near = np.bitwise_count((rows[left, 3:] ^ rows[left[0], 3:]).view(np.uint64)).sum(axis=1) <= limit
            root[left[near]] = left[0]
            left = left[~near]
            if not len(left):
                break
    return root


def similar_links(members: DataFrame, limit: int) -> DataFrame:
    """Edges (u, v), u > v, between nodes ``m`` of ``members`` (m, w, bands) that share a band and differ in at most ``limit`` bits of w.

    They span all such links. In a trie of over CELL members, those that differ from its first member in few enough bits
    are linked to it and need not meet each other; the others meet all members, cell by cell.
    """
    words = [F.col("w")[i].alias(f"w{i}") for i in range(WORDS)]
    laid = written(members.select("m", F.explode("bands").alias("k"), *words))
    names = [f"w{i}" for i in range(WORDS)]
    sizes = laid.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("m", *names)).alias("head")).where("n > 1")
    sizes = written(sizes)
    more, cells = None, laid.join(sizes.where(F.col("n") <= CELL).select("k"), "k", "left_semi").select("k", *names, "m")
    large = sizes.where(F.col("n") > CELL)
    if not large.isEmpty():
        apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"head.{c}"))) for c in names)
        hot = written(laid.join(large, "k").withColumn("near", apart <= limit))
        more = hot.where("near AND m != head.m").select(F.greatest("m", "head.m").alias("u"), F.least("m", "head.m").alias("v"))
        parts = hot.where("NOT near").groupBy("k").agg(F.ceil(F.count("*") / CELL).cast("int").alias("xs"))
        cut = hot.join(parts, "k").withColumn("ys", F.ceil(F.col("n") / CELL).cast("int"))
        x, y = (F.pmod(F.xxhash64("m", F.lit(s)), F.col(c)).cast("int") for s, c in ((1, "xs"), (2, "ys")))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        whole = cut.select("k", "m", *names, each("xs").alias("x"), y.alias("y"))
        others = cut.where("NOT near").select("k", "m", *names, x.alias("x"), each("ys").alias("y"))
        cells = cells.unionByName(whole.unionByName(others).select(F.xxhash64("k", "x", "y").alias("k"), *names, "m").distinct())
    # unsigned order of 63 bits; the lowest of the first word is compared with the other words
    dealt = cells.select("k", F.shiftrightunsigned("w0", 1).alias("v"), "m", *names).repartition("k").sortWithinPartitions("k", "v")

    def walk(rows: np.ndarray) -> np.ndarray:
        known = _first_links(rows, limit)
        pairs = trie_links(rows[:, 1].view(np.uint64).copy(), rows[:, 0], min(limit, limit // WORDS + 13), 63, known=known)

        def near():
            for i, j in pairs:
                ok = np.bitwise_count((rows[i, 3:] ^ rows[j, 3:]).view(np.uint64)).sum(axis=1) <= limit
                yield i[ok], j[ok]

        return _forest(len(rows), near(), known)

    edges = dealt.mapInArrow(_by_tries(walk), "u long, v long")
    return (edges if more is None else edges.unionByName(more)).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (u, v): root is the smallest node reachable.

    Alternating large-star and small-star rounds; each is written to the shared folder. Stars are formed by a minimum
    per node joined back, so the neighbours of a node with very many never meet in one task.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")) if small else joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v"))) if small else out
        return out.where("u != v").distinct()

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h) or not seen.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = (seen.n, seen.h)
        now = written(star(star(now, small=False), small=True))


def near_duplicates(docs: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links)."""
    fps = written(fingerprints(docs, width))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("m"))
    roots = components(near_links(distinct.select("fp"), budget))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "m", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("m").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over links of documents of this Jaccard similarity of shingles.

    A link is judged by 256 bits, so by an estimate: see ``differing``. Rows without a doc_id are left out; rows that
    share one each have their component.
    """
    found = written(sketches(docs, width))
    members = written(found.groupBy("w", "bands").agg(F.min("doc_id").alias("m")))
    roots = components(similar_links(members, differing(similarity)))
    named = members.join(roots, members.m == roots.node, "left").select("w", "bands", F.coalesce("root", "m").alias("component_id"))
    return found.join(named, ["w", "bands"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The documents, all columns, without those that another of their component stands for (the smallest doc_id stays).

    Rows without a doc_id stay; so do rows that repeat a doc_id of which one row stands for its component.
    """
    key = free(docs, "gone")
    found = similar(docs, similarity, width).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = found.where("NOT stays").select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(key), "left_anti")
