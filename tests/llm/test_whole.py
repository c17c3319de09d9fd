"""The whole job: cases that a shorter form of an operator left out."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from statloom.llm import bpe, common, queries, suffix, substring, tokenfile, toxicity


def test_passage_within_sentences(spark):
    """A repeat that starts and ends inside sentences and holds one whole sentence."""
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    a, b, c = say(18), say(22), say(19)
    passage = " ".join(a) + ". " + " ".join(b) + ". " + " ".join(c)
    around = lambda: f"{' '.join(say(30))}. {' '.join(say(9))} {passage} {' '.join(say(8))}. {' '.join(say(30))}."
    texts = {1: around(), 2: around(), 3: " ".join(say(100)) + "."}
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].text == texts[1] and got[3].text == texts[3] and got[1].n_removed == got[3].n_removed == 0
    held = set(passage.lower().replace(".", "").split())
    left = [w for w in got[2].text.replace(".", "").split() if w in held]
    assert len(left) <= 2 * (substring.STEP - 1) and got[2].n_removed == 3
    own = [w for w in texts[2].split() if w.replace(".", "") not in held]
    assert [w for w in got[2].text.split() if w.replace(".", "") not in held] == own
    assert substring.windows([["a", "b", "c"] * 200])[1:] == []  # periodic text is no passage


def test_toxic_evidence():
    """An n-gram of 10 toxic texts and no other has a weight."""
    counts = np.zeros((2, 3), np.int32)
    counts[1] = 10, 2, 0
    assert (toxicity.ratios(counts, np.array([2803, 352])) != 0).tolist() == [True, False, False] and toxicity.MOST >= 12_000


def plain_places(text):
    """Places of the text's n-grams, a character at a time."""
    low, out, m = text.lower(), set(), 0xFFFFFFFF
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            h = ord(low[i]) * 0x01000193 & m
            for c in low[i + 1 : i + n]:
                h = ((h + ord(c)) * 0x01000193 & m) ^ (h >> 15)
            out.add(((h + n) * 0x9E3779B1 & m) >> 32 - toxicity.BITS)
    return out


def test_toxicity_by_hand(spark, monkeypatch):
    """Scores recomputed in plain Python, and the gradient of the whole objective at what the fit found."""
    monkeypatch.setattr(toxicity, "CHUNK", 300)  # most texts go in pieces
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7)))
    plain, bad = [word() for _ in range(60)], ["Scurvyknave"]
    rows = []
    for i in range(160):
        own = [rng.choice(plain) for _ in range(rng.randint(3, 120))]
        if i % 3 == 0:
            own[rng.randrange(len(own))] = rng.choice(bad)
        rows.append((i, " ".join(own)))
    rows += [(160, None), (161, ""), (162, "Ünïcödé ΣΑΣ scurvyknave" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    named = {i: int(i % 3 == 0) for i in range(150)}
    weights, bias = toxicity.fit(docs, spark.createDataFrame(list(named.items()), "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, (weights, bias)).collect()}
    sets = {i: plain_places(t or "") for i, t in rows}
    for i, own in sets.items():
        assert abs(got[i] - 1 / (1 + math.exp(-sum(float(weights[k]) for k in own) - bias))) < 1e-5
    texts = {t: i for i, t in rows if i in named}
    learned = sorted(texts.values())
    n = [sum(named[i] == c for i in learned) for c in (0, 1)]
    counts = [[0] * (1 << toxicity.BITS) for _ in range(2)]
    for i in learned:
        for k in sets[i]:
            counts[named[i]][k] += 1
    slope: dict = {}
    for i in learned:
        e = (1 / (1 + math.exp(-sum(float(weights[k]) for k in sets[i]) - bias)) - named[i]) * 0.5 / n[named[i]]
        for k in [*sets[i], "bias"]:
            slope[k] = slope.get(k, 0) + e
    assert abs(slope["bias"]) < 1e-4
    some = 0
    for k in set().union(*sets.values()):
        p, q = counts[1][k] + 1, counts[0][k] + 1
        r = math.log(p / (n[1] + 2)) - math.log(q / (n[0] + 2))
        r = math.copysign(max(0, abs(r) - toxicity.Z * math.sqrt(1 / p + 1 / q)), r)
        if r == 0:
            assert weights[k] == 0
            continue
        x = r / math.sqrt((0.5 * counts[0][k] / n[0] + 0.5 * counts[1][k] / n[1]) * r * r + 1e-3)
        some += 1
        assert abs(slope[k] * x + 1e-3 * float(weights[k]) / x) < 1e-3
    assert some > 10 and all((got[i] > 0.5) == (i % 3 == 0) for i in range(160))
    assert toxicity.score(docs.limit(0), (weights, bias)).count() == 0 and toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))[1] == -1e9


def test_full_caps_and_chunks_without_ids(monkeypatch):
    """A chunk of white space that has no ids, first met with room for words only and again when they are full too."""
    with open(queries.tokenizer_file(), encoding="utf-8") as f:
        definition = f.read()
    blank = "one \u00a0 two \u2003 \u3000 six"
    want = tokenfile.Memo(definition).encode([blank, "three four", blank], b"")
    monkeypatch.setattr(tokenfile, "MEMO", 0)
    monkeypatch.setattr(tokenfile, "WORDS", 5)
    memo = tokenfile.Memo(definition)
    assert [memo.encode([x], b"")[0] for x in (blank, "three four", blank)] == want
    assert len(memo.words) >= 5 and b"" in memo.words.values()


def test_mixed_text_shares_words():
    """A quote or a foreign letter sends its own chunk to the whole tokenizer, if any, not the text's."""
    plain, mixed = "The cat's hat, and 12 dogs. The end", "The cat's hat, and “12 dogs” . Ω\u0301 The end"
    assert set(bpe.words_of(plain)) <= set(bpe.words_of(mixed)) and len(bpe.words_of(mixed)) < len(bpe.words_of(plain)) + 5
    han = "今日は、天気がいい。" * 3
    assert set(bpe.words_of(han)) == {"今日は", "、", "天気がいい", "。"}


def test_decode_alone(spark):
    """Ids decode without the texts that they came from."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    rng = random.Random(3)
    rows = [(i, np.array([rng.randrange(49408) for _ in range(rng.randint(0, 300))], "<u4")) for i in range(40)]
    d = spark.createDataFrame([(i, bytes(x.tobytes()), "clash") for i, x in rows] + [(40, None, None)], "doc_id long, ids binary, decoded string")
    got = {r.doc_id: r.decoded_ for r in bpe.decode(d, queries.tokenizer_file()).collect()}
    assert got == {i: whole.decode(x.tolist(), skip_special_tokens=False) for i, x in rows} | {40: ""}


def test_long_text(spark):
    """A text of 60 MB that holds another's passage."""
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 60_000_000, np.uint8)
    passage = long[31_000_000:31_000_200].tobytes().decode()
    d = spark.createDataFrame([(1, "x" * 10 + passage)], "doc_id long, text string").unionByName(spark.range(2, 3).selectExpr("id AS doc_id", "'' AS text"))
    data = pa.record_batch([pa.array([1, 2]), pa.array([d.first().text.encode(), long.tobytes()])], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as w:
        w.write_batch(data)
    block = suffix.Block(suffix._pack(sink.getvalue().to_pybytes()), 4, 50)
    assert len(block.first) < len(long) / 10 and block.many.sum() == (len(long) - 49) + (210 - 49)
    assert any(several.any() for _, _, several, _, _ in block.anchors())


def test_slabs_stay_small():
    """Anchors of a block of 4 MB are found with a working memory below 20 times its size, and cover every string once, in order."""
    text = np.random.default_rng(5).integers(97, 123, suffix.BLOCK, np.uint8).tobytes()
    data = pa.record_batch([pa.array([1, 2]), pa.array([text[:3_000_000], text[3_000_000:]])], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as w:
        w.write_batch(data)
    packed = suffix._pack(sink.getvalue().to_pybytes())
    tracemalloc.start()
    block = suffix.Block(packed, 4, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20
    ends = block.first + block.many
    assert block.many.sum() == len(text) - 2 * 49 and (block.at >= block.first + block.many - 1).all() and (block.at <= block.first + 50 - suffix.GRAM).all()
    assert (np.diff(block.first) > 0).all() and (ends[:-1] <= block.first[1:]).all()


def test_partitions_follow_the_input(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions(spark) == n and common.partitions(spark, 30 << 30) == 240
    d = spark.range(100).selectExpr("id AS block")
    assert "REPARTITION_BY_NUM" in common.grouped(d, "block", 240).count()._jdf.queryExecution().toString()


def test_language_by_hand(spark):
    """Profiles and out-of-place distances recomputed from strings; equal profiles go to the name that comes first."""
    from statloom.llm import langid

    rng = random.Random(11)
    said = {"aa": "the of and to in that is was he for", "bb": "der die und das von zu den mit sich", "cc": "der die und das von zu den mit sich"}
    rows = [(i, " ".join(rng.choice(said[lang].split()) for _ in range(rng.randint(1, 90))).title() + rng.choice(["", " 12!", " ß", "\n\nÉ"]), lang) for i in range(60) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(100 + i, t, "cc") for i, t, lang in rows if lang == "bb"] + [(200, None, "aa"), (201, "123 ... _", "bb"), (202, "the", None), (None, "und das", "aa"), (203, "the of " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)

    def counts(text):
        clean = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        s, out = f" {clean} ", {}
        for n in (1, 2, 3) if clean else ():
            for i in range(len(s) - n + 1):
                if s[i : i + n] != " ":
                    out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
        return out

    def top(n):
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return sorted(n, key=lambda g: (-n[g], code(g)))[:400]

    sums: dict = {}
    for _, text, lang in rows:
        for g, n in counts(text).items() if lang else ():
            sums.setdefault(lang, {})[g] = sums.setdefault(lang, {}).get(g, 0) + n
    ranks = {lang: {g: i for i, g in enumerate(top(n))} for lang, n in sums.items()}
    want = []
    for i, text, _ in rows:
        own = top(counts(text))
        far = {lang: sum(abs(k - r[g]) if g in r else 400 for k, g in enumerate(own)) for lang, r in ranks.items()}
        best = min(far, key=lambda lang: (far[lang], lang)) if own else "und"
        want.append((i, best, round(1 - far[best] / (400 * len(own)), 9) if own else 0.0))
    got = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, langid.fit(docs)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and not any(lang == "cc" for _, lang, _ in got)
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0 and langid.keep_known(docs.limit(0), langid.fit(docs)).count() == 0


def test_chunks_are_looked_up_once(tokenizer_ids):
    """Texts that are encoded together look a chunk up once, however often they have it, and have the tokenizer's ids."""

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    whole, memo = tokenizer_ids
    memo.ids = Counted(memo.ids)
    # every character that is cut without the tokenizer, and others between
    known = [x for x in map(chr, range(0x10000)) if not bpe._ODD.search(x) and not x.isspace()]
    texts = ["", " \t\r\n", "The cat's hat, " * 500, "“the” Cat's hat,", "".join(known), " ".join(known), "x" + "\n\n".join(known), "İ Σ <|endoftext|> the"]
    for _ in range(2):
        memo.ids.asked = 0
        assert memo.encode(texts, b"end!") == [np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() + b"end!" for x in texts]
        assert memo.ids.asked < 3 * len(known)
        memo.ids.asked = 0
        assert len(set(memo.encode(["the end " * 5000] * 4, b""))) == 1 and memo.ids.asked <= 3
    assert memo.encode([], b"") == [] and memo.encode(["", ""], b"e") == [b"e", b"e"]


@pytest.fixture
def tokenizer_ids():
    from tokenizers import Tokenizer

    with open(queries.tokenizer_file(), encoding="utf-8") as f:
        return Tokenizer.from_file(queries.tokenizer_file()), tokenfile.Memo(f.read())
