"""Queries of the training-data operators, one ``opN_<name>`` each over whole tables, and their DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe, decontam, langid, license, quality, simhash, substring, suffix, tokenfile, toxicity
from statloom.llm.common import shared_dir, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), rest != 0))
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), path)
    return tokenfile.read_tokens(spark, path, digest=True)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3
    found = langid.predict(docs, langid.fit(docs, rest != 1))
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i : i + 9] AS x FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
place AS (SELECT doc_id, i, n, w[i : i + n - 1] AS x FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON p.x = win.x),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_GRID = ", ".join(f"('{name}', CAST({c!r} AS DOUBLE))" for name, (_, grid) in quality.RULES.items() for c in grid)
_MEASURES = " UNION ALL ".join(f"SELECT doc_id, lang, '{name}' AS rule, CAST({m} AS DOUBLE) AS v FROM base WHERE n_words > 0" for name, (m, _) in quality.RULES.items())
_P = quality.RISK / len(quality.RULES)

OP9_SQL = rf"""
WITH cut AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM cut),
place AS (SELECT doc_id, i, w[i : i + 2] AS x FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM place QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + 3)) AS r(j) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
m AS ({_MEASURES}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT m.* FROM m JOIN base USING (doc_id) JOIN good USING (doc_id) WHERE NOT base_failed),
grid(rule, cutoff) AS (VALUES {_GRID}),
tried AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM held JOIN grid USING (rule) GROUP BY ALL),
tests AS (SELECT count(DISTINCT lang) * (SELECT count(DISTINCT rule) FROM grid) AS t FROM held),
tail AS (SELECT *, CASE WHEN k < n * {_P!r} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P!r}) + (n - i) * ln(1 - {_P!r})))) ELSE 1 END AS p FROM tried),
tested AS (SELECT lang, rule, cutoff, bool_and(p <= {quality.DELTA!r} / t) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS certified FROM tail, tests),
chosen AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tested WHERE certified GROUP BY lang, rule),
failed AS (SELECT DISTINCT doc_id FROM m JOIN chosen USING (lang, rule) WHERE v > cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept FROM base
"""

_KNOWN = ", ".join(f"('{sentence}', '{name}')" for sentence, name in license.known().items())
_RULES = ", ".join(f"({i}, '{name}', '{has}', '{out}')" for i, (name, has, out) in enumerate(license.patterns()))


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    """SQL of ``text`` after all the steps, patterns as RE2 has them and \\1 for $1."""
    for pattern, to in steps:
        to = "'" + to.replace("$", "\\").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '") + "'"
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return text


_CUT = "string_split(" + _replaced("{}", license.ENDS).replace("{8", "{{8").replace("0}", "0}}") + ", chr(10))"
_PARTED = "string_split(" + _replaced("chr(10) || lower(coalesce(text, '')) || chr(10)", license.PARTS) + ", chr(1))"
_FORM = _replaced("trim(regexp_replace(s[i], '" + license._ODD + "', ' ', 'g'))", [license.REFERS])

OP10_SQL = rf"""
WITH known(sentence, id) AS (VALUES {_KNOWN}), rules(i, license, has, rules_out) AS (VALUES {_RULES}),
parted AS (SELECT doc_id, {_PARTED} AS p FROM documents),
paragraph AS (SELECT doc_id, j, p[j] AS t FROM parted, unnest(range(1, len(p) + 1)) AS r(j)),
cut AS (SELECT doc_id, j, 0 AS wrapped, {_CUT.format("t")} AS s FROM paragraph UNION ALL SELECT doc_id, j, 1, {_CUT.format("replace(t, chr(10), ' ')")} FROM paragraph),
form AS (SELECT doc_id, j, wrapped, i, {_FORM} AS sentence FROM cut, unnest(range(1, len(s) + 1)) AS r(i)),
ids AS (SELECT doc_id, j, wrapped, list(id ORDER BY i) AS ids FROM form JOIN known USING (sentence) GROUP BY doc_id, j, wrapped),
read AS (SELECT doc_id, j, ids FROM ids QUALIFY row_number() OVER (PARTITION BY doc_id, j ORDER BY len(ids) DESC, wrapped) = 1),
best AS (SELECT doc_id, flatten(list(ids ORDER BY j)) AS ids FROM read GROUP BY doc_id),
rows AS (SELECT doc_id, '|' || array_to_string(ids, '||') || '|' AS line FROM best),
held AS (SELECT doc_id, license, min(i) AS i FROM rows JOIN rules ON regexp_matches(line, has) AND NOT regexp_matches(line, rules_out) GROUP BY doc_id, license),
named AS (SELECT doc_id, string_agg(license, ',' ORDER BY i) AS licenses FROM held GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op9_quality": OP9_SQL, "op10_license": OP10_SQL}
