"""Queries over the training-data tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import CONTROLS, conversation_digests, format_conversations
from .common import table
from .dart_minhash import near_duplicates
from .langid_gru import identify_languages
from .lloyd import cluster_vectors
from .packing import pack_documents
from .quality_gam import score_quality
from .simhash import fingerprint_documents
from .spelling import group_spellings
from .suffix_index import remove_repeats
from .toxicity import score_toxicity
from .unigram import encode_documents
from .url_filter import judge_urls
from .weak_rules import judge_quality


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the folder can be given as QUARRYLINE_TOKENIZERS."""
    import os

    if folder := os.environ.get("QUARRYLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Listed hosts and paths, with their verdicts.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_conversations(given.unionByName(extra)))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_toxicity, op3_sentencepiece, op4_url_filter, op5_quality_rules,
        op6_quality_classifier, op7_suffix_array_dedup, op8_minhash_near_dedup, op9_document_fingerprints, op10_language_id,
        op11_chat_formatting, op12_centroid_clustering, op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), places AS (
  SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}
), parts AS (
  SELECT rule, verdict, substr(rule, 1, strpos(rule, '/') - 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules
), fits AS (
  SELECT k, rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, rule) AS n
  FROM places JOIN parts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM places LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (k)
"""


#: A control string of op11's template with any backslashes after its first character.
_ESCAPABLE = "|".join(rf"{c[0] if c[0] == '<' else chr(92) + c[0]}\\*{c[1:].replace(']', chr(92) + ']')}" for c in CONTROLS)

#: Marks around a text: 7 + 8 code points for a user, 6 + 7 for a system, 5 + 4 for an assistant, 6 + 7 + 4 for other roles; 3 at the start.
OP11_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ESCAPABLE}')) AS escaped, length(role) + len(regexp_extract_all(role, '{_ESCAPABLE}')) AS role_escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(escaped + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 9 ELSE 17 + role_escaped END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _lloyd_sql(k: int = 16, rounds: int = 3, dimension: int = 64) -> str:
    """The rounds one after another; a centroid without vectors keeps its place."""
    nearest = """SELECT k, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT v.k, m.c, list_sum(list_transform(list_zip(v.q, m.q), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM kept v, {m} m) GROUP BY k"""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})""",
        f"m0 AS MATERIALIZED (SELECT n - 1 AS c, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) AS n FROM kept) WHERE n <= {k})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(m=f'm{i}')})")
        steps.append(f"s{i} AS MATERIALIZED (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT c, unnest(q) AS x, unnest(range(1, {dimension + 1})) AS i FROM kept JOIN a{i} USING (k)) GROUP BY c, i)")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(u.q, m.q) AS q FROM m{i} m LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM s{i} GROUP BY c) u USING (c))")
    steps.append(f"last AS MATERIALIZED ({nearest.format(m=f'm{rounds}')})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256 FROM kept JOIN last USING (k) JOIN m{rounds} m USING (c)"""


#: crc32 by its table of 256 remainders; near words share what is left of them without one letter, then one edit is checked.
OP13_SQL = f"""
WITH table_of AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY d, run
), bytes AS (SELECT d, run, n, hex(encode(d || ':' || run)) AS x FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
         lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS h FROM bytes, table_of
), made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(CAST(length(word) AS BIGINT))) AS i FROM words)
), met AS (
  SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM less a JOIN less b USING (rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), near AS (
  SELECT a AS word, count(*) AS n_near, any_value(a_n) AS n, max(b_n) AS best, arg_min(b, (-b_n, b)) AS b FROM met
  WHERE length(a) <> length(b) OR len(list_filter(range(1, CAST(length(a) AS BIGINT) + 1), lambda i: a[i] <> b[i])) = 1 GROUP BY a
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 10 * w.n THEN b END AS form, CASE WHEN best >= 10 * w.n THEN best END AS form_n FROM words w LEFT JOIN near USING (word)
), chain AS (
  WITH RECURSIVE up AS (SELECT word, word AS reached, 0 AS steps FROM forms UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN forms f ON f.word = up.reached WHERE f.form IS NOT NULL)
  SELECT word, arg_max(reached, steps) AS root FROM up GROUP BY word
)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN chain USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op11_chat_formatting": OP11_SQL, "op12_centroid_clustering": _lloyd_sql(), "op13_spelling_variants": OP13_SQL}
