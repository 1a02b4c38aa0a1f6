"""Resolving candidates of several sources, comparing relations, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import compact_key


def resolve_candidates(candidates: DataFrame) -> DataFrame:
    """item -> the value of the best candidate, and the number of other values.

    ``candidates``: item, priority, confidence, value, ord. Higher priority wins, then confidence, then order.
    """
    best = F.min_by(F.struct("value", "priority"), F.struct(-F.col("priority"), -F.col("confidence"), "ord")).alias("best")
    grouped = candidates.groupBy("item").agg(best, (F.count_distinct("value") - 1).alias("conflicts"), F.count(F.lit(1)).alias("candidates"))
    return grouped.select("item", F.col("best.value").alias("resolved"), "best.priority", "conflicts", "candidates")


def lineitem_candidates(lineitem: DataFrame) -> DataFrame:
    """Line items as candidates for their part: the return flag is the source, a smaller discount is surer."""
    priority = F.when(F.col("l_returnflag") == "N", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return lineitem.select(
        F.col("l_partkey").alias("item"), priority.alias("priority"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_suppkey").alias("value"),
        F.struct("l_orderkey", "l_linenumber").alias("ord"),
    )


def compare_relations(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: match, mismatch, left_only or right_only for each key.

    A row whose value is null is there: two nulls match, a null and a value don't. Keys that repeat are compared pair by pair;
    a null key meets none.
    """
    joined = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("here")).join(right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("there")), key, "full_outer")
    verdict = F.when(F.col("here").isNull(), "right_only").when(F.col("there").isNull(), "left_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "match").otherwise("mismatch")
    return joined.select(key, verdict.alias("verdict"))


def classify_channels(parts: DataFrame) -> DataFrame:
    """Each part's class from several weighted channels: type words, size, brand; with the margin over the next class."""
    key = F.col("p_partkey")
    by_type = parts.select(key, F.element_at(F.split("p_type", " "), -1).alias("kind"), F.lit(5).alias("points"))
    by_size = parts.select(key, F.when(F.col("p_size") < 17, "small").when(F.col("p_size") < 34, "medium").otherwise("large").alias("kind"), F.lit(3).alias("points"))
    by_brand = parts.select(key, F.element_at(F.split("p_type", " "), -1).alias("kind"), F.when(F.col("p_brand").endswith("1"), 2).otherwise(0).alias("points"))
    scored = by_type.unionAll(by_size).unionAll(by_brand).groupBy("p_partkey", "kind").agg(F.sum("points").alias("points"))
    order = Window.partitionBy("p_partkey").orderBy(F.desc("points"), "kind")
    ranked = scored.select("*", F.row_number().over(order).alias("n"), F.lead("points", 1, 0).over(order).alias("next"))
    return ranked.filter("n = 1").select("p_partkey", "kind", "points", (F.col("points") - F.col("next")).alias("margin"))


def quality_grades(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents graded by a sum of conditions, with the labels where there are any."""
    score = F.when(F.col("n_chars") >= 200, 40).otherwise(0) + F.when(F.col("lang").isNotNull(), 20).otherwise(0) + F.when(F.contains("text", F.lit("\n")), 10).otherwise(0) + F.coalesce(F.col("quality"), F.lit(0)) * 30
    graded = documents.join(labels, "doc_id", "left").select("doc_id", score.cast("int").alias("score"))
    return graded.withColumn("grade", F.when(F.col("score") >= 90, "found").when(F.col("score") >= 50, "partial").otherwise("failed"))


#: Lengths of the ends by which needles are looked up.
ENDS = (1, 2, 4, 8, 16, 32)


def _confirmed(pairs: DataFrame, needles: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (item_id, doc_id) of which a text contains a needle; the texts are fetched here."""
    wanted, held = needles.select(F.col("item_id").alias("_item"), "needle"), texts.select(F.col("doc_id").alias("_doc"), "text")
    met = pairs.distinct().join(wanted, F.col("item_id").eqNullSafe(F.col("_item"))).join(held, F.col("doc_id").eqNullSafe(F.col("_doc")))
    return met.filter(F.contains("text", F.col("needle"))).select("item_id", "doc_id").distinct()


#: Needles of more characters in all aren't handed to the tasks: their ends are joined with the texts' stretches instead.
MOST_SCANNED = 1_000_000
#: Greatest number of bits by which stretches are sifted before they are joined; 16 for each needle up to there.
MOST_BITS = 1 << 24


def _of_forms(needles: DataFrame) -> DataFrame:
    """item_id, form, needle: distinct, none empty; a needle without a form is searched for in the column ``text``."""
    form = F.col("form") if "form" in needles.columns else F.lit("text")
    return needles.filter(F.length("needle") > 0).select("item_id", form.alias("form"), "needle").distinct()


def _scanned(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id) by one pass over the texts with an automaton of all needles of each form; a row leaves a task for each needle that it holds."""
    listed: dict[str, list[str]] = {}
    for r in needles.select("form", "needle").distinct().collect():  # bounded by MOST_SCANNED
        listed.setdefault(r["form"], []).append(r["needle"])
    forms = sorted(listed)

    def scan(batches):
        automata = {}
        for form in forms:
            automata[form] = ahocorasick.Automaton()
            for needle in listed[form]:
                automata[form].add_word(needle, needle)
            automata[form].make_automaton()
        for batch in batches:
            rows, held, names = [], [], []
            for form in forms:
                for k, text in enumerate(batch.column(form)):
                    found = {needle for _, needle in automata[form].iter(text.as_py())} if text.is_valid else ()
                    rows += [k] * len(found)
                    held += found
                    names += [form] * len(found)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(held, pa.string())], ["doc_id", "form", "needle"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    hits = texts.select("doc_id", *forms).mapInArrow(scan, f"doc_id {kind}, form string, needle string") if forms else texts.select("doc_id", F.lit("").alias("form"), F.lit("").alias("needle")).limit(0)
    return hits.join(needles, ["form", "needle"]).select("item_id", "doc_id").distinct()


def _sieve(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for every value of the column ``h`` and for few others: bits in one array of bounded size."""
    bits = 1 << 10
    n = hashes.select("h").distinct().count()
    while bits < min(MOST_BITS, 16 * n):
        bits *= 2
    place = lambda h: h.bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    words = [0] * (bits // 64)
    for r in hashes.groupBy(F.shiftright(place(F.col("h")), 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():  # at most MOST_BITS / 64 rows
        words[r["word"]] = r["bits"]
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    return lambda h: F.getbit(F.get(table, F.shiftright(place(h), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def stretches_of_needles(wanted: DataFrame, texts: DataFrame, block: int = 256) -> DataFrame:
    """(doc_id, h): hashes of the stretches of ``texts`` (doc_id, text) that may end a needle of ``wanted`` (q: the end's length, h: its hash).

    Texts are read in overlapping blocks, as finding a character takes steps; what the sieve holds back is never a row.
    """
    sizes = [r["q"] for r in wanted.select("q").distinct().collect()]  # at most as many as ENDS
    sieves = {q: _sieve(wanted.filter(F.col("q") == q)) for q in sizes}
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(block))).alias("at")
    pieces = texts.select("doc_id", "text", starts).select("doc_id", F.substr("text", F.col("at"), F.lit(block + ENDS[-1] - 1)).alias("piece"))

    def stretches(q: int):
        last = F.least(F.length("piece") - q + 1, F.lit(block))
        hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substr("piece", i, F.lit(q))))
        return F.when(last >= 1, F.filter(hashes, sieves[q])).otherwise(F.array().cast("array<bigint>"))

    found = F.concat(F.array().cast("array<bigint>"), *[stretches(q) for q in sizes])
    return pieces.select("doc_id", F.explode(F.array_distinct(found)).alias("h"))


def with_ends(needles: DataFrame) -> DataFrame:
    """The needles with the length ``q`` of their end (the longest of ``ENDS`` that they have) and its hash ``h``."""
    end = F.greatest(*[F.when(F.length("needle") >= q, q) for q in ENDS])
    return needles.withColumn("q", end).withColumn("h", F.xxhash64(F.right("needle", F.col("q"))))


def substring_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the texts that contain a needle (item_id, needle, and form: the column of ``texts`` to search in, else ``text``) anywhere.

    Empty and null needles and null texts meet nothing. Needles of up to ``MOST_SCANNED`` characters in all become automata, which read each text
    once. More are looked up by their last characters, as many as the longest of ``ENDS`` that they have: these meet the texts' stretches of that
    length in an equi-join on their hash, after a sieve of bounded size.
    """
    listed = _of_forms(needles)
    size = listed.select("form", "needle").distinct().agg(F.sum(F.length("needle"))).first()[0] or 0
    if size <= MOST_SCANNED:
        return _scanned(listed, texts)
    out = None
    for form in sorted(r["form"] for r in listed.select("form").distinct().collect()):
        held, wanted = texts.select("doc_id", F.col(form).alias("text")), with_ends(listed.filter(F.col("form") == form))
        pairs = stretches_of_needles(wanted, held).join(wanted.select("item_id", "h"), "h").select("item_id", "doc_id")
        met = _confirmed(pairs, wanted, held)
        out = met if out is None else out.union(met)
    return out.distinct()


def containing_documents(passages: DataFrame, documents: DataFrame, words: int = 6) -> DataFrame:
    """(item_id, doc_id) of documents that contain a passage whole, whatever its length; an empty passage isn't searched for.

    Passages of up to ``MOST_SCANNED`` characters in all are searched for by :func:`substring_pairs`. Of more, a document that contains a passage of ``words`` + 2 words or more has the passage's first inner words in a row as well:
    these meet in an equi-join on their hash, and only such pairs are compared. Shorter passages, which may begin and
    end inside a word, are looked up by :func:`substring_pairs`.
    """
    def shingles(rows: DataFrame, key: str, all_of_them: bool) -> DataFrame:
        split = rows.select(key, F.split("text", " ").alias("w"))
        last = F.size("w") - words + 1 if all_of_them else F.lit(2)
        starts = F.sequence(F.lit(2) if not all_of_them else F.lit(1), last)
        made = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
        return split.filter(F.size("w") >= words + (0 if all_of_them else 2)).select(key, F.explode(F.array_distinct(made)).alias("h"))

    needles, n_words = passages.select("item_id", F.col("text").alias("needle")), F.size(F.split("needle", " "))
    if (needles.agg(F.sum(F.length("needle"))).first()[0] or 0) <= MOST_SCANNED:
        return substring_pairs(needles, documents.select("doc_id", "text"))
    pairs = shingles(documents.select("doc_id", "text"), "doc_id", True).join(shingles(passages.select("item_id", "text"), "item_id", False), "h")
    long = _confirmed(pairs.select("item_id", "doc_id"), needles.filter(n_words >= words + 2), documents)
    return long.union(substring_pairs(needles.filter(n_words < words + 2), documents.select("doc_id", "text"))).distinct()


def catalog_matches(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id) of documents that name an item: its text, or what follows its last colon, without regard to case.

    From 4 letters and digits on separators don't count either. Such needles are searched for in compact form only, as a text
    that contains a needle contains its compact form too; those with fewer are searched for in lower case.
    """
    candidates = items.select("item_id", F.explode(F.array("text", F.element_at(F.split("text", ":"), -1))).alias("needle")).select("item_id", F.trim("needle").alias("needle")).filter("needle <> ''").distinct()
    compact = compact_key(F.col("needle"))
    long = F.length(compact) >= 4
    needles = candidates.select("item_id", F.when(long, "compact").otherwise("lower").alias("form"), F.when(long, compact).otherwise(F.lower("needle")).alias("needle"))
    return substring_pairs(needles, documents.select("doc_id", compact_key(F.col("text")).alias("compact"), F.lower("text").alias("lower")))
