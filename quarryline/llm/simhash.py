"""SimHash fingerprints of whole texts, and permuted block tables that find all within a Hamming radius.

DataFrame functions only. A text's terms are its distinct words, weighted by length (at most 16); a term's 64-bit
hash votes on every bit. Votes are summed three bits to a long, in lanes of 21 bits, so that 22 sums make a fingerprint.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, cut, shuffle_partitions

#: Weights are at most this; a lane of 21 bits then holds the votes of 2**17 words.
MOST_WEIGHT = 16
SUB_WORDS = 1 << 17
_LANES = [i for i in range(22)]
_LANE_MASK = 1 | 1 << 22 | 1 << 44


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1)))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (unique in ``rows``) and ``simhash`` (long) of each row's text; without words all bits are 0.

    A text of more distinct words than a lane can count is summed in parts of ``SUB_WORDS`` words. No shuffle is
    needed where ``rows`` is already partitioned by some of the keys.
    """
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest((F.size("_terms") - 1) / SUB_WORDS, F.lit(0)).cast("int")), lambda k: F.slice(F.col("_terms"), k * SUB_WORDS + 1, SUB_WORDS)
    )
    words = rows.select(*keys, _terms(F.coalesce(text, F.lit(""))).alias("_terms")).select(*keys, F.posexplode(parts).alias("_part", "_words"))
    votes = words.select(*keys, "_part", F.explode_outer("_words").alias("_word")).select(
        *keys, "_part", F.xxhash64("_word").alias("_hash"), F.coalesce(F.least(F.length("_word"), F.lit(MOST_WEIGHT)), F.lit(0)).cast("long").alias("_weight")
    )
    lanes = [F.sum(F.shiftrightunsigned("_hash", i).bitwiseAND(F.lit(_LANE_MASK)) * F.col("_weight")).alias(f"_l{i}") for i in _LANES]
    summed = votes.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_all"), *lanes)
    low = (1 << 22) - 1
    bits = [F.sum(F.shiftrightunsigned(f"_l{i % 22}", 22 * (i // 22)).bitwiseAND(F.lit(low))).alias(f"_b{i}") for i in range(64)]
    counted = summed.groupBy(*keys).agg(F.sum("_all").alias("_all"), *bits)
    value = F.lit(0).cast("long")
    for i in range(64):
        one = F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")
        value = value.bitwiseOR(F.when(2 * F.col(f"_b{i}") > F.col("_all"), one).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, value.alias("simhash"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def within_radius(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, simhash, distance) of distinct fingerprints at most ``radius`` bits apart, all of them.

    The bits are dealt into ``blocks``; two fingerprints within the radius agree on at least ``blocks - radius`` of
    them, so each choice of that many blocks is a table keyed by their bits, and a pair is found in the first table
    that it shares. Both inputs have a column ``simhash``; equal fingerprints count once.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        one = rows.filter("simhash is not null").select(F.col("simhash").alias(name)).distinct()
        tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
        return one.select(name, F.inline(tables))

    pairs = keyed(queries, "query").join(keyed(table, "simhash"), ["t", "key"])
    close = pairs.withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("simhash")))).filter(F.col("distance") <= radius)
    first = F.array_position(F.array(*[F.col("query").bitwiseXOR(F.col("simhash")).bitwiseAND(F.lit(m)) for m in masks]), F.lit(0).cast("long")) - 1
    return close.filter(F.col("t") == first).select("query", "simhash", "distance")


def with_next(documents: DataFrame) -> DataFrame:
    """_bucket, _row (unique together), doc_id, text and _next_text: the next document's text, after the last the first's.

    Order is by doc_id, then text; null texts are empty. Rows are dealt into ranges of doc_id of about equal size;
    inside a range the next row is the window's lead, and a range's last row gets the first of the next range. A table
    of one row is its own next.
    """
    spark = documents.sparkSession
    n = shuffle_partitions(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)]
    cuts = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 10_000)).first()[0] if shares else []
    below = lambda k, b: k + F.coalesce(b < F.col("doc_id"), F.lit(False)).cast("int")
    listed = sorted(set(cuts or []))
    step = max(1, int(len(listed) ** 0.5))
    # the number of bounds below the id: every ``step``-th is looked at first, then those of one stretch, so about 2 sqrt(n) for n ranges
    coarse = F.array(*[F.lit(c).cast("long") for c in listed[step - 1 :: step]]).cast("array<bigint>")
    bounds = F.array(*[F.lit(c).cast("long") for c in listed]).cast("array<bigint>")
    rows = rows.withColumn("_stretch", F.aggregate(coarse, F.lit(0), below) * step)
    bucket = F.col("_stretch") + F.aggregate(F.slice(bounds, F.col("_stretch") + 1, step), F.lit(0), below)
    order = Window.partitionBy("_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    dealt = (
        rows.withColumn("_bucket", bucket).drop("_stretch")
        .withColumn("_row", F.row_number().over(order))
        .withColumn("_lead", F.lead("text").over(order))
    )
    firsts = dealt.filter("_row = 1").select("_bucket", F.col("text").alias("_first"))
    # the ranges that have rows: at most as many as there are partitions
    used = [r[0] for r in dealt.filter("_row = 1").select("_bucket").orderBy("_bucket").collect()]
    before = {b: a for a, b in zip(used, used[1:])} | ({used[0]: used[-1]} if used else {})
    table = spark.createDataFrame(list(before.items()) or [(0, 0)], "_bucket int, _to int")
    handed = firsts.join(F.broadcast(table), "_bucket").select(F.col("_to").alias("_bucket"), "_first")
    joined = dealt.join(handed, "_bucket", "left")
    return joined.select("_bucket", "_row", "doc_id", "text", F.coalesce("_lead", "_first").alias("_next_text"))


def fingerprint_documents(documents: DataFrame, search_every: int = 100, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter gives way to the next text's beginning.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_within:
    for rows whose id is divisible by ``search_every``, the number of other rows within ``radius`` bits, else null.
    """
    spark = documents.sparkSession
    taken = F.floor(F.length("text") / 4).cast("int")
    rows = with_next(documents)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - taken), F.substring(F.col("_next_text"), F.lit(1), taken))
    rows = rows.select("_bucket", "_row", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["_bucket", "_row", "doc_id", "n_chars", "edited_sha256", "_which"]
    both = F.array(F.struct(F.lit(0).alias("_which"), F.col("text").alias("_text")), F.struct(F.lit(1).alias("_which"), F.col("edited").alias("_text")))
    long = rows.select("_bucket", "_row", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.inline(both))
    prints = fingerprints(long, keys, "_text").groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("_which") == 0, F.col("simhash"))).alias("simhash"), F.max(F.when(F.col("_which") == 1, F.col("simhash"))).alias("edited")
    )
    prints = cut(prints)  # narrow: two longs and a digest for each document
    order = Window.partitionBy("_bucket").orderBy("_row")
    dealt = prints.withColumn("_lead", F.lead("simhash").over(order))
    firsts = {r["_bucket"]: r["simhash"] for r in prints.filter("_row = 1").select("_bucket", "simhash").collect()}  # one for each range
    used = sorted(firsts)
    table = spark.createDataFrame([(b, firsts[used[(k + 1) % len(used)]]) for k, b in enumerate(used)] or [(0, 0)], "_bucket int, _first long")
    rows = dealt.join(F.broadcast(table), "_bucket").withColumn("_next", F.coalesce("_lead", "_first"))
    counts = prints.groupBy("simhash").agg(F.count(F.lit(1)).alias("n"))
    queries = prints.filter(F.pmod("doc_id", F.lit(search_every)) == 0)
    found = within_radius(queries, counts, radius).join(counts, "simhash").groupBy(F.col("query").alias("simhash")).agg((F.sum("n") - 1).alias("n_within"))
    asked = queries.select("_bucket", "_row", "simhash").join(found, "simhash", "left").select("_bucket", "_row", "n_within")
    rows = rows.join(asked, ["_bucket", "_row"], "left")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("edited")), 16, "0").alias("edited_fingerprint"),
        likeness(F.col("simhash"), F.col("edited")).alias("near_edited"),
        likeness(F.col("simhash"), F.col("_next")).alias("near_next"),
        "n_within",
    )
