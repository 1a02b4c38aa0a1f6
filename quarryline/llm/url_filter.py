"""URL lists: a blocked Bloom filter passes possible hits to an exact join, which removes its false positives.

Everything is DataFrame functions. A listed entry is a host and a path prefix (``host/path``); it fits the host
and all its subdomains where the url's path starts with the entry's. A url's possible entries are its host's
suffixes joined to its path's prefixes of the lengths that occur in the list.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for a listed entry; a block has four words of 64 bits, and an entry sets one bit in each.
BITS_PER_ENTRY = 16
#: Filters and lists are broadcast up to this many bytes, counted before; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path; both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit for each word of a block, from a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    return [_bit(second, 6 * i) for i in range(4)]


def _bit(value: Column, shift: int) -> Column:
    place = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(keys: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """The filter of ``keys.key`` as a table (block, w0 to w3), and its number of blocks."""
    blocks = max(1, -(-entries * BITS_PER_ENTRY // 256))
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def judge_urls(pages: DataFrame, entries: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``entries`` has ``rule`` (``host/path``, lower-case host) and ``verdict``; the longest fitting rule decides, the
    smallest verdict where a rule is listed twice; a url that no rule fits gets ``otherwise``. An empty list fits none.
    """
    listed = entries.filter("rule is not null and instr(rule, '/') > 1").groupBy(F.col("rule").alias("key")).agg(F.min("verdict").alias("verdict"))
    listed = listed.persist()
    n = listed.count()
    sizes = listed.agg(F.collect_set(F.expr("length(key) - instr(key, '/') + 1")).alias("lengths"), F.sum(F.length("key") + 40).alias("bytes")).first()
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    # a url's possible entries depend on host and path only, so a host or url that many rows share counts once
    places = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in sorted(sizes["lengths"])]).cast("array<int>"), lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    possible = (
        places.filter("host <> '' and path <> ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", F.explode(F.transform(prefixes, lambda p: F.concat(F.col("suffix"), p))).alias("key"))
    )
    filter_table, blocks = bloom_blocks(listed, n)
    small_filter, small_list = blocks * 40 <= BROADCAST_BYTES, (sizes["bytes"] or 0) <= BROADCAST_BYTES
    probe = possible.withColumn("block", _block(F.col("key"), blocks))
    hit = probe.join(F.broadcast(filter_table) if small_filter else filter_table, "block")
    for i, mask in enumerate(_masks(F.col("key"))):
        hit = hit.filter(F.col(f"w{i}").bitwiseAND(mask) != 0)
    exact = hit.select("host", "path", "key").join(F.broadcast(listed) if small_list else listed, "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("size"), F.col("key").alias("rule"), "verdict")).alias("best"))
    # rows without a host fit no rule: they share one key, so they go around the join
    joined = split.filter("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    return joined.union(split.filter("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")))
