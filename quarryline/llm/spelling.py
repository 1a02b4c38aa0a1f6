"""Spelling variants by anagram hashing: words whose keys differ by the value of one letter are compared letter by letter.

A word's key is the sum of its letters' code points to the fifth power, so it doesn't depend on their order. Two words of one length that
differ by one exchange have keys that agree once a letter is taken from each; a word that lacks one letter of another has the other's key
less that letter's value. Each word is therefore listed under its key and under its key less each of its letters, and joined there. An edit
leaves the first or the last half of the shorter word in place, so the hash of a half is part of the join: words that merely share
their letters never meet. ``levenshtein`` then verifies the letters' order; hash collisions can't add or lose a pair.

Counting runs is a groupBy with partial sums, so a common word costs one row a partition; a word's near words are counted the same way.
A form has ten times its word's count, so a chain of forms has at most log10 of the greatest count steps, and pointers are doubled that
often.

Odd rows: null texts have no words, a null doc_id counts as the empty text in the hash, repeated rows count each time, an empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Runs of letters, and the letters whose case is folded.
RUN, UPPER, LOWER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every 31st run, by its hash, loses one letter.
DAMAGE, LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 31, 7, 2, 10
#: Keys are kept below this prime, so that no word is too long for a long.
MODULUS = (1 << 61) - 1


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def damaged(doc_id: Column, run: Column) -> Column:
    """The run as its document writes it: less one code point where 31 divides the hash of ``doc_id:run``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n of the words of at least seven letters that occur at least twice."""
    runs = F.regexp_extract_all(lowered(F.col("text")), F.lit(RUN), F.lit(0))
    # a damaged run may have lost one letter, no more
    occurring = documents.select("doc_id", F.explode(runs).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    words = occurring.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_value(letter: Column) -> Column:
    """Code point to the fifth power; at most 255 ** 5, so a long holds it."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, letter: (total + letter_value(letter)) % MODULUS)


def _halves(word: Column, length: Column) -> tuple[Column, Column]:
    """Hashes of the first and the last part of a word, if the shorter word of a pair has ``length`` letters; an edit leaves one of them."""
    first = F.floor((length - 1) / 2).cast("int")
    last = (length - 1 - first).cast("int")
    return F.xxhash64(F.substring(word, F.lit(1), first)), F.xxhash64(F.substring(word, F.length(word) - last + 1, last))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: words (word, n) that differ by one letter, each pair once in each direction."""
    keyed = words.select("word", "n", F.length("word").alias("size"), anagram_key(F.col("word")).alias("key"))
    letters = F.explode(F.array_distinct(F.split("word", ""))).alias("letter")
    less = keyed.select("word", "n", "size", "key", letters).withColumn("key", F.pmod(F.col("key") - letter_value(F.col("letter")), F.lit(MODULUS))).drop("letter")

    def listed(rows: DataFrame, side: str, length: Column) -> DataFrame:
        first, last = _halves(F.col("word"), length)
        halves = F.explode(F.array(F.struct(F.lit(0).alias("part"), first.alias("half")), F.struct(F.lit(1).alias("part"), last.alias("half"))))
        made = rows.select("word", "n", F.col("key"), length.alias("least"), first.alias("first"), halves.alias("h"))
        return made.select("key", "least", "h.part", "h.half", F.col("first").alias(f"{side}_first"), F.col("word").alias(side), F.col("n").alias(f"{side}_n"))

    on = ["key", "least", "part", "half"]
    # a pair whose first halves agree is found under these, so its last halves needn't find it again
    once = (F.col("part") == 0) | (F.col("a_first") != F.col("b_first"))
    one_edit = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    exchanged = listed(less, "a", F.col("size")).join(listed(less, "b", F.col("size")), on).filter(F.col("a") < F.col("b"))
    added = listed(less, "a", F.col("size") - 1).join(listed(keyed, "b", F.col("size")), on)
    pairs = exchanged.unionByName(added).filter(once & one_edit).select("a", "b", "a_n", "b_n")
    both = F.explode(F.array(F.struct("a", "b", "a_n", "b_n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def chosen_forms(pairs: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: a word's near word of greatest count (the smallest of equals), if that is ten times its own."""
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")))
    near = pairs.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.first("a_n").alias("n"), best.alias("best"))
    enough = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    return near.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, greatest: int) -> DataFrame:
    """word, root of the words that have a form; chains are at most log10(``greatest``) steps long."""
    reached = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(math.log10(max(greatest, 10)) + 1))):
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = reached.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return reached


def group_spellings(documents: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents' vocabulary."""
    words = stored(vocabulary(documents))
    forms = stored(chosen_forms(near_pairs(words)))
    greatest = words.agg(F.max("n")).collect()[0][0] or 1
    found = words.join(forms, "word", "left").join(roots(forms, greatest), "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
