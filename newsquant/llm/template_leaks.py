"""Benchmark decontamination by templates (native expressions only).

Words become a template: numbers, units after numbers and capitalised names
inside a sentence turn into typed placeholders, the rest is lowered and
stripped of punctuation. A run of names or of numbers is one placeholder.
Windows of eight template words of documents and benchmark items are
hash-joined. Matches on one diagonal (same offset between document and item)
are one alignment; its slots must map consistently, each value of the item to
one value of the document and back. So a question that was only
re-parameterised is caught with its original, and a chance meeting of
placeholders is not. Diagonals at most `SHIFT` apart are also taken together,
as a word put in or left out moves what follows.

An alignment is a leak if it is consistent and has `NEEDED` matched windows
(13 words in a row), or all windows of a shorter item. Windows of less than
`LITERAL` literal words are evidence only with equal values in their slots.
An item under eight words is one window of its own length.

Before the join, documents are tested against two tables of `BUCKETS` flags
(their size is fixed; false alarms only cost time): each item window names its
longest pair of neighbouring words, only at such pairs document windows are
cut out, and only those whose hash is flagged are joined. So a large benchmark
does not move all windows.

Defined results: null and empty texts and items match nothing; rows that repeat an id share their
verdict, null ids count as one id; an empty benchmark leaves all clean; other
columns are untouched.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsquant.llm.common import let, read, text_of, words_of
from newsquant.session import cut_lineage

WINDOW, NEEDED = 8, 6
#: Least number of literal words in a window.
LITERAL = 5
#: Greatest step from one diagonal to the next that are taken together.
SHIFT = 4
BUCKETS = 1 << 18

#: Placeholders, and what stands for the blank inside a run of names or numbers.
NAME, NUMBER, UNIT, RUN = "\ue010", "\ue011", "\ue012", "\ue013"
#: Unit words, recognised after a number only.
UNITS = (
    "mm|cm|m|km|inch|inches|ft|feet|foot|yd|yards?|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|mg|g|kg|grams?|kilograms?|tons?|tonnes?|lb|lbs|"
    "pounds?|oz|ounces?|ml|l|lit(?:er|re)s?|gal|gallons?|s|sec|secs|seconds?|min|mins|minutes?|h|hr|hrs|hours?|days?|weeks?|months?|years?|"
    "km/h|mph|m/s|kmh|hz|khz|mhz|ghz|w|kw|mw|v|volts?|a|amps?|j|kj|cal|kcal|percent|degrees?|usd|eur|dollars?|euros?|cents?|kb|mb|gb|tb")
_BLANK = "\\x20\\x09-\\x0D"


def plain(text: Column) -> Column:
    """The text without words that have neither letter nor digit, single-spaced, and without the placeholder signs."""
    text = F.regexp_replace(text, f"[{NAME}-{RUN}]", "")
    text = F.regexp_replace(text, f"(?<![^{_BLANK}])[^\\p{{L}}\\p{{N}}\\p{{M}}{_BLANK}]+(?![^{_BLANK}])", "")
    return F.regexp_replace(text, "\\x20{2,}", " ")


def joined(text: Column) -> Column:
    """A plain text with each run of names, and each run of numbers, as one word."""
    text = F.regexp_replace(
        text, f"\\x20(?=\\p{{Lu}})(?<=[^.!?:{_BLANK}]\\x20[\"'(]?\\p{{Lu}}[\\p{{L}}\\p{{N}}\\p{{M}}'-]{{0,40}}\\x20)", RUN)
    return F.regexp_replace(text, "\\x20(?=[+-]?\\p{Sc}?\\p{N})(?<=\\p{N}%?[,;]?\\x20)", RUN)


def template(text: Column) -> Column:
    """Template text of a plain text, word by word."""
    # the capital is tested before what stands in front of it: capitals are rare
    t = F.regexp_replace(text, f"\\p{{Lu}}(?<=[^.!?:{_BLANK}]\\x20[\"'(]?\\p{{Lu}})[\\p{{L}}\\p{{N}}\\p{{M}}'{RUN}-]*", NAME)
    number = "[+-]?\\p{Sc}?\\p{N}+(?:[.,:/]\\p{N}+)*%?"
    t = F.regexp_replace(t, f"{number}(?:[,;]?{RUN}{number})*", NUMBER)
    t = F.regexp_replace(t, f"(?<={NUMBER})(\\x20?)(?i:{UNITS})(?![\\p{{L}}\\p{{N}}\\p{{M}}])", f"$1{UNIT}")
    return F.regexp_replace(F.lower(t), f"[^\\p{{L}}\\p{{N}}\\p{{M}}{NAME}-{UNIT}{_BLANK}]+", "")


def split_words(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, words): the plain words and, place by place, the template words."""
    texts = rows.select(F.col(id_col).alias("id"), joined(plain(text_of(text_col))).alias("t"))
    return texts.select("id", words_of(F.col("t")).alias("raw"), words_of(template(F.col("t"))).alias("words"))


def pair_hash(words: str | Column, at: Column) -> Column:
    """Hash of the template words at `at` and after it (from 0)."""
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{NAME}-{UNIT}]")


def heavy(words: str | Column) -> Column:
    """Whether the words hold too few literal ones to be evidence without their slots' values."""
    return F.size(F.filter(words, lambda w: ~_is_slot(w))) < LITERAL


def bare(raw: Column) -> Column:
    """A slot's value: lowered, without punctuation around it."""
    return F.regexp_replace(F.lower(raw), "^[^\\p{L}\\p{N}\\p{M}]+|[^\\p{L}\\p{N}\\p{M}]+$", "")


def filled(words: str | Column, raw: str | Column) -> Column:
    """The template words with the slots' values."""
    return F.zip_with(words, raw, lambda w, r: F.when(_is_slot(w), F.concat(w, bare(r))).otherwise(w))


def windows(split: DataFrame, starts: list[tuple[Column, int]], wanted=None) -> DataFrame:
    """(id, at, h, raw, words): the windows at `starts`, arrays of places, each with the length of its windows; those that pass an end are left out.

    `wanted`, a test of the hash, is applied inside the row: explode copies
    what stands beside it for every element, so only the windows themselves
    pass it. Its outer form keeps Spark from testing the array below the
    projections as well, which would compute the words twice.
    """

    def cut(places: Column, n: int) -> Column:
        inside = F.array_distinct(F.filter(places, lambda at: (at >= 0) & (at + n <= F.size("words"))))
        plain_cut = F.transform(inside, lambda at: F.struct(
            at.alias("at"), F.slice("raw", at + 1, n).alias("raw"), F.slice("words", at + 1, n).alias("words")))
        hashed = F.transform(plain_cut, lambda w: F.struct(
            w["at"].alias("at"),
            F.when(heavy(w["words"]), F.xxhash64(filled(w["words"], w["raw"]))).otherwise(F.xxhash64(w["words"])).alias("h"),
            w["raw"].alias("raw"), w["words"].alias("words")))
        return hashed if wanted is None else F.filter(hashed, lambda w: wanted(w["h"]))

    every = F.concat(*[cut(places, n) for places, n in starts])
    return split.select("id", F.explode_outer(every).alias("w")).filter(F.col("w").isNotNull()).select("id", "w.*")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _flagged(hashes: DataFrame, column: str):
    """A test whether a hash may be among those of `column`: one bit each in a constant of 64-bit numbers."""
    flags = [0] * (BUCKETS // 64)
    for (b,) in hashes.select(_bucket(F.col(column)).alias("b")).distinct().collect():  # at most BUCKETS numbers
        flags[b >> 6] |= 1 << (b & 63)
    signed = [f - (1 << 64) if f >> 63 else f for f in flags]
    constant = F.from_json(F.lit(json.dumps(signed, separators=(",", ":"))), "array<bigint>")

    def maybe(h: Column) -> Column:
        return let(_bucket(h), lambda b: F.getbit(F.get(constant, F.shiftright(b, 6)), b.bitwiseAND(63)) == 1)

    return maybe


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, diagonal, windows, slots): the consistent alignments that are leaks."""
    every = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    whole = [(F.when(F.size("words") == n, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), n) for n in range(1, WINDOW)]
    items = windows(split_words(benchmark.filter("item_id is not null"), "item_id", "text"), [(every, WINDOW), *whole])
    lengths = F.transform("words", lambda w: F.length(w))
    pairs = F.zip_with(F.slice(lengths, 1, WINDOW - 1), F.slice(lengths, 2, WINDOW - 1), lambda a, b: a + b)
    longest = (F.array_position(pairs, F.array_max(pairs)) - 1).cast("int")
    items = cut_lineage(items.select(
        F.col("id").alias("item_id"), F.col("at").alias("item_at"), "h", F.col("raw").alias("item_raw"),
        F.col("words").alias("item_words"), pair_hash("words", longest).alias("pair"), F.xxhash64(F.get("words", F.lit(0))).alias("first"),
        heavy("words").alias("heavy"), F.size("words").alias("n")).dropDuplicates(["item_id", "item_at", "h"]))
    long = items.filter(F.col("n") == WINDOW)
    maybe_pair, maybe_window = _flagged(long, "pair"), _flagged(items, "h")
    split = split_words(docs, id_col, text_col)
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))
    pairs_at = F.filter(places, lambda at: maybe_pair(pair_hash("words", at)))
    # a pair lies at one of the first WINDOW - 1 places of its window
    starts = F.flatten(F.transform("pairs_at", lambda at: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 2)), lambda o: at - o)))
    searched, kept = [(starts, WINDOW)], [pairs_at.alias("pairs_at")]
    short = items.filter(F.col("n") < WINDOW)
    sizes_of_short = sorted(r.n for r in short.select("n").distinct().collect())  # below WINDOW numbers
    if sizes_of_short:
        maybe_first = _flagged(short, "first")
        kept.append(F.filter(places, lambda at: maybe_first(F.xxhash64(F.get("words", at)))).alias("firsts_at"))
        searched += [(F.col("firsts_at"), n) for n in sizes_of_short]
    found = windows(split.select("id", "raw", "words", *kept), searched, maybe_window)
    sizes = items.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    met = found.join(items, "h").filter(
        (F.col("words") == F.col("item_words")) & (~F.col("heavy") | (filled("words", "raw") == filled("item_words", "item_raw"))))
    pairs = F.filter(
        F.transform("words", lambda w, i: F.struct(
            w.alias("kind"), bare(F.get("item_raw", i)).alias("a"), bare(F.get("raw", i)).alias("b"))),
        lambda p: _is_slot(p["kind"]))
    placed = met.select("id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", pairs.alias("pairs"))
    aligned = placed.groupBy("id", "item_id", "diagonal").agg(
        F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    # neighbouring diagonals: one document's of one item, in order
    along = Window.partitionBy("id", "item_id").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT).cast("int"), F.lit(0))
    near = aligned.withColumn("new", new).withColumn("near", F.sum("new").over(along)).groupBy("id", "item_id", "near").agg(
        F.sort_array(F.collect_list(F.struct("diagonal", "ats", "pairs"))).alias("one"))

    def together(some: Column) -> Column:
        return F.struct(
            F.get(some, F.lit(0))["diagonal"].alias("diagonal"),
            F.array_distinct(F.flatten(F.transform(some, lambda x: x["ats"]))).alias("ats"),
            F.array_distinct(F.flatten(F.transform(some, lambda x: x["pairs"]))).alias("pairs"))

    two = F.transform(F.filter(F.sequence(F.lit(1), F.size("one")), lambda i: i < F.size("one")), lambda i: together(F.slice("one", i, 2)))
    tries = F.when(F.size("one") == 1, F.col("one")).otherwise(F.concat("one", two, F.array(together(F.col("one")))))

    def leak(x: Column) -> Column:
        def unique(side: str) -> Column:
            return F.size(F.array_distinct(F.transform(x["pairs"], lambda p: F.struct(p["kind"], p[side])))) == F.size(x["pairs"])

        return (F.size(x["ats"]) >= F.least(F.lit(NEEDED), F.col("item_windows"))) & unique("a") & unique("b")

    return (near.join(sizes, "item_id").select("id", "item_id", F.explode(F.filter(tries, leak)).alias("x"))
            .select("id", "item_id", "x.diagonal", F.size("x.ats").cast("bigint").alias("windows"), F.size("x.pairs").alias("slots")))


def leak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = leaks(docs, read(spark, sf_dir, "benchmark")).groupBy("id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("windows").alias("windows"), F.max("slots").alias("slots"))
    none = F.array().cast("array<bigint>")
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("windows", F.lit(0).cast("bigint")).alias("matched_windows"), F.coalesce("slots", F.lit(0)).alias("matched_slots"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak; columns as they came."""
    found = leaks(docs, benchmark).select(F.col("id").alias("__id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
