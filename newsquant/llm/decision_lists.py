"""Quality rules as a learned decision list (native expressions only).

Sequential covering on labelled documents: rules that reject are grown one
threshold condition at a time, pruned on rows held out from growing, and
emitted as one ordered chain of Spark conditions. All statistics the learner
reads are counts per (feature, bin), aggregated by Spark over every labelled
row; the driver only sees features x bins numbers.

Defined results: a null or empty text has no words, all counts zero and fails
the base rule; without labels (or with one class only) no rule is learned and
the base rule alone decides; rows that repeat an id are judged row by row; an
id without label is judged but not learned from; other columns are untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import BLANK, let, read, text_of, words_of
from newsquant.session import cut_lineage

WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the same text.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts
    with a repeated window pay for the sort that finds the window starts.
    """
    zero = F.lit(0).cast("bigint")

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.transform(s, lambda e, j: F.when(
                (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"]))
            return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

        def count(p: Column) -> Column:
            return F.aggregate(
                p, F.struct(zero.alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
                lambda acc: acc["n"])

        return let(let(ranked, starts), count)

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(zero)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= WINDOW, let(let(hashed, windows), counted)).otherwise(zero)


def base_counts(text: Column) -> Column:
    """Struct of the base counts of one text."""

    def of(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(t, BLANK, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
            F.length(F.regexp_replace(t, "[^0-9]+", "")).cast("bigint").alias("n_digits"),
            F.length(F.regexp_replace(t, "[^!?]+", "")).cast("bigint").alias("n_marks"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    return let(text, lambda t: let(words_of(t), lambda w: of(t, w)))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (c["n_repeat_words"] * 100 > c["n_words"] * 30)


def features(c: Column) -> dict[str, Column]:
    """Ratios the rules may test; a text without words has zeros."""

    def per(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(c[part].cast("double"), c[whole]), F.lit(0.0))

    return {
        "n_words": c["n_words"].cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, row: dict[str, Column]) -> Column:
        x = row[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Reject if all conditions hold."""

    conditions: tuple[Condition, ...]
    rejected: int
    kept: int

    def column(self, row: dict[str, Column]) -> Column:
        return reduce(Column.__and__, [c.column(row) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f"  [{self.rejected}:{self.kept}]"


def _all(conditions: list[Condition], row: dict[str, Column]) -> Column:
    return reduce(Column.__and__, [c.column(row) for c in conditions], F.lit(True))


def _thresholds(rows: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    qs = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(n, qs, 10_000).alias(n) for n in names]).first()
    return {n: sorted(set(got[n] or [])) for n in names}


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Per feature and bin the number of rejected and kept rows; bin b holds values above exactly b cuts."""
    def cell(n: str) -> Column:
        passed = F.filter(F.array(*map(F.lit, cuts[n])), lambda t: F.col(n) > t)
        return F.struct(F.lit(n).alias("f"), F.size(passed).alias("b"))

    cells = F.array(*[cell(n) for n in cuts if cuts[n]])
    counted = rows.select("reject", F.explode(cells).alias("c")).groupBy("c.f", "c.b").agg(
        F.sum(F.col("reject").cast("int")).alias("p"), F.count("*").alias("n"))
    out = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in cuts}
    for f, b, p, n in counted.collect():  # at most features x bins rows
        out[f][b] = [p, n - p]
    return out


def _best(hist: dict[str, list[list[int]]], cuts: dict[str, list[float]], p0: int, n0: int):
    """The condition of the largest information gain, its coverage, or None."""
    best, gain = None, 1e-9
    for f, cells in hist.items():
        below = [0, 0]
        for t, (p, n) in zip(cuts[f], cells, strict=False):
            below = [below[0] + p, below[1] + n]
            for above, (a, b) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                if a and a + b < p0 + n0:
                    g = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = (Condition(f, above, t), a, b), g
    return best


def fit(labelled: DataFrame, names: list[str], max_rules: int = 8, max_conditions: int = 4, bins: int = 64,
        min_precision: float = 0.97, min_covered: int = 5) -> list[Rule]:
    """Rules from rows with the named features, `reject` (boolean) and `grow` (boolean: grow or prune part)."""
    cuts = _thresholds(labelled, names, bins)
    if not any(cuts.values()):
        return []
    row = {n: F.col(n) for n in names}
    left, rules = labelled, []
    while len(rules) < max_rules:
        conditions, here = [], left.filter("grow")
        while len(conditions) < max_conditions:
            hist = _histogram(here, cuts)
            sums = max(([sum(x) for x in zip(*h, strict=True)] for h in hist.values()), default=[0, 0], key=sum)
            if not sums[0] or not sums[1]:
                break
            found = _best(hist, cuts, *sums)
            if found is None:
                break
            conditions.append(found[0])
            here = here.filter(found[0].column(row))
        if not conditions:
            break
        held = left.filter("not grow").agg(*[
            F.count_if(_all(conditions[:k], row) & (F.col("reject") == r)).alias(f"{side}{k}")
            for k in range(1, len(conditions) + 1) for side, r in (("p", True), ("n", False))]).first()
        worth = {k: (held[f"p{k}"] - held[f"n{k}"]) / (held[f"p{k}"] + held[f"n{k}"])
                 for k in range(1, len(conditions) + 1) if held[f"p{k}"] + held[f"n{k}"]}
        if not worth:
            break
        k = max(worth, key=lambda x: (worth[x], -x))
        p, n = held[f"p{k}"], held[f"n{k}"]
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(conditions[:k]), p, n))
        left = left.filter(~rules[-1].column(row))
    return rules


def verdict(rules: list[Rule], row: dict[str, Column]) -> Column:
    """Ordered conditions: the first rule that holds rejects, else the text is kept."""
    chain = F
    for r in rules:
        chain = chain.when(r.column(row), F.lit(False))
    return F.lit(True) if not rules else chain.otherwise(F.lit(True))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts per document."""
    counts = docs.select(F.col(id_col).alias("id"), base_counts(text_of(text_col)).alias("c"))
    return counts.select("id", "c.*")


def learn(counts: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Rules from all labelled rows of `counts` (as `counted` gives them); `labels`: doc_id, quality."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("reject"))
    row = features(F.struct(*[F.col(c) for c in counts.columns if c != "id"]))
    part = F.pmod(F.xxhash64("id"), F.lit(3)) > 0
    labelled = cut_lineage(counts.join(known, "id").select("reject", part.alias("grow"), *[v.alias(k) for k, v in row.items()]))
    return fit(labelled, list(row), **options)


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut_lineage(counted(read(spark, sf_dir, "documents")))
    rules = learn(counts, read(spark, sf_dir, "labels"))
    c = F.struct(*[F.col(x) for x in counts.columns if x != "id"])
    return counts.select(
        F.col("id").alias("doc_id"), *COUNTS, base_failed(c).alias("base_failed"),
        (~base_failed(c) & verdict(rules, features(c))).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rule and the learned list; columns as they came."""
    rules = learn(cut_lineage(counted(docs)), labels)
    judged = docs.withColumn("__counts", base_counts(text_of("text")))
    c = F.col("__counts")
    return judged.filter(~base_failed(c) & verdict(rules, features(c))).drop("__counts")
