"""Hosts of URLs and their registered domains by public-suffix rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from newsquant.functions.lookup import code_of, let

# Second labels under which countries register names, and rules by wildcard and exception.
# A whole list in the public format is read by `read_rules`.
COUNTRY_LABELS = {
    "ar": "com edu gob gov int net org", "au": "asn com edu gov id net org", "br": "art com edu gov mil net org",
    "cn": "ac com edu gov mil net org", "co": "com edu gov mil net nom org", "es": "com edu gob nom org", "gr": "com edu gov net org",
    "hk": "com edu gov idv net org", "id": "ac co go net or sch web", "il": "ac co gov k12 muni net org",
    "in": "ac co edu firm gov net org res", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re",
    "mx": "com edu gob net org", "my": "com edu gov net org", "nz": "ac co govt iwi net org school", "pe": "com edu gob net nom org",
    "ph": "com edu gov net org", "pl": "com edu gov net org", "pt": "com edu gov net org", "sg": "com edu gov net org per",
    "th": "ac co go in mi net or", "tr": "bel com edu gov k12 net org", "tw": "com edu gov idv net org", "ua": "com edu gov net org",
    "uk": "ac co gov ltd me net nhs org plc police", "ve": "co com edu gob gov net org", "vn": "ac com edu gov net org",
    "za": "ac co gov net org web",
}
PATTERN_RULES = ["*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg", "*.sch.uk", "*.kawasaki.jp", "!city.kawasaki.jp"]
RULES = [f"{label}.{country}" for country, labels in COUNTRY_LABELS.items() for label in labels.split()] + PATTERN_RULES

#: Labels of the longest suffix that is looked for, and rules that are sent to all tasks at most.
MAX_LABELS, MAX_RULES = 5, 100_000


def read_rules(spark: SparkSession, path: str) -> list[str]:
    """Rules of a file in the format of the public suffix list; more than MAX_RULES are refused."""
    line = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    rows = spark.read.text(path).select(line.alias("rule")).filter((F.col("rule") != "") & ~F.startswith("rule", F.lit("//")))
    rules = [r.rule.removeprefix(".") for r in rows.distinct().orderBy("rule").limit(MAX_RULES + 1).collect()]
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} suffix rules")
    return rules


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and final dots; an address of version 6 keeps its brackets."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def suffix_labels(labels: Column, rules: Sequence[str] = tuple(RULES)) -> Column:
    """Number of labels of a host's public suffix: the longest rule, one label if there is none; exceptions go first."""
    exact = code_of([r for r in rules if r[0] not in "*!"])
    wild = code_of([r[2:] for r in rules if r.startswith("*.")])
    spared = code_of([r[1:] for r in rules if r.startswith("!")])
    n = F.size(labels)

    def tail(k: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")

    longest = F.lit(1)
    for k in range(2, MAX_LABELS + 1):
        longest = F.when((n >= k) & ((exact(tail(k)) > 0) | (wild(tail(k - 1)) > 0)), k).otherwise(longest)
    for k in range(2, MAX_LABELS + 1):
        longest = F.when((n >= k) & (spared(tail(k)) > 0), k - 1).otherwise(longest)
    return longest


def registered_domain(url: Column, rules: Sequence[str] = tuple(RULES)) -> Column:
    """The label left of the public suffix of a URL's host.

    A host of one label and an address are their own domain; a host that is a
    suffix as a whole has the empty one; a text without host too; null stays.
    """
    def named(host: Column) -> Column:
        address = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | F.startswith(host, F.lit("["))
        labels = F.split(host, r"\.")
        left = F.size(labels) - suffix_labels(labels, rules)
        return F.when(host.isNull() | address | (F.size(labels) == 1), host).when(left > 0, F.get(labels, left - 1)).otherwise("")

    return let(url_host(url), named)
