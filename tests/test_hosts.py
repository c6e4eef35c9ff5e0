"""Registered domains by public-suffix rules."""

import random

import pytest

from newsquant.functions import hosts
from newsquant.functions.lookup import code_of


def plain(host, rules):
    """One host by the words of the rules."""
    labels = host.split(".")
    if len(labels) == 1 or host.startswith("[") or (len(labels) == 4 and all(x.isdigit() for x in labels)):
        return host
    found = [(False, 1)]
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", e) for p, e in zip(reversed(parts), reversed(labels))):
            found.append((rule[0] == "!", len(parts) - (rule[0] == "!")))
    size = max(found)[1]
    return labels[-size - 1] if len(labels) > size else ""


@pytest.mark.parametrize(("url", "want"), [
    ("http://www.news.or.jp/a", "news"), ("http://site.gob.mx", "site"), ("https://me:pw@a.b.example.co.uk:8080/x@y", "example"),
    ("http://192.168.0.1:80/", "192.168.0.1"), ("http://[2001:db8::1]:80/", "[2001:db8::1]"), ("http://localhost/", "localhost"),
    ("http://co.uk/", ""), ("http://x.city.kawasaki.jp/", "city"), ("http://x.y.z.kawasaki.jp/", "y"), ("http://www.ck/", "www"),
    ("http://a.b.ck/", "a"), ("HTTP://WWW.Example.COM./", "example"), ("no url", ""), ("", ""), ("http:///x", ""), (None, None),
])
def test_domain(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(hosts.registered_domain(df.u)).first()[0] == want


def test_hosts_equal_plain_rules(spark):
    rng = random.Random(2)
    words = ["a", "www", "x", "co", "com", "kawasaki", "city", "sch", "ck", "uk", "jp", "gob", "mx", "or"]
    names = [".".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(f"http://{n}/",) for n in names], "u string")
    got = [r[0] for r in df.select(hosts.registered_domain(df.u)).collect()]
    assert got == [plain(n, hosts.RULES) for n in names]


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("// words\n\nblog.example  and more\n*.deep.test\n!not.deep.test\nBlog.Example\n")
    rules = hosts.read_rules(spark, str(path))
    assert sorted(rules) == ["!not.deep.test", "*.deep.test", "blog.example"]
    df = spark.createDataFrame([("http://me.blog.example/",), ("http://w.x.deep.test/",), ("http://v.not.deep.test/",)], "u string")
    assert [r[0] for r in df.select(hosts.registered_domain(df.u, rules)).collect()] == ["me", "w", "not"]


def test_codes(spark):
    values = [f"v{i}" for i in range(1000)] + ["é", ""]
    df = spark.createDataFrame([(v,) for v in [*values, "w", None]], "v string")
    assert [r[0] for r in df.select(code_of(values)(df.v)).collect()] == [*range(1, len(values) + 1), 0, 0]
    assert [r[0] for r in df.select(code_of([])(df.v)).distinct().collect()] == [0]
