import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsquant.llm import token_counts as tc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(tc.Merges(PATH))


def n(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_proven_strings_are_one_token(library, counter):
    assert len(counter.merges.proven) > 45_000
    assert all(n(library, s) == 1 for s in counter.merges.proven[::7] if len(regex.findall(tc.PIECES, s)) == 1)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, counter, text):
    assert counter.tokens(text) == n(library, text)


def test_every_blank_and_letter_class(library, counter):
    for code in [*range(0, 0x3100), *range(0xFE00, 0x10000)]:
        if not 0xD800 <= code < 0xE000:
            text = f"a {chr(code)} {chr(code)}b1{chr(code)}"
            if counter.tokens(text) != n(library, text):
                # letters newer than the library's character tables
                assert regex.match(r"\p{Age=15.0}|\p{Age=15.1}|\p{Age=16.0}|\p{Age=17.0}|[\p{L}\p{N}\p{M}]", chr(code)), hex(code)


def test_special_and_long(library, counter):
    for text in ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|> ", "  <|endoftext|>  x", "y" * 20000,
                 "ab" * 9000, " " * 5000, "é" * 3000, "x1" * 4000, "\n" * 999]:
        assert counter.tokens(text) == n(library, text)


def test_forgetting_keeps_counts(library, counter, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", len(counter.merges.proven) + 3)
    fresh = tc.Counter(counter.merges)
    text = "thntblere ououver zzqqx blorpish thntblere enverstach qwrtz"
    assert fresh.tokens(text) == n(library, text)


def test_query(spark, sf, odd, library):
    for path in (SF, sf(odd)):
        rows = spark.read.parquet(f"{path}/documents.parquet").collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n(library, r.text or "")) for r in rows)
        got = tc.token_rows(spark, path).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tc.token_rows(spark, sf([])).count() == 0
