"""The pipeline's rows against its steps done again with brute force on the smallest table."""

import sentencepiece

import corpus_pipeline
from newsquant.llm import decision_lists, entropy_secrets, piece_lattice, template_leaks
from tests.llm.test_entropy_secrets import added, base
from tests.llm.test_shingle_overlap import brute as groups

SF = "/root/testdata/sf0.001"


def masked(text):
    known = base(text)
    out, at = [], 0
    for s, k, e in sorted(known + added(text, known)):
        if s >= at:
            out.append(text[at:s] + f"<{entropy_secrets.KINDS[k]}>")
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece_encoding"]


def test_run_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in decision_lists.quality_rows(spark, SF).collect() if r.kept}
    first = {c for _, c in groups([(d, texts[d]) for d in sorted(kept)])}
    leaked = {r.doc_id for r in template_leaks.leak_rows(spark, SF).collect() if r.contaminated}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.model_path())
    want = {d: library.encode(masked(texts[d])) for d in first - leaked}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(texts)


def test_odd_rows_and_empty_tables(spark, sf, odd):
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    bench = spark.createDataFrame([], "item_id BIGINT, text STRING")
    words = [(20 + i, " ".join(f"w{i}k{j}" for j in range(30))) for i in range(3)]
    for rows, n in ((odd + words, 3), ([], 0)):
        assert corpus_pipeline.run(spark, sf(rows, labels=labels, benchmark=bench)).count() == n
