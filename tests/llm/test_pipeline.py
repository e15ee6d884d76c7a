"""The pipeline against the same stages in plain Python."""

import hashlib

import __spark_entry__ as driver
import corpus_pipeline
from recordmill.llm import compression_quality

from tests.llm.test_pairs import groups_of, line_truth, shingles

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_python(llm):
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    model = compression_quality.fit(docs, llm.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    scores = compression_quality.predict(model, [t for _, t in rows])
    kept = [r for r, s in zip(rows, scores) if s >= 0.5]
    texts, _ = line_truth(kept)
    kept = [(i, texts[i]) for i, t in kept if texts[i].strip() or not t.strip()]
    sets = {i: shingles(t, 5) for i, t in kept}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    groups = groups_of(links, sets)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    items = [shingles(r.text, 5) for r in llm.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(10 * len(sets[i] & x) >= 8 * len(x) for x in items)]
    got = corpus_pipeline.run(llm, FOLDER).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept}
    assert 0 < len(got) < len(rows) and all(4 * r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_survive_odd_rows(llm, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "'en' as lang", "key as source", "length(text) as n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, FOLDER)
        assert out.columns == docs.columns
        out.collect()
        assert stage(llm, docs.limit(0), FOLDER).collect() == []
    assert corpus_pipeline.STAGES[-1][1](llm, docs, FOLDER).count() == 16


def test_every_operator_is_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and "pipeline" in driver.queries()
