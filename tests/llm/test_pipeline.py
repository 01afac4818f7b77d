"""The pipeline on the small sample, stage by stage, against plain Python."""

from test_text_operators import DATA, plain_groups, plain_tokens, shingles

import corpus_pipeline
from creditgrain.llm.common import table
from creditgrain.session import store


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    bench = [shingles(r.text) for r in table(spark, DATA, "benchmark").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = store(stage(spark, docs, DATA), name)
        if name != "byte_bpe":
            assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            gone = before.keys() - after
            assert all(labels.get(i, 0) == 0 for i in gone)
            assert not [i for i in after if labels.get(i, 1) == 0]
        elif name == "exact_dedup":
            last = {t: i for i, t in sorted(before.items())}
            assert after == set(last.values())
        elif name == "near_dedup":
            assert after == {c for _, _, c in plain_groups(list(before.items()))}
        elif name == "decontamination":
            dirty = {i for i, t in before.items() if any(s and len(s & shingles(t)) >= 0.8 * len(s) for s in bench)}
            assert dirty and after == before.keys() - dirty
        else:
            assert {r.doc_id: r.n_tokens for r in docs.collect()} == {i: len(plain_tokens(t)) for i, t in before.items()}
    assert len(corpus_pipeline.STAGES) == 5
