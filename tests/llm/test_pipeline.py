"""The pipeline against its stages done in plain Python."""

import pytest

from .test_ops import brute_groups, brute_hits, brute_lines, brute_targets


def test_stages_in_order(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    stages = [f for _, f in pipeline.STAGES]
    from regnet.llm import mixing, quality

    kept = stages[0](spark, docs, data)
    good = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in rows} == good

    lines = stages[1](spark, kept, data)
    want = {r.doc_id: "\n".join(b) for r, _, b in brute_lines(rows)}
    rows = lines.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    groups = {d: c for d, _, c in brute_groups(rows)}
    rows = [r for r in rows if groups[r.doc_id] == r.doc_id]
    one = stages[2](spark, lines, data)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in rows}

    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    clean = [r for r, _, hit, _ in brute_hits(rows, items) if not hit]
    left = stages[3](spark, one, data)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in clean}

    mixed = {r.doc_id: r for r in pipeline.run(spark, data).collect()}
    assert set(mixed) == {r.doc_id for r in clean}
    sizes = {}
    for r in mixed.values():
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = brute_targets(sizes)
    for s, t in targets.items():
        assert abs(sum(r.taken for r in mixed.values() if r.source == s) - t) <= 1.5 * mixing.BLOCK
