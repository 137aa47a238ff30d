"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from cohortlens.llm import bin_packing, decontamination, near_duplicates, queries, toxicity
from cohortlens.llm.common import table, written
from test_native_operators import found
from test_token_operators import check_packing, crc, encode


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, tables = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], sf), name))
        if name != "packing":
            assert tables[-1].columns == columns
    start, calm, unique, clean, private, packed = tables

    model = queries.toxicity_model(spark, start, sf)
    rejected = {r.doc_id for r in toxicity.score(start, model).collect() if r.predicted}
    assert {r.doc_id for r in start.collect()} - rejected == {r.doc_id for r in calm.collect()}

    kept = {r.doc_id for r in near_duplicates.near_duplicates(calm).collect() if r.kept}
    assert kept == {r.doc_id for r in unique.collect()} and unique.count() == len(kept)
    assert all(r.kept for r in near_duplicates.near_duplicates(unique).collect())

    bench = table(spark, sf, "benchmark")
    assert not any(r.contaminated for r in decontamination.contamination(clean, bench).collect())
    originals = {e for r in clean.collect() for e in found(r.text)}
    assert originals and not any(originals & set(found(r.text)) for r in private.collect())

    rows = packed.collect()
    texts = {r.doc_id: r.text for r in private.collect()}
    ids = {i: [*encode(t), 1] for i, t in texts.items()}
    assert {r.doc_id for r in rows} == set(texts)
    assert all(crc(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 for r in rows)
    total = sum(r.length for r in rows)
    assert total == sum(map(len, ids.values())) and check_packing(rows, bin_packing.CAPACITY) <= -(-total // 4096) + 1

    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_hard_rows_and_empty_table(spark, sf, hard_docs):
    for docs in (hard_docs, hard_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, sf), name)
            assert name == "packing" or out.columns == docs.columns
            docs = out
    assert docs.count() == 0
