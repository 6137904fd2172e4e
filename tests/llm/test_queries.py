"""The registered queries over whole tables against their SQL, and the pipeline against its stages by brute force."""

import numpy as np
import pytest
from oracle_check import compare, oracle_connection

import corpus_pipeline
from gridgale.llm import decontamination, minhash, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    ours = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(ours, oracle_connection(SF).execute(queries.SQL[name]).df()) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES) and all(isinstance(s, str) for s in queries.SQL.values())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert len(now) == docs.count() and set(now) <= set(seen)
        if name == "quality":
            good = [d for d in seen if d in labels and labels[d].quality == 1 and labels[d].toxic == 0]
            bad = [d for d in seen if d in labels and (labels[d].quality == 0 or labels[d].toxic == 1)]
            assert sum(d in now for d in good) / len(good) > 0.9 and sum(d in now for d in bad) / len(bad) < 0.3
        if name == "near_duplicates":
            out = minhash.near_duplicates(spark.createDataFrame(list(seen.items()), "doc_id long, text string")).collect()
            assert set(now) == {r.component_id for r in out}
        if name == "decontamination":
            index = decontamination.Index.of(items)
            assert set(now) == {d for d, t in seen.items() if not index.leaks(t)}
        if name == "personal_data":
            for d, t in now.items():
                spans = pii.rule_spans(seen[d])
                assert spans or "@" in seen[d] or any(c.isdigit() for c in seen[d]) or t == seen[d]
                assert not pii.rule_spans(t) and all(f"[{pii.KINDS[k].upper()}]" in t for _, k, _ in spans)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        seen = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(out.doc_id) == set(seen)
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= 2048 and seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1].tolist()]


def test_an_empty_corpus_passes_through(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
