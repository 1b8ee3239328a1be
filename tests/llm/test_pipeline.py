"""The stages, one after another, on the smallest tables."""

import collections

import corpus_pipeline
from orbweave.llm.queries import QUERIES


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        rows.append(docs.count())
    assert rows[0] > rows[1] > rows[2] >= rows[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(total[d] % tokens[d] == 0 and total[d] // tokens[d] <= 2 for d in total)


def test_one_query_for_each_operator():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 11))
