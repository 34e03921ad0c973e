"""The pipeline's stages on the smallest tables: columns, order, and what each may drop."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from relgraph.llm import minhash
from relgraph.llm.common import materialise, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialise(stage(spark, docs, sf), "stage")
    return [*out, docs]


def test_columns_and_sizes(stages):
    documents, *kept, pieces = stages
    assert all(x.columns == documents.columns for x in kept)
    n = [x.count() for x in (documents, *kept)]
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in kept[-1].select("doc_id").collect()}


def test_clean_documents_stay(stages, spark, sf):
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, sf, "labels").collect()}
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in stages[:4]]
    gone = ids[0] - ids[1]
    assert sum(labels.get(i) == (1, 0) for i in gone) <= 0.02 * sum(x == (1, 0) for x in labels.values())
    assert sum(labels.get(i, (1, 0))[0] == 0 for i in ids[1]) <= 0.1 * sum(x[0] == 0 for x in labels.values())
    mixed = ids[2] - ids[3]
    assert sum(labels.get(i) == (1, 0) for i in mixed) <= 0.1 * len([i for i in ids[2] if labels.get(i) == (1, 0)])


def test_near_duplicates_by_brute_force(stages):
    rows = stages[1].select("doc_id", "text").collect()
    sets = [set(minhash.shingle_hashes((r.text or "").encode().lower().split()).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if rows[i].text == rows[j].text or n and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == set(least.values())


def test_every_query_is_registered():
    names = __spark_entry__.queries().keys()
    assert {m[1] for n in names if (m := re.match(r"op(\d+)_", n))} == {str(i) for i in range(1, 11)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "mixing to target weights", "best-fit packing"]
