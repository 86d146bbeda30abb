"""Registered text queries against their SQL, and the pipeline against its operators' brute-force rules."""

from collections import defaultdict

import oracle
import pytest

import corpus_pipeline
from creditmill.llm import mixture, quality
from creditmill.llm.queries import QUERIES, SQL

SF = f"{oracle.TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect("0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, SF), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_covers_the_whole_table(spark, name):
    source = "conversations" if name == "op10_chat_quotes" else "documents"
    key = "conv_id" if name == "op10_chat_quotes" else "doc_id"
    whole = spark.read.parquet(f"{SF}/{source}.parquet")
    assert {r[0] for r in QUERIES[name](spark, SF).select(key).collect()} == {r[0] for r in whole.select(key).collect()}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, steps = {r.doc_id: r for r in docs.collect()}, {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF).cache()
        steps[name] = current
        if name != "packing":
            assert current.columns == docs.columns
    good = {r.doc_id for r in steps["quality rules"].collect()}
    assert good == {r.doc_id for r in quality.digest(docs).where("kept").collect()}
    last = {}
    for d in good:
        last[rows[d].text] = max(d, last.get(rows[d].text, d))
    exact = {r.doc_id for r in steps["exact dedup"].collect()}
    assert exact == set(last.values())
    from test_text_operators import expected_components

    near = {r.doc_id for r in steps["near dedup"].collect()}
    assert near == {c for _, _, c in expected_components([(d, rows[d].text) for d in exact])}
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixture.plan(steps["near dedup"]).collect()}
    mixed = defaultdict(int)
    for r in steps["source mixture"].collect():
        mixed[r.doc_id] += 1
    assert dict(mixed) == {d: n for d, n in taken.items() if n}
    tokens = defaultdict(int)
    for p in current.collect():
        tokens[p.doc_id, p.doc_tokens] += p.length
    assert {(d, n): mixed[d] * n for d, n in tokens} == dict(tokens) and {d for d, _ in tokens} == set(mixed)
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() == current.count()
