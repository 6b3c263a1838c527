"""The registered queries on the smallest tables; the pipeline against its operators."""

import os

import duckdb
import pytest
from test_operators import brute

import corpus_pipeline
from stratalog.llm import decontaminate, packing, queries, secrets

SF = "/root/testdata/sf0.001"
ORACLES = queries.oracles()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in result.description)
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert columns == sorted(found.columns)
    assert sorted(repr([r[c] for c in columns]) for r in found.collect()) == sorted(repr([r[i] for i in at]) for r in result.fetchall())


def test_languages_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries.op10_language_id(spark, SF).collect() if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Every stage on nulls, empty and long texts, repeats, clashing columns; and on no rows."""
    os.symlink(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, text_key string, hash long, none boolean"
    more = ("x", 1, "k", 2, True)
    rows = [(i, f"the words of document {i} are these and no others {i * 7}", "en", "s", 1, *more) for i in range(12)]
    rows += [rows[0], (50, None, "en", None, None, *more), (51, "", None, "s", 0, *more), (52, "long " * 50_000, None, "s", None, *more), (None, "a row that has no id at all", "en", "s", 3, *more)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        docs.write.parquet(f"{tmp_path}/{len(data)}/documents.parquet")
        os.symlink(f"{SF}/benchmark.parquet", tmp_path / str(len(data)) / "benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            ids = [r.doc_id for r in out.collect()]
            assert len(ids) == {"language_id": len(data) - 2, "near_duplicates": len(data) - 2}.get(name, len(data)) if data else not ids, name
        found = corpus_pipeline.run(spark, f"{tmp_path}/{len(data)}").collect()
        assert {r.doc_id for r in found} == ({*range(12), 52, None} if data else set())


def test_pipeline(spark):
    """Plain Python over the same documents gives the same pieces of text."""
    docs = {r.doc_id: r for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    roots = brute({d: r.text for d, r in docs.items()})
    docs = {d: r for d, r in docs.items() if roots[d] == d}
    bad = {r.doc_id for r in decontaminate.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    words = secrets.vocabulary_words(queries.byte_bpe())
    texts = {d: secrets.redacted(r.text, secrets.spans(r.text, words=words)) for d, r in docs.items() if d not in bad}
    encode = packing.Encoder(packing.definition_of(queries.byte_bpe()))
    want = {d: len(encode(t)) // 4 + 1 for d, t in texts.items()}
    found = corpus_pipeline.run(spark, SF).collect()
    got: dict = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want
