"""Plans of the operators: native where asked, narrow reads, no hidden shuffles."""

import os
import re

import pytest

from stratalog.llm import queries
from stratalog.llm.common import spread

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_chat_preferences", "op7_decontamination"])
def test_native_operators_run_no_python(spark, name):
    found = plan(queries.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", found)


@pytest.mark.parametrize("name", ["op3_packing", "op4_license_scan", "op7_decontamination", "op8_quality_rules", "op9_secret_scan"])
def test_only_needed_columns_are_read(spark, name):
    found = plan(queries.QUERIES[name](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in found and "lang:" not in found


def test_narrow_operators_do_not_shuffle_large_tables(spark, monkeypatch):
    for module in (queries.packing, queries.quality, queries.secrets):
        monkeypatch.setattr(module, "spread", lambda df: df)
    for name in ("op3_packing", "op6_url_filter", "op8_quality_rules", "op9_secret_scan"):
        assert "Exchange" not in plan(queries.QUERIES[name](spark, SF))


def test_spread_counts_splits_of_scans_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grouped = docs.groupBy("lang").count()
    assert spread(grouped) is grouped
    assert spread(docs.select("doc_id")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_batches_for_python_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "repeat('long words here. ', 6000) as text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = [r.n for r in spread(texts).mapInArrow(sizes, "n long").collect()]
    assert max(found) < 10_000_000 and len(found) >= 4
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    spread(texts)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
