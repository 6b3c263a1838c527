"""Corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, extra ones
too. An empty table stays empty through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontaminate, langid, packing, secrets, simhash
from stratalog.llm.common import table
from stratalog.llm.queries import byte_bpe
from stratalog.session import dropped, shared_folder

#: Languages to keep; None keeps all that the documents' labels teach.
LANGUAGES: tuple[str, ...] | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is wanted and likelier right than wrong; a null lang
    becomes the prediction. Null, empty and letterless texts go; where no document has a lang,
    all with a letter stay. Repeated rows stay."""
    return langid.keep_languages(docs, LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id. Null and empty texts are
    one group; rows that repeat id and text count as one; rows without an id stay."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of benchmark words; null and empty texts have none. Repeated
    rows and rows without an id are judged each."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars following; null texts stay null."""
    return secrets.redact(docs, vocabulary=byte_bpe())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences; null and empty texts are one end mark.
    Repeated rows are packed as often as they come; extra columns are not read."""
    return packing.pack(docs, byte_bpe())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: No SQL runs a trained classifier, SimHash or a tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, gone once the
    next one is written. The last one's input stays, as the result is read from it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
