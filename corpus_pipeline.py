"""Corpus pipeline: five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. The first four return the columns of documents; the last returns the
mixed blocks.

* language_id: documents whose language can't be told go.
* line_dedup: later occurrences of repeated three-line windows are cut out of the texts.
* near_dedup: of each class of near-duplicates the document with the smallest doc_id stays.
* decontamination: spans that the benchmark holds are cut out; documents that consist mostly of them go.
* mixing: the blocks of the mix, by shard and slot.

Defined results: each stage keeps what its operator defines for nulls, empty and very long texts, ties and
repeated rows; extra columns are carried along up to the last stage; empty tables give an empty mix.
"""

from __future__ import annotations

import uuid

from millrace.llm import decontaminate, langid, linededup, mixing, simhash
from millrace.llm.common import shared_folder, table


def language_id(spark, docs, sf_dir):
    return langid.accepted(docs)


def line_dedup(spark, docs, sf_dir):
    return linededup.dedup(docs)


def near_dedup(spark, docs, sf_dir):
    return simhash.one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix)]

#: SQL has no conditional random field; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; what stands between the stages is written below spark.checkpoint.dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
