"""The corpus pipeline: five stages over `documents`, each on all that the stage before it kept.

1. language ID: documents that are in no learned language (no letters, or a posterior below 0.5) go;
2. line dedup: lines that came earlier go; a document that has nothing left goes with them;
3. near dedup: of each class of near copies the one with the smallest doc_id stays;
4. decontamination: documents that hold a benchmark item go;
5. packing: what is left is packed into sequences; one row per piece.

Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from tidemark.llm.common import materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_POSTERIOR = 0.5
BROADCAST_IDS = 1_000_000  # some ten MB
PYTHON_BYTES = 4 << 20  # of texts that a Python worker of a stage gets at a time, at most PYTHON_ROWS of them; one longer text comes alone
PYTHON_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Settings of the session: a stage's result is computed after the stage has returned, so they can't be set back here."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PYTHON_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PYTHON_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is learned with a posterior of LEAST_POSTERIOR or more. Those that have no text, no letter or no learned
    language go, whatever their length; of repeated rows each is judged; an empty table stays empty.
    """
    _small_batches(spark)
    models = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # doc_id is carried by the operator itself
    found = language_id.predict(docs, models, carry=COLUMNS[1:])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR)).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came earlier, their characters counted anew. A document all of whose lines went goes; null and
    empty texts have none and stay; repeated rows keep what the first of them keeps; an empty table stays empty.
    """
    done = line_dedup.dedup_lines(docs, keep_columns=("lang", "source"))
    left = done.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose ids are not in `ids`, which are broadcast if they are counted to be few; rows without an id stay."""
    ids = materialize(ids.select("doc_id").distinct(), "removed-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id; null and empty texts, and rows without an id, are copies of none
    and stay; repeated rows of an id stay or go together; an empty table stays empty.
    """
    return _without(docs, near_dedup.near_duplicates(docs).where(~F.col("kept")))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and rows without an id stay; repeated rows of an id stay or go
    together; with an empty benchmark all stay.
    """
    return _without(docs, decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty ones; repeated rows are
    packed each; an empty table gives no piece.
    """
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: The stages can't be said in SQL; tests/llm compares each, and run(), with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
