"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next one's documents. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontam import drop_contaminated
from millrace.llm.durable import folder, remove
from millrace.llm.langid import UNDETERMINED, fit_languages, held_out, predict_language
from millrace.llm.near_dups import keep_first_documents
from millrace.llm.pieces import encoded, load_model
from millrace.llm.pii import redact_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: ``lang`` becomes the language that the document is written in, whatever it was
    labelled; documents in which none is recognised go, that is those of null text or without letters.
    Rows that are held out teach nothing here either. If no row is labelled, no language is known and
    the documents stay as they are."""
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.select(COLUMNS)
    told = docs.select(*COLUMNS, predict_language(F.col("text"), model)["lang"].alias("told"))
    return told.where(F.col("told") != UNDETERMINED).withColumn("lang", F.col("told")).select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each class the document of smallest id stays, of rows of one id and text the
    first by their other columns. Rows without an id, and texts without words, are alone in their class."""
    return keep_first_documents(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark window go. Null and empty texts hold none, and
    an empty benchmark has none; each of several equal rows is judged alike."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: each span becomes the name of its kind, and ``n_chars`` follows; all documents stay, null and empty
    texts as they are."""
    return redact_documents(docs, "text", "n_chars").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the documents with their ids; those whose ids don't give the text back are marked. Null and
    empty texts have no ids. All documents stay."""
    out = docs.select(*COLUMNS, encoded(F.col("text"), load_model()).alias("code"))
    return out.select(*COLUMNS, "code.ids", "code.n_tokens", "code.ids_sha256", "code.word_parity", "code.round_trip")


STAGES = [
    ("language_id", identify),
    ("minhash_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("sentencepiece", encode),
]

#: Language ID, the tagger and the vocabulary can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder. A stage's folder is
    removed when the next one is written, and all of them when a stage fails; the last one's is the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    place, before = f"{folder(spark)}/pipeline-{uuid4().hex}", None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
            docs = spark.read.parquet(f"{place}/{name}")
            if before:
                remove(spark, before)
            before = f"{place}/{name}"
    except Exception:
        remove(spark, place)
        raise
    return docs
