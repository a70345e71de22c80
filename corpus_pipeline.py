"""The corpus pipeline: stages over documents, each calling one operator of namewright.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs. Rows are told apart by id
and text hash, null ids included, so what a stage rejects goes and everything else stays. Stages
accept nulls in any column, empty tables, repeated rows and further columns as their operators do.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm import near_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from namewright.llm.common import stored, table

#: No stage but the last could be SQL, and that one needs a tokenizer; tests compare with brute force.
ORACLE_SQL = None
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of a repeated passage: fifty words of four letters and a space, so that passages of over fifty words are cut.
REPEAT_BYTES = 250

#: Columns of documents; further columns are carried through under other names, so that none clashes with an operator's.
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage):
    """The stage, with the columns beyond CORE out of its way."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        aside = [c if c in CORE else f"_carried{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*aside), sf_dir).select(*aside).toDF(*names)

    return run_stage


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, text_hash) that verdicts rejects."""
    gone = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")


@_carrying
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality posterior is below one half."""
    out = quality_classifier.score(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.filter("kept").select(*docs.columns)


@_carrying
def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the counting rules or the distribution distances reject."""
    return _without(docs, quality_rules.score(docs))


@_carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group (five-word shingles, similarity of 0.8 or more)."""
    return _without(docs, near_dedup.dedup(docs))


@_carrying
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of REPEAT_BYTES or more that also stand elsewhere; n_chars follows the text. Documents stay, be their text empty."""
    out = suffix_dedup.remove(docs, window=REPEAT_BYTES, as_text=True)
    changed = {"text": F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of power-of-two lengths."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
