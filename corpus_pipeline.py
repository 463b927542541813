"""A training-data pipeline over ``documents``: STAGES one after another, each written and read again.

1. toxicity: documents with a score of 0.5 or more go.
2. lines: of lines that are equal or nearly so one stays, in the whole corpus.
3. copies: of documents that are copies or near copies one stays, the one with the smallest doc_id. Candidates come from SimHash
   fingerprints by the pigeonhole search, and from MinHash where these fall short; exact Jaccard similarity decides.
4. mixture: documents are taken as often as a mix of the sources to target weights reads them.
5. tokens: token identifiers of every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmcrate.llm import bpe, common, copies, lines, mixture, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Word shingles of the near-duplicate stage, and Jaccard similarity from which documents count as copies.
SHINGLE, SIMILAR = 5, 0.8


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on their labelled part, does not reject. Null texts stay."""
    docs = common.pick(docs, *COLUMNS)
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(docs, model)("text") < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one; n_chars follows the text."""
    rows = lines.dedup_lines(common.pick(docs, *COLUMNS))
    return rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: the first by doc_id (null last), then by hash of the text; of repeated rows any one.

    Rows are named by doc_id and text: different texts that share a doc_id, or have none, stay
    unless they are copies. Documents without words are no copies of each other and stay.
    """
    rows = common.pick(docs, *COLUMNS)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    real = rows.where(worded)
    found = copies.copy_classes(real, SHINGLE, SIMILAR)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("th") == F.col("kept_th")))).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    real = real.withColumn("_th", F.xxhash64("text"))
    kept = real.join(gone, real["doc_id"].eqNullSafe(gone["_d"]) & (real["_th"] == gone["_t"]), "left_anti").dropDuplicates(["doc_id", "_th"])
    return kept.select(*COLUMNS).union(rows.where(~worded))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of whole documents reads them (``mixture.read_times``); those never read go. Rows without words stay once.

    Every row is read for itself, whatever its doc_id: null, shared and repeated ones too.
    Texts of any length are read whole; an empty table gives no rows; other columns are not read.
    """
    rows = common.settle(common.pick(docs, *COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    times = mixture.read_times(rows, "_row").where("times > 0").withColumnRenamed("_row", "_r")
    repeats = rows.join(times, F.col("_row") == F.col("_r")).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeats.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row."""
    return bpe.encode_documents(docs, keep=("doc_id", "source"))


STAGES = [("toxicity", clean), ("lines", dedup_lines), ("copies", drop_copies), ("mixture", mix), ("tokens", tokens)]

#: SQL cannot express the trained model, the candidate search or the tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
