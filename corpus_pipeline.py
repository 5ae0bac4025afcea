"""From raw documents to sampled token sequences: toxicity, near duplicates, benchmark passages, personal data, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import decontaminate, pii, queries, simhash, toxicity
from pagequarry.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    scored = toxicity.score_texts(docs, queries.fitted_toxicity(spark, sf_dir), output="__toxicity")
    return scored.where(F.col("__toxicity") < queries.TOXIC_SCORE).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, likeness 0.8 or more) the row with the smallest id stays, rows
    without id last, and among equal ids the one whose text has the smallest MD5.

    Rows are told apart by id and text: unrelated texts under one id all stay.  Of rows equal in both, the one with the
    smallest other columns stays.
    """
    first = materialize(simhash.representatives(docs).withColumnRenamed("id", "__id"), "representatives")
    marked = docs.withColumn("__md5", simhash.text_md5("text"))

    def rows_of(chosen: DataFrame) -> DataFrame:
        return marked.join(chosen, marked["doc_id"].eqNullSafe(chosen["__id"]) & (marked["__md5"] == chosen["md5"]), "left_semi")

    once = rows_of(first.where("n = 1"))
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    again = rows_of(first.where("n > 1")).groupBy("doc_id", "__md5").agg(F.first("text").alias("text"), F.min(F.struct(*others)).alias("others"))
    return once.select(*COLUMNS).unionByName(again.select("doc_id", "text", "others.*").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.find_contamination(docs, queries.table(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS))
    return found.where(F.size("hit_words") == 0).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; the length is that of the new text."""
    return pii.pseudonymize(docs, queries.PSEUDONYM_KEY, found=None).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return queries.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("encoding", encode),
]
#: No stage can be expressed in SQL (trained models, hashes and sampling); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
