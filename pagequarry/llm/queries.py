"""The registered queries ``op1_`` to ``op13_`` and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import (
    decontaminate, html_text, language_model, order_minhash, periodic_runs, pii, quality, sampling, sentencepieces, sharding, simhash, spelling_variants,
    sqltext, token_files, toxicity,
)
from .columns import crc_of, fold_of, let

SHARDS = 40
#: Labelled rows per class that a classifier is fitted on (label 0, label 1).
TOXICITY_SAMPLE = (4_000, 2_000)
QUALITY_SAMPLE = (2_000, 2_000)
TOXIC_SCORE = 0.7
GOOD_SCORE = 0.3
#: Key of the pseudonyms; a deployment passes its own.
PSEUDONYM_KEY = os.environ.get("PAGEQUARRY_PSEUDONYM_KEY", "pagequarry public demonstration key")


def tokenizer_path() -> str:
    """The SentencePiece model, from the installed public tokenizers unless the environment names another."""
    if path := os.environ.get("PAGEQUARRY_SENTENCEPIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def bpe_path() -> str:
    """The byte-level BPE file, from the installed public tokenizers unless the environment names another."""
    if path := os.environ.get("PAGEQUARRY_BPE_FILE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fitted_toxicity(spark: SparkSession, sf_dir: str) -> toxicity.SubwordSoftmax:
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 3) != 1)
    return toxicity.train(sampling.labelled_sample(table(spark, sf_dir, "documents"), labels, "toxic", TOXICITY_SAMPLE))


def fitted_quality(spark: SparkSession, sf_dir: str) -> quality.CompressionModel:
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)
    prior = labels.agg(F.avg("quality")).first()[0]
    return quality.train(sampling.labelled_sample(table(spark, sf_dir, "documents"), labels, "quality", QUALITY_SAMPLE), 0.5 if prior is None else prior)


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs, "doc_id", SHARDS, tie_columns=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, words64=1, radius=2, ratio=None)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_texts(docs.select("doc_id", F.col("text").cast("binary").alias("text")), fitted_toxicity(spark, sf_dir))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_texts(docs, fitted_quality(spark, sf_dir))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    signed = docs.withColumn("print", order_minhash.order_minhash(F.col("text")))
    pairs = order_minhash.with_next(signed, "doc_id", "tie", ["text", "print"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "print", "next_print", order_minhash.order_minhash(F.col("edited")).alias("edited_print"),
    )
    return edited.select(
        "doc_id", "n_chars", "edited_sha256", order_minhash.fingerprint_text(F.col("print")).alias("fingerprint"),
        order_minhash.fingerprint_text(F.col("edited_print")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        order_minhash.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)

    def count(kind: str):
        return F.size(F.filter("pii", lambda f: f["kind"] == kind)).alias(f"n_{kind}")

    return found.select("doc_id", "text", F.size("pii").alias("n_replaced"), *map(count, pii.PATTERNS))


def encoded(docs: DataFrame) -> DataFrame:
    """Two sampled segmentations of each text, whole token sequences with their digests; all of them decode to the text."""
    sampled = sentencepieces.sample_encodings(docs.select("doc_id", "text"), sentencepieces.Vocabulary(tokenizer_path()), k=2)

    def of_samples(field, name):
        return F.transform("samples", field).alias(name)

    return sampled.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.size("samples").alias("n_samples"),
        of_samples(lambda s: s["ids"], "ids"), of_samples(lambda s: F.size(s["ids"]), "n_pieces"), of_samples(lambda s: F.xxhash64(s["ids"]), "ids_hash"),
        of_samples(lambda s: s["log_prob"], "log_prob"), of_samples(lambda s: s["inclusion"], "inclusion"),
        of_samples(lambda s: s["log_inclusion"], "log_inclusion"),
        F.forall("samples", lambda s: s["exact"]).alias("round_trip"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in texts whose id hash ends in 0, all words from some place on repeat the first of them."""
    h = crc_of(F.col("doc_id"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words, planted)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_periods(table(spark, sf_dir, "documents")))

    def more(a, b):  # exact: a longer share of periods, then the smaller start, then the smaller period
        mine, other = b["length"] * a["period"], a["length"] * b["period"]
        return (mine > other) | ((mine == other) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])))

    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def spelled_words(docs: DataFrame, least_letters: int = 6, least_rows: int = 5) -> DataFrame:
    """``word, n`` of the frequent words of the texts, with misspellings planted by the hash of id and word."""
    runs = docs.select("doc_id", F.explode(spelling_variants.letter_runs(F.col("text"), least_letters)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = spelling_variants.group_variants(spelled_words(table(spark, sf_dir, "documents")))
    return grouped.select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "tokens")
    token_files.write_token_files(docs, folder, bpe_path(), end_id=2)
    read = token_files.read_documents(spark, folder, docs.schema["doc_id"].dataType)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bounded_ring, op2_simhash, op3_toxicity, op4_quality, op5_language_model, op6_html_text, op7_decontaminate, op8_order_minhash, op9_pseudonyms,
        op10_sentencepiece, op11_periodic_runs, op12_spelling_variants, op13_token_files,
    )
}
ORACLES: dict[str, str] = {
    "op7_decontaminate": sqltext.DECONTAMINATE, "op11_periodic_runs": sqltext.PERIODIC_RUNS, "op12_spelling_variants": sqltext.SPELLING_VARIANTS,
}
