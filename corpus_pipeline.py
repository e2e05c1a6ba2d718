"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Stages but the last return the columns of ``documents``. The quality classifier drops what it rejects, MinHash keeps
one document of each group of near duplicates, decontamination drops documents that hold a benchmark window, the
secret scan replaces secrets in the texts, and the last stage encodes and decodes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.llm import bpe, decontam, minhash, quality, secrets
from urbanloom.llm.queries import vocabulary
from urbanloom.llm.storage import scratch_path, stored
from urbanloom.llm.training import held_out
from urbanloom.session import load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score at least 0.7; the model learns from labelled rows of ``docs`` that are not held out."""
    weights = quality.fit(docs, load(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    scored = quality.classify(docs, weights, carry=COLUMNS)
    return scored.where("score >= 0.7").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8): that of least id.

    Rows are written with a key of their own, so of rows that repeat the kept id one stays, and a row without an id stays
    only where its whole group has none. Documents without words are no one's duplicates and all stay.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row").alias("key"), "text")
    gone = minhash.near_duplicates(keyed, id_col="key").where("not kept").select("key.row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    scanned = decontam.contamination(docs, load(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return scanned.where("size(hits) = 0").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by ``<secret>`` and counts the characters anew; no document is dropped."""
    scanned = secrets.scan(docs, carry=("doc_id", "lang", "source", "n_chars"))
    changed = F.size("spans") > 0
    return scanned.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text, decodes the ids and returns counts and digests."""
    return bpe.digests(bpe.encode_decode(docs, *vocabulary()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: The classifier can't be expressed in SQL, so the whole pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
