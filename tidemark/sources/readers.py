"""Sources (A1-A4): fixture tables, embeddings, annotation CSVs, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import l2_normalize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_embeddings(spark: SparkSession, sf_dir: str, normalize: bool = True,
                    name: str = "embeddings") -> DataFrame:
    """A1 + A2: ``(id, embedding array<double>, label)``; L2-normalised on request.

    No shuffle and no drop: the scan is projected to three columns and the
    normalisation is a per-row higher-order expression.
    """
    df = table(spark, sf_dir, name).select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("int").alias("label"))
    if normalize:
        df = df.withColumn("embedding", l2_normalize("embedding"))
    return df


# The three question headers a vote export may carry.
QUESTION_HEADERS = (
    "Does the image reflect a label error?",
    "Do the images reflect an irrelevant sample?",
    "Do the images reflect a near-duplicate?",
)


def read_annotations(spark: SparkSession, path: str, annotators: list[str]) -> DataFrame:
    """A3: annotation CSV with ``sampling_type``, ``Ranking`` and vote columns.

    The schema is given, never inferred: votes are strings (Yes / No / empty).
    """
    ddl = ", ".join(["item_id BIGINT", "sampling_type STRING", "Ranking INT"]
                    + [f"`{a}` STRING" for a in annotators])
    return spark.read.schema(ddl).option("header", True).csv(path)


def harmonise_question(df: DataFrame, target: str = "label") -> DataFrame:
    """Rename whichever question header is present to ``target``."""
    present = {c: target for c in QUESTION_HEADERS if c in df.columns}
    return df.withColumnsRenamed(present) if present else df


def manifest(df: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """A4: ``(filename, label)`` with id and label encoded as ``{id}|{label}.jpg``."""
    return df.select(
        F.format_string("%d|%s.jpg", F.col(id_col), F.col(label_col).cast("string")).alias("filename"),
        F.col(label_col).cast("string").alias("label"))


def decode_manifest(df: DataFrame, file_col: str = "filename") -> DataFrame:
    """A4 inverse: recover ``(id, label)`` from the file stem."""
    stem = F.regexp_extract(F.col(file_col), r"^(?:.*/)?([^/]*?)(?:\.[^./]*)?$", 1)
    return df.select(
        F.split_part(stem, F.lit("|"), F.lit(1)).cast("bigint").alias("id"),
        F.split_part(stem, F.lit("|"), F.lit(2)).cast("int").alias("label"))
