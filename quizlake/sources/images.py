"""Frame image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions.frames import frame_index

# --- fixed values -----------------------------------------------------------------
LISTED_IMAGES = r"\.(?:png|jpg|jpeg|webp)$"
# -----------------------------------------------------------------------------------


def _job_of(path):
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """PNG frames of `path`/<job>/frame_n.png, decoded. An image that cannot be decoded stays
    as a row of width -1: the filters must see it."""
    images = spark.read.format("image").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path)
    origin = F.col("image.origin")
    return images.select(
        _job_of(origin).alias("job_id"),
        F.coalesce(frame_index(origin), F.lit(0).cast("bigint")).alias("frame_idx"),
        origin.alias("path"),
        "image",
    )


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """All image files under `path` with their lower-case order key; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.filter(name.rlike(LISTED_IMAGES)).select(
        _job_of("path").alias("job_id"), "path", "length", name.alias("order_key")
    )
