"""Question-bank files, polish-cache files and document sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "struct<id:string, stem:string, options:map<string,string>, sourceFrames:array<string>, "
    "confidence:double, topics:array<string>>"
)
FRAME = "struct<name:string, meanConfidence:double, charCount:int>"
BANK = f"version int, framesDir string, frames array<{FRAME}>, questions array<{QUESTION}>"
CACHE_VERSION = BANK_VERSION = 1
SOURCES_PER_PART, QUESTIONS_PER_LINE = 1000, 200


def _banks(spark: SparkSession, path: str, one_per_file: bool) -> DataFrame:
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    banks = spark.read.schema(BANK).option("recursiveFileLookup", "true").json(path, multiLine=one_per_file)
    return banks.withColumn("job_id", F.regexp_replace(folder, "^job_id=", ""))


def _pieces(spark: SparkSession, path: str, one_per_file: bool) -> DataFrame:
    """Question objects with their number: the one in their id, else their place."""
    rows = _banks(spark, path, one_per_file).select("job_id", F.posexplode("questions").alias("i", "q"))
    number = F.nullif(F.regexp_extract("q.id", r"^q([0-9]+)$", 1), F.lit("")).cast("bigint")
    return rows.select("job_id", F.coalesce(number, (F.col("i") + 1).cast("bigint")).alias("q_idx"), "q")


def read_banks(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Questions of bank files: what `write_bank` wrote, or (`one_per_file`) foreign files of
    one JSON object each, <job>/<name>.json. Source frames: `read_bank_sources`."""
    rows = _pieces(spark, path, one_per_file)
    return rows.dropDuplicates(["job_id", "q_idx"]).select("job_id", "q_idx", "q.id", "q.stem", "q.options", "q.confidence", "q.topics")


def read_bank_sources(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """(job_id, q_idx, source_frame) of bank files."""
    rows = _pieces(spark, path, one_per_file)
    return rows.select("job_id", "q_idx", F.explode("q.sourceFrames").alias("source_frame")).distinct()


def read_bank_frames(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """(job_id, name, mean_confidence, char_count) of bank files."""
    rows = _banks(spark, path, one_per_file).select("job_id", F.explode("frames").alias("f"))
    return rows.select("job_id", "f.name", F.col("f.meanConfidence").alias("mean_confidence"), F.col("f.charCount").alias("char_count"))


def existing_or_default(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Bank path of a job: the recorded one if it exists, else the default one if that
    exists. `jobs`: job_id, recorded_path, default_path; `listing`: path."""
    found = listing.select(F.col("path").alias("_p")).distinct().withColumn("_there", F.lit(True))
    recorded = found.withColumnsRenamed({"_p": "recorded_path", "_there": "_recorded"})
    default = found.withColumnsRenamed({"_p": "default_path", "_there": "_default"})
    return jobs.join(recorded, "recorded_path", "left").join(default, "default_path", "left").select(
        "job_id",
        F.when(F.col("_recorded"), F.col("recorded_path"))
        .when(F.col("_default"), F.col("default_path"))
        .alias("bank_path"),
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Polish-cache files to rows; files of another version are ignored. Every job has one in
    a folder of its name."""
    files = spark.read.schema(
        "v int, polishByHash map<string, struct<stem:string, options:map<string,string>>>"
    ).json(path, multiLine=True)
    job = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
    return files.filter(F.col("v") == CACHE_VERSION).select(
        job.alias("job_id"), F.explode("polishByHash").alias("content_hash", "entry")
    ).select("job_id", "content_hash", "entry.stem", "entry.options")


def write_bank(questions: DataFrame, sources: DataFrame, frames: DataFrame, path: str, frames_dir: str = "") -> None:
    """Bank objects as JSON lines, partitioned by job: each line has the shape of a whole bank
    and holds a run of its questions or frames, so no line grows with a job. A question seen in
    very many frames is in several lines, each with a part of its source frames.
    `frames`: job_id, name, mean_confidence, char_count."""
    key = ["job_id", "q_idx"]
    parts = sources.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SOURCES_PER_PART).alias("_parts"))
    part = F.pmod(F.xxhash64("source_frame"), F.col("_parts"))
    listed = sources.join(parts, key).groupBy(*key, part.alias("part")).agg(
        F.array_sort(F.collect_set("source_frame")).alias("sourceFrames")
    )
    topics = F.col("topics") if "topics" in questions.columns else F.lit(None).cast("array<string>")
    question = F.struct(
        "id", "stem", "options", F.coalesce("sourceFrames", F.array().cast("array<string>")).alias("sourceFrames"),
        F.round("confidence", 4).alias("confidence"), topics.alias("topics"),
    )
    asked = (
        questions.join(listed, key, "left")
        .groupBy("job_id", F.floor((F.col("q_idx") - 1) / QUESTIONS_PER_LINE).alias("run"), F.coalesce("part", F.lit(0)).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("q_idx", F.to_json(question).alias("q")))).alias("_q"))
    )
    asked = asked.select("job_id", "run", "part", F.transform("_q", lambda x: F.from_json(x["q"], QUESTION)).alias("questions"))
    shown = F.struct("name", F.round("mean_confidence", 4).alias("meanConfidence"), F.col("char_count").cast("int").alias("charCount"))
    counted = frames.groupBy("job_id").agg(F.ceil(F.count(F.lit(1)) / SOURCES_PER_PART).alias("_parts"))
    seen = (
        frames.join(counted, "job_id")
        .groupBy("job_id", F.pmod(F.xxhash64("name"), F.col("_parts")).alias("run"))
        .agg(F.array_sort(F.collect_list(shown)).alias("frames"))
        .withColumn("part", F.lit(-1).cast("bigint"))
    )
    rows = asked.unionByName(seen, allowMissingColumns=True).select(
        "job_id", "run", "part", F.lit(BANK_VERSION).alias("version"), F.lit(frames_dir).alias("framesDir"),
        F.coalesce("frames", F.array().cast(f"array<{FRAME}>")).alias("frames"),
        F.coalesce("questions", F.array().cast(f"array<{QUESTION}>")).alias("questions"),
    )
    (
        rows.repartitionByRange("job_id", "run", "part")
        .sortWithinPartitions("job_id", "run", "part")
        .drop("run", "part")
        .write.mode("overwrite")
        .partitionBy("job_id")
        .json(path)
    )


def write_text_parts(parts: DataFrame, path: str) -> None:
    """Document parts as text files in order, one folder per job."""
    (
        parts.repartitionByRange("job_id", "part")
        .sortWithinPartitions("job_id", "part")
        .select("job_id", F.col("body").alias("value"))
        .write.mode("overwrite")
        .partitionBy("job_id")
        .option("lineSep", "\n")
        .text(path)
    )


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Next snapshot of a maintained table. Write to a new folder: a path that is being read
    must not be overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, key: str = "job_id") -> None:
    """Replace only the partitions that occur in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
