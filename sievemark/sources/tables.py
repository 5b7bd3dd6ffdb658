"""Reading and writing: Parquet tables, whole text files, JSON, CSV, binary objects, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = "*.{txt,md,json,yaml,yml,js,ts,py,html}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes a core from which a table's own splits are taken to be enough.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table may have fewer row groups than there are cores; its rows are dealt to all cores, which costs little beside a scan of its texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def text_files(spark: SparkSession, path: str, glob: str = TEXT_SUFFIXES) -> DataFrame:
    """One row per file: path, text."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of prompts."""
    return spark.read.schema("id string, text string, category string, expected_threats array<string>, word_count long").json(path, multiLine=True)


def write_prompts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Benchmark results as CSV with a header."""
    df.write.mode("append").option("header", True).csv(path)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a store with a checksum: path, length, modified, sha256."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def by_day(df: DataFrame, path: str, time: str = "ts") -> None:
    """Events partitioned by day, so that a time range reads only its days."""
    df.withColumn("day", F.to_date(time)).write.partitionBy("day").mode("overwrite").parquet(path)


def day_range(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Events of by_day from one day to another; only their folders are read."""
    return spark.read.parquet(path).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def container_logs(lines: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """JSON lines of containers: ts, stream, log, and the container in the file's path."""
    x = F.from_json(value, "stream string, log string, time string")
    rows = lines.select(F.regexp_extract(path, "/var/lib/docker/containers/(?<id>[^/]+)/.*", 1).alias("container_id"), x.alias("x"))
    return rows.select(F.try_to_timestamp("x.time").alias("ts"), "container_id", "x.stream", "x.log")


def system_logs(lines: DataFrame, year: int, value: str = "value") -> DataFrame:
    """Lines of the system log: ts (they have no year), hostname, program, message; lines of other shapes go."""
    pattern = r"^(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+):\s+(.*)$"
    rows = lines.where(F.rlike(value, F.lit(pattern))).select(*(F.regexp_extract(value, pattern, i).alias(n) for i, n in enumerate(("at", "hostname", "program", "message"), 1)))
    return rows.select(F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace("at", r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss")).alias("ts"), "hostname", "program", "message")


def tail(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """Lines of log files and of those that come later: value, path."""
    return spark.readStream.option("pathGlobFilter", glob).text(folder).withColumn("path", F.col("_metadata.file_path"))


def log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON log lines: ts, level, target, message and the numbers in key=value form of the message."""
    parsed = F.from_json(value, "timestamp string, level string, target string, message string, fields map<string,string>")
    rows = lines.select(parsed.alias("x"))
    return rows.select(F.try_to_timestamp("x.timestamp").alias("ts"), F.lower("x.level").alias("level"), "x.target", "x.message", F.regexp_extract("x.message", r"latency_ms=(?<ms>[0-9.]+)", 1).try_cast("double").alias("latency_ms"))
