"""Readers: tables, exact texts, tolerant JSON and image manifests; and writers that commit last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exact_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, raw, text, digest, valid of every file: bytes as they are, text where they are UTF-8."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"))
    valid = F.is_valid_utf8(F.col("raw").cast("string"))
    return files.select("path", "raw", F.when(valid, F.decode("raw", "UTF-8")).alias("text"), F.sha2("raw", 256).alias("digest"), valid.alias("valid"))


def case_folders(spark: SparkSession, root: str, marks: tuple[str, ...] = ("run.json", "status.json")) -> DataFrame:
    """folder and the names of its marks, of every folder right below the root that has any of them, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{','.join(marks)}}}").load(f"{root.rstrip('/')}/*").select("path")
    parts = files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("mark"))
    return parts.groupBy("folder").agg(F.array_sort(F.collect_set("mark")).alias("marks")).orderBy("folder")


def tolerant_json(rows: DataFrame, column: str, schema: str, name: str) -> DataFrame:
    """Adds the parsed record; what does not parse is a record of nulls."""
    return rows.withColumn(name, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def commit(frame: DataFrame, folder: str, name: str, version: str) -> None:
    """Write a table, then its manifest row with digest and count: readers trust the manifest alone."""
    path = f"{folder}/{name}/{version}"
    frame.write.mode("overwrite").parquet(path)
    spark = frame.sparkSession
    back = spark.read.parquet(path)
    row = back.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
    row.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/_manifest/{version}")


def committed(spark: SparkSession, folder: str, name: str, version: str) -> DataFrame:
    """A committed table, verified against its manifest; raises where count or digest differ."""
    back = spark.read.parquet(f"{folder}/{name}/{version}")
    want = spark.read.parquet(f"{folder}/{name}/_manifest/{version}").first()
    got = back.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    if (want["rows"], want["digest"]) != (got[0], got[1]):
        raise ValueError(f"{name} {version} does not match its manifest")
    return back
