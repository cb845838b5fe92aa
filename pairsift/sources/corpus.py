"""Reading pair corpora and writing the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairsift.functions.text import null_to_empty
from pairsift.operators.aligning import zip_parallel
from pairsift.session import materialise


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """Any Spark source. Text formats need a schema; nothing is inferred by a scan."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    Text rules are bound by the CPU, and a small file is a single split. Big tables have
    many splits and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_pairs(
    spark: SparkSession, path: str, source: str = "en", target: str = "oc", fmt: str = "parquet", struct: str = "translation", **options
) -> DataFrame:
    """One split of a pair corpus, ``struct<source, target>`` unnested into src and tgt.

    Only the two fields are read (nested column pruning); nulls become empty strings here,
    so the operators after this one never see one.
    """
    df = read_table(spark, path, fmt, **options)
    rest = [c for c in df.columns if c != struct]
    return from_struct(df.select(*rest, struct), source, target, struct)


def from_struct(df: DataFrame, source: str, target: str, struct: str = "translation") -> DataFrame:
    rest = [c for c in df.columns if c != struct]
    return df.select(
        *rest,
        null_to_empty(F.col(f"{struct}.{source}")).alias("src"),
        null_to_empty(F.col(f"{struct}.{target}")).alias("tgt"),
    )


def from_records(spark: SparkSession, records, schema: str) -> DataFrame:
    """Lists, dicts or a pandas frame into a DataFrame; for small local data only."""
    return spark.createDataFrame(records, schema)


def with_file_position(spark: SparkSession, path: str, out: str = "sent_id", schema: StructType | str | None = None) -> DataFrame:
    """A Parquet corpus with ``out`` = 0..n-1 in the order of its files (by path) and of the rows in each file.

    The position in the file comes from the reader, whatever splits it makes, so no row is sorted or shuffled; each file adds the rows of the files
    before it. These offsets have one row for each file and are broadcast as long as Catalyst finds them small.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    read = read_table(spark, path, "parquet", schema).withColumn("_place", place)
    files = read.groupBy(F.col("_place.file").alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # over files, not rows
    offsets = materialise(files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")), "file-offsets")
    placed = read.join(offsets, F.col("_place.file") == F.col("_file"))
    return placed.withColumn(out, F.col("_before") + F.col("_place.row")).drop("_place", "_file", "_before")


def load_monolingual_pair(spark: SparkSession, src_path: str, tgt_path: str, sent_id: str | None = "sent_id", fmt: str = "parquet") -> DataFrame:
    """Two monolingual corpora (``text``) side by side: by their column ``sent_id``, or, with None, by their place in the files."""
    if sent_id is None:
        return zip_parallel(with_file_position(spark, src_path), with_file_position(spark, tgt_path))
    return zip_parallel(read_table(spark, src_path, fmt), read_table(spark, tgt_path, fmt), sent_id)


def project_pairs(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "src", "tgt")


def sink_scored(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Write the scored corpus. For CSV, nested columns must be dropped by the caller."""
    df.write.format(fmt).mode(mode).options(**options).save(path)


def sink_clean_log(cleaned: DataFrame, log: DataFrame, cleaned_path: str, log_path: str, mode: str = "overwrite") -> None:
    cleaned.write.mode(mode).parquet(cleaned_path)
    log.write.mode(mode).parquet(log_path)
