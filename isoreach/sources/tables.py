"""Parquet tables by name, and the driver's star schema as surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the Parquet tables in a folder, asked of Spark's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))


def read_example(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame | list[str]:
    """A table of a folder, or the names where none is given; an unknown name names the known ones."""
    names = list_tables(spark, path)
    if dataset is None:
        return names
    if dataset not in names:
        raise ValueError(f"dataset {dataset!r} not found; available: {', '.join(names)}")
    return table(spark, path, dataset)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_surface(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("value"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("facility_id"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("s_cap"), F.lit(1.0).alias("s_unit"))


def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_suppkey").alias("facility_id")).agg(F.min("l_quantity").alias("value"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("zone"))


def demand_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("layer")).agg(F.sum("o_totalprice").alias("value"))


def pmf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand(spark, sf_dir).select("cell_id", (F.col("value") * 100).cast("long").alias("value"))
