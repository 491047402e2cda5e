"""Sinks that also pass their table on."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Quotes are doubled. NULL is written as NA and empty text as two quotes, so the two differ when read again.
QUOTED = {"quote": '"', "escape": '"', "nullValue": "NA"}
TO_CSV = {**QUOTED, "emptyValue": '""'}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the table and return it as read back, so it is computed once."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, **TO_CSV)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    reader = df.sparkSession.read.schema(df.schema).format(fmt)
    return (reader.options(header=True, multiLine=True, **QUOTED) if fmt == "csv" else reader).load(path).select(*[F.col(f"`{c}`") for c in df.columns])


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: write_table(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def write_bucketed(
    df: DataFrame, path: str, key: str, buckets: int, partition_by: Sequence[str] = (), files_per_bucket: int = 1
) -> DataFrame:
    """Write the table in folders of ``partition_by``, cut into buckets by a hash of ``key``, and return it as read back.

    Grouping by the key, and joins with tables of as many buckets, then need no exchange. A key that holds many
    rows is written by ``files_per_bucket`` tasks, and by more where a task would be given more than
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so the rows that one task sorts do not grow with the table;
    it is read as one bucket, which a grouping streams through.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    # Rows of one bucket meet in few tasks, else each task writes a file for every bucket. The hint takes names only.
    deal = {
        f"_b_{name}": F.pmod(F.hash(F.col(f"`{key}`")), F.lit(buckets)),
        f"_p_{name}": F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_bucket)),
    }
    dealt = df.withColumns(deal).hint("rebalance", *deal).drop(*deal)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """A table that ``write_bucketed`` wrote in another session."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    folders = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)}) " if partition_by else ""
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet {folders}"
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


MANIFEST = "_manifest"


def publish_tables(tables: Mapping[str, DataFrame], folder: str, checks: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """Write the tables of one run so that readers see all of them or none.

    Each run writes into a place of its own below ``folder``; the manifest, one row a table with
    its path, its rows and the sums asked for in ``checks``, is written last. Rows and sums are
    observed while the table is written, so nothing is scanned twice. A run that fails leaves
    the manifest of the run before it as it was. Returns the manifest of this run.
    """
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    rows = []
    for name, df in tables.items():
        seen = Observation(f"{name}-{run}")
        sums = {k: c.cast("double") for k, c in (checks or {}).get(name, {}).items()}
        path = f"{folder}/{run}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()]).write.parquet(path)
        rows.append((name, path, seen.get["rows"], {k: seen.get[k] for k in sums}))
    manifest = spark.createDataFrame(rows, "name string, path string, rows long, sums map<string, double>")
    # One file of a few rows. Its folder is new, and it counts only once the writer's success mark is there.
    manifest.coalesce(1).withColumn("at", F.current_timestamp()).write.parquet(f"{folder}/{MANIFEST}/run={run}")
    return manifest


def read_published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last run that was published whole."""
    runs = spark.read.option("basePath", f"{folder}/{MANIFEST}").parquet(f"{folder}/{MANIFEST}/run=*")
    last = runs.select(F.max_by("run", F.struct("at", "run"))).scalar()
    # One row a table of the program.
    return {r["name"]: spark.read.parquet(r["path"]) for r in runs.where(F.col("run") == last).select("name", "path").collect()}
