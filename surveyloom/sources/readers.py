"""Readers: delimited tables, microdata extracts, fixed-width text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.cleaning import null_if_any, null_microdata_codes, TEXT_NULLS


def read_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, every column as text, optionally only some.

    A quote inside a quoted field is doubled. A field may hold line breaks only with
    ``multi_line``, which reads each file in one task.
    """
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line).csv(path)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def typed(df: DataFrame, schema: T.StructType, clean: Callable[[Column], Column], keep_rest: bool = False) -> DataFrame:
    """Clean text columns and cast them to the schema; other text gives NULL."""
    known = {f.name: f.dataType for f in schema.fields}

    def column(name: str) -> Column:
        text = clean(F.col(f"`{name}`"))
        return (text if isinstance(known[name], T.StringType) else text.try_cast(known[name])).alias(name)

    rest = [c for c in df.columns if c not in known] if keep_rest else []
    return df.select(*[column(c) for c in known], *[F.col(f"`{c}`") for c in rest])


def read_table(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table by header name with a fixed schema; empty text and NA are NULL."""
    wanted = schema if columns is None else T.StructType([schema[c] for c in columns])
    return typed(read_strings(spark, path), wanted, lambda c: null_if_any(c, TEXT_NULLS))


# From the narrowest to the widest; text takes everything.
INFERRED = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType()}


def _value_counts(df: DataFrame) -> DataFrame:
    """Partial counts of ``type_report``: one row a column and task, so a column's values are never sorted.

    Spark judges the values; a task adds them up batch by batch and keeps the two smallest texts of each column.
    """
    columns, kinds = df.columns, list(INFERRED)

    def bit(kind: str, fits: Column) -> Column:
        return F.when(fits, 2 << kinds.index(kind)).otherwise(0)

    def mask(v: Column) -> Column:
        """Bit 0 is a value, the others are the types it fits. A whole number has the form of a real one, a date never."""
        whole, real = v.rlike(r"^[+-]?(0|[1-9][0-9]*)$"), v.rlike(r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        day = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull()
        counts = F.when(whole, bit("int", v.try_cast("int").isNotNull()).bitwiseOR(bit("bigint", v.try_cast("bigint").isNotNull()))).otherwise(0)
        number = bit("double", v.try_cast("double").isNotNull()).bitwiseOR(counts)
        return F.when(v.isNull(), 0).otherwise(F.lit(1).bitwiseOR(F.when(real, number).otherwise(bit("date", day))))

    # One step after the other, so that each expression is evaluated once a value.
    at = range(len(columns))
    values = df.select(*[null_if_any(F.col(f"`{c}`").cast("string"), TEXT_NULLS).alias(f"v{i}") for i, c in enumerate(columns)])
    masks = values.select(*[f"v{i}" for i in at], *[mask(F.col(f"v{i}")).alias(f"m{i}") for i in at])
    no_double = [F.when(F.col(f"m{i}").bitwiseAND(2 << kinds.index("double")) == 0, F.col(f"v{i}")) for i in at]
    judged = masks.select(*[F.struct(F.col(f"m{i}").alias("fits"), no_double[i].cast("binary").alias("text")).alias(f"c{i}") for i in at])
    date = 2 << kinds.index("date")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(columns), 2 << len(kinds)), np.int64)
        odd: list[bytes | None] = [None] * len(columns)
        no_number: list[bytes | None] = [None] * len(columns)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                bits, text = column.field("fits").to_numpy(), column.field("text")
                counts[i] += np.bincount(bits, minlength=counts.shape[1])
                if text.null_count == len(text):
                    continue
                neither = text.filter(pa.array(bits & date == 0))
                for least, seen in ((no_number, text), (odd, neither)):
                    found = [x for x in (least[i], pc.min(seen).as_py()) if x is not None]
                    least[i] = min(found, default=None)
        some = np.flatnonzero(counts.sum(axis=1))
        held = np.arange(counts.shape[1])
        out = {"column": pa.array([columns[i] for i in some], pa.string()), "n_values": counts[some, 1:].sum(axis=1), "n_null": counts[some, 0]}
        out |= {f"n_{k}": counts[some][:, held & 2 << j != 0].sum(axis=1) for j, k in enumerate(kinds)}
        out |= {"_odd": pa.array([odd[i] for i in some], pa.binary()), "_no_number": pa.array([no_number[i] for i in some], pa.binary())}
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in out.items()})

    numbers = ["n_values", "n_null", *[f"n_{k}" for k in kinds]]
    schema = f"column string, {', '.join(f'{n} long' for n in numbers)}, _odd binary, _no_number binary"
    # Texts go as bytes, which sort as Spark sorts text, valid UTF-8 or not.
    parts = judged.mapInArrow(add, schema)
    return parts.groupBy("column").agg(*[F.sum(n).alias(n) for n in numbers], *[F.min(n).cast("string").alias(n) for n in ("_odd", "_no_number")])


def type_report(df: DataFrame) -> DataFrame:
    """What type each text column could have, judged by all its values.

    One row a column: ``column, type, n_values, n_null``, for each type of ``INFERRED`` the
    number of values that fit (``n_int`` and so on), and ``text_example``, the smallest value
    that is not a number, or not a date in a column that begins as dates. Empty text and NA are missing. A number with leading zeros is a
    code, so it fits no number; a column without any value is text. A task holds one batch of rows and
    a row of counts for each column, whatever the table's size.
    """
    counts = _value_counts(df)
    kind = F.lit("string")
    for name in reversed(INFERRED):
        kind = F.when((F.col("n_values") > 0) & (F.col(f"n_{name}") == F.col("n_values")), name).otherwise(kind)
    example = F.when(F.col("type") == "string", F.coalesce("_odd", "_no_number"))
    typed_counts = counts.withColumn("type", kind)
    return typed_counts.select("column", "type", "n_values", "n_null", *[f"n_{name}" for name in INFERRED], example.alias("text_example"))


def read_inferred(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """A CSV table (or a folder of such files) with types taken from all its rows, and the report on them.

    The report is computed at once and holds one row a column. No row can fail to
    fit: a single late value that is wider widens its column.
    """
    text = read_strings(spark, path, multi_line=multi_line)
    found = type_report(text).collect()
    report = spark.createDataFrame(found, type_report(text).schema)
    kinds = {r["column"]: INFERRED.get(r["type"], T.StringType()) for r in found}
    # A table without rows has no row in the report either: its columns stay text.
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in text.columns])
    return typed(text, schema, lambda c: null_if_any(c, TEXT_NULLS)), report


def read_folder(spark: SparkSession, folder: str, tables: Mapping[str, tuple[str, T.StructType]]) -> dict[str, DataFrame]:
    """Several tables of one folder, each by its name and never by its position."""
    return {name: read_table(spark, f"{folder}/{file}", schema) for name, (file, schema) in tables.items()}


def read_microdata(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", where: Column | None = None
) -> DataFrame:
    """Person records: the named columns only, null codes removed, typed.

    ``where`` may name a column outside the schema, such as the state or the
    year; on Parquet it reaches the scan.
    """
    raw = read_strings(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    if where is not None:
        raw = raw.where(where)
    if fmt == "csv":
        return typed(raw, schema, null_microdata_codes)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_fixed_width(
    spark: SparkSession, path: str, layout: Mapping[str, tuple[int, int, T.DataType]]
) -> DataFrame:
    """Lines of text cut by a table of column positions (from 1) and lengths."""
    return cut_columns(spark.read.text(path), "value", layout)


def cut_columns(df: DataFrame, line: str, layout: Mapping[str, tuple[int, int, T.DataType]]) -> DataFrame:
    def column(name: str, start: int, length: int, dtype: T.DataType) -> Column:
        text = F.nullif(F.trim(F.substring(F.col(line), start, length)), F.lit(""))
        return (text if isinstance(dtype, T.StringType) else text.try_cast(dtype)).alias(name)

    return df.select(*[column(name, *spec) for name, spec in layout.items()])
