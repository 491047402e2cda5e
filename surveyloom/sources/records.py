"""Records of a fixed number of bytes, as a Spark data source.

Files hold nothing but records of one length, so a task finds its first record by
multiplication: files are cut into byte ranges at record borders, without a search for
line ends. Only the asked columns are taken out of the bytes, and filters on them are
applied before any other column is decoded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "fixed_records"
# Bytes of one task, and of one block that is decoded at once.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}


def _data_source() -> type[DataSource]:
    """The data source. Its classes are made here so that they travel to the workers by value."""
    range_bytes, block_bytes, source_name = RANGE_BYTES, BLOCK_BYTES, NAME
    tests = {"EqualTo": "equal", "GreaterThan": "greater", "GreaterThanOrEqual": "greater_equal", "LessThan": "less", "LessThanOrEqual": "less_equal"}

    class Records(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.path, self.length = options["path"], int(options["recordLength"])
            # Name, first byte from 0, bytes, type.
            self.columns = [tuple(c) for c in json.loads(options["layout"])]
            self.tests: list[tuple[str, str, Any]] = []

        def pushFilters(self, filters):  # noqa: N802
            names = {c[0] for c in self.columns}
            for f in filters:
                kind, column = type(f).__name__, getattr(f, "attribute", ())
                # A number that is not a number compares otherwise in Arrow than in Spark.
                known = len(column) == 1 and column[0] in names and getattr(f, "value", None) == getattr(f, "value", None)
                if known and kind in ("IsNull", "IsNotNull"):
                    self.tests.append((column[0], kind, None))
                elif known and kind in tests and f.value is not None:
                    self.tests.append((column[0], tests[kind], f.value))
                elif known and kind == "In" and all(v is not None for v in f.value):
                    self.tests.append((column[0], kind, list(f.value)))
                else:
                    yield f

        def _files(self):
            import pyarrow.fs as fs

            path = self.path[5:] if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
            system, root = fs.FileSystem.from_uri(path)
            info = system.get_file_info(root)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
            # Names that begin so are marks of writers, as in Spark's own sources.
            return system, sorted((i.path, i.size) for i in found if i.is_file and i.size and i.base_name[0] not in "._")

        def partitions(self) -> Sequence[InputPartition]:
            step = max(1, range_bytes // self.length)
            ranges = []
            for path, size in self._files()[1]:
                if size % self.length:
                    raise ValueError(f"{path}: {size} bytes are not whole records of {self.length}")
                ranges += [(path, at, min(step, size // self.length - at)) for at in range(0, size // self.length, step)]
            return [InputPartition(r) for r in ranges] or [InputPartition(None)]

        def read(self, partition: InputPartition) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
            patterns = {"int": r"^[+-]?[0-9]{1,18}$", "bigint": r"^[+-]?[0-9]{1,18}$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"}

            def column(records, first: int, width: int, kind: str):
                cut = np.ascontiguousarray(records[:, first : first + width]).reshape(-1)
                text = pa.Array.from_buffers(pa.binary(width), len(records), [None, pa.py_buffer(cut)]).cast(pa.binary()).cast(pa.string())
                text = pc.utf8_trim(text, " ")
                text = pc.if_else(pc.equal(text, ""), None, text)
                if kind == "string":
                    return text
                text = pc.if_else(pc.match_substring_regex(text, patterns[kind]), pc.replace_substring_regex(text, r"^\+", ""), None)
                if kind == "double":
                    return text.cast(pa.float64())
                whole = text.cast(pa.int64())
                if kind == "int":
                    fits = pc.and_(pc.less(whole, 2**31), pc.greater_equal(whole, -(2**31)))
                    whole = pc.if_else(fits, whole, None).cast(pa.int32())
                return whole

            def holds(values, test: str, value):
                if test == "IsNull":
                    return pc.is_null(values)
                if test == "IsNotNull":
                    return pc.is_valid(values)
                if test == "In":
                    return pc.is_in(values, value_set=pa.array(value, values.type))
                return getattr(pc, test)(values, pa.scalar(value, values.type))

            if partition.value is None:
                return
            path, at, count = partition.value
            kinds = {name: rest for name, *rest in self.columns}
            with self._files()[0].open_input_file(path) as file:
                file.seek(at * self.length)
                step = max(1, block_bytes // self.length)
                for done in range(0, count, step):
                    n = min(step, count - done)
                    records = np.frombuffer(file.read(n * self.length), np.uint8).reshape(n, self.length)
                    for name, test, value in self.tests:
                        keep = pc.fill_null(holds(column(records, *kinds[name]), test, value), False)
                        records = records[keep.to_numpy(zero_copy_only=False)]
                    if len(records):
                        arrays = [column(records, *rest) for rest in kinds.values()]
                        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([(n, arrow[r[2]]) for n, r in kinds.items()]))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return ", ".join(f"`{name}` {kind}" for name, _, _, kind in json.loads(self.options["layout"]))

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Records(self.options)

    return Source


def read_records(
    spark: SparkSession,
    path: str,
    layout: Mapping[str, tuple[int, int, T.DataType]],
    record_length: int,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Columns of a file, or of all files below a folder, that hold records of ``record_length`` bytes.

    ``layout`` gives the first byte (from 1), the bytes and the type (text, int, bigint or double)
    of every column; a line end is part of the record. Values are trimmed; empty text is NULL, and so is text
    that is no number of the type. Whole numbers have at most 18 digits. Texts are UTF-8, and a
    column must not cut a character. Comparisons of a column with a value that are joined by AND are
    pushed into the scan. A size that is not a multiple of the record length is an error.
    """
    names = {kind: name for name, kind in KINDS.items()}
    wanted = list(layout if columns is None else columns)
    for name in wanted:
        first, width, kind = layout[name]
        if kind not in names:
            raise ValueError(f"{name}: records hold text, int, bigint and double, not {kind.simpleString()}")
        if first < 1 or width < 1 or first + width - 1 > record_length:
            raise ValueError(f"{name} does not lie in a record of {record_length} bytes")
    spec = json.dumps([(name, layout[name][0] - 1, layout[name][1], names[layout[name][2]]) for name in wanted])
    # Spark keeps filters from sources in Python unless this is set.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_data_source())
    return spark.read.format(NAME).options(path=path, layout=spec, recordLength=record_length).load()
