"""SAS, SPSS and Stata files as a Spark data source, their metadata, and writers.

    register(spark); spark.read.format("statfile").load("survey.sav")     or     read_stat(spark, "survey.sav")

A file's header is parsed on the driver for the schema; executors read ranges of rows. Where rows have one width (xpt,
plain sav) a task reads its own bytes, a batch at a time; portable files of numbers are scanned once on the driver for
places where rows begin. Of other files (packed sav, portable files with texts, sas7bdat, dta) each task holds the whole.
"""

from __future__ import annotations

import io
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from statloom.sources import spss, xpt
from statloom.sources.model import NAME_LENGTH, StatFile, Stored, Variable, batch_of, check_name, check_options, detect, encode, spark_schema, texts_of, variable_of, write_bytes


def _sas7bdat(data: bytes, encoding: str | None) -> StatFile:
    import pandas as pd

    reader = pd.read_sas(io.BytesIO(data), format="sas7bdat", encoding=None, iterator=True, convert_dates=False)
    columns, code = reader.columns, encoding or getattr(reader, "inferred_encoding", None) or "utf-8"
    frame = reader.read()
    text = lambda b: b.decode(code, "replace").rstrip() if isinstance(b, bytes) else b
    out = StatFile("sas7bdat", [])
    for c in columns:
        strings = c.ctype == b"s" or c.ctype == "s"
        name = text(c.name)
        out.variables.append(Variable(name, "STRING" if strings else "DOUBLE", text(c.format) or "", text(c.label) or "", c.length))
        v = frame.iloc[:, len(out.variables) - 1]
        out.columns.append(np.array([("" if x != x else text(x)) if x is not None else "" for x in v], object) if strings else v.to_numpy(float))
    return out


def _dta(data: bytes, encoding: str | None) -> StatFile:
    import pandas as pd

    with pd.read_stata(io.BytesIO(data), convert_dates=False, convert_categoricals=False, preserve_dtypes=True, iterator=True) as reader:
        frame, labels = reader.read(), reader.variable_labels()
        formats = dict(zip(frame.columns, getattr(reader, "_fmtlist", []) or [""] * frame.shape[1]))
    sizes = {"int8": "INT8", "int16": "INT16", "int32": "INT32", "float32": "FLOAT"}
    out = StatFile("dta", [])
    for c in frame.columns:
        v = frame[c]
        strings = v.dtype == object
        out.variables.append(Variable(str(c), "STRING" if strings else sizes.get(str(v.dtype), "DOUBLE"), formats.get(c, "") or "", labels.get(c, "") or "", 8))
        out.columns.append(np.array(list(v), object) if strings else v.to_numpy(float))
    return out


def parse(path: str, kind: str | None = None, encoding: str | None = None, header_only: bool = False) -> StatFile:
    """The file; errors name it."""
    kind = detect(path, kind)
    try:
        with Stored(path) as data:
            if kind == "xpt":
                return xpt.read(data, encoding or "utf-8", header_only)
            if kind in ("sav", "zsav"):
                return spss.read_sav(data, encoding, header_only)
            if kind == "por":
                return spss.read_por(data, encoding, header_only)
            return _sas7bdat(data[:], encoding) if kind == "sas7bdat" else _dta(data[:], encoding)
    except Exception as e:
        raise ValueError(f"Failed to read {'metadata of ' if header_only else ''}'{path}': {e}") from e


#: bytes of rows of one width that a task reads, and a batch of it
TASK, BATCH = 16 << 20, 2 << 20


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Rows(InputPartition):
    """Rows of a portable file between two of its cuts."""

    def __init__(self, start: tuple[int, int], stop: tuple[int, int]):
        self.start, self.stop = start, stop


class StatFileReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.kind, self.encoding, self.schema = options["path"], options.get("format"), options.get("encoding"), schema
        self.parts = int(options.get("numpartitions", "1"))

    def partitions(self) -> list[InputPartition]:
        f = parse(self.path, self.kind, self.encoding, header_only=True)
        if f.fixed:
            n, most = f.fixed.count, max(1, TASK // f.fixed.width)
            step = max(1, min(most, math.ceil(n / max(1, self.parts))))
        elif cuts := self.cuts():
            return [_Rows(a, b) for a, b in zip(cuts, cuts[1:])]
        elif self.parts <= 1:
            return [_Range(0, 1 << 62)]
        else:
            f = parse(self.path, self.kind, self.encoding)
            n = len(f.columns[0]) if f.columns else 0
            step = max(1, math.ceil(n / self.parts))
        return [_Range(k, k + step) for k in range(0, max(n, 1), step)]

    def cuts(self) -> list[tuple[int, int]] | None:
        if detect(self.path, self.kind) != "por":
            return None
        try:
            with Stored(self.path) as data:
                return spss.por_cuts(data, self.encoding)
        except Exception as e:
            raise ValueError(f"Failed to read '{self.path}': {e}") from e

    def read(self, partition: _Range | _Rows) -> Iterator[pa.RecordBatch]:
        f, schema = parse(self.path, self.kind, self.encoding, header_only=True), to_arrow_schema(self.schema)
        if f.fixed:
            stop, step = min(partition.stop, f.fixed.count), max(1, BATCH // f.fixed.width)
            with Stored(self.path) as data:
                for k in range(partition.start, stop, step):
                    n = min(step, stop - k)
                    yield batch_of(f, f.fixed.columns(data.read(f.fixed.at + k * f.fixed.width, n * f.fixed.width)), schema)
            return
        if isinstance(partition, _Rows):
            with Stored(self.path) as data:
                for columns in spss.por_columns(data, self.encoding, partition.start, partition.stop, max(1, BATCH // (8 * len(f.variables)))):
                    yield batch_of(f, columns, schema)
            return
        f = parse(self.path, self.kind, self.encoding)
        whole = batch_of(f, [c[partition.start : partition.stop] for c in f.columns], schema)
        step = max(1, BATCH * whole.num_rows // max(1, whole.nbytes))
        for k in range(0, whole.num_rows, step):
            yield whole.slice(k, step)


class StatFileSource(DataSource):
    """Options: path, format (else by the file's extension), encoding, numPartitions."""

    @classmethod
    def name(cls) -> str:
        return "statfile"

    def schema(self) -> T.StructType:
        return spark_schema(parse(self.options["path"], self.options.get("format"), self.options.get("encoding"), header_only=True))

    def reader(self, schema: T.StructType) -> StatFileReader:
        return StatFileReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StatFileSource)


def read_stat(spark: SparkSession, path: str, format: str | None = None, encoding: str | None = None, partitions: int = 1) -> DataFrame:
    """The rows of a file. Variable labels are the columns' comments."""
    schema = spark_schema(parse(path, format, encoding, header_only=True))
    register(spark)
    options = {k: v for k, v in {"format": format, "encoding": encoding, "numPartitions": str(partitions)}.items() if v}
    df = spark.read.format("statfile").options(**options).load(path)
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in schema])


def read_stat_metadata(spark: SparkSession, path: str, format: str | None = None, encoding: str | None = None) -> DataFrame:
    """column_name, type, format, label of each variable, from the header."""
    f = parse(path, format, encoding, header_only=True)
    return spark.createDataFrame([(v.name, v.type, v.format, v.label) for v in f.variables], "column_name string, type string, format string, label string")


def write_stat(df: DataFrame, path: str, format: str | None = None, **options) -> None:
    """Writes ``df`` as one file. Options by format: version, table_name (xpt), label (all), compression (sav, zsav).

    These formats name the widest text and the number of rows first: an aggregate runs where there are texts, executors
    encode and count blocks of rows, and the driver streams the blocks, a partition at a time. Timestamps with a time
    zone are written as the session's zone shows them.
    """
    kind = detect(path, format)
    if kind not in NAME_LENGTH:
        raise ValueError(f"no writer for {kind} files")
    options = check_options(kind, options)
    version = int(options.get("version", 5))
    if kind == "sas7bdat":
        raise NotImplementedError("sas7bdat files can be read, not written; use xpt (version 8 for long names)")
    most = NAME_LENGTH["xpt8" if kind == "xpt" and version == 8 else kind]
    names: set[str] = set()
    for f in df.schema:
        check_name(kind, f.name, most)
        if f.name.upper() in names:
            raise ValueError(f"{kind}: column name '{f.name}' is not unique")
        names.add(f.name.upper())
    variables = [variable_of(f, kind, 8) for f in df.schema]
    plain = {T.TimestampType: "timestamp_ntz"}
    numeric = lambda f: isinstance(f.dataType, (T.NumericType, T.BooleanType))
    df = df.select(*[F.col(f"`{f.name}`").cast("double" if numeric(f) else plain.get(type(f.dataType), f.dataType)).alias(f.name) for f in df.schema])
    texts = [f.name for f, v in zip(df.schema, variables) if v.type == "STRING"]
    held = [df.persist()] if texts else []
    try:
        row = df.agg(*[F.max(F.octet_length(f"`{c}`")).alias(f"w_{c}") for c in texts]).first() if texts else {}
        for f, v in zip(df.schema, variables):
            if v.type == "STRING":
                width = max(1, row[f"w_{f.name}"] or 1)
                v.width, v.format = width, variable_of(f, kind, width).format
            if kind in ("xpt", "por"):
                v.name = v.name.upper()
        block = {"xpt": xpt.block, "por": spss.por_block}.get(kind, spss.sav_block)

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, BATCH // sum(v.width for v in variables))
            for b in batches:
                for k in range(0, b.num_rows, step):
                    part = b.slice(k, step)
                    columns = [texts_of(c) if v.type == "STRING" else encode(kind, c) for v, c in zip(variables, part.columns)]
                    yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([block(variables, columns)], pa.binary())], ["n", "block"])

        made = df.mapInArrow(encoded, "n long, block binary").persist()
        held.append(made)
        count = made.agg(F.sum("n")).first()[0] or 0
        blocks = (bytes(r[0]) for r in made.select("block").toLocalIterator())

        label = str(options.get("label", ""))
        if kind == "xpt":
            base = os.path.splitext(os.path.basename(path))[0].upper()
            table = str(options.get("table_name", "".join(c for c in base if c.isalnum() or c == "_") or "DATASET"))[: 32 if version == 8 else 8]
            chunks = xpt.write(variables, blocks, count, version=version, label=label, table=table)
        elif kind == "por":
            chunks = spss.write_por(variables, blocks, count, label=label)
        else:
            packed = "zlib" if kind == "zsav" else str(options.get("compression", "none")).lower()
            chunks = spss.write_sav(variables, blocks, count, label=label, compression=packed)
        write_bytes(path, chunks)
    finally:
        for d in held:
            d.unpersist()
