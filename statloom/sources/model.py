"""What all statistical file formats share: variables, temporal formats, epochs, names, options."""

from __future__ import annotations

import datetime as dt
import os
import re
import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

FORMATS = ("sas7bdat", "xpt", "sav", "zsav", "por", "dta")


@dataclass
class Variable:
    name: str
    type: str = "DOUBLE"  # STRING, INT8, INT16, INT32, FLOAT, DOUBLE
    format: str = ""
    label: str = ""
    width: int = 8


@dataclass
class Fixed:
    """Rows of one width: where they begin, how many they are, and columns from the bytes of some of them."""

    at: int
    width: int
    count: int
    columns: Callable[[bytes], list[np.ndarray]]


@dataclass
class StatFile:
    """A parsed file: ``columns`` has a numpy array of numbers (NaN: missing) or of texts (None: missing) by variable."""

    kind: str
    variables: list[Variable]
    columns: list[np.ndarray] = field(default_factory=list)
    label: str = ""
    fixed: Fixed | None = None


def detect(path: str, given: str | None = None) -> str:
    kind = (given or os.path.splitext(path)[1].lstrip(".")).lower()
    if kind not in FORMATS:
        raise ValueError(f"Cannot detect file format of '{path}': expected one of {', '.join(FORMATS)}" if given is None else f"Unknown file format '{given}'")
    return kind


class Stored:
    """A file's bytes, read as they are asked for, also from stores that Arrow knows by their scheme."""

    def __init__(self, path: str, block: int = 1 << 20):
        if re.match(r"[a-z0-9]+://", path) and not path.startswith("file://"):
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            self.file = store.open_input_file(inner)
            self.size = self.file.size()
        else:
            self.file = open(path.removeprefix("file://"), "rb")  # noqa: SIM115
            self.size = os.fstat(self.file.fileno()).st_size
        self.block, self.start, self.held = block, 0, b""

    def __enter__(self) -> Stored:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def __len__(self) -> int:
        return self.size

    def read(self, start: int, n: int) -> bytes:
        self.file.seek(min(start, self.size))
        return self.file.read(n)

    def __getitem__(self, k: slice | int):
        if isinstance(k, int):
            return self[k : k + 1][0]
        start, stop = k.start or 0, self.size if k.stop is None else min(k.stop, self.size)
        if start >= stop:
            return b""
        if stop - start > self.block:
            return self.read(start, stop - start)
        if not self.start <= start or stop > self.start + len(self.held):
            self.start, self.held = start, self.read(start, self.block)
        return self.held[start - self.start : stop - self.start]


def unpack_at(form: str, data: bytes | Stored, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def write_bytes(path: str, chunks: Iterable[bytes]) -> None:
    """Writes a file piece by piece, also to stores that Arrow knows by their scheme."""
    if re.match(r"[a-z0-9]+://", path) and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_output_stream(inner) as out:
            for chunk in chunks:
                out.write(chunk)
        return
    with open(path.removeprefix("file://"), "wb") as out:
        out.writelines(chunks)


# Display formats that make a number a date, a timestamp or a time.
DATES = """
WEEKDATE WEEKDATX MMDDYY DDMMYY YYMMDD DATE DATE7 DATE9 YYMMDD10 DDMMYYB DDMMYYB10 DDMMYYC DDMMYYC10 DDMMYYD DDMMYYD10
DDMMYYN6 DDMMYYN8 DDMMYYP DDMMYYP10 DDMMYYS DDMMYYS10 MMDDYYB MMDDYYB10 MMDDYYC MMDDYYC10 MMDDYYD MMDDYYD10 MMDDYYN6
MMDDYYN8 MMDDYYP MMDDYYP10 MMDDYYS MMDDYYS10 DTDATE IS8601DA E8601DA B8601DA YYMMDDB YYMMDDD YYMMDDN YYMMDDP YYMMDDS
WORDDATE WORDDATX JULDAY JULIAN MONYY YYQ DATE8 DATE11 DATE12 ADATE ADATE8 ADATE10 EDATE EDATE8 EDATE10 JDATE JDATE5
JDATE7 SDATE SDATE8 SDATE10
""".split()
TIMESTAMPS = """
DATETIME DATETIME17 DATETIME18 DATETIME19 DATETIME20 DATETIME21 DATETIME22 E8601DT DATEAMPM MDYAMPM IS8601DT B8601DT
B8601DN DATETIME8 DATETIME23.2 YMDHMS16 YMDHMS19 YMDHMS19.2 YMDHMS20
""".split()
TIMES = "TIME HHMM HHMMSS TIME5 TIME8 TIME20 TIME20.3 TOD TIMEAMPM IS8601TM E8601TM B8601TM DTIME TIME11.2".split()
# Additions: formats of the same kinds that the lists above lack, and, in temporal(), any width of those that they have.
MORE_DATES = "DDMMYYN MMDDYYN YYMM YYMMN MMYY MMYYN EURDFDD MONNAME MOYR QYR WKYR QTR YEAR NENGO WEEKU WEEKV WEEKW YYMON".split()
MORE_TIMESTAMPS, MORE_TIMES = ["EURDFDT", "YMDHMS"], ["MMSS", "HOUR"]
KINDS = {"timestamp": {*TIMESTAMPS, *MORE_TIMESTAMPS}, "date": {*DATES, *MORE_DATES}, "time": {*TIMES, *MORE_TIMES}}


def temporal(kind: str, fmt: str) -> str | None:
    """date, timestamp or time, from a variable's display format."""
    if kind == "dta":
        if fmt.startswith(("%tc", "%tC")):
            clock = "HH" in fmt and not any(x in fmt for x in ("DD", "CC", "YY", "NN"))
            return "time" if clock else "timestamp"
        return "date" if fmt.startswith(("%td", "%d")) else None
    whole = fmt.upper().strip()
    base = whole.split(".")[0]
    # as it is first: the digits at the end of a name may be its width
    for text in (whole, base, base.rstrip("0123456789")):
        for name, known in KINDS.items():
            if text in known:
                return name
    return None


SAS_EPOCH, SPSS_EPOCH = dt.datetime(1960, 1, 1), dt.datetime(1582, 10, 14)


_UNIX = dt.datetime(1970, 1, 1)
_DAYS = [(x - _UNIX).days for x in (dt.datetime.min, dt.datetime.max)]


def decode(kind: str, what: str, x: np.ndarray) -> pa.Array:
    """Temporal values from the file's numbers; NULL for missing ones and those outside the years 1 to 9999."""
    epoch = (SPSS_EPOCH if kind in ("sav", "zsav", "por") else SAS_EPOCH) - _UNIX
    if what == "date":
        if kind in ("sav", "zsav", "por"):
            whole = np.floor(x)
            days = np.floor((whole + (np.rint((x - whole) * 1e6) >= 1e6)) / 86400) + epoch.days
        else:
            days = np.floor(x) + epoch.days
        known = (days >= _DAYS[0]) & (days <= _DAYS[1])
        return pa.array(np.where(known, days, 0).astype(np.int32), mask=~known).cast(pa.date32())
    seconds = x / 1000 if kind == "dta" else x
    if what == "time":
        known = np.isfinite(seconds)
        micros = np.rint(np.where(known, seconds, 0) % 86400 * 1e6).astype(np.int64) % 86_400_000_000
        return pa.array(micros, mask=~known).cast(pa.time64("us"))
    near = np.abs(seconds) < 4e11
    micros = np.rint(np.where(near, seconds, 0) * 1e6).astype(np.int64) + epoch // dt.timedelta(microseconds=1)
    known = near & (micros >= _DAYS[0] * 86_400_000_000) & (micros < (_DAYS[1] + 1) * 86_400_000_000)
    return pa.array(np.where(known, micros, 0), mask=~known).cast(pa.timestamp("us"))


def encode(kind: str, a: pa.Array) -> np.ndarray:
    """The file's numbers (NaN: missing) of an Arrow array of numbers or temporal values."""
    spss, form = kind in ("sav", "zsav", "por"), a.type
    epoch = _UNIX - (SPSS_EPOCH if spss else SAS_EPOCH)
    null = a.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_date(form):
        v = a.cast(pa.int32()).fill_null(0).to_numpy().astype(float) + epoch.days
        v = v * 86400 if spss else v
    elif pa.types.is_timestamp(form) or pa.types.is_time(form):
        micros = a.cast(pa.timestamp("us") if pa.types.is_timestamp(form) else pa.time64("us")).cast(pa.int64()).fill_null(0).to_numpy()
        seconds = micros // 1_000_000 + (epoch // dt.timedelta(seconds=1) if pa.types.is_timestamp(form) else 0)
        v = seconds + micros % 1_000_000 / 1e6
    else:
        v = a.cast(pa.float64()).fill_null(0).to_numpy().astype(float)
    return np.where(null, np.nan, v)


_TIME_TYPE = getattr(T, "TimeType", None)
_READ = {"STRING": T.StringType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType()}


def spark_schema(f: StatFile) -> T.StructType:
    fields = []
    for v in f.variables:
        what = temporal(f.kind, v.format) if v.type != "STRING" else None
        kind = {"date": T.DateType(), "timestamp": T.TimestampNTZType(), "time": _TIME_TYPE(6) if _TIME_TYPE else T.StringType()}[what] if what else _READ[v.type]
        fields.append(T.StructField(v.name, kind, True, {"comment": v.label} if v.label else None))
    return T.StructType(fields)


def batch_of(f: StatFile, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """Columns of the file as the Arrow types of spark_schema(), those that ``schema`` names."""
    at, arrays = {v.name: k for k, v in enumerate(f.variables)}, []
    for name, kind in zip(schema.names, schema.types):
        v, x = f.variables[at[name]], columns[at[name]]
        what = temporal(f.kind, v.format) if v.type != "STRING" else None
        if v.type == "STRING":
            arrays.append(pa.array(list(x), kind))
        elif what:
            arrays.append(decode(f.kind, what, x).cast(kind))
        else:
            gone = np.isnan(x)
            arrays.append(pa.array(np.where(gone, 0, x).astype(np.int64) if v.type.startswith("INT") else x, mask=gone).cast(kind))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# -- writing ------------------------------------------------------------------------------------------------------------

NAME_LENGTH = {"xpt": 8, "xpt8": 32, "sas7bdat": 32, "sav": 32, "zsav": 32, "por": 8}
OPTIONS = {"xpt": {"version", "label", "table_name"}, "sas7bdat": {"label", "compression"}, "sav": {"label", "compression"}, "zsav": {"label", "compression"}, "por": {"label"}}


def check_name(kind: str, name: str, most: int) -> None:
    if not name:
        raise ValueError(f"{kind}: empty column name is not allowed")
    if len(name.encode()) > most:
        raise ValueError(f"{kind}: column name '{name}' is longer than {most} characters")
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"{kind}: column name '{name}' has characters other than letters, digits and underscores")
    if name[0].isdigit():
        raise ValueError(f"{kind}: column name '{name}' starts with a digit")


def check_options(kind: str, options: dict) -> dict:
    out = {k.lower(): v for k, v in options.items()}
    for k in out:
        if k in ("version", "table_name") and kind != "xpt":
            raise ValueError(f"{k.upper()} is only valid for XPT")
        if k == "compression" and kind not in ("sas7bdat", "sav", "zsav"):
            raise ValueError("COMPRESSION is only valid for SAS7BDAT and SAV")
        if k not in OPTIONS[kind]:
            raise ValueError(f"Unrecognized {kind.upper()} option '{k}'")
    if int(out.get("version", 5)) not in (5, 8):
        raise ValueError("VERSION must be 5 or 8")
    if str(out.get("compression", "none")).lower() not in ("none", "rows", "rle", "zlib"):
        raise ValueError(f"Unknown COMPRESSION '{out['compression']}'")
    return out


def variable_of(f: T.StructField, kind: str, width: int) -> Variable:
    """How a column is written."""
    spss = kind in ("sav", "zsav", "por")
    label = (f.metadata or {}).get("comment", "")
    t = f.dataType
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return Variable(f.name, "STRING", f"A{max(width, 1)}" if spss else "", label, max(width, 1))
    if isinstance(t, T.DateType):
        return Variable(f.name, "DOUBLE", "DATE11" if spss else "DATE9.", label)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Variable(f.name, "DOUBLE", "DATETIME20" if spss else "DATETIME19.", label)
    if _TIME_TYPE and isinstance(t, _TIME_TYPE):
        return Variable(f.name, "DOUBLE", "TIME8" if spss else "TIME8.", label)
    if isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
        return Variable(f.name, "INT32", "F8.0" if spss else "", label)
    if isinstance(t, T.NumericType):
        return Variable(f.name, "DOUBLE", "F8.2" if spss else "", label)
    raise ValueError(f"{kind}: column '{f.name}' has the unsupported type {t.simpleString()}")


def texts_of(a: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in a.to_pylist()]
