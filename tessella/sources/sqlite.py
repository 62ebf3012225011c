"""SQLite files as a data source: tables read in ranges of row ids with pushed filters, folders written with a commit.

``path`` is a SQLite file, or a folder that this source wrote. Files must lie where the
driver and all executors see them under one path (a shared mount), as SQLite opens no others.

Reading. A partition is a range of row ids of one file (option ``rows``, default 1,000,000
ids); tables without row ids are one partition a file. Comparisons of columns with literals,
IN, and null tests are answered by SQLite where the literal is a number, a boolean, a string
without NUL or a date; other filters are left to Spark. The schema of a folder is the one that
was written; that of a file follows its declared types (option ``table``), by SQLite's rules:
INT long, CHAR, CLOB and TEXT string, REAL, FLOA and DOUB double, BOOL boolean, BLOB or none binary,
others string. A value that doesn't fit its column's type is an error; with ``bad=null`` it is null, and
then no filter is pushed, as SQLite would compare what was stored.

Writing. Each task writes one SQLite file into a staging folder. The commit moves the files of the tasks
that succeeded beside their predecessors and then links a manifest under the next free number, which
fails if another writer took it and is tried again; only files that the last manifest names
are ever read. An abort removes the staging folder and whatever was moved. Option ``index``: columns
to index in each file, comma-separated. Dates and times (UTC) are text, decimals are text, NaN is the
text NaN, which SQLite sorts above all numbers, as Spark does. An empty DataFrame leaves a manifest without files.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass, field
from decimal import Decimal
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

NAME = "sqlite_files"
TABLE = "data"
UTC = dt.timezone.utc
COMPARISONS = {ds.EqualTo: "=", ds.EqualNullSafe: "IS", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: SQLite's default bound on parameters is 999 in old versions.
MOST_PARAMETERS = 900


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite opens files of a mounted folder only: {path}")
    return path.rstrip("/")


def connection(path: str) -> sqlite3.Connection:
    """Read-only; a missing file is an error, not a new database."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def stored_value(v, kind: T.DataType | None = None):
    """A cell as SQLite keeps it; times without a zone are local ones unless ``kind`` has none."""
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        v = v if isinstance(kind, T.TimestampNTZType) else v.astimezone(UTC)
        return v.replace(tzinfo=None).isoformat(" ", "microseconds")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, Decimal):
        return format(v, "f")
    return bytes(v) if isinstance(v, bytearray) else v


def cell_reader(kind: T.DataType, strict: bool):
    """A function from a stored cell to a value of ``kind``."""

    def read(v):
        if isinstance(kind, T.BooleanType) and v in (0, 1):
            return bool(v)
        if isinstance(kind, INTEGERS) and isinstance(v, int):
            return v
        if isinstance(kind, (T.DoubleType, T.FloatType)) and (isinstance(v, (int, float)) or v == "NaN"):
            return float(v)
        if isinstance(v, str):
            if isinstance(kind, T.StringType):
                return v
            if isinstance(kind, T.DateType):
                return dt.date.fromisoformat(v)
            if isinstance(kind, T.TimestampType):
                return dt.datetime.fromisoformat(v).replace(tzinfo=UTC)
            if isinstance(kind, T.TimestampNTZType):
                return dt.datetime.fromisoformat(v)
            if isinstance(kind, T.DecimalType):
                return Decimal(v)
        if isinstance(kind, T.BinaryType) and isinstance(v, (bytes, str)):
            return v if isinstance(v, bytes) else v.encode()
        raise ValueError(f"{v!r} is no {kind.simpleString()}")

    def cell(v):
        if v is None:
            return None
        try:
            return read(v)
        except (ValueError, ArithmeticError):
            if strict:
                raise
            return None

    return cell


def declared_type(text: str) -> T.DataType:
    up = (text or "").upper()
    for parts, kind in ((("INT",), T.LongType()), (("CHAR", "CLOB", "TEXT"), T.StringType()), (("BLOB",), T.BinaryType()), (("REAL", "FLOA", "DOUB"), T.DoubleType()), (("BOOL",), T.BooleanType())):
        if any(p in up for p in parts):
            return kind
    return T.StringType() if up else T.BinaryType()


def column_type(kind: T.DataType) -> str:
    if isinstance(kind, (*INTEGERS, T.BooleanType)):
        return "INTEGER"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "REAL"
    if isinstance(kind, T.BinaryType):
        return "BLOB"
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return "TEXT"
    raise ValueError(f"SQLite has no form for {kind.simpleString()}")


def last_manifest(folder: str) -> tuple[int, dict | None]:
    """Number and content of the newest manifest; (0, None) where nothing was committed."""
    try:
        names = os.listdir(folder)
    except FileNotFoundError:
        return 0, None
    numbers = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()]
    if not numbers:
        return 0, None
    with open(f"{folder}/manifest-{max(numbers)}.json", encoding="utf-8") as f:
        return max(numbers), json.load(f)


@dataclass
class Range(ds.InputPartition):
    """Rows of one file: all, or those with low <= row id < high."""

    file: str
    low: int | None = None
    high: int | None = None
    rowid: str = "rowid"

    def __post_init__(self):
        self.value = self.file


class SqliteReader(ds.DataSourceReader):
    def __init__(self, files: list[str], table: str, schema: T.StructType, rows: int, strict: bool) -> None:
        self.files, self.table, self.schema, self.rows, self.strict = files, table, schema, rows, strict
        self.where: list[str] = []
        self.parameters: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            found = self._condition(f) if self.strict else None
            if found is None or len(self.parameters) + len(found[1]) > MOST_PARAMETERS:
                yield f
            else:
                self.where.append(found[0])
                self.parameters += found[1]

    def _condition(self, f: ds.Filter) -> tuple[str, list] | None:
        if isinstance(f, ds.Not):
            inner = self._condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        path = getattr(f, "attribute", ())
        if len(path) != 1 or path[0] not in self.schema.names:
            return None
        name, kind = quoted(path[0]), self.schema[path[0]].dataType
        if isinstance(f, (ds.IsNull, ds.IsNotNull)):
            return f"{name} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL", []
        values = list(f.value) if isinstance(f, ds.In) else [f.value] if type(f) in COMPARISONS else None
        if values is None or not all(self._comparable(v, kind) for v in values):
            return None
        sign = f"IN ({', '.join('?' * len(values))})" if isinstance(f, ds.In) else f"{COMPARISONS[type(f)]} ?"
        return f"{name} {sign}", [stored_value(v) for v in values]

    @staticmethod
    def _comparable(v, kind: T.DataType) -> bool:
        """Whether SQLite compares the stored column with ``v`` as Spark does."""
        if isinstance(kind, (*INTEGERS, T.BooleanType)):
            return isinstance(v, int)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return isinstance(v, (int, float)) and not isinstance(v, bool)
        if isinstance(kind, T.StringType):
            return isinstance(v, str) and "\0" not in v
        return isinstance(kind, T.DateType) and isinstance(v, dt.date) and not isinstance(v, dt.datetime)

    def partitions(self) -> list[Range]:
        out = []
        for file in self.files:
            with closing(connection(file)) as con:
                columns = {r[1].lower() for r in con.execute(f"PRAGMA table_info({quoted(self.table)})")}
                if not columns:
                    raise ValueError(f"{file} has no table {self.table}")
                rowid = next((n for n in ("rowid", "_rowid_", "oid") if n not in columns), None)
                try:
                    low, high = con.execute(f"SELECT min({rowid}), max({rowid}) FROM {quoted(self.table)}").fetchone() if rowid else (None, None)
                except sqlite3.OperationalError:  # a view, or a table without row ids
                    rowid = None
            if not rowid:
                out.append(Range(file))
            elif low is not None:
                out += [Range(file, at, min(at + self.rows, high + 1), rowid) for at in range(low, high + 1, self.rows)]
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        where, parameters = list(self.where), list(self.parameters)
        if partition.low is not None:
            where += [f"{partition.rowid} >= ?", f"{partition.rowid} < ?"]
            parameters += [partition.low, partition.high]
        columns = ", ".join(quoted(n) for n in self.schema.names)
        sql = f"SELECT {columns} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(f'({w})' for w in where)}" if where else "")
        cells = [cell_reader(f.dataType, self.strict) for f in self.schema]
        with closing(connection(partition.file)) as con:
            for row in con.execute(sql, parameters):
                yield tuple(c(v) for c, v in zip(cells, row, strict=True))


@dataclass
class Written(ds.WriterCommitMessage):
    file: str | None = None
    rows: int = 0


@dataclass
class SqliteWriter(ds.DataSourceWriter):
    folder: str
    schema: T.StructType
    overwrite: bool
    index: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.job = uuid.uuid4().hex
        self.staging = f"{self.folder}/_staging-{self.job}"
        self.columns = ", ".join(f"{quoted(f.name)} {column_type(f.dataType)}" for f in self.schema)
        if len({n.lower() for n in self.schema.names}) < len(self.schema):
            raise ValueError("SQLite's column names don't differ by case alone")
        if unknown := set(self.index) - set(self.schema.names):
            raise ValueError(f"no columns to index: {sorted(unknown)}")
        os.makedirs(self.staging)  # not by the tasks: one that outlives an abort must not bring it back

    def write(self, iterator: Iterator[T.Row]) -> Written:
        task = TaskContext.get()
        name = f"part-{self.job}-{task.partitionId()}-{task.attemptNumber()}-{task.taskAttemptId()}.sqlite"
        insert = f"INSERT INTO {TABLE} VALUES ({', '.join('?' * len(self.schema))})"
        kinds = [f.dataType for f in self.schema]
        n = 0

        def rows():
            nonlocal n
            for row in iterator:
                n += 1
                yield tuple(map(stored_value, row, kinds))

        with closing(sqlite3.connect(f"{self.staging}/{name}")) as con:
            con.execute("PRAGMA journal_mode = OFF")  # a failed task's file is never used
            con.execute("PRAGMA synchronous = OFF")
            con.execute(f"CREATE TABLE {TABLE} ({self.columns})")
            con.executemany(insert, rows())
            for column in self.index:
                con.execute(f"CREATE INDEX {quoted('by_' + column)} ON {TABLE} ({quoted(column)})")
            con.commit()
        if not n:
            os.remove(f"{self.staging}/{name}")
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        new = [{"file": m.file, "rows": m.rows} for m in messages if m and m.file]
        for part in new:
            os.replace(f"{self.staging}/{part['file']}", f"{self.folder}/{part['file']}")
        draft = f"{self.folder}/_draft-{self.job}"
        while True:
            number, last = last_manifest(self.folder)
            if last and not self.overwrite and last["schema"] != self.schema.jsonValue():
                raise ValueError("rows of another schema can't be appended")
            kept = [] if self.overwrite or not last else last["files"]
            with open(draft, "w", encoding="utf-8") as f:
                json.dump({"schema": self.schema.jsonValue(), "files": kept + new}, f)
            try:
                os.link(draft, f"{self.folder}/manifest-{number + 1}.json")
                break
            except FileExistsError:
                continue
        os.remove(draft)
        shutil.rmtree(self.staging, ignore_errors=True)
        if self.overwrite and last:
            for part in last["files"]:
                os.remove(f"{self.folder}/{part['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        gone = f"{self.staging}-aborted"
        if os.path.isdir(self.staging):
            os.rename(self.staging, gone)  # tasks that still run find no folder to open files in
            shutil.rmtree(gone)
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if self.job in name:
                    os.remove(f"{self.folder}/{name}")


class SqliteSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _place(self) -> tuple[list[str], str, T.StructType | None]:
        """Files, table, and the schema that was written (null for a foreign file)."""
        path = local_path(self.options["path"])
        if not os.path.isdir(path):
            return [path], self.options.get("table", TABLE), None
        number, manifest = last_manifest(path)
        if manifest is None:
            raise ValueError(f"nothing was committed to {path}")
        return [f"{path}/{p['file']}" for p in manifest["files"]], TABLE, T.StructType.fromJson(manifest["schema"])

    def schema(self) -> T.StructType:
        files, table, schema = self._place()
        if schema is None:
            with closing(connection(files[0])) as con:
                found = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
            if not found:
                raise ValueError(f"{files[0]} has no table {table}")
            schema = T.StructType([T.StructField(name, declared_type(kind)) for _, name, kind, *_ in found])
        return schema

    def reader(self, schema: T.StructType) -> SqliteReader:
        files, table, _ = self._place()
        return SqliteReader(files, table, schema, int(self.options.get("rows", 1_000_000)), self.options.get("bad", "fail") != "null")

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        index = [c for c in self.options.get("index", "").split(",") if c]
        return SqliteWriter(local_path(self.options["path"]), schema, overwrite, index)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it hand filters to the source."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str = TABLE, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(path=path, table=table, **options).load()


def write(df: DataFrame, path: str, mode: str = "append", index: list[str] | None = None) -> None:
    """``mode`` append or overwrite. ``df`` may be of any size: one file for each of its partitions."""
    register(df.sparkSession)
    df.write.format(NAME).mode(mode).options(path=path, index=",".join(index or [])).save()
