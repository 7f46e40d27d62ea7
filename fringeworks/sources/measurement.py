"""Measurement sets as a format of Spark: ``spark.read.format("visibilities")``.

A set is what ``sources.write_vis`` writes: Parquet files in folders by
(field_id, ddid, scan).  The driver lists names and sizes of files and leaves out
the folders that a filter excludes; an input partition is a range of bytes of a
large file or several small files, and tasks open the files, pass over the row
groups whose statistics exclude a filter, and read the columns asked for.
"""

from __future__ import annotations

import fnmatch
import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FORMAT = "visibilities"
#: Folders of a set, from the outermost inwards; they become columns.
KEYS = ("field_id", "ddid", "scan")
OPTIONS = {"path", "columns", "bytes"}
#: Bytes of files that one input partition holds at most or so.
BYTES = 128 << 20
#: Rows that a task hands to Spark at a time.
_ROWS = 1 << 16
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

_ORDER: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class _Piece:
    """Bytes begin to end of a file, with its set and the values of its folders."""

    path: str
    size: int
    begin: int
    end: int
    ms: str
    keys: tuple[int | None, ...]


@dataclass
class _Pieces(InputPartition):
    pieces: list[_Piece]


def files_of(path: str) -> tuple[fs.FileSystem, list[_Piece]]:
    """The files of the sets at a path, whose last name may be a pattern with ``*``, in order."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    root = root.rstrip("/")
    above, _, pattern = root.rpartition("/")
    if "*" in above:
        raise ValueError(f"only the last name of a path may be a pattern: {path}")
    if "*" in pattern:
        sets = [x.path for x in system.get_file_info(fs.FileSelector(above)) if x.type == fs.FileType.Directory and fnmatch.fnmatchcase(x.base_name, pattern)]
    else:
        sets = [root]
    out = []
    for folder in sorted(sets):
        for x in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            names = x.path[len(folder) + 1 :].split("/")
            if x.type == fs.FileType.File and x.extension == "parquet" and not any(n.startswith(("_", ".")) for n in names):
                found = dict(n.split("=", 1) for n in names[:-1] if "=" in n)
                if set(found) != set(KEYS):
                    raise ValueError(f"not in folders by {', '.join(KEYS)}: {x.path}")
                keys = tuple(None if found[k] == _NO_VALUE else int(found[k]) for k in KEYS)
                out.append(_Piece(x.path, x.size, 0, x.size, folder.rpartition("/")[2], keys))
    if not out:
        raise FileNotFoundError(f"no measurement set at {path}")
    return system, sorted(out, key=lambda p: p.path)


def _holds(f: Filter, value: int | None) -> bool:
    """Does a value meet a filter on it?"""
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    return True if isinstance(f, IsNotNull) else _ORDER[type(f)](value, f.value)


def _excluded(f: Filter, low: object, high: object) -> bool:
    """Can no value from low to high meet a filter?"""
    if isinstance(f, In):
        return all(v is None or v < low or v > high for v in f.value)
    if isinstance(f, EqualTo):
        return f.value < low or f.value > high
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return not _ORDER[type(f)](high, f.value)
    return isinstance(f, (LessThan, LessThanOrEqual)) and not _ORDER[type(f)](low, f.value)


class MeasurementSets(DataSource):
    """Options: path; columns, separated by commas (all if unset); bytes, those of an input partition.

    Rows have the columns of the first file, those of the folders, and ``ms``,
    the name of the set.  A column that a later set lacks is null there.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _checked(self) -> tuple[str, list[str] | None, int]:
        given = dict(self.options)
        if unknown := sorted(set(given) - OPTIONS):
            raise ValueError(f"no such options: {', '.join(unknown)}; there are {', '.join(sorted(OPTIONS))}")
        if not given.get("path"):
            raise ValueError("a measurement set needs a path")
        size = given.get("bytes", str(BYTES))
        if not (size.isdigit() and int(size)):
            raise ValueError(f"bytes is no positive number: {size}")
        columns = [c.strip() for c in given["columns"].split(",")] if "columns" in given else None
        return given["path"], columns, int(size)

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        path, columns, _ = self._checked()
        system, files = files_of(path)
        with system.open_input_file(files[0].path) as f:
            held = pq.read_schema(f).remove_metadata()
        every = pa.schema([*held, *(pa.field(k, pa.int32()) for k in KEYS), pa.field("ms", pa.string())])
        if columns is not None:
            if missing := [c for c in columns if c not in every.names]:
                raise ValueError(f"the set has no columns {', '.join(missing)}")
            every = pa.schema([every.field(c) for c in columns])
        return from_arrow_schema(every)

    def reader(self, schema: StructType) -> DataSourceReader:
        path, _, size = self._checked()
        return _Reader(path, schema, size)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, size: int):
        self.path, self.schema, self.size = path, schema, size
        self.folders: list[Filter] = []
        self.rows: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on folders are met by the list of files; by others row groups are passed over, and Spark looks at the rows."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in KEYS and isinstance(f, (*_ORDER, In, IsNotNull)):
                self.folders.append(f)
                continue
            # statistics do not count NaN, which is above every number: no bound from below on doubles
            real = name in self.schema.names and self.schema[name].dataType.typeName() in ("double", "float")
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and f.value == f.value or isinstance(f, (GreaterThan, GreaterThanOrEqual, In)) and not real:
                self.rows.append(f)
            yield f

    def partitions(self) -> list[_Pieces]:
        _, files = files_of(self.path)
        out, held = [_Pieces([])], 0
        for p in files:
            if not all(_holds(f, p.keys[KEYS.index(f.attribute[0])]) for f in self.folders):
                continue
            for begin in range(0, p.size, self.size):
                end = min(begin + self.size, p.size)
                if held and held + end - begin > self.size:
                    out.append(_Pieces([]))
                    held = 0
                out[-1].pieces.append(_Piece(p.path, p.size, begin, end, p.ms, p.keys))
                held += end - begin
        return out

    def read(self, partition: _Pieces) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, out = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem(), to_arrow_schema(self.schema)
        for p in partition.pieces:
            with system.open_input_file(p.path) as f:
                file = pq.ParquetFile(f)
                names = [c for c in file.schema_arrow.names if c in out.names and c not in KEYS]
                at = {file.metadata.row_group(0).column(i).path_in_schema: i for i in range(file.metadata.num_columns)} if file.num_row_groups else {}
                for i in range(file.num_row_groups):
                    group = file.metadata.row_group(i)
                    first = min(c for k in range(group.num_columns) for c in (group.column(k).data_page_offset, group.column(k).dictionary_page_offset) if c)
                    if p.begin <= first < p.end and not self._passed_over(group, at):
                        if names:
                            for batch in file.iter_batches(_ROWS, row_groups=[i], columns=names):
                                yield _shaped(dict(zip(batch.schema.names, batch.columns, strict=True)), batch.num_rows, p, out)
                        else:
                            yield _shaped({}, group.num_rows, p, out)

    def _passed_over(self, group: pq.RowGroupMetaData, at: dict[str, int]) -> bool:
        for f in self.rows:
            stats = group.column(at[f.attribute[0]]).statistics if len(f.attribute) == 1 and f.attribute[0] in at else None
            if stats is not None and stats.has_min_max:
                low = stats.min
                value = next((v for v in f.value if v is not None), None) if isinstance(f, In) else f.value
                comparable = isinstance(low, (int, float)) and isinstance(value, (int, float)) or type(low) is type(value)
                if comparable and _excluded(f, low, stats.max):
                    return True
        return False


def _shaped(columns: dict[str, pa.Array], rows: int, p: _Piece, schema: pa.Schema) -> pa.RecordBatch:
    """The columns of the schema; the folders' values and the set's name the same in all rows."""
    same = dict(zip(KEYS, p.keys, strict=True)) | {"ms": p.ms}
    made = []
    for field in schema:
        if field.name in same:
            made.append(pa.repeat(pa.scalar(same[field.name], field.type), rows))
        elif field.name in columns:
            made.append(pc.cast(columns[field.name], field.type))
        else:
            made.append(pa.nulls(rows, field.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach formats in Python there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MeasurementSets)


def scan_sets(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The sets at a path by the format, with the columns asked for."""
    register(spark)
    reader = spark.read.format(FORMAT)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
