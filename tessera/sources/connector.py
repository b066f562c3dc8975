"""Corpora as a data source: ``spark.read.format("corpus")`` gives documents (id, content, source) of Parquet files.

Options: ``path`` (a file or a folder) and the columns that are the ``id``, ``content`` and ``source`` of a document.  The driver
reads footers only: each row group that pushed filters don't rule out by its statistics is a partition of its own, and an
executor reads of it the columns that are named.  Pushed filters over one column (equal, in, less, greater, not null) are
taken over, others stay with Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

COLUMNS = ("id", "content", "source")
_COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str):
    """The file system and the Parquet files of a path."""
    from pyarrow import fs

    files, root = _store(path)
    if files.get_file_info(root).type == fs.FileType.File:
        return files, [root]
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda f: any(part.startswith(("_", ".")) for part in f.path.removeprefix(root).split("/"))
    return files, sorted(f.path for f in found if f.path.endswith(".parquet") and not hidden(f))


def may_hold(f: Filter, low, high) -> bool:
    """Whether values between ``low`` and ``high`` can satisfy a filter."""
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value if v is not None)
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return high > f.value or isinstance(f, GreaterThanOrEqual) and high == f.value
    if isinstance(f, (LessThan, LessThanOrEqual)):
        return low < f.value or isinstance(f, LessThanOrEqual) and low == f.value
    return True


def holds(f: Filter, column: pa.Array) -> pa.Array:
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], column.type))
    return _COMPARED[type(f)](column, pa.scalar(f.value, column.type))


class CorpusReader(DataSourceReader):
    def __init__(self, path: str, columns: dict[str, str]):
        self.path, self.columns, self.filters = path, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            single = isinstance(f, (*_COMPARED, In, IsNotNull)) and len(f.attribute) == 1
            if single and (isinstance(f, (In, IsNotNull)) or f.value is not None):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[RowGroup]:
        import pyarrow.parquet as pq

        files, paths = _files(self.path)
        out = []
        for path in paths:
            with files.open_input_file(path) as source:
                about = pq.ParquetFile(source).metadata
            place = {about.schema.column(i).path: i for i in range(about.num_columns)}
            out += [RowGroup(path, g) for g in range(about.num_row_groups) if all(self._open(f, about.row_group(g), place) for f in self.filters)]
        return out or [RowGroup("", -1)]  # Spark reads one partition at least

    def _open(self, f: Filter, group, place: dict[str, int]) -> bool:
        column = place.get(self.columns[f.attribute[0]])
        found = group.column(column).statistics if column is not None else None
        return found is None or not found.has_min_max or may_hold(f, found.min, found.max)

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition.group < 0:
            return
        with _store(self.path)[0].open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.group], columns=list(self.columns.values()), batch_size=2000):
                named = {name: batch.column(of) for name, of in self.columns.items()}
                mask = None
                for f in self.filters:
                    one = holds(f, named[f.attribute[0]])
                    mask = one if mask is None else pc.and_(mask, one)
                out = pa.RecordBatch.from_arrays([named[c] for c in self.columns], list(self.columns))
                yield out if mask is None else out.filter(mask)


class Corpus(DataSource):
    """Documents of Parquet files; see the module."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def _columns(self) -> dict[str, str]:
        return {c: self.options[c] for c in COLUMNS if c in self.options}

    def schema(self) -> str:
        import pyarrow.parquet as pq

        files, paths = _files(self.options["path"])
        with files.open_input_file(paths[0]) as source:
            kinds = pq.ParquetFile(source).schema_arrow
        plain = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.large_string(): "string"}
        return ", ".join(f"{name} {plain[kinds.field(of).type]}" for name, of in self._columns().items())

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options["path"], self._columns())


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Corpus)
    return spark
