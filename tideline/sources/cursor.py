"""A polled source of paged records as a stream with one cursor an asset.

Pages lie below a folder as ``asset=<a>/page=<n>/*.parquet``; a page is written once and in order. The offset of the stream
maps each asset to the pages behind its cursor, and is kept in the query's checkpoint, so that a query that stops
between pages goes on with the next one of every asset. Assets that appear later start at their first page. A page is read
by one task, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


class Pages(InputPartition):
    """Some pages of one asset, read together."""

    def __init__(self, asset: str, paths: list[str]):
        self.asset = asset
        self.paths = paths


def _children(path: str, prefix: str) -> list[str]:
    """Names behind ``prefix`` of the folders below a path that any of Arrow's file systems can list."""
    system, inner = pf.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    found = system.get_file_info(pf.FileSelector(inner, allow_not_found=True))
    return sorted(f.base_name.removeprefix(prefix) for f in found if f.type == pf.FileType.Directory and f.base_name.startswith(prefix))


def _table(path: str) -> pa.Table:
    system, inner = pf.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    files = [f.path for f in system.get_file_info(pf.FileSelector(inner)) if f.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f, filesystem=system, partitioning=None) for f in sorted(files)])


class CursorReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.path = options["path"].rstrip("/")
        #: Pages of one asset that one task reads.
        self.pages_per_task = int(options.get("pagesPerTask", 16))
        self.clock = options.get("clock")
        self.low, self.high = (int(options[k]) if k in options else None for k in ("from", "until"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Pages that are there, asset by asset, as far as they follow on each other."""
        out = {}
        for asset in _children(self.path, "asset="):
            pages = set(map(int, _children(f"{self.path}/asset={asset}", "page=")))
            n = 0
            while n in pages:
                n += 1
            if n:
                out[asset] = n
        return out

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        out = []
        for asset, last in sorted(end.items()):
            paths = [f"{self.path}/asset={asset}/page={n}" for n in range(start.get(asset, 0), last)]
            out += [Pages(asset, paths[i : i + self.pages_per_task]) for i in range(0, len(paths), self.pages_per_task)]
        return out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        """The rows whose clock lies within the session bounds, from the first on and before the second."""
        wanted = to_arrow_schema(self.schema)
        for path in partition.paths:
            table = _table(path)
            if self.clock is not None:
                clock = table.column(self.clock)
                if self.low is not None:
                    table = table.filter(pc.fill_null(pc.greater_equal(clock, self.low), False))
                    clock = table.column(self.clock)
                if self.high is not None:
                    table = table.filter(pc.fill_null(pc.less(clock, self.high), False))
            if "asset" in wanted.names and "asset" not in table.column_names:
                table = table.append_column("asset", pa.array([partition.asset] * table.num_rows, pa.string()))
            yield from table.select(wanted.names).cast(wanted).to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offset; pages stay where they are."""


class CursorSource(DataSource):
    """``paged``: options ``path``; ``clock`` with ``from`` and ``until``, whole numbers; ``pagesPerTask``. Without a stated schema
    it is that of the first page."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> T.StructType:
        path = self.options["path"].rstrip("/")
        asset = _children(path, "asset=")[0]
        found = from_arrow_schema(_table(f"{path}/asset={asset}/page={min(map(int, _children(f'{path}/asset={asset}', 'page=')))}").schema)
        return found if "asset" in found.names else found.add("asset", "string")

    def streamReader(self, schema: T.StructType) -> CursorReader:
        return CursorReader(schema, self.options)


def write_pages(rows: DataFrame, path: str, asset: str = "asset", page: str = "page") -> None:
    """Rows as pages, numbered from 0 within an asset by the column ``page``; one file a page."""
    rows.repartition(asset, page).write.mode("append").partitionBy(asset, page).parquet(path)


def poll(spark: SparkSession, path: str, schema: T.StructType, clock: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """A folder of pages as a stream."""
    spark.dataSource.register(CursorSource)
    bounds = {k: str(v) for k, v in (("clock", clock), ("from", low), ("until", high)) if v is not None}
    return spark.readStream.format("paged").schema(schema).options(path=path, **bounds).load()
