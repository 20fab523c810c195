"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from operator import and_

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one chunk of documents may hold before it is worked on.
CHUNK_CHARS = 4_000_000
#: Documents in one chunk; slots of a chunk fit two bytes.
CHUNK_DOCS = 60_000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that setting is empty, a local master takes a
    temporary folder; on a cluster that is an error, as executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write the frame as Parquet in the shared folder and read it back: the lineage ends there, and
    lost executors cost nothing."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the folders of stored frames that nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "stored_at", None):
            jvm = frame.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


class Steps:
    """The stored steps of one operator, deleted together once its result is stored."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, frame: DataFrame) -> DataFrame:
        self.frames.append(stored(frame))
        return self.frames[-1]

    def result(self, frame: DataFrame) -> DataFrame:
        out = stored(frame)
        forget(*self.frames)
        return out


#: Ids that a broadcast may hold: some 20 MB.
BROADCAST_IDS = 500_000


def by_ids(frame: DataFrame, key: str | list[str], ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``frame`` whose key is (``left_semi``, ``inner``) or is not (``left_anti``) among ``ids``, whose
    first columns are the key; ``inner`` adds the others, and takes each key once.

    The ids are counted first: up to a bound they are broadcast, so that whole texts needn't be shuffled; beyond
    it both sides are shuffled by id.
    """
    keys = [key] if isinstance(key, str) else key
    ids = ids.toDF(*[f"_id{i}" for i in range(len(keys))], *ids.columns[len(keys) :])
    if how != "inner":
        ids = ids.distinct()
    few = ids.count() <= BROADCAST_IDS
    same = reduce(and_, [frame[k] == ids[f"_id{i}"] for i, k in enumerate(keys)])
    return frame.join(F.broadcast(ids) if few else ids, same, how).drop(*[f"_id{i}" for i in range(len(keys))])


#: Plan nodes that pass the rows of a scan on, one by one.
_PASSING = {"Project", "Filter", "SubqueryAlias", "View"}


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` itself where each row has a name that every reading repeats (a scan of Parquet files, projected
    or filtered); any other frame is stored first. Partition and position are no such name: both change when
    executors are lost or the frame is computed anew."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _PASSING:
        plan = plan.children().head()
    if "LogicalRelation" in plan.nodeName():
        try:
            docs.select(docs.metadataColumn("_metadata").getField("row_index"))
            return docs
        except AnalysisException:
            pass
    return stored(docs)


def row_name(docs: DataFrame) -> list[Column]:
    """The name of each row of a ``scanned`` frame: a hash of its file, and its place there."""
    hidden = docs.metadataColumn("_metadata")
    return [F.xxhash64(hidden.getField("file_path")).alias("row_file"), hidden.getField("row_index").alias("row_at")]


def named_columns(docs: DataFrame, **names: str) -> DataFrame:
    """As ``own_columns``, after ``row_file, row_at``; ``docs`` is ``scanned``."""
    return docs.select(*row_name(docs), *[F.col(f"`{column}`").alias(name) for name, column in names.items()])


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts are large: hand them to Python workers by the thousand and by some megabytes, unless the
    session says otherwise."""
    records, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(records) == "10000":
        spark.conf.set(records, "1000")
        spark.conf.set(size, str(8 << 20))


_turn: list = [None, None]


def turn(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins. Python workers live on from one operator to the next: when another
    one takes over, what the one before remembered goes, and freed memory goes back to the machine."""
    if _turn[0] != owner:
        if _turn[1] is not None:
            _turn[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
    _turn[:] = [owner, clear]


def own_columns(docs: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns of any name do no harm."""
    return docs.select(*[F.col(f"`{column}`").alias(name) for name, column in names.items()])


def chunks(batches: Iterable[pa.RecordBatch], text_at: int = 1, most: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Keys (the column before the text, or tuples of all of them) and texts (null: empty) in lists of bounded size;
    a single longer text comes alone."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
        keys = [part.column(i).to_pylist() for i in range(text_at)]
        keys = keys[0] if text_at == 1 else zip(*keys, strict=True)
        for key, text in zip(keys, part.column(text_at).to_pylist(), strict=True):
            text = text or ""
            if texts and (held + len(text) > most or len(texts) >= CHUNK_DOCS):
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(key)
            texts.append(text)
            held += len(text)
    if texts:
        yield ids, texts
    pa.default_memory_pool().release_unused()  # a worker lives on, beside the next stage's


def rows_out(schema: pa.Schema, columns: list, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of at most ``most`` rows."""
    table = pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    yield from table.to_batches(max_chunksize=most)


def rows_where(docs: DataFrame, text_column: str, test) -> DataFrame:
    """The rows of ``docs``, all columns, for whose texts a test holds. ``test()`` is called once a task and
    returns a function from a list of texts to a list of booleans; nothing is shuffled."""
    at = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = test()
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            yield batch.filter(pa.array(holds(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def texts_changed(docs: DataFrame, text_column: str, change) -> DataFrame:
    """``docs`` with each text (null stays null) replaced; ``change()`` is called once a task and returns a
    function from a list of texts to a list of texts."""
    at = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed = change()
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            yield batch.set_column(at, batch.schema.field(at), pa.array(changed(batch.column(at).to_pylist()), batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
