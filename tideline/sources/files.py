"""CSV and JSON-line files, write-once and content-addressed sinks, and scratch folders that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that stands for null in CSV files, so that empty text stays empty.
CSV_NULL = "\\N"
_CSV = {
    "header": True, "escape": '"', "nullValue": CSV_NULL, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that setting is empty, a local master takes a temporary
    folder; on a cluster that is an error, as executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(frame: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header; quotes are doubled, line ends stay inside quotes, null and empty text differ. Parts are
    written in parallel; an existing path is an error."""
    frame.write.mode("errorifexists").options(**_CSV, compression=compression).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, several_lines: bool = True) -> DataFrame:
    """CSV of a stated schema, nothing inferred; a row that does not fit is an error. Fields with line ends need
    ``several_lines``, which keeps a file in one task; without it files are split."""
    return spark.read.schema(schema).options(**_CSV, multiLine=several_lines, mode="FAILFAST").csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line of JSON files with its fields and a ``status``: ok, torn (malformed and cut before its closing
    brace, as a writer leaves it that was stopped) or malformed. Nothing is dropped."""
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    torn = bad & ~F.col("value").rlike(r"\}\s*$")
    status = F.when(torn, "torn").when(bad, "malformed").otherwise("ok")
    return parsed.select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields], "file", status.alias("status"))


def observations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The sound rows of JSON lines. One torn line a file is dropped; more of them, or a malformed line, is an error."""
    rows = json_lines(spark, path, schema)
    bad = rows.where("status <> 'ok'").groupBy("file").agg(F.count_if(F.col("status") == "torn").alias("torn"), F.count_if(F.col("status") == "malformed").alias("malformed"))
    wrong = bad.where("torn > 1 or malformed > 0").limit(5).collect()
    if wrong:
        raise ValueError("MALFORMED_LINES:" + ";".join(f"{r.file}: {r.torn} torn, {r.malformed} malformed" for r in wrong))
    return rows.where("status = 'ok'").drop("file", "status")


def content_key(frame: DataFrame) -> str:
    """Order-free digest of a frame's columns and rows: equal contents have equal keys, however they are dealt."""
    row = F.sha2(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")
    n, *sums = frame.select(row.alias("h")).agg(F.count("*"), *[F.sum(part(at)) for at in (1, 16, 31, 46)]).first()
    parts = [n, *(s or 0 for s in sums), ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in frame.schema))]
    return frame.sparkSession.range(1).select(F.sha2(F.lit(":".join(map(str, parts))), 256)).first()[0]


def write_addressed(frame: DataFrame, folder: str) -> str:
    """Write a frame below its content's key, once: equal content that is there already is left as it is. Returns
    the path."""
    path = f"{folder}/{content_key(frame)}"
    spark = frame.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def stored(frame: DataFrame, name: str = "step") -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: its lineage ends there, so that lost executors
    repeat this step only."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read_addressed(spark: SparkSession, path: str) -> DataFrame:
    """Read content below its key; content that has changed since is an error."""
    frame = spark.read.parquet(path)
    key = path.rstrip("/").rsplit("/", 1)[-1]
    if content_key(frame) != key:
        raise ValueError(f"CONTENT_CHANGED:{key}")
    return frame
