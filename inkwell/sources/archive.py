"""The stored archive, a snapshot with segments of changes laid over it, and its key/value state.

The state names the snapshot and the segments that count, so a write that broke off is never read. A segment holds one
row per changed id, or only the id and `deleted`; of several segments the one with the highest `seq` decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.fields import DOCUMENT_COLUMNS

STATE_SCHEMA = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("seq", T.LongType())]
)
DOCUMENT_SCHEMA = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType()) if n == "tags" else T.StringType()) for n in DOCUMENT_COLUMNS]
)
LAST_SYNC = "last_sync_at"
CURRENT = "current_snapshot"
#: Keys of live segments begin with this; the value is the folder.
SEGMENT = "segment-"
SEGMENT_SCHEMA = T.StructType(
    [*DOCUMENT_SCHEMA.fields, T.StructField("deleted", T.BooleanType()), T.StructField("seq", T.LongType())]
)


def write_documents(docs: DataFrame, path: str) -> DataFrame:
    """A snapshot in a folder of its own; a half-written one is never the current one,
    because the state that names it is written afterwards."""
    docs.write.partitionBy("type").parquet(path)
    return read_documents(docs.sparkSession, path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The schema is fixed: a snapshot without documents has no file to tell it."""
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(path).select(*DOCUMENT_COLUMNS)


def latest_state(entries: DataFrame) -> DataFrame:
    """The last value of every key wins."""
    return entries.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def write_state(entries: DataFrame, path: str) -> None:
    """Append (`key`, `value`, `seq`) rows; a write is one small file."""
    entries.select("key", "value", "seq").coalesce(1).write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """`key`, `value`; empty where nothing was written yet."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    if not exists:
        return spark.createDataFrame([], "key string, value string")
    return latest_state(spark.read.schema(STATE_SCHEMA).parquet(path))


def state_value(state: DataFrame, key: str) -> str | None:
    """One value, or None for a missing key."""
    row = state.where(F.col("key") == key).select("value").first()
    return row["value"] if row else None


def write_segment(changed: DataFrame, gone: DataFrame | None, path: str, seq: int) -> None:
    """The rows of changed ids (at most one each) and the ids that are deleted. Its size follows the change."""
    rows = changed.select(*DOCUMENT_COLUMNS).withColumn("deleted", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.select("id", F.lit(True).alias("deleted")), allowMissingColumns=True)
    rows.withColumn("seq", F.lit(seq).cast("long")).write.parquet(path)


def live_segments(state: DataFrame) -> dict[str, str]:
    """Key and folder of the segments that are not folded yet; their number is that of commits since the last fold."""
    rows = state.where(F.col("key").startswith(SEGMENT) & F.col("value").isNotNull()).collect()
    return {r["key"]: r["value"] for r in sorted(rows, key=lambda r: r["key"])}


def lay_over(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The documents of `base` with the last change of every id laid over them, deleted ones left out."""
    newest = Window.partitionBy("id").orderBy(F.col("seq").desc())
    last = changes.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1 AND NOT deleted")
    kept = base.join(changes.select("id"), "id", "left_anti").select(*DOCUMENT_COLUMNS)
    return kept.unionByName(last.select(*DOCUMENT_COLUMNS))


def read_segments(spark: SparkSession, state: DataFrame) -> DataFrame | None:
    """The rows of all live segments, or None where there is none."""
    paths = list(live_segments(state).values())
    return spark.read.schema(SEGMENT_SCHEMA).parquet(*paths) if paths else None


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """The documents held below `root`: the current snapshot and its live segments."""
    state = read_state(spark, f"{root}/state")
    snapshot = state_value(state, CURRENT)
    base = read_documents(spark, snapshot) if snapshot else spark.createDataFrame([], DOCUMENT_SCHEMA)
    changes = read_segments(spark, state)
    return base if changes is None else lay_over(base, changes)
