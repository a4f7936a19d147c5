"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import functools
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    """Session used by the tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("inkwell")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    A folder of its own is only chosen where the session names none and runs on one machine, as in tests.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"a cluster needs {CHECKPOINT_KEY}: a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own_root.setdefault(app, "") or tempfile.mkdtemp(prefix="inkwell-")
        _own_root[app] = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Its size is known from then on, so Spark itself decides whether to broadcast it, and lost
    executors do not recompute what came before. The folder stays until the caller clears the
    shared folder, since lazy results still read it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Put this package on the workers' path, sent once per application as a Python archive."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        name = Path(tempfile.mkdtemp()) / f"{package.name}-{context.applicationId}"
        context.addPyFile(shutil.make_archive(str(name), "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def on_workers(df: DataFrame, batches, schema) -> DataFrame:
    """`mapInArrow` with this package on the workers' path."""
    _ship(df.sparkSession)
    return df.mapInArrow(batches, schema)


def build_once(build):
    """Keep the columns a function of plain values returns.

    Long expressions take many calls into the JVM to put together; a search does it once per
    driver instead of once per call.
    """
    kept = {}

    @functools.wraps(build)
    def wrapper(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapper
