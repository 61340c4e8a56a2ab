"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    A machine-local folder is set only for a local master, where executor and
    driver share the disk; elsewhere a missing setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="inkloom-checkpoint-")
    context.setCheckpointDir(named)
    return named


#: Where the rows of a frame made by ``materialize`` are written.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Folders made inside each open ``scratch_scope``, innermost last.
_SCOPES: list[list[str]] = []
#: The folder of each application below its checkpoint folder.
_ROOTS: dict[str, str] = {}


def materialize(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and continue from the written rows.

    The planner sees the size of the written files.  A checkpoint would keep the
    estimate of the plan it replaces, and in a loop that joins its own former result
    the digits of that estimate double each round.  Columns are written by place, so
    names that clash in Parquet are no obstacle.  ``instead_of`` is a former result of
    this function that nothing refers to any more: its files are removed.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, "rows")
    df.toDF(*[f"c{i}" for i in range(len(schema))]).write.parquet(path)
    placed = type(schema)([type(f)(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])
    out = spark.read.schema(placed).parquet(path).toDF(*schema.names)
    _WRITTEN[out] = path
    if instead_of is not None:
        release(instead_of)
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a result of ``materialize``, else its written rows."""
    return df if df in _WRITTEN else materialize(df)


def release(*frames: DataFrame) -> None:
    """Remove the files behind results of ``materialize``; other frames are left alone."""
    for frame in frames:
        path = _WRITTEN.pop(frame, None)
        if path is not None:
            _remove(frame.sparkSession, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A lineage cut that keeps partitions, their order and their sorting, and the size estimate of its plan.

    For steps that read rows in the order they were dealt; not for loops.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder for data a query writes and reads back.

    All such paths of an application lie in one folder, which is removed when its driver ends.
    """
    application = spark.sparkContext.applicationId
    if application not in _ROOTS:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/inkloom-{uuid.uuid4().hex}"
        files, place = _file_system(spark, root)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _ROOTS[application] = root
    path = f"{_ROOTS[application]}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, all that was written below ``scratch_path`` inside it.

    Results made inside must be written or collected inside; long-lived drivers use it around each query.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _remove(spark, path)
