"""Sessions, table access and durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, ANSI, AQE with skew handling.

    On a cluster leave ``master`` unset; keyword settings override the defaults (dots as ``__``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of our own only where none is set and the run is local.

    A cluster must name a folder that all executors share in ``spark.checkpoint.dir``.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = os.path.join(tempfile.gettempdir(), f"tidemark-checkpoints-{os.getpid()}")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read from there.

    Lineage ends and lost executors cost nothing. Unlike a checkpoint, which runs the plan once for the action and once more
    to write, the plan runs once, and readers take only the columns they need. The tables go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stored_once(spark: SparkSession, key: tuple, write: Callable[[str], None]) -> str:
    """The folder of a table that is written by ``write`` when it is first asked for in a session, and kept until the driver ends."""
    name = (spark.sparkContext.applicationId, *key)
    if name not in _stored:
        path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
        write(path)
        _written.append((spark, path))
        _stored[name] = path
    return _stored[name]


_written: list[tuple[SparkSession, str]] = []
_stored: dict[tuple, str] = {}


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended before; its folder is then cleared with it
            return
