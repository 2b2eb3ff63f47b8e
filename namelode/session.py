"""Session helpers: reading tables and cutting lineage durably."""

from __future__ import annotations

import shutil
import tempfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "namelode", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and local runs; on a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / root.name), "zip", root.parent, root.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where that is unset, on one machine only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="namelode-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the reliable checkpoint folder, its lineage cut.

    The folder is the one the session has, see ``checkpoint_folder``. The files survive the loss of an executor; Spark deletes them with the
    frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``local_session`` does.
    """
    context = df.sparkSession.sparkContext
    ship(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def nullif_empty(col: Column) -> Column:
    """NULL for NULL and ''."""
    return F.nullif(col, F.lit(""))


def trimmed(col: Column) -> Column:
    """A text without outer white space of any kind, non-breaking blanks among it."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of ``conditions``; TRUE for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
