"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "ruleweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans rely on; a cluster supplies its own master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, app: str = "ruleweave-local") -> SparkSession:
    memory = os.environ.get("RULEWEAVE_DRIVER_MEMORY", "12g")
    return build_session(
        app,
        master=f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": memory},
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; a cluster must name
    one, since a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ruleweave-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so an iterative job survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cut off like a checkpoint, but read by column and planned by their size."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors with the job, once per application."""
    context = spark.sparkContext
    if getattr(context, "_ruleweave_shipped", False):
        return spark
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(file.relative_to(PACKAGE.parent))), file.read_bytes())
    folder = tempfile.mkdtemp(prefix="ruleweave-package-")  # read by the driver only, which serves it to the executors
    name = os.path.join(folder, "ruleweave_package.zip")
    Path(name).write_bytes(body.getvalue())
    context.addPyFile(name)
    context._ruleweave_shipped = True
    return spark
