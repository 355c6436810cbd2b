"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "hearthspan", **conf) -> SparkSession:
    """Session with the defaults above; `conf` keys use dots, values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one beside the warehouse's tables.

    On a cluster a warehouse on a local disk is not shared, so there the setting must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    alone = spark.conf.get("spark.master", "local").split("[")[0] == "local"
    if not alone and (folder.startswith("file:") or "://" not in folder):
        raise ValueError(f"executors do not share {folder}: set spark.checkpoint.dir to a folder that they do")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
