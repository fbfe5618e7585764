"""Session settings the operators rely on."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC calendar days, last-wins duplicate JSON keys, runtime re-planning of skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: Set only where the cluster has no value.  A fixed number keeps the split of the
#: input independent of how many executors happen to be up, which the line numbers
#: of ``sources.lines`` rely on.
DEFAULTS = {"spark.sql.files.minPartitionNum": "8"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings; sizes (partitions, memory) stay the cluster's."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    for name, value in DEFAULTS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    import tempfile

    folder = tempfile.mkdtemp(prefix="turnwise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder: computed once, and its lineage ends there."""
    path = f"{scratch_dir(df.sparkSession)}/turnwise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
