"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


#: bytes of a method beyond which the JVM never compiles it: such generated code would run interpreted
JIT_LIMIT = 8000


def get_session(app: str = "watchloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.codegen.hugeMethodLimit": str(JIT_LIMIT),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compiled(spark: SparkSession) -> SparkSession:
    """The session with the limit on the size of methods lowered to what the JVM compiles, for sessions made elsewhere."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > JIT_LIMIT:
        spark.conf.set(key, str(JIT_LIMIT))
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over the shuffle partitions.

    For narrow rows before costly per-row work, whose files may hold few or uneven splits. It always shuffles;
    inputs that are well split already should be taken as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the cluster's, else (local only) a new one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="watchloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, keeps partitions and row order."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to Parquet beside the checkpoints, for results that several plans read: each reads only its columns."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
