"""Where the operators of this subpackage put what they write between stages, and what all of them use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the store that driver and executors share.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local temporary
    folder takes its place in local mode (tests, one machine), and a cluster,
    whose machines would not share it, is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="pubspark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/pubspark-{uuid.uuid4().hex}"


def written(df: DataFrame, rows: int | None = None, per: int = 1 << 16, dealt: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: this cuts the lineage and survives lost executors.

    Where about so many ``rows`` are to come, tasks are joined until each has ``per`` of them: a small
    table otherwise has a file for each shuffle partition, and Hadoop starts processes for each local file.
    With ``dealt`` the rows are dealt anew instead, so that the tasks that find them, which may be long, stay as many.
    """
    path = shared_dir(df.sparkSession)
    if rows is not None:
        df = df.repartition(min(tasks(rows, per), partitions(df))) if dealt else df.coalesce(tasks(rows, per))
    df.write.options(**(_WRITE | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEWEST = 4  # tasks that stay, however small the table
TEXTS = 1 << 13  # texts or signatures that a task writes at least, if there are so many
_WRITE = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}  # nobody else waits for the files


def tasks(rows: int, per: int = 1 << 16) -> int:
    """How many tasks write so many rows."""
    return max(FEWEST, -(-rows // per))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """A-Z to a-z and nothing else, as the contracts say."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
