"""Session, table access, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: A side of a join is broadcast only if it has at most this many rows (and few, narrow columns).
BROADCAST_ROWS = 200_000


def build_session(app: str = "tavuflow", master: str | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one is set only where none is named."""
    where = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tavuflow-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, nothing rests on one executor.

    The files hold only what df selects; they are removed with the shared folder (see release()).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tavuflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(spark: SparkSession, name: str, key: dict[str, str], build) -> DataFrame:
    """The table kept under name and key in the shared folder; build() makes it where there is none. It is never renewed: the key
    must tell all that the table depends on."""
    path = "/".join([shared_dir(spark), "tavuflow", "kept", name, *(f"{k}={v}" for k, v in sorted(key.items()))])
    if not hadoop_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give work to less than half of them; an input of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def release(spark: SparkSession) -> None:
    """Remove all tables that materialize() wrote, once no result rests on them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tavuflow")
    path.getFileSystem(conf).delete(path, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most so many rows, else df as it is (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hadoop_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (glob allowed) exists on its own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(conf).globStatus(p)
    return bool(found)
