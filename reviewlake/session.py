"""Session helpers shared by all modules: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, tuple] = {}
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder; elsewhere that is an error, because a
    machine-local folder is not visible to the other executors.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="reviewlake-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it once as a table in the shared folder and read that.

    A reliable checkpoint would compute the last stage twice, once to count and once to write. The
    table outlives lost executors and lets the optimizer see its size. :func:`forget` removes it early, the end of the session the rest.
    The shuffle files of the write go with it: nothing reads them again, and until the driver's garbage is collected they would add up on disk.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SHUFFLES)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    sc = spark.sparkContext
    _WRITTEN[path] = (sc._jvm, sc._jsc.hadoopConfiguration())
    return out


def spread(df: DataFrame, key: str, rows_per_task: int = 20_000) -> DataFrame:
    """``df`` in enough partitions for a costly step, by a hash of ``key``: small tables would otherwise be read by one task.

    ``df`` should be a table that :func:`cut` wrote, so that counting it reads no data.
    """
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))
    return df.repartition(parts, key)


def parallel(scan: DataFrame, key: str) -> DataFrame:
    """``scan``, a table with narrow steps only, in at least as many partitions as there are cores, for a costly step to come."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores, key)


def forget(df: DataFrame) -> None:
    """Remove the table that :func:`cut` wrote for ``df``; nothing may read it afterwards."""
    _remove(getattr(df, "_cut_path", ""))


def _remove(path: str) -> None:
    jvm, conf = _WRITTEN.pop(path, (None, None))
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_WRITTEN):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001 - the virtual machine may be gone already
            return


def local_session(name: str = "reviewlake", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
