"""Session, shared storage and materialisation helpers used by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "wayspring", cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context: they may run on
    other machines, or in a folder from which it can't be imported."""
    sc = spark.sparkContext
    if getattr(sc, "_wayspring_shipped", False):
        return
    sc._wayspring_shipped = True
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="wayspring-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/wayspring.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, str(Path(home.name) / p.relative_to(home)))
    sc.addPyFile(f"{folder}/wayspring.zip")  # executors fetch it from the driver


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame; a directory or a single parquet file."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share. A cluster names it in spark.checkpoint.dir;
    a private temporary folder stands in only where that is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = getattr(sc, "_wayspring_dir", None)
    if kept is None:
        kept = tempfile.mkdtemp(prefix="wayspring-")
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        sc._wayspring_dir = kept
        sc.setCheckpointDir(f"file://{kept}/checkpoints")
    return f"file://{kept}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/wayspring/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as parquet in the shared folder and read it back.

    Columnar and compressed, so it costs less disk than a row checkpoint, and
    it survives the loss of any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def version(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """What the named tables are made of now: paths, sizes and times of their files."""
    jvm, out = spark.sparkContext._jvm, []
    for name in names:
        where = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(where)]
    return "\n".join(sorted(out))


def materialize_buckets(df: DataFrame, label: str, by: str, n: int) -> DataFrame:
    """As materialize, in n buckets by a column: what is grouped by it, or by it and
    others, is grouped where it lies. df is best partitioned so already."""
    spark = df.sparkSession
    name = f"wayspring_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch_path(spark, label)).bucketBy(n, by).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the session is gone; the folder is removed by its own hook
        pass


def beside(df: DataFrame, label: str, rows: int = 200_000) -> DataFrame:
    """df, written, as the small side of a join: broadcast if it has at most so many
    rows, else shuffled and hashed, so that the large side is never sorted."""
    written = materialize(df, label)
    return F.broadcast(written) if written.count() <= rows else written.hint("shuffle_hash")


def written(spark: SparkSession, label: str, of: str) -> DataFrame | None:
    """What `once` wrote; null if it was never written, or swept from the shared folder since."""
    found = (getattr(spark.sparkContext, "_wayspring_tables", None) or {}).get((label, of))
    files = found.inputFiles() if found is not None else []
    return found if files and exists(spark, files[0]) else None


def once(spark: SparkSession, label: str, of: str, build, write=materialize) -> DataFrame:
    """The written table `label` of a version (see above): built on first use, then
    shared by every query of the session. It is scratch, dropped with the driver."""
    sc = spark.sparkContext
    found = written(spark, label, of)
    if found is None:
        found = write(build(), label)
        if getattr(sc, "_wayspring_tables", None) is None:
            sc._wayspring_tables = {}
        sc._wayspring_tables[label, of] = found
    return found


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python operators receive: texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
