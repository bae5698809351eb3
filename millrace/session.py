"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_cuts: list[str] = []


def get_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the results rely on (UTC, AQE)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once for each Spark context: they may run elsewhere, or in a folder
    from which it cannot be imported."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="millrace-code-")
    atexit.register(shutil.rmtree, folder, True)
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(folder, "millrace_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._millrace_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a
    folder of our own; on a cluster, where every executor would write to its own disk, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        path = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, path, True)
        _own["dir"] = f"file://{path}"
    return _own["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and every later use reads the same rows.

    A column type that Parquet lacks is not expected here. An empty ``df`` keeps its schema.
    """
    ship(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _cuts.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, for what is read for as long as the application runs: ``release`` leaves it."""
    out = cut(df, name)
    _cuts.pop()
    return out


def file_versions(df: DataFrame) -> tuple:
    """The files a table is read from, with their sizes and times: another version has another one."""
    spark = df.sparkSession
    out = []
    for name in sorted(df.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written so far, once the results that read them are done with."""
    paths, _cuts[:] = list(_cuts), []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def at_least(spark: SparkSession, low: int = 12) -> int:
    """Shuffle partitions of the session, ``low`` or more."""
    return max(low, int(spark.conf.get("spark.sql.shuffle.partitions")))
