"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a session on this machine alone (``local[*]``) gets a temporary folder, once for each
    application; on a cluster that is an error, as executors and driver don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return found.rstrip("/")


def build_session(app: str = "verdigris", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings that the queries expect; ``settings`` take underscores for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application: they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="verdigris-")
    path = os.path.join(folder, "verdigris.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.join("verdigris", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: a step of a loop costs its own work, and a lost executor a task."""
    path, schema = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that nothing lazy refers to any more."""
    for df in tables:
        spark = df.sparkSession
        own = shared_dir(spark)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            # Only what ``staged`` made, never an input.
            if folder.split(":", 1)[-1].lstrip("/").startswith(own.split(":", 1)[-1].lstrip("/")):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
