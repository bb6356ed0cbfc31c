"""Session helpers: local sessions for tests and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "fleetgauge", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in SESSION_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the results depend on (the session's time zone, UTC from then on) and keep AQE on.

    This changes the caller's session; registered queries call it, reports do not.
    """
    for name, value in SESSION_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in spark.checkpoint.dir; without it this raises an error there.
    Only a local session (tests, a laptop) gets a folder of its own, which goes with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = getattr(spark, "_fleetgauge_root", None)
    if not root:
        root = tempfile.mkdtemp(prefix="fleetgauge-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark._fleetgauge_root = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one run's tables or state; `drop_work` takes it away."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = getattr(spark, "_fleetgauge_work", None)
    if made is None:
        made = spark._fleetgauge_work = []
    made.append(path)
    return path


def drop_work(spark: SparkSession) -> int:
    """Remove the tables between steps that this session has made; for when all results that read them are written.

    Returns how many there were. Logs, baselines and stored findings lie at paths of their own and stay.
    """
    made, jvm = getattr(spark, "_fleetgauge_work", None) or [], spark._jvm
    for path in made:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    count = len(made)
    made.clear()
    return count
