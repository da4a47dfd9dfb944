"""Session defaults and the shared scratch area that iterative plans write to."""

from __future__ import annotations

import atexit
import os
import pickle
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "varloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides (underscores stand for dots)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, which only a local master may use.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="varloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Spark's setting for the end of a query.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written between the rounds of an iterative plan.

    ``stage`` cuts the lineage: the rows go to Parquet in the shared folder and are read back, so a
    lost executor costs one task and file statistics feed the join planner. ``close`` removes all
    tables but those that the result still reads; these go when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str = "stage"):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/varloom/{label}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def stage(self, df: DataFrame, release: bool = False) -> DataFrame:
        """``release``: the shuffle files of this writing go as soon as it is done, not when the driver happens to collect its garbage."""
        path = f"{self.root}/{len(self.paths) + 1}"
        if not self.paths:
            fs, root = self._fs(self.root)
            fs.mkdirs(root)
            fs.deleteOnExit(root)
        self.paths.append(path)
        before = self.spark.conf.get(RELEASE, "false")
        self.spark.conf.set(RELEASE, "true" if release else before)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(RELEASE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def remove(self) -> None:
        """Remove the whole folder."""
        fs, p = self._fs(self.root)
        fs.delete(p, True)
        self.paths = []

    def close(self, *keep: DataFrame | None) -> None:
        """Remove every table but ``keep``; no plan that is still to run may read the others."""
        kept = {getattr(df, "_scratch_path", None) for df in keep}
        for path in self.paths:
            if path not in kept:
                fs, p = self._fs(path)
                fs.delete(p, True)
        self.paths = [p for p in self.paths if p in kept]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str, per_core: int = 2) -> DataFrame:
    """``df`` hashed by ``key`` over the cores when its scan has fewer tasks than cores; a scan of many splits stays as it is.

    For Python stages over small tables of few files; at scale the scan has enough tasks and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core, key)


#: Objects that a worker process keeps from task to task.
KEPT = 6


def kept(key: str, make: Callable):
    """``make()``, once in a worker process; the oldest of more than ``KEPT`` objects is dropped."""
    home = sys.modules.setdefault("_varloom_kept", types.ModuleType("_varloom_kept")).__dict__.setdefault("objects", {})
    if key not in home:
        while len(home) >= KEPT:
            home.pop(next(iter(home)))
        home[key] = make()
    return home[key]


def ship(spark: SparkSession, value) -> Callable:
    """A broadcast of any object, with the classes it needs, as a function to call in tasks.

    A plain broadcast names an object's class, which only workers with this package could load.
    """
    data, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: kept(key, lambda: pickle.loads(data.value))
