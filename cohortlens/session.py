"""Session helpers.

The library never creates its own cluster settings when running inside an
existing session: every function takes the caller's ``SparkSession``.  These
helpers only fill in defaults for local runs (tests, bench) and resolve the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # exact percentiles / modes keep a value->count map; keep codegen on
    "spark.sql.codegen.wholeStage": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortlens") -> SparkSession:
    """Session for tests and the bench (``local[n]``); a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder and is
    used as is; a cluster without one is an error, because a folder of one machine is
    not visible to the others.  Only a ``local`` master (tests) gets a folder of its
    own, which is removed when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not configured and not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if current is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cohortlens`` importable on executors (Arrow UDFs, mapInPandas helpers).

    In local mode (tests, bench, the verify harness) the package is zipped once per driver
    process and registered with ``addPyFile``.  On a cluster the package is expected to be
    submitted with ``--py-files`` or installed in the image; set
    ``spark.cohortlens.shipPackage=true`` to ship it from the driver anyway."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    forced = spark.conf.get("spark.cohortlens.shipPackage", "false").lower() == "true"
    if not (sc.master.startswith("local") or forced):
        _SHIPPED.add(id(sc))
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="cohortlens-pkg-", dir="/tmp"), "cohortlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))
