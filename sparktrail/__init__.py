"""sparktrail: trace analytics on Spark, expressed as DataFrame plans."""

from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED = "sparktrail.shipped"


def ship(spark):
    """Send this package to the executors, once a context, and return the session.

    Executors share no folder with the driver, so the package travels as a zip
    through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED) != sc.applicationId:
        root = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="sparktrail"), "sparktrail.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("sparktrail", os.path.relpath(path, root)))
        sc.addPyFile(out)
        sc.setLocalProperty(_SHIPPED, sc.applicationId)
    return spark


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only where that is unset and all runs on one machine, as in tests, a temporary folder is taken."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut_lineage(df):
    """df, computed and kept in files of the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tasks_for(df, rows: int = 200_000) -> int:
    """To how many tasks df is dealt for so many rows a task, at least as many as are set, so that what a task holds does not grow with the table. Counts df."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
