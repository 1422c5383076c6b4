"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine, as in tests, a temporary folder
    is made; on a cluster executors couldn't read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(spark.sparkContext, "_umbra_store", None)
        if not path:
            path = tempfile.mkdtemp(prefix="umbra-store-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            spark.sparkContext._umbra_store = path
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor costs at most the re-read of its part of these files.
    """
    path = f"{shared_dir(df.sparkSession)}/umbra-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
