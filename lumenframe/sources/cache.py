"""Content-addressed and plan-bound caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys without a sound entry in ``cache(key, sound)``; a corrupt entry counts as missing."""
    return wanted.select("key").distinct().join(cache.where("sound").select("key"), "key", "left_anti")


def fingerprint(identity: dict) -> str:
    """Name of a result from all that decides it."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, allow_nan=False).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, identity: dict, make) -> DataFrame:
    """The table stored under ``identity``, made once. Spark's committer leaves ``_SUCCESS`` last, so a half-written one is made anew."""
    path = f"{folder.rstrip('/')}/{fingerprint(identity)}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(column: str = "content"):
    return F.sha2(F.col(column), 256)
