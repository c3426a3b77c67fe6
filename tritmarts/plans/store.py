"""Marts written once per session and sample, then read back.

Raw rows are rolled up once; every later query starts from the written mart,
so its lineage is a file scan that survives a lost executor.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tritmarts.session import shared_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}


def settings_digest(*settings: object) -> str:
    """Short digest of frozen settings, so that marts of other settings have other names."""
    return hashlib.sha256(repr(settings).encode()).hexdigest()[:12]


def is_stored(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _WRITTEN


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
