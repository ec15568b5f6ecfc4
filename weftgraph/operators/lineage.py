"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir; where none is set (local tests) in a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="weftgraph-"))
    return df.checkpoint()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share; where none is set (local tests) in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
