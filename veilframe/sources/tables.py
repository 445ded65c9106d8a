"""Parquet tables of cases: roles travel in column metadata, which Parquet keeps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.cases import CaseSchema, as_cases, schema_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a temporary folder only where it is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilframe-")
    return f"{found.rstrip('/')}/veilframe/{tag}-{uuid.uuid4().hex}"


def write_cases(cases: DataFrame, schema: CaseSchema, path: str, mode: str = "errorifexists") -> None:
    as_cases(cases, schema).write.mode(mode).parquet(path)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, CaseSchema]:
    found = spark.read.parquet(path)
    return found, schema_of(found)
