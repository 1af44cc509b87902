"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.plans.stored import saved as saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark so that any store of the cluster will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def import_on_workers(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver has it.

    On a cluster without a shared home the package is shipped with ``--py-files``.
    """
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        joined = os.pathsep.join(p for p in (home, known) if p)
        spark.sparkContext.environment["PYTHONPATH"] = joined


def text_of(column: str) -> Column:
    """The column as text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_of(column: str) -> Column:
    """The UTF-8 bytes of :func:`text_of`."""
    return text_of(column).cast("binary")


def id_remainder(column: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(text_of(column)) % F.lit(modulus)
