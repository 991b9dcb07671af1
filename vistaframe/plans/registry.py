"""Queries of the driver by name, with their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.overview import overview
from . import catalog_files, catalog_tables

_MODULES = (catalog_tables, catalog_files)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}


def entry(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The overview of the table orders in sf_dir, or in the folder that VISTAFRAME_DATA names."""
    return overview(spark, f"{sf_dir or os.environ.get('VISTAFRAME_DATA', '/root/testdata/sf0.001')}/orders.parquet")
