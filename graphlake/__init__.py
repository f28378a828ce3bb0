"""A declarative query and data-graph engine on Spark DataFrames."""

from graphlake.errors import EngineError, ErrorCode
from graphlake.schema import Column, Relation, Schema, Table
from graphlake.values import UNSET

__all__ = ["Column", "EngineError", "ErrorCode", "Relation", "Schema", "Table", "UNSET", "connect"]


def connect(spark, schema, sources, **options):
    """A client over ``sources``: table name -> DataFrame or parquet path."""
    from graphlake.client import Client

    return Client.open(spark, schema, sources, **options)
