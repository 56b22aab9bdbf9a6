"""Registration of queries over views of the driver tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .views import ORACLE_VIEWS

QUERIES: dict = {}
ORACLE_SQL: dict = {}
c = F.col


def q(name: str, sql: str | None, view=V.incidents):
    """Register a function of a view's DataFrame, with its oracle."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(view(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = (ORACLE_VIEWS if "FROM" in sql else "") + sql
        return f

    return put


def tables(*names: str):
    """A view of several tables: the query gets them in order."""
    return lambda spark, sf_dir: [getattr(V, n)(spark, sf_dir) if hasattr(V, n) else V.table(spark, sf_dir, n) for n in names]
