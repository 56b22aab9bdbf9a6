"""Column functions by name, so that rules and callers can name what they apply; own functions may be added."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents, paths, text

FUNCTIONS: dict[str, Callable[..., Column]] = {name: f for module in (documents, paths, text) for name, f in inspect.getmembers(module, inspect.isfunction) if f.__module__ == module.__name__ and not name.startswith("_") and name != "one_of"}


def register(name: str, f: Callable[..., Column]) -> None:
    """Add a function of columns; a name that is taken is an error."""
    if name in FUNCTIONS:
        raise ValueError(f"{name} is there already")
    FUNCTIONS[name] = f


def apply(df: DataFrame, name: str, out: str, *columns: str, **options: object) -> DataFrame:
    """df with column ``out``: the named function of its columns."""
    return df.withColumn(out, FUNCTIONS[name](*(F.col(c) for c in columns), **options))
