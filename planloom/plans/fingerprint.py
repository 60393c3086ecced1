"""Structural fingerprint of a plan: equal for plans that differ in constants, estimates and counts alone."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from . import schema
from .flatten import walk


def structure(document: str | dict) -> str:
    """What the fingerprint is taken of: for each node in pre-order its structural keys with their text values, the
    names of its conditions (not the conditions), and its depth."""
    parts = []
    for node, _, _, depth in walk(document):
        parts.append(f":depth={depth}:")
        for key, value in node.items():
            if key in schema.FINGERPRINT_CONDITIONS:
                parts.append(key)
            elif key in schema.STRUCTURAL and isinstance(value, str):
                parts.append(f"{key}={value}")
    return "|".join(parts)


def planid(document: str | dict) -> str:
    """An unsigned 64-bit number as text."""
    return str(xxhash.xxh64_intdigest(structure(document)))


def planid_column(column):
    """The same over a column of documents."""
    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else planid(d))

    return run(column)
