"""Similarity of short strings, evaluated on candidate pairs only."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters, ``2 * matched / total length``."""
    return pd.Series([SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype="float64")
