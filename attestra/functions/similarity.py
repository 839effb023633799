"""Name similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalized(name: str) -> str:
    """Words of a name: underscores, hyphens and capitals part them."""
    spaced = name.replace("_", " ").replace("-", " ")
    return "".join(f" {c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(spaced)).strip()


def ratio(a: str, b: str) -> float:
    """difflib's ratio; it depends on the order of its arguments, which is (fact, claim)."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    return names.map(normalized, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def name_ratio(facts: pd.Series, claims: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b) for a, b in zip(facts, claims)], dtype=float)
