"""Canonical JSON and schema digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def py_json(value) -> str:
    """JSON with sorted keys, ", " and ": " between items, and text beyond ASCII as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def schema_id(source: str, graph: str, payload) -> str:
    return f"{source}:{graph}:{hashlib.sha256(py_json(payload).encode()).hexdigest()[:16]}"


@F.pandas_udf(T.StringType())
def schema_id_udf(source: pd.Series, graph: pd.Series, payload: pd.Series) -> pd.Series:
    """payload: JSON text of nodes and relationships in any layout."""
    return pd.Series([schema_id(s, g, json.loads(p)) for s, g, p in zip(source, graph, payload)])
