"""Surrogate keys: md5 over the text of the natural key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.clean import as_column

# Separator and NULL token of the public dbt_utils key macro (1.x).
KEY_SEPARATOR = "-"
KEY_NULL_TOKEN = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*columns: Column | str) -> Column:
    parts = [F.coalesce(as_column(c).cast("string"), F.lit(KEY_NULL_TOKEN)) for c in columns]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *parts))
