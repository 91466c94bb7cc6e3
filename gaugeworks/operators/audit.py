"""Audit of a table of SQL statements with the text rules of the query gate.

All rules are native column expressions, so a log of any size is judged in one
narrow pass. The rules are textual and therefore coarser than ``governed``; the two
differ, for instance, on a keyword inside a string.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.governed import DEFAULT_ROWS, MAX_ROWS, OPEN_TABLES

# Blocked words, blocked patterns, and how table and CTE names are found.
FORBIDDEN_KEYWORDS = (
    "insert", "update", "delete", "merge", "upsert",
    "create", "drop", "alter", "truncate", "rename",
    "grant", "revoke",
    "commit", "rollback", "savepoint", "begin", "start",
    "copy", "vacuum", "analyze", "cluster", "reindex", "refresh",
    "call", "do", "execute", "prepare", "deallocate", "listen", "notify",
    "set", "reset", "show", "lock", "comment", "import", "load",
    "extension", "pg_read_file", "pg_ls_dir", "lo_import", "lo_export",
    "dblink", "pg_sleep",
)
FORBIDDEN_PATTERN = (
    r"pg_read_file|pg_read_binary_file|pg_ls_dir|pg_stat_file|lo_import|lo_export|copy\s"
    r"|\bpg_catalog\b|\binformation_schema\b"
)
TABLE_PATTERN = r'(?i)\b(?:from|join)\s+([a-zA-Z_][\w\."]*)'
CTE_PATTERN = r"(?i)\b([a-zA-Z_]\w*)\s+as\s*\("
LIMIT_PATTERN = r"(?i)\blimit\s+([0-9]+)\b"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"--[^\n]*"

KEYWORD_PATTERN = r"\b(" + "|".join(FORBIDDEN_KEYWORDS) + r")\b"

EMPTY = "empty query"
STACKED = "more than one statement"
NOT_A_QUERY = "not a select"
KEYWORD = "forbidden keyword: "
PATTERN = "blocked function or schema"
TABLE = "table not open: "


def audit_sql_log(
    df: DataFrame,
    sql_column: str,
    tables: Collection[str] = OPEN_TABLES,
    default_rows: int = DEFAULT_ROWS,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Adds verdict, reason, referenced_tables, row_limit, governed_sql to every statement."""
    text = F.coalesce(F.col(sql_column), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, BLOCK_COMMENT, " "), LINE_COMMENT, " ")
    flat = F.trim(F.regexp_replace(bare, r"\s+", " "))
    cleaned = F.trim(F.regexp_replace(flat, ";+$", ""))
    parsed = df.withColumn("_clean", cleaned).withColumn(
        "_parts", F.filter(F.transform(F.split("_clean", ";"), lambda s: F.trim(s)), lambda s: s != "")
    )

    stmt = F.coalesce(F.get("_parts", F.lit(0)), F.lit(""))
    lowered = F.lower(stmt)
    open_tables = F.array(*[F.lit(t.lower()) for t in tables])
    named = F.transform(
        F.regexp_extract_all(stmt, F.lit(TABLE_PATTERN), F.lit(1)),
        lambda t: F.lower(F.element_at(F.split(F.replace(t, F.lit('"'), F.lit("")), r"\."), -1)),
    )
    ctes = F.regexp_extract_all(lowered, F.lit(CTE_PATTERN), F.lit(1))
    keywords = F.array_intersect(
        F.array(*[F.lit(k) for k in FORBIDDEN_KEYWORDS]),
        F.regexp_extract_all(lowered, F.lit(KEYWORD_PATTERN), F.lit(1)),
    )
    judged = (
        parsed.withColumn("_stmt", stmt)
        .withColumn("_tables", named)
        .withColumn("_closed", F.array_except(F.array_except("_tables", ctes), open_tables))
        .withColumn("_keyword", F.get(keywords, F.lit(0)))
        .withColumn("_asked", F.regexp_extract(lowered, LIMIT_PATTERN, 1))
    )

    stmt, lowered = F.col("_stmt"), F.lower("_stmt")
    reason = (
        F.when(F.trim(text) == "", F.lit(EMPTY))
        .when(F.size("_parts") != 1, F.lit(STACKED))
        .when(~(lowered.startswith("select") | lowered.startswith("with")), F.lit(NOT_A_QUERY))
        .when(F.col("_keyword").isNotNull(), F.concat(F.lit(KEYWORD), F.col("_keyword")))
        .when(lowered.rlike(FORBIDDEN_PATTERN), F.lit(PATTERN))
        .when(F.size("_closed") > 0, F.concat(F.lit(TABLE), F.get("_closed", F.lit(0))))
    )
    asked = F.least(F.coalesce(F.col("_asked").try_cast("int"), F.lit(max_rows)), F.lit(max_rows))
    row_limit = F.when(F.col("_asked") == "", F.lit(min(default_rows, max_rows))).otherwise(asked)
    limited = F.when(
        F.col("_asked") == "", F.concat(stmt, F.lit(" LIMIT "), F.col("row_limit").cast("string"))
    ).otherwise(
        F.regexp_replace(
            stmt, F.lit(LIMIT_PATTERN), F.concat(F.lit("LIMIT "), F.col("row_limit").cast("string"))
        )
    )
    accepted = F.col("reason").isNull()
    return (
        judged.withColumn("reason", reason)
        .withColumn("verdict", F.when(accepted, F.lit("accepted")).otherwise(F.lit("rejected")))
        .withColumn("referenced_tables", F.when(accepted, F.array_join("_tables", ",")))
        .withColumn("row_limit", F.when(accepted, row_limit))
        .withColumn("governed_sql", F.when(accepted, limited))
        .drop("_clean", "_parts", "_stmt", "_tables", "_closed", "_keyword", "_asked")
    )
