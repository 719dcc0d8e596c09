"""The text functions by name, for those who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import MARKED, PLAIN


def register(spark: SparkSession) -> None:
    """Temporary SQL functions fold, tokens, path_name and language_or_und; they are inlined into plans."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION fold(s STRING) RETURNS STRING RETURN "
        f"CASE WHEN s RLIKE '[^\\\\x00-\\\\x7F]' THEN regexp_replace(translate(lower(s), '{MARKED}', '{PLAIN}'), '\\\\p{{M}}+', '') ELSE lower(s) END"
    )
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION tokens(s STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(fold(s), '([\\p{L}\\p{N}]+)', 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION path_name(p STRING) RETURNS STRING RETURN regexp_replace(element_at(split(p, '/'), -1), '(.)\\\\.[^.]*$', '$1')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION language_or_und(l STRING) RETURNS STRING RETURN CASE WHEN l IS NULL OR l = '' THEN 'und' ELSE lower(l) END")
