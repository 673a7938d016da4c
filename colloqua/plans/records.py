"""Queries on nested share records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloqua.operators import nested
from colloqua.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.parent_child_links(table(spark, sf_dir, "conversations_raw"))


#: The flat tables, each as a query p6_<name>.
FLAT = ("shares", "sources", "moderation", "tools", "safe_urls", "file_types", "messages", "message_children", "payloads", "payload_safe_urls", "nodes", "parts", "thoughts", "citations", "attachments", "children", "runs")


def _flat(name: str):
    return lambda spark, sf_dir: nested.flat_tables(table(spark, sf_dir, "conversations_raw"))[name]


QUERIES = {"p6_found": p6_found} | {f"p6_{n}": _flat(n) for n in FLAT}
SQL: dict[str, str] = {}
