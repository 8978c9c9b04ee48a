"""Registration of verifiable queries: a Spark callable and, where SQL can say it, its twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; ``sql`` may name any common table of ``twin``."""
    from bidspan.registry.tables import Tables

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            TWINS[name] = sql
        return fn

    return wrap


def with_common(sql: str, common: dict[str, str]) -> str:
    """Prefix the common tables a statement names, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[a-z_0-9]+", text)):
            if word in common and word not in needed:
                needed.add(word)
                visit(common[word])

    visit(sql)
    if not needed:
        return sql
    parts = [f"{n} AS ({common[n]})" for n in common if n in needed]
    body = sql.strip()
    recursive = bool(re.match(r"(?i)with\s+recursive\b", body))
    own = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body) if re.match(r"(?i)with\b", body) else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + (",\n" + own if own is not None else "\n" + body)
