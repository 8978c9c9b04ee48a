"""Typed JSON at the boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAPPERS = ["AnaliseResultado", "analiseResultado", "resultado", "analise"]  # fixed values


def unwrap(json: Column) -> Column:
    """Inner object when the answer came wrapped under a known name, else the text itself."""
    found = [F.get_json_object(json, f"$.{name}") for name in WRAPPERS]
    objects = [F.when(F.substring(F.ltrim(f), 1, 1).isin("{", "["), f) for f in found]
    return F.coalesce(*objects, json)


def typed(json: Column, schema: str) -> Column:
    """Parsed value; text that is not JSON gives NULL fields, never an error."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def enum_or(value: Column, allowed: Sequence[str], fallback: str) -> Column:
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(fallback))


def validated(json: Column, schema: str, required: Sequence[str] = (), enums: dict[str, tuple[Sequence[str], str]] | None = None) -> Column:
    """``struct<value, reason>`` of an answer: its typed fields, or why it is refused.

    An answer is refused if it is no JSON object or lacks a required field. Texts
    are trimmed; blank ones count as missing. Fields in ``enums`` that hold another
    word get the fallback. A refused answer keeps its fields, for inspection.
    """
    parsed = typed(unwrap(json), f"{schema}, _corrupt_record string")
    fields = [part.split()[:2] for part in schema.split(",")]
    clean = {}
    for name, kind in fields:
        value = parsed[name]
        if kind == "string":
            value = F.nullif(F.trim(value), F.lit(""))
        if enums and name in enums:
            value = enum_or(value, *enums[name])
        clean[name] = value
    broken = json.isNull() | parsed["_corrupt_record"].isNotNull() | ~F.coalesce(F.ltrim(unwrap(json)).startswith("{"), F.lit(False))
    reason = F.when(broken, "não é JSON de objeto")
    for name in required:
        reason = reason.when(clean[name].isNull(), f"campo obrigatório ausente: {name}")
    return F.struct(F.struct(*(v.alias(n) for n, v in clean.items())).alias("value"), reason.alias("reason"))


def canonical(columns: Sequence[str]) -> Column:
    """JSON with keys in alphabetical order and absent (NULL) keys dropped."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def item(columns: Sequence[str], internal: Sequence[str] = ()) -> Column:
    """A row as JSON without its internal columns."""
    hidden = set(internal)
    return F.to_json(F.struct(*[F.col(c) for c in columns if c not in hidden]))
