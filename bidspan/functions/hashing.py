"""Content hashes and deterministic uniforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields whose change counts as a change of the tender; anything else is ignored.
CONTENT_FIELDS = [
    "control_no", "cnpj", "object", "extra_info", "modality_id", "dispute_mode_id", "status_id", "srp", "value",
    "published_at", "opens_at", "closes_at", "updated_at_source", "uf", "city", "city_code", "unit_code",
    "agency", "delegate_cnpj",
]


def content_hash(fields: Sequence[str]) -> Column:
    """Hash of the listed columns; NULL and blank stay different."""
    packed = F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"})
    return F.sha2(packed, 256)


def text_hash(text: Column) -> Column:
    return F.md5(text)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def uniform(text: Column) -> Column:
    """Deterministic number in [0, 1) from a text: first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(2**32)


def fingerprint(header: Column, documents: Column, versions: Sequence[str]) -> Column:
    """SHA-256 of canonical header JSON, sorted per-document digests and version labels."""
    return F.sha2(F.concat_ws("|", header, documents, *[F.lit(v) for v in versions]), 256)
