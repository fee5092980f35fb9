"""Content hashes and identities as Spark expressions; hashes of configurations on the driver."""

from __future__ import annotations

import hashlib
import json
from datetime import date
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def merged(*parts: Column) -> Column:
    """sha256 over the parts, each led by its length in bytes as eight big-endian bytes, so no two lists of parts look alike."""
    led = []
    for p in parts:
        raw = p.cast("string").cast("binary")
        led += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("bigint")), 16, "0")), raw]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*led), 256))


def _short(digest: Column, n: int = 24) -> Column:
    return F.substring(digest, 8, n)


def document_id(namespace: Column | str, uri: Column) -> Column:
    """From the place of a document, so it stays through edits."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    return _short(merged(F.lit("doc"), ns, uri))


def unit_id(document: Column, content_hash: Column, occurrence: Column) -> Column:
    """From a unit's document and text, and which of equal texts in it this is; its place doesn't count."""
    return _short(merged(F.lit("unit"), document, content_hash, occurrence))


def occurrence(document: str = "document_id", content_hash: str = "content_hash", order: str = "ordinal") -> Column:
    return F.row_number().over(Window.partitionBy(document, content_hash).orderBy(order)) - 1


def cache_key(stage: str, impl: str, version: str, params: dict[str, Any], input_hash: Column, scope_hash: Column) -> Column:
    """Key of a stage's result: what made it, and from what. The scope names the document, so equal bytes elsewhere are another entry."""
    return merged(F.lit(stage), F.lit(impl), F.lit(version), F.lit(config_hash(params)), input_hash, scope_hash)


def canonical(value: Any) -> str:
    """One JSON text for equal values: sorted keys, no white space, dates in ISO form, sets in order; other types are refused."""

    def other(x: Any) -> Any:
        if isinstance(x, (set, frozenset)):
            return sorted(x, key=repr)
        if isinstance(x, date):
            return x.isoformat()
        raise TypeError(f"{type(x).__name__} has no canonical form")

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=other)


def config_hash(value: Any) -> str:
    """Hash of a configuration without its secrets, so a rotated key makes nothing stale."""
    from quernstone.config import redacted

    value = redacted(value)
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()
