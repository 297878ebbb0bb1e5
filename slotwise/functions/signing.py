"""Hashes and signatures built from Spark's own sha2."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_BLOCK = 64


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer key pads of HMAC-SHA256."""
    key = secret.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def request_signature(secret: str, timestamp: Column, nonce: Column, body: Column) -> Column:
    """Hex HMAC-SHA256 of timestamp, nonce and body joined by line feeds."""
    inner, outer = hmac_pads(secret)
    message = F.encode(F.concat_ws("\n", timestamp, nonce, body), "UTF-8")
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def sql_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def dedupe_key(
    monitor_id: Column, program_id: Column, comparator: Column, template: Column, threshold: Column, value: Column
) -> Column:
    """Fingerprint of one alert: same monitor text and same value, same key."""
    text = F.format_string(
        "%d|%s|%s|%s|%.6f|%.6f",
        monitor_id.cast("bigint"),
        F.coalesce(program_id, F.lit("")),
        comparator,
        template,
        threshold.cast("double"),
        value.cast("double"),
    )
    return F.sha2(text, 256)


def plain_base64(c: Column) -> Column:
    """Base64 on one line; Spark's own breaks lines every 76 characters."""
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")
