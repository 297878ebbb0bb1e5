"""Verification of signed inbound requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signing import request_signature
from ..functions.text import is_json, strip
from ..functions.timing import parse_unix_or_rfc3339
from .ordered_rules import new_nonces

# Allowed clock drift and life of a nonce.
TOLERANCE_S = 300
NONCE_TTL_S = 600


def verify_requests(
    requests: DataFrame, secret: str, key_id: str = "", tolerance_s: int = TOLERANCE_S
) -> DataFrame:
    """Add received_at and the first failed check, NULL when the request is authentic."""
    sent_at, nonce = strip(F.col("sent_at")), strip(F.col("nonce"))
    received = parse_unix_or_rfc3339(sent_at)
    given = strip(F.regexp_replace(strip(F.col("signature")), r"^v1=", ""))
    expected = request_signature(secret, sent_at, nonce, F.col("body"))
    drift = F.abs(F.unix_micros("arrived_at") - F.unix_micros(received))
    other_key = (F.lit(key_id) != "") & (strip(F.col("key_id")) != "") & (strip(F.col("key_id")) != key_id)
    reason = (
        F.when(F.coalesce(strip(F.col("body")), F.lit("")) == "", "payload is required")
        .when(~is_json(F.col("body")), "payload must be valid JSON")
        .when(F.coalesce(sent_at, F.lit("")) == "", "timestamp is required")
        .when(received.isNull(), "timestamp must be unix seconds or RFC3339")
        .when(drift > tolerance_s * 1_000_000, "timestamp outside allowed tolerance")
        .when(F.coalesce(nonce, F.lit("")) == "", "nonce is required")
        .when(F.octet_length(nonce) > 128, "nonce exceeds maximum length")
        .when(F.coalesce(given, F.lit("")) == "", "signature is required")
        .when(given != expected, "invalid signature")
        .when(other_key, "key id mismatch")
    )
    return (
        requests.withColumn("received_at", received)
        .withColumn("reject_reason", reason)
        .withColumn("nonce", nonce)
        .withColumn("signature", given)
        .withColumn("key_id", strip(F.col("key_id")))
        .withColumn("source_ip", strip(F.col("source_ip")))
    )


def inbound_rows(verified: DataFrame) -> DataFrame:
    """Authentic requests in the shape of the landing table; time is the sender's."""
    return verified.where("reject_reason IS NULL").select(
        "request_id", "nonce", "signature", "key_id", "source_ip", F.col("body").alias("payload"), "received_at"
    )


def accept_requests(verified: DataFrame, ttl_s: int = NONCE_TTL_S, **tuning) -> DataFrame:
    """Authentic requests with ``fresh``: false for a replayed nonce."""
    rows = inbound_rows(verified).withColumn("received_us", F.unix_micros("received_at"))
    return new_nonces(rows, "nonce", "received_us", "request_id", ttl_s * 1_000_000, **tuning).drop("received_us")


def live_nonces(nonces: DataFrame, now_us: int) -> DataFrame:
    """Nonces that survive a purge: an entry ending exactly now still lives."""
    return nonces.where(F.col("expires_us") >= now_us)
