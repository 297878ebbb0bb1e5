"""Ids, keys and names of normalised events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null


def transaction_event_id(signature: Column, slot: Column, index: Column) -> Column:
    return F.concat_ws(":", F.coalesce(signature, F.lit("unknown-signature")), slot, index)


def account_event_id(slot: Column, pubkey: Column) -> Column:
    return F.concat_ws(":", slot, pubkey, F.lit("account"))


def partition_key(signature: Column, fallback: Column) -> Column:
    return F.coalesce(signature, fallback)


def registry_name(name: Column, content: Column) -> Column:
    """Given name, else the name text inside the content, else 'unknown'."""
    doc = F.try_parse_json(content)
    inner = F.when(
        F.schema_of_variant(F.try_variant_get(doc, "$.name", "variant")) == "STRING",
        F.try_variant_get(doc, "$.name", "string"),
    )
    kept = F.when(blank_to_null(name).isNotNull(), name)
    return F.coalesce(kept, inner, F.lit("unknown"))


def registry_version(content: Column) -> Column:
    """The version inside the content as JSON text, so that 25 stays a number and "25" a text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(content), "$.version", "variant"))
