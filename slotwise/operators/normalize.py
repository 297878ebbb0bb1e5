"""Raw chain updates joined with the program registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import (
    account_event_id,
    partition_key,
    registry_name,
    registry_version,
    transaction_event_id,
)
from ..functions.signing import plain_base64
from ..functions.text import blank_to_null, strip
from ..session import dimension

_JSON = {"ignoreNullFields": "false"}


def subscribed_transactions(transactions: DataFrame, program_ids: list[str]) -> DataFrame:
    """Non-vote transactions naming a subscribed program; failed ones stay."""
    ids = F.array(*[F.lit(p) for p in program_ids])
    return transactions.where(~F.col("is_vote") & F.arrays_overlap("account_keys", ids))


def subscribed_accounts(accounts: DataFrame, program_ids: list[str]) -> DataFrame:
    return accounts.where(F.col("owner").isin(list(program_ids)))


def load_registry(registry: DataFrame) -> DataFrame:
    """Registry ready to join. A blank program id fails the whole load."""
    program = F.when(strip(F.col("program_id")) != "", F.col("program_id")).otherwise(
        F.raise_error(F.lit("registry holds a blank program_id"))
    )
    return registry.select(
        program.alias("program_id"),
        registry_name(F.col("name"), F.col("content")).alias("idl_name"),
        registry_version(F.col("content")).alias("idl_version"),
    )


def load_routes(routes: DataFrame) -> DataFrame:
    """Active routes, blank filters as NULL. A blank url fails the whole load."""
    url = strip(F.col("url"))
    checked = F.when(url != "", url).otherwise(F.raise_error(F.lit("a route holds a blank url")))
    return routes.where("is_active").select(
        "route_id",
        checked.alias("url"),
        blank_to_null(F.col("program_id")).alias("program_id"),
        blank_to_null(F.col("event_type")).alias("event_type"),
    )


def normalize_transactions(transactions: DataFrame, registry: DataFrame, limit: int | None = None) -> DataFrame:
    """One event per instruction whose program the registry knows."""
    none = F.array().cast("array<string>")
    keys = F.concat(
        "account_keys", F.coalesce("loaded_writable", none), F.coalesce("loaded_readonly", none)
    )
    steps = (
        transactions.withColumn("account_keys", keys)
        .select("*", F.posexplode("instructions").alias("instruction_index", "instruction"))
        .withColumn("program_id", F.get("account_keys", F.col("instruction.program_id_index")))
        .where(F.col("program_id").isNotNull())
    )
    known = steps.join(dimension(registry, limit), "program_id")
    payload = F.struct(
        F.col("account_keys"),
        F.col("filters"),
        F.col("idl_name"),
        F.try_parse_json("idl_version").alias("idl_version"),
        F.struct(
            F.col("instruction.accounts").alias("accounts"),
            plain_base64(F.col("instruction.data")).alias("data_base64"),
            F.col("instruction.program_id_index").alias("program_id_index"),
        ).alias("instruction"),
        F.col("instruction_index"),
        F.col("is_vote"),
        F.struct(
            F.col("compute_units_consumed"),
            F.col("fee"),
            F.coalesce("log_messages", none).alias("log_messages"),
        ).alias("meta"),
    )
    return known.select(
        transaction_event_id(F.col("signature"), F.col("slot"), F.col("instruction_index")).alias("event_id"),
        F.lit("transaction").alias("event_type"),
        "program_id",
        "slot",
        "signature",
        partition_key(F.col("signature"), F.col("program_id")).alias("partition_key"),
        "source_endpoint",
        "observed_at_unix_ms",
        F.to_json(payload, _JSON).alias("payload"),
    )


def normalize_accounts(accounts: DataFrame, registry: DataFrame, limit: int | None = None) -> DataFrame:
    """One event per account update whose owner the registry knows."""
    owners = registry.withColumnRenamed("program_id", "owner")
    known = accounts.join(dimension(owners, limit), "owner")
    payload = F.struct(
        F.col("pubkey").alias("account_pubkey"),
        plain_base64(F.col("data")).alias("data_base64"),
        F.col("executable"),
        F.col("filters"),
        F.col("idl_name"),
        F.try_parse_json("idl_version").alias("idl_version"),
        F.col("lamports"),
        F.col("owner"),
        F.col("rent_epoch"),
        F.col("write_version"),
    )
    return known.select(
        account_event_id(F.col("slot"), F.col("pubkey")).alias("event_id"),
        F.lit("account").alias("event_type"),
        F.col("owner").alias("program_id"),
        "slot",
        "signature",
        partition_key(F.col("signature"), F.col("pubkey")).alias("partition_key"),
        "source_endpoint",
        "observed_at_unix_ms",
        F.to_json(payload, _JSON).alias("payload"),
    )


def event_log_rows(events: DataFrame) -> DataFrame:
    """Normalised events in the shape of the event log; no signature becomes ''."""
    return events.select(
        F.timestamp_millis("observed_at_unix_ms").cast("timestamp_ntz").alias("timestamp"),
        "event_id",
        "event_type",
        "program_id",
        "slot",
        F.coalesce("signature", F.lit("")).alias("signature"),
        "payload",
    )


def record_parts(columns: list[str]) -> tuple[Column, Column]:
    """Key and value of the record that publishes an event of these columns."""
    key = F.coalesce(F.nullif(F.col("partition_key"), F.lit("")), F.col("program_id"))
    return key, F.to_json(F.struct(*columns), _JSON)


def topic_records(events: DataFrame) -> DataFrame:
    """Key and value of the published record."""
    key, value = record_parts(events.columns)
    return events.select(key.alias("key"), value.alias("value"))


def channel_records(events: DataFrame, prefix: str) -> DataFrame:
    """Every event on the channel of its type and on the channel of all types."""
    kinds = F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("kind")
    return events.select("*", kinds).select(
        F.concat_ws(":", F.lit(prefix), "program_id", "kind").alias("channel"), *events.columns
    )
