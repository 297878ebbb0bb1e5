"""Matching events with delivery routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signing import request_signature
from ..session import fits_broadcast

_TARGET = ("route_id", "url", "program_id_filter", "event_type_filter", "source")
# A key that accepts everything, and the mark in front of a given value; so a value "*" is only itself.
_ANY, _GIVEN = "*", "="
# Routes without any filter beyond the broadcast limit: how many go together, and over how many keys events spread.
WILD_SLICE, SALTS = 1024, 64


def route_matches(program_filter: Column, type_filter: Column, program: Column, kind: Column) -> Column:
    """A missing filter accepts everything; both filters must hold."""
    return (program_filter.isNull() | (program_filter == program)) & (
        type_filter.isNull() | (type_filter == kind)
    )


def _key(filter_value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(_GIVEN), filter_value), F.lit(_ANY))


def _targets(routes: DataFrame) -> DataFrame:
    # Ordered by url, then by route: equal urls stand together and the lowest route comes first.
    return routes.select(
        _key(F.col("program_id")).alias("program_key"),
        _key(F.col("event_type")).alias("type_key"),
        F.struct(
            F.col("url"),
            F.col("route_id").cast("bigint").alias("ord"),
            F.col("route_id").cast("string").alias("route_id"),
            F.coalesce("program_id", F.lit("*")).alias("program_id_filter"),
            F.coalesce("event_type", F.lit("*")).alias("event_type_filter"),
            F.lit("registry").alias("source"),
        ).alias("target"),
    )


def _static_target(url: str) -> Column:
    return F.struct(
        F.lit(url).alias("url"),
        F.lit(2**63 - 1).cast("bigint").alias("ord"),
        F.lit("static-env").alias("route_id"),
        F.lit("*").alias("program_id_filter"),
        F.lit("*").alias("event_type_filter"),
        F.lit("env").alias("source"),
    )


def _first_of_url(sorted_targets: Column) -> Column:
    return F.filter(sorted_targets, lambda t, i: (i == 0) | (F.get(sorted_targets, i - 1)["url"] != t["url"]))


def matched_routes(
    events: DataFrame,
    routes: DataFrame,
    static_url: str | None = None,
    unique_urls: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Events joined with every route that accepts them.

    With ``static_url`` one more target accepts every event. With ``unique_urls`` an
    event row reaches each url once: the lowest route id wins and the static target
    comes last. A redelivered event is a row of its own. An event without program or
    type only meets routes without that filter.

    A route can only be found under four keys of an event: its program or any, with
    its type or any. Routes of one key travel as one array, unique per url beforehand
    where asked, so the event row is never multiplied before its targets are known.
    Up to ``limit`` routes and the session's byte bound the table of keys is broadcast, and the
    routes without any filter are one value that a scalar subquery fetches. Beyond them
    the joins on keys shuffle, adaptive execution splits busy programs, and the routes without
    any filter meet the events in slices of WILD_SLICE. Both give the same rows.
    """
    fits = fits_broadcast(routes, limit)
    targets = _targets(routes)
    wild = targets.where((F.col("program_key") == _ANY) & (F.col("type_key") == _ANY))
    if unique_urls and not fits:
        lowest = wild.groupBy("target.url").agg(F.min("target.ord").alias("_wild"))
        of_url = targets.withColumn("_url", F.col("target.url")).join(
            lowest.withColumnRenamed("url", "_url").hint("merge"), "_url", "left"
        )
        # A route is beaten wherever it matches by a lower one of its url that accepts everything.
        targets = of_url.where(F.col("_wild").isNull() | (F.col("target.ord") <= F.col("_wild"))).drop("_url", "_wild")
        wild = wild.groupBy("target.url").agg(F.min("target").alias("target")).select("target")
    grouped = targets.groupBy("program_key", "type_key").agg(F.array_sort(F.collect_list("target")).alias("found"))
    if unique_urls:
        grouped = grouped.withColumn("found", _first_of_url(F.col("found")))
    none = F.array().cast(grouped.schema["found"].dataType)
    joined, hits = events, []
    # The empty piece of event_id keeps the key a column where all events have one type: a constant
    # would leave the join without a key.
    nothing = F.coalesce(F.left(F.col("event_id"), F.lit(0)), F.lit(""))
    program, kind = (F.concat(F.lit(_GIVEN), nothing, F.col(c)) for c in ("program_id", "event_type"))
    for i, (own_program, own_kind) in enumerate([(True, True), (True, False), (False, True)]):
        p, k, hit = f"_p{i}", f"_k{i}", f"_hit{i}"
        side = grouped.select(F.col("program_key").alias(p), F.col("type_key").alias(k), F.col("found").alias(hit))
        side = F.broadcast(side) if fits else side.hint("merge")
        same = (F.col(p) == (program if own_program else F.lit(_ANY))) & (F.col(k) == (kind if own_kind else F.lit(_ANY)))
        joined = joined.join(side, same, "left").drop(p, k)
        hits.append(F.coalesce(F.col(hit), none))
    if fits:
        free = grouped.where((F.col("program_key") == _ANY) & (F.col("type_key") == _ANY))
        joined = joined.withColumn("_hit3", free.select(F.max("found")).scalar())
        hits.append(F.coalesce("_hit3", none))
    every = F.concat(*hits)
    if static_url and (fits or not unique_urls or not wild.where(F.col("target.url") == static_url).take(1)):
        every = F.array_append(every, _static_target(static_url))
    if unique_urls:
        joined = joined.withColumn("_all", F.array_sort(every))
        every = _first_of_url(F.col("_all"))
    found = joined.select(*events.columns, every.alias("_found"))
    if not fits:
        found = found.unionByName(_with_free_routes(found, wild, unique_urls))
    found = found.select(*events.columns, F.explode("_found").alias("target"))
    return found.select(*events.columns, *[F.col(f"target.{c}").alias(c) for c in _TARGET])


def _with_free_routes(found: DataFrame, wild: DataFrame, unique_urls: bool) -> DataFrame:
    """Each event once for every slice of the routes that accept everything, with that slice's targets.

    Only their number comes to the driver. Slices and events are dealt by (slice, salt), so no task
    holds all events for one slice.
    """
    slices = -(-wild.count() // WILD_SLICE)
    if not slices:
        return found.where("false")
    cut = wild.withColumn("_slice", F.pmod(F.xxhash64("target.url", "target.ord"), F.lit(slices)))
    cut = cut.groupBy("_slice").agg(F.collect_list("target").alias("_free"))
    cut = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.withColumn("_salt", F.pmod(F.xxhash64(F.col("event_id")), F.lit(SALTS)).cast("int"))
    dealt = dealt.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    met = dealt.join(cut.hint("merge"), ["_slice", "_salt"])
    if unique_urls:
        own = F.transform("_found", lambda t: t["url"])
        kept = F.filter("_free", lambda t: ~F.array_contains(own, t["url"]))
        # The static target is the last of its url; it is left out beforehand where a free route has it.
    else:
        kept = F.col("_free")
    return met.withColumn("_found", kept).drop("_slice", "_salt", "_free")


def event_envelope(event: Column, context: str, timestamp_ms: Column) -> Column:
    """Body posted to a route."""
    return F.to_json(
        F.struct(
            F.lit(context).alias("agent_context"),
            F.struct(
                *[F.col(c) for c in ("event_type_filter", "program_id_filter", "route_id", "source")]
            ).alias("delivery_target"),
            event.alias("event"),
            timestamp_ms.alias("timestamp_ms"),
        ),
        {"ignoreNullFields": "false"},
    )


def event_outbox(
    matched: DataFrame, context: str, now_unix_s: int, secret: str, key_id: str, attempts: int
) -> DataFrame:
    """Signed deliveries of matched events, for a consumer to post."""
    event = F.struct(*[c for c in matched.columns if c not in _TARGET])
    nonce = F.sha2(F.concat_ws("|", "event_id", "route_id"), 256)
    body = event_envelope(event, context, F.lit(now_unix_s * 1000))
    return signed_rows(matched.withColumn("body", body).withColumn("nonce", nonce), now_unix_s, secret, key_id, attempts)


def signed_rows(rows: DataFrame, now_unix_s: int, secret: str, key_id: str, attempts) -> DataFrame:
    sent_at = F.lit(str(now_unix_s))
    return rows.withColumn("sent_at", sent_at).withColumn(
        "signature",
        F.concat(F.lit("v1="), request_signature(secret, sent_at, F.col("nonce"), F.col("body"))),
    ).withColumn("key_id", F.lit(key_id)).withColumn(
        "max_attempts", attempts if isinstance(attempts, Column) else F.lit(attempts)
    )
