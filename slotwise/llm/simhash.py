"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most d bits differ in at most d of their eight
bytes, so they share at least 8 - d positional bytes: 4 at the default of 4 bits. A posting
list holds the distinct fingerprints that share a given set of KEY_BYTES positional bytes;
any pair with the guaranteed number of matches meets in at least one list made of the first
7 positions (it shares 3 of any 7). Inside a list the positional bytes a pair shares are
tallied, pairs that reach the guaranteed minimum stay, and their bits are compared.

A list never turns into all its pairs: rows compare with those after them only within
short lists, and a long list is searched from one member at a time, each search removing
what it links, so a list of near copies shrinks at once and its output is one link for each
member. Equal fingerprints meet before the index. Links become components by
alternating large-star and small-star steps, each written to the shared folder.

Null texts are empty; texts without words have fingerprint zero and link like any other.
Repeated rows share a fingerprint and so a component. Rows without doc_id keep their
fingerprint; they lend no component id, so a component of such rows alone has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, partitions, query, raw_texts, record, stored, table, texts, unused

SHINGLE, MAX_BITS, SEED = 4, 4, 42
POSITIONS, KEY_BYTES = 7, 3
SHORT = 48
BYTE_SUMS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.uint8)


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """SimHash of a text in UTF-8: words in lower case (A-Z only), overlapping shingles."""
    parts = text.lower().split()
    if not parts:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hash_of(b" ".join(parts), SEED)
    joined, ends, at = b" ".join(parts), [], 0
    for p in parts:
        at += len(p)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:])], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in raw_texts(batch)], np.uint64).view(np.int64)
            yield record(schema, {"doc_id": cells(batch, "doc_id"), "print": prints})

    return texts(docs).mapInArrow(run, "doc_id long, print long")


def shared_bytes(a, b) -> np.ndarray:
    """How many of the eight positional bytes are equal."""
    return (np.bitwise_xor(a, b).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def linked(a, b, bits: int) -> np.ndarray:
    """Count filter, then the bits of the pairs that pass it."""
    out = shared_bytes(a, b) >= 8 - bits
    # Of a signed number it would count the absolute value's bits.
    out[out] = np.bitwise_count(np.bitwise_xor(a[out], b[out]).view(np.uint64)) <= bits
    return out


def links_of(members: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected in one list. Each search from a member takes the
    members it links out of the rest."""
    rest, open_ = members, []
    while len(rest) or open_:
        if open_:
            seed = open_.pop()
        else:
            seed, rest = rest[0], rest[1:]
        if not len(rest):
            continue
        hit = linked(np.full(len(rest), seed), rest, bits)
        if hit.any():
            yield np.full(int(hit.sum()), seed), rest[hit]
            open_.extend(rest[hit])
            rest = rest[~hit]


def posting_keys(bits: int) -> list[tuple[int, ...]]:
    if bits != MAX_BITS:
        least = 8 - bits
        if least < 1:
            raise ValueError("at most 7 bits")
        return list(combinations(range(8), min(least, 4)))
    return list(combinations(range(POSITIONS), KEY_BYTES))


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints: all of a component's members are connected."""
    spark = prints.sparkSession
    sets = posting_keys(bits)
    width = len(sets[0])
    posting = pa.schema([("key", pa.int64()), ("print", pa.int64())])
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def post(batches):
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False)
            octets = p.view(np.uint8).reshape(-1, 8).astype(np.int64)
            for number, positions in enumerate(sets):
                key = np.full(len(p), number, np.int64)
                for i in positions:
                    key = key << 8 | octets[:, i]
                yield record(posting, {"key": key, "print": p})

    def match(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key, p = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort([p, key])
        key, p = key[order], p[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        length = np.diff(cuts)
        short = np.repeat((length > 1) & (length <= SHORT), length)
        k, q = key[short], p[short]
        for step in range(1, SHORT):
            same = np.flatnonzero(k[step:] == k[:-step])
            if not len(same):
                break
            a, b = q[same], q[same + step]
            hit = linked(a, b, bits)
            if hit.any():
                yield record(pair, {"a": a[hit], "b": b[hit]})
        for i in np.flatnonzero(length > SHORT):
            for a, b in links_of(p[cuts[i]:cuts[i + 1]], bits):
                yield record(pair, {"a": np.minimum(a, b), "b": np.maximum(a, b)})

    postings = prints.select("print").mapInArrow(post, "key long, print long")
    # A partition is a share of the index, held in two arrays of 8 bytes a posting.
    dealt = postings.repartition(partitions(spark, 2), "key")
    return dealt.mapInArrow(match, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes with links.

    ``edges`` (a, b). Large-star links a node's larger neighbours to the smallest of its
    neighbourhood, small-star its smaller ones; both keep components and shorten paths.
    """
    def smallest(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return sym.join(low, "u")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(current)
    while seen[0]:
        both = current.selectExpr("a u", "b v").union(current.selectExpr("b u", "a v"))
        large = smallest(both).where("v > u").selectExpr("v a", "m b").distinct()
        down = large.selectExpr("a u", "b v")
        small = smallest(down)
        small = small.selectExpr("v a", "m b").union(small.selectExpr("u a", "m b")).where("a <> b").distinct()
        current = stored(small, "links")
        now = state(current)
        if now == seen:
            break
        seen = now
    return current.selectExpr("a node", "b root").union(current.selectExpr("b node", "b root")).distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs, words), "prints")
    return with_components(prints, bits)


def with_components(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    return prints.join(classes(prints, bits), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def classes(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """print, root (one print that stands for the component), component_id."""
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    nodes = components(links(first.select("print"), bits))
    rooted = first.join(nodes.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = stored(rooted.select("print", "root", "first"), "prints-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("print", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each component: that of the
    smallest doc_id (any one of its rows where the doc_id repeats)."""
    mark = unused(docs, "print")

    @F.pandas_udf("long")
    def of(text):
        return text.map(lambda t: fingerprint((t or "").encode(), words)).astype("uint64").astype("int64")

    marked = stored(docs.withColumn(mark, of("text")), "documents-with-prints")
    prints = marked.select(F.col("doc_id").alias("doc_id"), F.col(mark).alias("print"))
    stands = prints.join(classes(prints, bits), "print").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # The smallest print where one doc_id has several in a component; ``rows`` over 1 only for repeated rows.
    stands = stands.groupBy("root", "component_id", "print").agg(F.count("*").alias("rows"))
    stands = stands.groupBy("root", "component_id").agg(F.min(F.struct("print", "rows")).alias("s"))
    keep = stored(stands.select(F.col("component_id").alias("_keep_id"), "s.print", "s.rows"), "kept")
    keep = keep.select("_keep_id", F.col("print").alias("_keep_print"), F.col("rows").alias("_keep_rows"))
    same = F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col(mark) == F.col("_keep_print"))
    # Nulls meet as equal, and the print spreads what one doc_id may hold.
    kept = marked.join(keep, same)
    once = kept.where("_keep_rows = 1").select(docs.columns)
    repeated = kept.where("_keep_rows > 1").dropDuplicates(["doc_id", mark]).select(docs.columns)
    return once.unionByName(repeated)


@query("op5_simhash_components")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
