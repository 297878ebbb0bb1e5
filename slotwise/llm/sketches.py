"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a line over STRETCH code points is taken in stretches of that length from
its start. A text's set is the digests of its paragraphs, each with its number among
equal ones. A sketch adds every digest to one cell in each of three parts: a count, the exclusive-or
of digests and of their check values. Subtracting the sketches of two versions cancels what
they share; cells with one digest left are peeled until all cells are empty, which
recovers the digests on either side. If peeling gets stuck the pair goes on with sketches of twice
the cells and other hash functions, until it ends. Likeness is twice the shared paragraphs
over the paragraphs of both (1 for two empty texts).

``fingerprint`` is the number of paragraphs and the smallest sketch in base64; equal
texts have equal ones. Sketches of many pairs are peeled together as arrays.

``edited_pairs`` puts each document beside the next one in ascending doc_id (null first, equal ids
by their text's hash): ranges of doc_id are sorted apart, and the first document of each
range is also sent to the range before it. Null texts are empty. Texts are used whole. Of
repeated rows each is the other's neighbour; a table of one row is its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, in_pieces, partitions, query, table, texts

STRETCH, FIRST_CELLS, PARTS, CHUNK = 64, 12, 3, 512
MIX = np.uint64(0xD6E8FEB86659FD93)


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        if len(line) <= STRETCH:
            if line:
                out.append(line)
        else:
            out += [line[i:i + STRETCH] for i in range(0, len(line), STRETCH)]
    return out


def digests(text: str) -> np.ndarray:
    """One 64-bit digest for each paragraph; equal paragraphs differ by their number."""
    seen: Counter = Counter()
    out = []
    for p in paragraphs(text):
        out.append(xxhash.xxh64_intdigest(p, seen[p]))
        seen[p] += 1
    return np.array(out, np.uint64)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * MIX
    x ^= x >> np.uint64(32)
    x *= MIX
    return x ^ (x >> np.uint64(29))


class Sketches:
    """Cells of many sketches at once; item i belongs to sketch ``owner[i]``."""

    def __init__(self, count: int, cells_each: int, rung: int):
        self.each, self.rung = cells_each, rung
        self.count = np.zeros(count * cells_each, np.int64)
        self.keys = np.zeros(count * cells_each, np.uint64)
        self.checks = np.zeros(count * cells_each, np.uint64)

    def places(self, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
        part = np.uint64(self.each // PARTS)
        at = [owner * self.each + i * int(part) + (mixed(key, 11 + PARTS * self.rung + i) % part).astype(np.int64) for i in range(PARTS)]
        return np.concatenate(at)

    def add(self, owner: np.ndarray, key: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Adds with sign 1, subtracts with -1; gives the cells that changed."""
        at, key3 = self.places(owner, key), np.tile(key, PARTS)
        np.add.at(self.count, at, np.tile(sign, PARTS))
        np.bitwise_xor.at(self.keys, at, key3)
        np.bitwise_xor.at(self.checks, at, mixed(key3, 5))
        return at

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of all that can be recovered; cells that stay filled are stuck."""
        found = []
        at = np.flatnonzero(self.count)
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            at = at[mixed(self.keys[at], 5) == self.checks[at]]
            owner, key, sign = at // self.each, self.keys[at], self.count[at]
            _, first = np.unique(np.stack([owner.astype(np.uint64), key]), axis=1, return_index=True)
            owner, key, sign = owner[first], key[first], sign[first]
            if not len(key):
                break
            found.append((owner, key, sign))
            at = np.unique(self.add(owner, key, -sign))
        if not found:
            return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(*found))

    def stuck(self) -> np.ndarray:
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return left.reshape(-1, self.each).any(1)


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.zeros(0, np.uint64), *sets])


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets what only the first and only the second holds, from their sketches."""
    out: list = [None] * len(a)
    waiting, size, rung = np.arange(len(a)), FIRST_CELLS, 0
    while len(waiting):
        sketch = Sketches(len(waiting), size, rung)
        for sets, sign in ((a, 1), (b, -1)):
            owner, key = flat([sets[i] for i in waiting])
            sketch.add(owner, key, np.full(len(key), sign))
        owner, key, sign = sketch.peel()
        order = np.argsort(owner, kind="stable")
        owner, key, sign = owner[order], key[order], sign[order]
        cuts = np.searchsorted(owner, np.arange(len(waiting) + 1))
        stuck = sketch.stuck()
        for i in np.flatnonzero(~stuck):
            k, s = key[cuts[i]:cuts[i + 1]], sign[cuts[i]:cuts[i + 1]]
            out[waiting[i]] = k[s > 0], k[s < 0]
        waiting, size, rung = waiting[stuck], size * 2, rung + 1
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    out = []
    for x, y, (only_x, only_y) in zip(a, b, differences(a, b)):
        both = len(x) + len(y)
        out.append((both - len(only_x) - len(only_y)) / both if both else 1.0)
    return out


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    sketch = Sketches(len(sets), FIRST_CELLS, 0)
    owner, key = flat(sets)
    sketch.add(owner, key, np.ones(len(key), np.int64))
    shape = (len(sets), FIRST_CELLS, 1)
    cells_ = np.concatenate([
        sketch.count.astype("<i4").reshape(shape).view(np.uint8), sketch.keys.astype("<u8").reshape(shape).view(np.uint8),
        sketch.checks.astype("<u4").reshape(shape).view(np.uint8),
    ], axis=2)
    return [f"{len(s)}:{base64.b64encode(c.tobytes()).decode()}" for s, c in zip(sets, cells_)]


def bucket_of(column, bounds: list, low: int = 0, high: int | None = None):
    """Number of bounds at or below the column's value, by a tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(column < bounds[middle], bucket_of(column, bounds, low, middle)).otherwise(bucket_of(column, bounds, middle + 1, high))


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
RESULT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, last, doc_id, text) sorted inside partitions that hold whole buckets; a bucket ends
    with the first document of the next one (of the first one, for the last), marked by ``last``."""
    spark = docs.sparkSession
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    n = partitions(spark, 4)
    bounds = sorted(set(rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)))
    bounds = [int(b) for b in bounds]
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket_of(F.col("doc_id"), bounds))
    rows = rows.withColumn("bucket", bucket)
    # One row for each bucket.
    firsts = sorted(
        rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h")).alias("f")).collect(),
        key=lambda r: r["bucket"],
    )
    before = [(r["f"]["doc_id"], r["f"]["h"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    ends = spark.createDataFrame(before, "f_id long, f_h long, to int")
    marked = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    own = F.struct("bucket", F.lit(0).alias("last"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("bucket"), F.lit(1).alias("last"))))
    placed = marked.select("doc_id", "text", "h", F.explode(places).alias("p")).select("p.bucket", "p.last", "doc_id", "h", "text")
    dealt = placed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "last", "doc_id", "h")
    return dealt.select("bucket", "last", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document: its and its edited text's fingerprint, and the likeness to the edited and the next text."""

    def neighbours(batches):
        held = None
        for batch in batches:
            for bucket, last, doc, text in zip(*(cells(batch, n) for n in ("bucket", "last", "doc_id", "text"))):
                if held is not None and held[0] == bucket:
                    yield held[1], held[2], text
                held = None if last else (bucket, doc, text)

    def compared(chunk):
        own = [digests(t) for _, t, _ in chunk]
        changed = [edited_text(t, n) for _, t, n in chunk]
        theirs, following = [digests(t) for t in changed], [digests(n) for _, _, n in chunk]
        near = likeness(own + own, theirs + following)
        shas = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
        sizes = [len(t) for _, t, _ in chunk]
        n = len(chunk)
        return zip((d for d, _, _ in chunk), sizes, shas, fingerprints(own), fingerprints(theirs), near[:n], near[n:])

    def run(batches):
        def rows():
            chunk = []
            for pair in neighbours(batches):
                chunk.append(pair)
                if len(chunk) == CHUNK:
                    yield from compared(chunk)
                    chunk = []
            if chunk:
                yield from compared(chunk)

        yield from in_pieces(rows(), RESULT)

    return in_order(docs).mapInArrow(run, RESULT_DDL)


@query("op7_invertible_sketches")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
