"""Periodic run detection: scale-tiled distribution.

A run is a stretch of consecutive words in which words ``period`` apart are equal, with that as its
smallest period, that no neighbouring word extends, and that holds at least EXPONENT periods and
LEAST words. Word i *matches* at period q if it equals word i + q; a run is a maximal
stretch of matching words, 3 q long or more.

Periods are taken by octave, P to 2 P - 1. Boundaries stand 3 P words apart, so every run of the octave
has one in it with 1.5 P matching words to its left or to its right. Per octave a
document is exploded into tiles: some boundaries, with 3 P words before the first and 5 P after
the last, so tiles overlap. Only tiles with a boundary where a few words to one side match at some
period are sent on, dealt to all tasks by tile, so one long document is the work of many. A
tile is solved by itself: a Z-function forwards and one backwards from each boundary tell for every
period of the octave how far words match within 3 P; the forward one also tells which periods
are multiples of a shorter one. Fragments that touch are put together inside the tile and
travel, few numbers each, by document and period, where they are stitched to whole runs.

Rows of equal doc_id and text are one document to the shuffles (their tiles are the same, so stitching
changes nothing) and each gets the result. A null text is empty, a null doc_id is an id of its own.
Ties cannot occur among runs: two runs differ in start or in period. Texts are used whole,
memory is linear in the longest one. Only ``doc_id`` and ``text`` are read, so other columns may have any
name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cells, query, raw_texts, record, sized_pieces, stored, table, texts

EXPONENT, LEAST = 4, 6
#: Words of a tile besides its overlap, where octaves leave room.
CORE = 3072
#: Words next to a boundary that are compared before a tile is sent on.
PROBES = 8
#: Documents are probed together up to so many words, and as many pairs of a boundary and a period.
BLOCK = PART = 1 << 18
#: Tiles that a task solves.
TASK_BYTES = 2 << 20
SPACES = r"[\x20\x09-\x0D]+"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def probed(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: int) -> np.ndarray:
    """Boundaries next to which words match at some period of the octave, of all documents that lie
    one behind the other in ids; a superset of the boundaries in runs."""
    long = ends - starts >= max(EXPONENT * p, LEAST)
    starts, ends = starts[long], ends[long]
    each = -(-(ends - starts - p) // (3 * p))
    owner = np.repeat(np.arange(len(each)), each)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    bounds, low, high = starts[owner] + 3 * p * place, starts[owner], ends[owner]
    periods = np.arange(p, 2 * p)
    reach = min(-(-3 * p // 2), PROBES)
    out = []
    # The table of boundaries and periods is a third of the words large; it is taken in parts of bounded size.
    for at in range(0, len(bounds), max(1, PART // p)):
        part = bounds[at:at + max(1, PART // p)]
        i, j = np.nonzero(ids[part][:, None] == ids[np.minimum(part[:, None] + periods, len(ids) - 1)])
        c, q = part[i], periods[j]
        first, last = low[at:][i], high[at:][i]
        right = left = c + q < last
        for step in range(1, reach + 1):
            live = right | left
            if not live.all():
                c, q, first, last, right, left = (x[live] for x in (c, q, first, last, right, left))
            if step < reach:
                right = right & (c + q + step < last)
                right[right] = ids[c[right] + step] == ids[c[right] + q[right] + step]
            left = left & (c - step >= first)
            left[left] = ids[c[left] - step] == ids[c[left] + q[left] - step]
        out.append(c[right | left])
    return np.unique(np.concatenate(out)) if out else bounds


def tiles(ids: np.ndarray, sizes: list[int]):
    """(document, octave, first word, boundaries, words) of the tiles worth solving, of documents of the given sizes
    one behind the other; boundaries count from the tile's first word."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    p = 1
    while sizes and max(EXPONENT * p, LEAST) <= max(sizes):
        at = probed(ids, starts, ends, p)
        if len(at):
            core = 3 * p * max(1, CORE // (3 * p))
            doc = np.searchsorted(ends, at, "right")
            tile = (at - starts[doc]) // core
            for group in np.split(np.arange(len(at)), np.flatnonzero((np.diff(tile) != 0) | (np.diff(doc) != 0)) + 1):
                d = int(doc[group[0]])
                first = max(int(starts[d]), int(at[group[0]]) - 3 * p)
                last = min(int(ends[d]), int(at[group[-1]]) + 5 * p)
                yield d, p, first - int(starts[d]), at[group] - first, ids[first:last]
        p *= 2


def z_function(s: list[int]) -> list[int]:
    """For every place how many words from there on equal those at the start."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def boundary_fragments(ids: np.ndarray, p: int, c: int) -> list[tuple[int, int, int, bool]]:
    """(period, start, end, own) of the matching words around boundary c, 3 p at most to either side, that belong
    to a stretch of 3 p or more; own if no smaller period is behind it. One that is not own stands for all."""
    n = len(ids)
    highest = min(2 * p - 1, n - 1 - c)
    if highest < p:
        return []
    ahead = ids[c:c + 3 * p + highest]
    forward = np.array(z_function(ahead.tolist()))
    periods = np.arange(p, highest + 1)
    right = np.minimum(forward[p:highest + 1], 3 * p)
    # Backwards: the words before c, reversed, against the words before c + q, reversed.
    low = max(0, c - 3 * p)
    pattern = ids[low:c][::-1]
    behind = np.concatenate([pattern, [-1], ids[low:c + highest][::-1]])
    backward = np.array(z_function(behind.tolist())) if len(pattern) else np.zeros(len(behind), np.int64)
    left = np.minimum(backward[len(pattern) + 1 + highest - periods], 3 * p)
    kept = (right > 0) & (left + right >= 3 * p)
    if not kept.any():
        return []
    # Smallest period of the first q words from c on: the first whose matches reach q.
    reached = np.maximum.accumulate(np.arange(len(forward)) + forward * (np.arange(len(forward)) > 0))
    q = periods[kept]
    smallest = np.searchsorted(reached, q)
    own = (smallest >= q) | (q % np.maximum(smallest, 1) != 0)
    listed = own.copy()
    listed[np.argmin(own)] = True
    return list(zip(*(x[listed].tolist() for x in (q, c - left[kept], c + right[kept], own))))


def matching(ids: np.ndarray, q: int, at: int) -> int:
    """The first place from ``at`` on whose word differs from the one q later, within the tile."""
    size = 64
    while at + q < len(ids):
        same = ids[at:min(at + size, len(ids) - q)] == ids[at + q:at + q + size]
        if not same.all():
            return at + int(np.argmin(same))
        at, size = at + len(same), size * 2
    return at


def solved(ids: np.ndarray, p: int, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Fragments of a tile, those that touch as one.

    A fragment is followed to the right to its end or the tile's. A run shares fewer than 4 p words with
    any other stretch that has a period of its octave, so a boundary that deep inside one is passed over.
    """
    found: list[tuple[int, int, int]] = []
    deep = -1
    for c in bounds.tolist():
        if c < deep:
            continue
        for q, a, b, own in boundary_fragments(ids, p, c):
            if b == c + 3 * p:
                b = matching(ids, q, b)
            if own:
                found.append((q, a, b))
            if c - a >= 3 * p:  # the next boundary lies 4 p inside at least
                deep = max(deep, b - 4 * p + 1)
    out: list[list[int]] = []
    for q, a, b in sorted(found):
        if out and out[-1][0] == q and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([q, a, b])
    return [tuple(x) for x in out]


# ---- Spark

SPLIT = pa.schema([
    ("doc_id", pa.int64()), ("print", pa.int64()), ("n_words", pa.int64()), ("words_sha256", pa.string()), ("words", pa.string()),
    ("octave", pa.int64()), ("first", pa.int64()), ("bounds", pa.binary()), ("ids", pa.binary()),
])
SPLIT_DDL = (
    "doc_id long, print long, n_words long, words_sha256 string, words string, octave long, first long, bounds binary, ids binary"
)
FRAGMENT = pa.schema([(c, pa.int64()) for c in ("doc_id", "print", "period", "start", "stop")])
KEY = ("doc_id", "print")


def split(docs: DataFrame) -> DataFrame:
    """A row for each document, and one for each of its tiles worth solving (with an octave). The words, joined by
    one space, are kept of documents with tiles alone, and the digest of the joined words of all."""

    def blocks(batches):
        """Documents with their words, about BLOCK words together; a longer document alone."""
        held, size = [], 0
        for batch in batches:
            for doc, mark, text in zip(cells(batch, "doc_id"), cells(batch, "print"), raw_texts(batch)):
                words = text.split()
                if held and size + len(words) > BLOCK:
                    yield held
                    held, size = [], 0
                held.append((doc, mark, words))
                size += len(words)
        if held:
            yield held

    def run(batches):
        def rows():
            for block in blocks(batches):
                ids = numbered([w for _, _, words in block for w in words])
                suspects = set()
                for d, p, first, bounds, part in tiles(ids, [len(words) for _, _, words in block]):
                    suspects.add(d)
                    yield *block[d][:2], None, None, None, p, first, bounds.astype("<i4").tobytes(), part.tobytes()
                for d, (doc, mark, words) in enumerate(block):
                    joined = b" ".join(words)
                    yield doc, mark, len(words), hashlib.sha256(joined).hexdigest(), joined if d in suspects else None, None, None, None, None

        yield from sized_pieces(rows(), SPLIT)

    return texts(docs).withColumn("print", F.xxhash64("text")).mapInArrow(run, SPLIT_DDL)


def fragments(tile_rows: DataFrame) -> DataFrame:
    """Matching stretches of each tile, as places in the document."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, mark, p, first, bounds, ids in zip(*(cells(batch, n) for n in ("doc_id", "print", "octave", "first", "bounds", "ids"))):
                found = solved(np.frombuffer(ids, np.int32), p, np.frombuffer(bounds, "<i4"))
                out += [(doc, mark, q, first + a, first + b) for q, a, b in found]
            if out:
                yield record(FRAGMENT, dict(zip(FRAGMENT.names, zip(*out))))

    # As many tasks as the tiles' bytes ask for, and one a core: they are small for the work they are, so sizes of partitions mislead.
    size = tile_rows.agg(F.sum(F.octet_length("ids") + F.octet_length("bounds"))).first()[0] or 0
    tasks = max(tile_rows.sparkSession.sparkContext.defaultParallelism, 1 + size // TASK_BYTES)
    dealt = tile_rows.select(*KEY, "octave", "first", "bounds", "ids").repartition(tasks, *KEY, "octave", "first")
    return dealt.mapInArrow(run, "doc_id long, print long, period long, start long, stop long")


def stitched(found: DataFrame) -> DataFrame:
    """(doc_id, print, start, length, period) of whole runs: fragments of one document and period that touch are one."""
    by_start = W.partitionBy(*KEY, "period").orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opened = found.withColumn("opens", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    run = F.sum("opens").over(by_start.rowsBetween(W.unboundedPreceding, 0))
    whole = opened.withColumn("run", run).groupBy(*KEY, "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    whole = whole.withColumn("length", length).where(F.col("length") >= F.greatest(F.lit(LEAST), EXPONENT * F.col("period")))
    return whole.select(*KEY, "start", "length", "period")


RUN_DDL = "array<struct<start:long,length:long,period:long>>"
RESULT_DDL = f"doc_id long, n_words long, runs {RUN_DDL}, words_sha256 string, collapsed string"


def runs(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (by start, then period), words_sha256 (of the words joined by one
    space) and collapsed (the words left when every run keeps its first period alone; null without a run)."""
    made = stored(split(docs), "period-tiles")
    found = stitched(fragments(made.where("octave IS NOT NULL")))
    listed = found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    rows = made.where("octave IS NULL").select(*KEY, "n_words", "words_sha256", "words")
    empty = F.array().cast(RUN_DDL)
    # Documents without a tile are done; the others, with their words, meet their runs.
    done = rows.where("words IS NULL").select("doc_id", "n_words", empty.alias("runs"), "words_sha256", F.lit(None).cast("string").alias("collapsed"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.print") == F.col("r.print"))
    waiting = rows.where("words IS NOT NULL").alias("l").join(listed.alias("r"), same, "left")
    waiting = waiting.select("l.doc_id", "n_words", F.coalesce("runs", empty).alias("runs"), "words_sha256", F.col("words").alias("collapsed"))
    return done.unionByName(waiting.mapInArrow(collapsed_words, RESULT_DDL))


def kept_words(words: list, spans: list) -> list:
    """Words that no run holds after its first period; spans are (start, length, period)."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in spans:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def collapsed_words(batches):
    """The last column, a document's words, gives way to the words left; null without a run."""
    for batch in batches:
        out = []
        for found, words in zip(cells(batch, "runs"), raw_texts(batch, "collapsed")):
            spans = [(r["start"], r["length"], r["period"]) for r in found]
            out.append(b" ".join(kept_words(words.split(b" "), spans)) if spans else None)
        left = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], left], names=batch.schema.names)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents of which the crc32 of a tenth of the ids makes the tail repeat with some period (the contract's rule)."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SPACES), lambda w: w != "")
    size = F.size(words).cast("long")
    g, n = F.floor(h / 10), F.greatest(size, F.lit(1))
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # Whole slices: a lambda over the places would split the text anew for each word.
    head, block = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.concat(head, F.flatten(F.array_repeat(block, times))), F.lit(1), n.cast("int"))
    text = F.when(h % 10 == 0, F.when(size > 0, F.array_join(tail, " "))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runs(repeated_tails(table(spark, sf_dir, "documents")))

    def longer(a: Column, b: Column) -> Column:
        """By exact length / period, largest first, then by start and period (the order they are in)."""
        gain = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when(gain != 0, F.signum(gain.cast("double"))).otherwise(
            F.signum((a["start"] - b["start"]).cast("double")) * 2 + F.signum((a["period"] - b["period"]).cast("double"))
        ).cast("int")

    best = F.get(F.array_sort("runs", longer), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    made = made.withColumn("best", best)
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.coalesce(F.sha2("collapsed", 256), F.col("words_sha256")).alias("collapsed_sha256"),
    )
