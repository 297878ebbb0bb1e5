"""Language-model scores from a weighted backoff automaton.

States are contexts: a word seen in training, the start of a text, and the empty context at the
root. A state's arcs are the words seen after it; any other word takes the failure arc,
which costs the state's backoff weight and goes on at the root, where every word has an
arc. One pass over a text from left to right carries the state and adds up the log10 weights.
Weights are Dirichlet-smoothed bigrams over add-one unigrams:

    p(w | h) = (c(h w) + m p(w)) / (c(h) + m),   p(w) = (c(w) + 1) / (N + V + 1)

so each state's arcs and failure arc sum to one over the V known words and one unknown. m is
the value of GRID with the best leave-one-out likelihood of the training texts.

The automaton grows with the corpus, so no task holds all of it. Texts are kept in blocks of
about BLOCK tokens; a block sends its distinct words and word pairs, with their counts in
its training texts, to buckets of the key space, and gets back the totals where these differ
from its own. It then builds the part of the automaton its own texts can reach. Keys are 64-bit
hashes of words (xxh64) and pairs; two of 10^9 distinct words share one with a chance
below 3 %. Hot words reach a bucket once for each block, not once for each use.

Words are what ASCII white space separates, A-Z in lower case, and each text ends with an
end token. Null texts are empty and hold that token alone. Repeated rows count and score
each. Rows without doc_id are training rows. Without any training row all scores are
those of add-one counts of nothing: zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, in_pieces, query, raw_texts, stored, table, texts

FOLDS, HELD_FOLD = 7, 2
BLOCK, BUCKET = 1 << 20, 1 << 21
GRID = (1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0)
START, END_HASH = np.uint64(0x51_7C_C1_B7_27_22_0A_95), np.uint64(0x2545F4914F6CDD1D)
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Local(dict):
    """Words of one block, numbered from 1 as they come; 0 is the end token."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self) + 1
        return at


def squeezed(a: np.ndarray) -> bytes:
    """Numbers as bytes of equal place side by side, which the shuffle's codec shrinks."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def spread(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def hashed_pairs(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h * MIX_A) ^ ((w + MIX_A) * MIX_B)
    x ^= x >> np.uint64(32)
    return x * MIX_A


BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
    ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("ids", pa.binary()), ("n", pa.int64()),
])
BLOCKS_DDL = "block long, doc_ids array<long>, held_out array<boolean>, lengths array<int>, words binary, ids binary, n long"


def blocks(docs: DataFrame) -> DataFrame:
    """Texts as numbers of their block's words, about BLOCK tokens a row or one text."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_FOLD, F.lit(False))

    def run(batches):
        first = TaskContext.get().partitionId() << 32

        def rows():
            number, tokens = first, 0
            local, docs_held, ids = Local(), [], []

            def closed():
                hashes = np.array([END_HASH, *map(xxhash.xxh64_intdigest, local)], np.uint64)
                lengths = [len(i) for i in ids]
                return (
                    number, [d for d, _ in docs_held], [h for _, h in docs_held], lengths, hashes.tobytes(),
                    np.concatenate(ids).tobytes(), tokens,
                )

            for batch in batches:
                for doc, is_held, text in zip(cells(batch, "doc_id"), cells(batch, "held_out"), raw_texts(batch)):
                    words = text.lower().split()
                    ids.append(np.zeros(len(words) + 1, "<u4"))
                    ids[-1][:-1] = np.fromiter(map(local.__getitem__, words), np.uint32, len(words))
                    docs_held.append((doc, is_held))
                    tokens += len(words) + 1
                    if tokens >= BLOCK:
                        yield closed()
                        number, tokens = number + 1, 0
                        local, docs_held, ids = Local(), [], []
            if docs_held:
                yield closed()

        yield from in_pieces(rows(), BLOCKS, 1)

    return texts(docs).withColumn("held_out", held).select("doc_id", "held_out", "text").mapInArrow(run, BLOCKS_DDL)


class Block:
    """A block's tokens, its distinct words and pairs in key order, and their own training counts."""

    def __init__(self, row: dict):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held_out"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        words = np.frombuffer(row["words"], "<u8")
        self.ids = np.frombuffer(row["ids"], "<u4").astype(np.int64)
        self.size = len(words)  # as a context: the start of a text; size + 1: the root
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        context = np.concatenate([[0], self.ids[:-1]])
        context[self.starts] = self.size
        codes = context * (self.size + 2) + self.ids
        train = np.repeat(~self.held, self.lengths)
        self.codes, place = np.unique(codes, return_inverse=True)
        own = np.bincount(place[train], minlength=len(self.codes))
        h, w = np.divmod(self.codes, self.size + 2)
        keys = hashed_pairs(np.append(words, START)[h], words[w])
        self.order = {1: np.argsort(words), 2: np.argsort(keys)}
        self.keys = {1: words[self.order[1]], 2: keys[self.order[2]]}
        self.own = {1: np.bincount(self.ids[train], minlength=self.size)[self.order[1]], 2: own[self.order[2]]}

    def parts(self, order: int, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin, and the end."""
        high = (self.keys[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(high.astype(np.int64), np.arange(buckets + 1))

    def totals(self, order: int, buckets: int, rows: list[dict]) -> np.ndarray:
        """Counts over all blocks, back in the order of words or codes."""
        total, cuts = self.own[order].astype(np.int64), self.parts(order, buckets)
        for r in rows:
            if r["order"] == order and r["places"]:
                places = np.cumsum(spread(r["places"])).astype(np.int64)
                total[cuts[r["bucket"]] + places] = spread(r["totals"])
        out = np.empty_like(total)
        out[self.order[order]] = total
        return out


def sent(rows: DataFrame, buckets: int) -> DataFrame:
    """Each block's words and pairs with their own counts, by bucket of the key space."""
    schema = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        def out():
            for batch in batches:
                for row in batch.to_pylist():
                    b = Block(row)
                    for order in (1, 2):
                        cuts = b.parts(order, buckets)
                        for k in np.flatnonzero(np.diff(cuts)):
                            keys, own = (x[cuts[k]:cuts[k + 1]] for x in (b.keys[order], b.own[order]))
                            yield order, k, row["block"], squeezed(np.diff(keys, prepend=np.uint64(0))), squeezed(own)

        yield from in_pieces(out(), schema, 64)

    return rows.mapInArrow(run, "order int, bucket int, block long, keys binary, counts binary")


TOTALS = "order int, bucket int, block long, places binary, totals binary, tokens long, types long"


def summed(parts: DataFrame) -> DataFrame:
    """For each block and bucket the places and totals that differ from the block's own; and a row
    without block with the bucket's training tokens and types."""
    schema = pa.schema([
        ("order", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("places", pa.binary()),
        ("totals", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()),
    ])

    def run(t: pa.Table) -> pa.Table:
        own_keys = [np.cumsum(spread(k), dtype=np.uint64) for k in t["keys"].to_pylist()]
        counts = np.concatenate([spread(c) for c in t["counts"].to_pylist()]).astype(np.int64)
        keys = np.concatenate(own_keys)
        order = np.argsort(keys)
        first = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0])
        total = np.add.reduceat(counts[order], first)
        each = np.empty(len(keys), np.int64)
        each[order] = np.repeat(total, np.diff(np.r_[first, len(keys)]))
        name = {c: t[c][0].as_py() for c in ("order", "bucket")}
        rows = [(*name.values(), None, b"", b"", int(total.sum()), int((total > 0).sum()))]
        at = 0
        for block, k in zip(t["block"].to_pylist(), own_keys):
            mine = each[at:at + len(k)]
            differ = np.flatnonzero(mine != counts[at:at + len(k)])
            at += len(k)
            if len(differ):
                rows.append((*name.values(), block, squeezed(np.diff(differ, prepend=0)), squeezed(mine[differ]), 0, 0))
        return pa.Table.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)

    return parts.groupBy("order", "bucket").applyInArrow(run, TOTALS)


class Automaton:
    """The part of the backoff automaton that a block's texts can reach, for every value of GRID."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, tokens: int, types: int):
        grid = np.array(GRID)
        self.codes, self.width, self.root = block.codes, block.size + 2, block.size + 1
        h, w = np.divmod(block.codes, self.width)
        seen = np.append(words, words[0])[:, None]  # a text starts as often as one ends
        self.arc_seen = pairs > 0
        self.state_seen = np.append(seen[:, 0] > 0, False)
        p = (words + 1) / (tokens + types + 1)
        self.root_arc = np.log10(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.arc = np.log10((pairs[:, None] + grid * p[w][:, None]) / (seen[h] + grid))
            self.failure = np.vstack([np.log10(grid / (seen + grid)), np.zeros(len(grid))])
            # Leave one out: each training token is scored without itself.
            p1 = np.maximum(words, 1) / max(1, tokens + types)
            left = np.log10((pairs[:, None] - 1 + grid * p1[w][:, None]) / (seen[h] - 1 + grid))
        own = np.empty(len(pairs))
        own[block.order[2]] = block.own[2]
        self.left_out = np.where(own[:, None] > 0, own[:, None] * left, 0).sum(0)

    def scores(self, block: Block) -> np.ndarray:
        """Sums for each text and value of GRID: all texts of the block go on one token a step."""
        order = np.argsort(-block.lengths, kind="stable")
        starts, lengths = block.starts[order], block.lengths[order]
        out = np.zeros((len(order), len(GRID)))
        state = np.where(self.state_seen[block.size], np.full(len(order), block.size), self.root)
        active = len(order)
        for step in range(int(lengths[0]) if len(order) else 0):
            while lengths[active - 1] <= step:
                active -= 1
            s, w = state[:active], block.ids[starts[:active] + step]
            code = s * self.width + w
            arc = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            has = self.arc_seen[arc] & (self.codes[arc] == code)
            out[:active] += np.where(has[:, None], self.arc[arc], self.failure[s] + self.root_arc[w][:, None])
            state[:active] = np.where(self.state_seen[w], w, self.root)
        back = np.empty_like(out)
        back[order] = out
        return back


SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("scores", pa.list_(pa.float64())), ("left_out", pa.list_(pa.float64())),
])
SCORED_DDL = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"
)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text."""
    spark = docs.sparkSession
    kept = stored(blocks(docs), "lm-blocks")
    buckets = 1 + (kept.agg(F.sum("n")).first()[0] or 0) // BUCKET
    back = stored(summed(sent(kept, buckets)), "lm-totals")
    tokens, types = back.where("block is null and `order` = 1").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))
    ).first()

    def run(block_rows: pa.Table, total_rows: pa.Table) -> pa.Table:
        rows = total_rows.to_pylist()
        out = {n: [] for n in SCORED.names}
        for row in block_rows.to_pylist():
            b = Block(row)
            words, pairs = (b.totals(order, buckets, rows) for order in (1, 2))
            machine = Automaton(b, words, pairs, tokens, types)
            token_sums = lambda x: np.add.reduceat(x[b.ids], b.starts)
            out["doc_id"] += b.doc_ids
            out["held_out"] += b.held.tolist()
            out["n_tokens"] += b.lengths.tolist()
            out["n_known"] += token_sums((words > 0).astype(np.int64)).tolist()
            out["base_score"] += token_sums(machine.root_arc).tolist()
            out["scores"] += machine.scores(b).tolist()
            out["left_out"] += [machine.left_out.tolist()] + [None] * (len(b.doc_ids) - 1)
        return pa.Table.from_pydict(out, schema=SCORED)

    totals = back.where("block is not null")
    rows = stored(kept.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, SCORED_DDL), "lm-scores")
    sums = rows.agg(*(F.sum(F.col("left_out")[i]) for i in range(len(GRID)))).first()
    best = max(range(len(GRID)), key=lambda i: (sums[i] if sums[i] is not None else 0.0, -i))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score",
        F.col("scores")[best].alias("score"), F.lit(GRID[best]).alias("smoothing"),
    )


@query("op3_backoff_automaton")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
