"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. An open
sequence takes, of all items that fit, the one whose size vector has the largest dot
product with the room left, both as shares of the limits. Items wait in a pool of
bounded size. ``pack_documents`` may cut items: when nothing fits, the longest item
is cut at the room left, so only the limits on segments and loss leave room unused.
``pack_examples`` never cuts, as an instruction example must stay whole.

Every partition packs its own rows in one pass and nothing is shuffled. What is left
in a partition's last sequence is dealt to sequences whose lengths are powers of two,
which need no padding.

Null texts are empty; an empty text is one piece with its end id only. Repeated rows
are packed one by one. An example larger than a limit is refused with an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import cells, in_pieces, query, raw_texts, table, texts
from .tokens import END, tokenizer_path, word_ids

SEQUENCE = 4096


@dataclass(frozen=True)
class Limits:
    tokens: int = SEQUENCE
    segments: int = 1024
    loss: int = SEQUENCE


class Pool:
    """Waiting items: size vectors in arrays, what they stand for in a list."""

    def __init__(self, limits: Limits, room: int):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.size = np.zeros((room, 3))
        self.what: list = []

    def add(self, tokens: int, loss: int, what) -> None:
        if len(self.what) == len(self.size):
            self.size = np.vstack([self.size, np.zeros_like(self.size)])
        self.size[len(self.what)] = (tokens, 1, loss)
        self.what.append(what)

    def take(self, at: int):
        """Removes an item; the last one moves to its place."""
        item, last = self.what[at], len(self.what) - 1
        self.size[at], self.what[at] = self.size[last], self.what[last]
        self.what.pop()
        return item

    def best(self, room: np.ndarray) -> int:
        """The item that fits with the largest dot product with the room, or -1."""
        size = self.size[: len(self.what)]
        dot = size @ (room / self.limits**2)
        dot[(size > room).any(1)] = -1
        at = int(dot.argmax()) if len(dot) else -1
        return at if at >= 0 and dot[at] >= 0 else -1

    def longest(self) -> int:
        return int(self.size[: len(self.what), 0].argmax())


def fill(pool: Pool, cut) -> list:
    """One sequence out of the pool: items in order. ``cut(item, tokens)`` gives head and
    (tokens, loss, rest) of an item, or is None where items must stay whole."""
    room, out = pool.limits.copy(), []
    while pool.what:
        at = pool.best(room)
        if at < 0:
            if cut is None or room.min() < 1:
                break
            at = pool.longest()
            keep = int(min(room[0], room[2]))
            if keep >= pool.size[at, 0]:
                keep = int(pool.size[at, 0]) - 1
            if keep < 1:
                break
            head, rest = cut(pool.take(at), keep)
            out.append(head)
            room -= (keep, 1, keep)
            pool.add(*rest)
            continue
        room -= pool.size[at]
        out.append(pool.take(at))
    return out


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECES_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _cut(item, keep):
    doc, start, ids, total = item
    rest = (doc, start + keep, ids[4 * keep:], total)
    return (doc, start, ids[: 4 * keep], total), (len(rest[2]) // 4, len(rest[2]) // 4, rest)


def _powers_of_two(items: list, segments: int) -> Iterator[list]:
    """Deals the items of a short sequence to sequences of power-of-two lengths, none with more than so many pieces.

    A sequence is as long as its first pieces allow, so a small limit gives more and shorter sequences."""
    left = sum(len(x[2]) // 4 for x in items)
    while left:
        reach = sum(len(x[2]) // 4 for x in items[:segments])
        want = 1 << (reach.bit_length() - 1)
        left, part = left - want, []
        while want:
            have = len(items[0][2]) // 4
            if have > want:
                head, (_, _, rest) = _cut(items[0], want)
                items = [rest, *items[1:]]
            else:
                head, items = items[0], items[1:]
            part.append(head)
            want -= len(head[2]) // 4
        yield part


def pack_documents(docs: DataFrame, limits: Limits = Limits(), pool_items: int = 2048, path: str | None = None) -> DataFrame:
    """Pieces of the documents' token ids, each with its sequence and place there."""
    path = path or tokenizer_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pool, number = word_ids(path), Pool(limits, pool_items), TaskContext.get().partitionId() << 40

        def rows(items):
            nonlocal number
            offset = 0
            for doc, start, ids, total in items:
                yield doc, start, len(ids) // 4, zlib.crc32(ids), total, number, offset
                offset += len(ids) // 4
            number += 1

        def everything():
            full = 4 * min(limits.tokens, limits.loss)
            for batch in batches:
                for doc, text in zip(cells(batch, "doc_id"), raw_texts(batch)):
                    ids = encode.text(text) + end
                    total, at = len(ids) // 4, 0
                    while len(ids) - at >= full:
                        yield from rows([(doc, at // 4, ids[at:at + full], total)])
                        at += full
                    if at < len(ids):
                        pool.add((len(ids) - at) // 4, (len(ids) - at) // 4, (doc, at // 4, ids[at:], total))
                    while len(pool.what) >= pool_items:
                        yield from rows(fill(pool, _cut))
            while pool.what:
                items = fill(pool, _cut)
                for part in [items] if pool.what else _powers_of_two(items, limits.segments):
                    yield from rows(part)

        yield from in_pieces(everything(), PIECES)

    return texts(docs).mapInArrow(run, PIECES_DDL)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), pool_items: int = 2048) -> DataFrame:
    """Whole examples (example_id, n_tokens, n_loss) to sequences: example_id, n_tokens, n_loss,
    sequence_id, offset. A null count is zero."""
    schema = pa.schema([(n, pa.int64()) for n in ("example_id", "n_tokens", "n_loss", "sequence_id", "offset")])

    def run(batches):
        pool, number = Pool(limits, pool_items), TaskContext.get().partitionId() << 40

        def rows(items):
            nonlocal number
            offset = 0
            for example, tokens, loss in items:
                yield example, tokens, loss, number, offset
                offset += tokens
            number += 1

        def everything():
            for batch in batches:
                for example, tokens, loss in zip(*(cells(batch, n) for n in ("example_id", "n_tokens", "n_loss"))):
                    tokens, loss = tokens or 0, loss or 0
                    if tokens > limits.tokens or loss > limits.loss:
                        raise ValueError(f"example {example} is larger than a sequence: {tokens} tokens, {loss} with loss")
                    pool.add(tokens, loss, (example, tokens, loss))
                    while len(pool.what) >= pool_items:
                        yield from rows(fill(pool, None))
            while pool.what:
                yield from rows(fill(pool, None))

        yield from in_pieces(everything(), schema)

    rows = examples.selectExpr("cast(example_id as long) example_id", "cast(n_tokens as long) n_tokens", "cast(n_loss as long) n_loss")
    return rows.mapInArrow(run, "example_id long, n_tokens long, n_loss long, sequence_id long, offset long")


@query("op8_vector_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
