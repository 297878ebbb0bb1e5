"""Token ids as static range asymmetric numeral system blocks.

One frequency table, counted over all documents, is shared by every block. A block
holds whole documents and codes its ids in interleaved lanes: id number i belongs to
lane i mod LANES. Every lane keeps a 64-bit state and all lanes write to one stream of
32-bit words. Blocks are independent of each other, a checkpoint inside a block (the
lanes' states and the place in the stream) lets a reader start in its middle, and every
block carries the crc32 of its stream and states.

The file format is a folder with two Parquet tables. ``frequencies``: id, frequency
(they add up to 2**SCALE). ``blocks``: shard, block, doc_ids, lengths, stream, states,
checkpoints, crc32; shards and blocks in order hold the documents by ascending doc_id
(null first), rows of one doc_id by their ids' crc32.

A null text is empty and codes as its end id alone. An empty table writes empty tables.
Repeated rows are coded one by one. The largest block is BLOCK ids or one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cells, folder, in_pieces, partitions, query, stored, table, texts
from .tokens import END, SPACE, WordIds, tokenizer_path, word_ids

SCALE, LANES, BLOCK, CHECKPOINT = 18, 512, 1 << 18, 1 << 17
LOW = np.uint64(1 << 31)
#: Bytes of texts encoded at once.
SLICE = 4 << 20


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2**SCALE; an id that occurs keeps at least 1."""
    seen = counts > 0
    free = (1 << SCALE) - int(seen.sum())
    if free < 0:
        raise ValueError("more distinct ids than the scale has slots")
    out = np.where(seen, 1 + (counts.astype(object) * free // max(1, int(counts.sum()))), 0).astype(np.int64)
    if seen.any():
        out[counts.argmax()] += (1 << SCALE) - out.sum()
    return out


class Coder:
    """Encoder and decoder over one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.filler = int(freq.argmax())

    def encode(self, ids: np.ndarray) -> dict:
        steps = -(-len(ids) // LANES)
        padded = np.full(steps * LANES, self.filler, np.int64)
        padded[: len(ids)] = ids
        freq, base = self.freq[padded].reshape(steps, LANES), self.base[padded].reshape(steps, LANES)
        x, words, states = np.full(LANES, LOW), [b""] * steps, {}
        for t in range(steps - 1, -1, -1):
            f = freq[t]
            over = x >= f << np.uint64(63 - SCALE)
            words[t] = x[over].astype("<u4").tobytes()
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + base[t]
            if t * LANES % CHECKPOINT == 0:
                states[t] = x.astype("<u8").tobytes()
        places = np.cumsum([0, *map(len, words)]) // 4
        stream = b"".join(words)
        marks = [{"step": t, "place": int(places[t]), "states": states[t]} for t in sorted(states)]
        return {"stream": stream, "checkpoints": marks, "crc32": checksum(stream, marks)}

    def decode(self, block: dict, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first..last of a block of n ids, from the nearest checkpoint before them."""
        if checksum(block["stream"], block["checkpoints"]) != block["crc32"]:
            raise ValueError("a block's checksum is wrong")
        last = n if last is None else min(last, n)
        if first >= last:
            return np.zeros(0, np.uint32)
        mark = max((m for m in block["checkpoints"] if m["step"] * LANES <= first), key=lambda m: m["step"])
        words = np.frombuffer(block["stream"], "<u4").astype(np.uint64)
        x, place = np.frombuffer(mark["states"], "<u8").astype(np.uint64), mark["place"]
        start, steps = mark["step"], -(-last // LANES)
        out = np.empty((steps - start, LANES), np.uint32)
        for t in range(steps - start):
            slot = x & np.uint64((1 << SCALE) - 1)
            s = self.symbol[slot]
            out[t] = s
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.base[s]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << np.uint64(32)) | words[place:place + len(low)]
            place += len(low)
        return out.reshape(-1)[first - start * LANES:last - start * LANES]


def checksum(stream: bytes, marks: list[dict]) -> int:
    crc = zlib.crc32(stream)
    for m in marks:
        crc = zlib.crc32(m["states"], zlib.crc32(f"{m['step']}:{m['place']}".encode(), crc))
    return crc


BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("stream", pa.binary()),
    ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("place", pa.int64()), ("states", pa.binary())]))),
    ("crc32", pa.int64()),
])
BLOCKS_DDL = (
    "shard int, block int, doc_ids array<long>, lengths array<int>, stream binary, "
    "checkpoints array<struct<step:int,place:long,states:binary>>, crc32 long"
)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 16-bit where the vocabulary allows), ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("order", pa.int64())])

    def run(batches):
        encode = word_ids(path)
        for batch in batches:
            docs = batch.column(0)
            text = batch.column(1).cast(pa.binary())
            bounds, data = binary_parts(text)
            first = 0
            while first < len(text):
                # Whole texts of up to SLICE bytes; a longer text goes alone.
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1)
                near = bounds[first:last + 1]
                ids, n = encoded(encode, data[near[0]:near[-1]], near - near[0], SLICE)
                ids, n = np.insert(ids, np.cumsum(n), END), n + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.astype("<u4")).cast("B")
                order = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                short = ids.astype(kind)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * short.itemsize).astype(np.int32)), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([docs.slice(first, len(n)).cast(pa.int64()), pa.array(n, pa.int64()), packed, pa.array(order, pa.int64())], schema=schema)
                first = last

    kind = "<u2" if vocabulary(path) <= 1 << 16 else "<u4"
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, order long")


def encoded(encode: WordIds, data: np.ndarray, bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode.texts``; one text of more than ``most`` bytes in parts cut behind white space."""
    if len(data) <= most:
        return encode.texts(data, bounds)
    found, at = [], 0
    while at < len(data):
        stop = min(at + most, len(data))
        while stop < len(data) and not SPACE[data[at:stop]].any():
            stop = min(stop + most, len(data))
        if stop < len(data):
            stop = at + int(np.flatnonzero(SPACE[data[at:stop]])[-1]) + 1
        found.append(encode.texts(data[at:stop], np.array([0, stop - at]))[0])
        at = stop
    return (ids := np.concatenate(found)), np.array([len(ids)])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a binary column without nulls begin and end, and the bytes they lie in."""
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    bounds = np.frombuffer(bounds, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; the vocabulary bounds what reaches the driver."""
    kind = "<u2" if size <= 1 << 16 else "<u4"
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            bounds, data = binary_parts(batch.column(0))
            ids = data[bounds[0]:bounds[-1]].view(kind)
            for at in range(0, len(ids), 1 << 20):
                total += np.bincount(ids[at:at + (1 << 20)], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=schema)

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write(docs: DataFrame, target: str, path: str | None = None) -> None:
    """Writes the documents' ids to the folder ``target``."""
    path = path or tokenizer_path()
    spark, size = docs.sparkSession, vocabulary(path)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens = stored(tokenized(docs, path), "tokens")
    freq = frequencies(count_ids(tokens, size))
    table_rows = pa.table({"id": pa.array(np.flatnonzero(freq), pa.int32()), "frequency": pa.array(freq[freq > 0], pa.int32())})
    spark.createDataFrame(table_rows).coalesce(1).write.parquet(f"{target}/frequencies")

    def run(batches):
        coder, shard = Coder(freq), TaskContext.get().partitionId()

        def blocks():
            number, docs_held, ids_held, held = 0, [], [], 0

            def closed():
                out = coder.encode(np.concatenate(ids_held))
                return shard, number, docs_held, [len(i) for i in ids_held], out["stream"], out["checkpoints"], out["crc32"]

            for batch in batches:
                for doc, ids in zip(cells(batch, "doc_id"), cells(batch, "ids")):
                    docs_held.append(doc)
                    ids_held.append(np.frombuffer(ids, kind))
                    held += len(ids_held[-1])
                    if held >= BLOCK:
                        yield closed()
                        number, docs_held, ids_held, held = number + 1, [], [], 0
            if docs_held:
                yield closed()

        yield from in_pieces(blocks(), BLOCKS, 1)

    order = tokens.select("doc_id", "ids", "order")
    order = order.repartitionByRange(partitions(spark), "doc_id", "order").sortWithinPartitions("doc_id", "order")
    order.select("doc_id", "ids").mapInArrow(run, BLOCKS_DDL).write.parquet(f"{target}/blocks")


def read(spark: SparkSession, source: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, decoded block by block."""
    table_rows = spark.read.parquet(f"{source}/frequencies").collect()  # bounded by the vocabulary
    freq = np.zeros(1 + max([0, *(r["id"] for r in table_rows)]), np.int64)
    for r in table_rows:
        freq[r["id"]] = r["frequency"]
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("block", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]):
        coder = Coder(freq)

        def rows():
            for batch in batches:
                for b in batch.to_pylist():
                    ids = coder.decode(b, sum(b["lengths"])).astype("<u4")
                    at = 0
                    for doc, n in zip(b["doc_ids"], b["lengths"]):
                        yield doc, at, n, zlib.crc32(ids[at:at + n].tobytes()), b["shard"], b["block"]
                        at += n

        yield from in_pieces(rows(), schema)

    blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{source}/blocks")
    sizes = blocks.select("shard", "block", F.expr("aggregate(lengths, 0L, (a, n) -> a + n)").alias("n"))
    # What lies in front of a block: whole shards (one row for each writing task), then blocks of its shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("block_start"))
    starts = starts.join(shards, "shard")
    decoded = blocks.mapInArrow(run, "doc_id long, place long, n_tokens long, ids_crc32 long, shard int, block int")
    return decoded.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("shard_start") + F.col("block_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op1_rans_token_blocks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = folder(spark, "rans")
    write(table(spark, sf_dir, "documents"), target)
    return read(spark, target)
