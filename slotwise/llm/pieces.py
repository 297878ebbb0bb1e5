"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds the model's pieces. Reading a text once, it reports at each position
every piece that ends there (the state's own and, along output links, the shorter ones), and
each reported piece relaxes the best score of its end from that of its start. The result is the
segmentation with the largest sum of piece scores; of equal sums the one whose last
piece is longer, judged at every position. A character no piece covers costs less than any
piece and becomes its UTF-8 byte pieces (or the unknown id where the model has none).

White space is written as the model's sign, with one sign before the text. Where two
neighbouring characters stand together in no piece, no piece can span the place: the text is
cut there without changing the best segmentation, and each distinct unit is scored once.
Decoding joins pieces and bytes and drops the sign added in front.

Null texts are empty and have no pieces. Repeated rows encode alike. A text that itself holds
the model's sign reads back with spaces instead; ``round_trip`` then says false.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import cells, in_pieces, query, raw_texts, table, texts
from .tokens import tokenizer_path

SIGN = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
MODEL = "piece_bpe_32k.model"


class Pieces(dict):
    """Unit of text -> (ids as little-endian unsigned 32-bit bytes, score); at most ``limit`` units are kept."""

    def __init__(self, path: str, limit: int = 700_000, longest: int = 64):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        self.limit, self.longest = limit, longest
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.automaton, self.written, self.byte_ids, self.unknown = ahocorasick.Automaton(), [], {}, 0
        normal = []
        for i, p in enumerate(model.pieces):
            out = b""
            if p.type in (NORMAL, USER_DEFINED):
                self.automaton.add_word(p.piece, (len(p.piece), i, p.score))
                normal.append(p)
                out = p.piece.replace(SIGN, " ").encode()
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                out = bytes([int(p.piece[3:5], 16)])
            elif p.type == UNKNOWN:
                self.unknown, out = i, " ⁇ ".encode()
            self.written.append(out)
        self.automaton.make_automaton()
        self.worst = min(p.score for p in normal) - 10
        self.apart = not any(re.search(f"[^{SIGN}]{SIGN}", p.piece) for p in normal)
        self.joined = {pair for p in normal for pair in zip(p.piece, p.piece[1:])}

    def viterbi(self, text: str) -> tuple[bytes, float]:
        """One pass over the text; ids in order and the sum of scores."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0

        def close(end):
            # No piece that ends before ``end`` is still to come: bare characters fill what none reached.
            nonlocal done
            while done < end:
                done += 1
                bare = best[done - 1] + self.worst
                if best[done] is None or bare > best[done]:
                    best[done], back[done] = bare, None

        for last, (length, i, score) in self.automaton.iter(text):
            end = last + 1
            if end > done + 1:
                close(end - 1)
            value = best[end - length] + score
            if best[end] is None or value > best[end] or (value == best[end] and length > back[end][0]):
                best[end], back[end] = value, (length, i)
        close(n)
        out, at = [], n
        while at:
            if back[at] is None:
                at -= 1
                raw = text[at].encode()
                ids = [self.byte_ids.get(b, self.unknown) for b in raw] if self.byte_ids else [self.unknown]
                out += reversed(ids)
            else:
                length, i = back[at]
                out.append(i)
                at -= length
        return array("I", out[::-1]).tobytes(), best[n]

    def __missing__(self, unit: bytes) -> tuple[bytes, float]:
        text = unit.decode()
        cuts = [i for i, pair in enumerate(zip(text, text[1:]), 1) if pair not in self.joined]
        if cuts:
            found = [self[text[a:b].encode()] for a, b in zip([0, *cuts], [*cuts, len(text)])]
            out = b"".join(f[0] for f in found), sum(f[1] for f in found)
        else:
            out = self.viterbi(text)
        if len(unit) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = out
        return out

    def encode(self, text: bytes) -> tuple[bytes, float]:
        if not text:
            return b"", 0.0
        sign = SIGN.encode()
        marked = sign + text.replace(b" ", sign)
        units = self.units(marked) if self.apart else [marked]
        found = [self[u] for u in units]
        return b"".join([f[0] for f in found]), float(sum([f[1] for f in found]))

    @staticmethod
    def units(marked: bytes) -> list[bytes]:
        sign = SIGN.encode()
        if sign + sign not in marked:
            return [sign + u for u in marked.split(sign)[1:]]
        return [u.encode() for u in re.findall(f"{SIGN}*[^{SIGN}]+|{SIGN}+", marked.decode())]

    def decode(self, ids) -> bytes:
        text = b"".join(map(self.written.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


@lru_cache(maxsize=1)
def model(path: str) -> Pieces:
    return Pieces(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("score", pa.float64())])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, score of every text."""
    path = path or tokenizer_path(MODEL)

    def run(batches):
        m = model(path)
        rows = (
            (doc, list(memoryview(ids).cast("I")), score)
            for batch in batches
            for doc, text in zip(cells(batch, "doc_id"), raw_texts(batch))
            for ids, score in [m.encode(text)]
        )
        yield from in_pieces(rows, ENCODED, 512)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids); bytes that are no UTF-8 give way to replacement signs."""
    path = path or tokenizer_path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        m = model(path)
        out = (
            (doc, m.decode(ids or []).decode(errors="replace"))
            for batch in batches
            for doc, ids in zip(cells(batch, "doc_id"), cells(batch, "ids"))
        )
        yield from in_pieces(out, schema, 512)

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number and crc32 of its piece ids, score, and what decoding gives back."""
    path = path or tokenizer_path(MODEL)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()),
        ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()),
    ])

    def run(batches):
        m = model(path)

        def rows():
            for batch in batches:
                for doc, text in zip(cells(batch, "doc_id"), raw_texts(batch)):
                    ids, score = m.encode(text)
                    back = m.decode(memoryview(ids).cast("I"))
                    yield doc, len(ids) // 4, zlib.crc32(ids), score, hashlib.sha256(back).hexdigest(), back == text

        yield from in_pieces(rows(), schema)

    return texts(docs).mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean"
    )


@query("op10_piece_viterbi")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
