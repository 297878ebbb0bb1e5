"""Language ID: bit-sliced Bloom filters that return all languages containing an n-gram.

N-grams are the one to LONGEST letters of lower-cased words, a space standing for a word's edge;
none reaches over a space. One table of ROWS rows holds the Bloom filters of all languages
side by side, a bit column for each language. The conjunction of an n-gram's HASHES rows is the
bitmask of all languages that contain it. A text's n-grams, repeats included, give one popcount
per language. Of N n-grams a language that contains none would still get N times its false-positive
rate (its share of set bits to the power HASHES), so its count is corrected to
(count - N * rate) / (1 - rate). The largest corrected count decides and its share of N is the score.

A language contains an n-gram if the n-gram makes up at least MIN_SHARE of the language's
n-grams of that length in all training documents, and at least a RATIO-th of the share it has in any
language. So a language has at most LONGEST / MIN_SHARE n-grams however large the corpus is, and
the table, ROWS * ceil(languages / 8) bytes, is safe to broadcast; more than MAX_LANGUAGES
languages are refused. Counting covers all training documents; counts are added up in
tasks before they are shuffled by n-gram, so no language and no n-gram is one task's.

A null text and a text without a letter are ``und`` with score 0, as is every text if there
is nothing to learn from. Ties, also of texts none of whose n-grams is known, go to the language
with more training documents, then to the smaller name. Null languages do not train; a null doc_id
trains (it has no remainder) and is not held out. Repeated rows train and are answered as often as
they occur. Long texts are read whole, in stretches of BLOCK n-gram starts. Only ``doc_id``,
``text`` and, for training, ``lang`` are read, so other columns may have any name. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cells, query, record, stored, table

LONGEST, HASHES, ROWS = 4, 3, 1 << 20
MIN_SHARE, RATIO, MAX_LANGUAGES = 2e-5, 8.0, 256
#: Code points of texts taken together, and distinct n-grams a task holds before it gives their counts away.
BLOCK, HELD = 1 << 18, 1 << 20
FOLDS, TEST_FOLD = 3, 1
UNKNOWN = "und"
SPACE = np.uint32(32)
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point 2 if it is a letter, 1 if it is a mark that goes with letters."""
    import sys
    import unicodedata

    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            kinds[i] = 2 if kind == "L" else 1
    return kinds


def blocks(texts: list) -> Iterator[list[int]]:
    """Places of texts to take together: about BLOCK code points, a longer text alone."""
    held: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if held and size + len(text) > BLOCK:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(text) + 1
    if held:
        yield held


def spelled(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lower-cased words with a space between words; where each text ends; whether it has a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    kind = kinds[points]
    inside = kind > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    letters_before = np.concatenate([[0], np.cumsum(kind == 2)])[ends]
    kept_before = np.concatenate([[0], np.cumsum(kept)])[ends]
    out = np.where(inside, points, SPACE)[kept]
    # The space in front of the first word; a text's later first words have that of the text before.
    return np.concatenate([[SPACE], out]), kept_before + 1, np.diff(letters_before, prepend=0) > 0


def grams(points: np.ndarray) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of the n-grams of each length and the place of their last letter, BLOCK starting places at a time."""
    for start in range(0, len(points), BLOCK):
        part = points[start:start + BLOCK + LONGEST - 1]
        solid = part != SPACE
        wide = part.astype(np.uint64) + np.uint64(1)
        h, inner, out = wide, None, []
        for n in range(1, min(LONGEST, len(part)) + 1):
            if n == 1:
                whole = solid
            else:
                h = h[:-1] * MIX + wide[n - 1:]
                h ^= h >> np.uint64(29)
                # Spaces may stand at either end, not inside.
                inner = None if n == 2 else solid[1:-1] if n == 3 else inner[:-1] & solid[n - 2:-1]
                whole = np.ones(len(h), bool) if n == 2 else inner
            at = np.flatnonzero(whole[:BLOCK])
            g = h[at] * MIX
            out.append((g ^ (g >> np.uint64(31)), at + (start + n - 1)))
        yield out


def places(grams_: np.ndarray, rows: int) -> list[np.ndarray]:
    """The HASHES rows of each n-gram, by double hashing."""
    step = (grams_ >> np.uint64(32)) | np.uint64(1)
    return [((grams_ + np.uint64(i) * step) & np.uint64(rows - 1)).view(np.int64) for i in range(HASHES)]


#: For every byte value its eight bits, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@dataclass
class Filters:
    """Languages, the table of their bits (byte of 8 languages, row) and their false-positive rates."""

    languages: list[str]
    bits: np.ndarray
    rates: np.ndarray
    order: np.ndarray  # places of the languages, most training documents first

    def masks(self, grams_: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that contain each n-gram, a row for every 8 languages."""
        at = places(grams_, self.bits.shape[1])
        found = self.bits[:, at[0]]
        for more in at[1:]:
            found &= self.bits[:, more]
        return found

    def counts(self, grams_: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """For each owner (a text) how many of its n-grams each language contains, and their number."""
        out = np.zeros((owners, len(self.bits) * 8 + 1), np.int64)
        for byte, mask in enumerate(self.masks(grams_)):
            of_value = np.bincount(owner * 256 + mask, minlength=owners * 256).reshape(owners, 256)
            out[:, byte * 8:byte * 8 + 8] = of_value @ BYTE_BITS
            out[:, -1] = of_value.sum(1)
        return out

    def decide(self, texts: list[str], kinds: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        names: list[str] = []
        scores = []
        for block in blocks(texts):
            points, ends, lettered = spelled([texts[i] for i in block], kinds)
            sums = np.zeros((len(block), len(self.bits) * 8 + 1), np.int64)
            for parts in grams(points):
                g, last = (np.concatenate(x) for x in zip(*parts))
                first, end = np.searchsorted(ends, [last.min(), last.max()], "right") if len(last) else (0, -1)
                # Texts of this stretch of points only: a long text has many stretches.
                owner = np.repeat(np.arange(first, end + 1), np.diff(np.concatenate([[0], ends])[first:end + 2])) if end >= first else last
                base = ends[first - 1] if first else 0
                sums[first:end + 1] += self.counts(g, owner[last - base] - first, max(end - first + 1, 0))
            hits, total = sums[:, :len(self.languages)], sums[:, -1:]
            shares = np.clip((hits - total * self.rates) / (1 - self.rates) / np.maximum(total, 1), 0, 1)
            best = self.order[np.argmax(shares[:, self.order], axis=1)]
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores.append(np.where(lettered, shares[np.arange(len(block)), best], 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string")) % FOLDS == TEST_FOLD, F.lit(False))


COUNTED = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, size, gram, n) over all rows of docs (lang, text), added up in tasks first."""
    kinds = docs.sparkSession.sparkContext.broadcast(letters())

    def run(batches):
        held: dict = {}  # (lang, size) -> distinct n-grams and their counts
        fresh: dict = {}  # (lang, size) -> n-grams as they come

        def settle():
            for key, parts in fresh.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                if key in held:
                    both = np.concatenate([held[key][0], g])
                    g, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[key][1], n])).astype(np.int64)
                held[key] = g, n
            fresh.clear()

        def given():
            for (lang, size), (g, n) in held.items():
                for i in range(0, len(g), 1 << 16):
                    part = g[i:i + (1 << 16)].view(np.int64)
                    columns = [pa.repeat(pa.scalar(lang), len(part)), pa.repeat(pa.scalar(size, pa.int32()), len(part)), part, n[i:i + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=COUNTED)
            held.clear()

        waiting = 0
        for batch in batches:
            by_lang: dict = {}
            for lang, text in zip(cells(batch, "lang"), cells(batch, "text")):
                by_lang.setdefault(lang, []).append(text or "")
            for lang, texts in by_lang.items():
                for block in blocks(texts):
                    for parts in grams(spelled([texts[i] for i in block], kinds.value)[0]):
                        for size, (g, _) in enumerate(parts, 1):
                            fresh.setdefault((lang, size), []).append(g)
                            waiting += len(g)
                    if waiting > 4 * HELD:
                        settle()
                        waiting = 0
                        if sum(len(g) for g, _ in held.values()) > HELD:
                            yield from given()
        settle()
        yield from given()

    rows = docs.mapInArrow(run, "lang string, size int, gram long, n long")
    return rows.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def contained(counts: DataFrame) -> DataFrame:
    """(lang, gram): what each language contains, at most LONGEST / MIN_SHARE rows a language."""
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    # LONGEST rows for each of at most MAX_LANGUAGES languages.
    share = counts.join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total"))
    often = share.where(F.col("share") >= MIN_SHARE)
    top = F.max("share").over(W.partitionBy("gram"))
    return often.withColumn("top", top).where(F.col("share") * RATIO >= F.col("top")).select("lang", "gram")


def train(docs: DataFrame, rows: int = ROWS) -> Filters:
    """Filters of all languages from docs (doc_id, lang, text) that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), "text")
    found = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages; their table would be too large to broadcast")
    names = sorted(r["lang"] for r in found)
    order = np.array([names.index(r["lang"]) for r in sorted(found, key=lambda r: (-r["n"], r["lang"]))], np.int64)
    bits = np.zeros((-(-len(names) // 8), rows), np.uint8)
    if not names:
        return Filters(names, bits, np.zeros(0), order)
    number = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    # Each n-gram's rows are computed where the n-grams are, then or-ed by (row, byte).
    chosen = contained(stored(gram_counts(known), "language-grams")).select("gram", number[F.col("lang")].alias("language"))
    schema = pa.schema([("row", pa.int32()), ("byte", pa.int32()), ("bits", pa.int32())])

    def placed(batches):
        for batch in batches:
            g = batch.column(0).to_numpy().view(np.uint64)
            language = batch.column(1).to_numpy()
            at = np.concatenate(places(g, rows)).astype(np.int32)
            byte, bit = np.tile(language // 8, HASHES), np.tile(1 << (language % 8), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (at, byte, bit)], schema=schema)

    set_bits = chosen.mapInArrow(placed, "row int, byte int, bits int").groupBy("row", "byte").agg(F.bit_or("bits").alias("bits"))
    # At most rows * ceil(languages / 8) small rows come back, whatever the corpus.
    made = set_bits.toArrow()
    bits[made["byte"].to_numpy(), made["row"].to_numpy()] = made["bits"].to_numpy()
    per_language = np.concatenate([np.bincount(b, minlength=256) @ BYTE_BITS for b in bits])[:len(names)]
    return Filters(names, bits, (per_language / rows) ** HASHES, order)


FOUND = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    context = docs.sparkSession.sparkContext
    sent, kinds = context.broadcast(filters), context.broadcast(letters())

    def run(batches):
        for batch in batches:
            names, scores = sent.value.decide([t or "" for t in cells(batch, "text")], kinds.value)
            yield record(FOUND, {"doc_id": batch.column(0), "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


@query("op13_language_filters")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = identified(docs, train(docs.select("doc_id", "lang", "text")))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
