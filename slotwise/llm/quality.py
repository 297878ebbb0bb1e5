"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader updates and scored as a sparse dot product.

Words are what ASCII white space separates, case and punctuation kept. Features are the
hashed one- and two-word sequences of the words themselves, and the one- to three-word
sequences of the words' shapes (``Ax!`` for ``Anxt!!``; ``=`` where a word repeats the one
before it), which say how a text is written where its words are rare. A feature's value
is its share of the text's features times SPREAD, so long and short texts are alike.
Features come from the text alone.

Training reads at most about ``train_rows`` labelled rows, chosen by a hash of doc_id, in
SHARDS parts; every pass starts all parts from the mean of their weights. Scores for label
1 are between 0 and 1. Null and empty texts have no features and score the bias alone.
Rows without a label (or a null one) do not train; repeated rows train and score as often
as they occur. Without any training row every score is 0.5.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, stored, table, texts, unused

BITS, SPREAD, SHARDS = 18, 30.0, 4
RULE = {"alpha": 0.3, "beta": 1.0, "l1": 0.05, "l2": 0.5}
THRESHOLD, TEST_FOLDS = 0.3, 5
MIX = np.uint64(0x9E3779B97F4A7C15)
CLASSES = bytes(
    ord("A") if chr(b).isupper() and b < 128 else ord("a") if b >= 128 or chr(b).isalpha() else ord("9") if 48 <= b < 58 else b
    for b in range(256)
)


RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Character classes of a whole word, runs written once."""
    return RUN.sub(rb"\1", word.translate(CLASSES))


class Words(dict):
    """word -> place in two growing arrays of hashes, of the word and of its shape. ``limit`` bounds
    the words kept and ``most_bytes`` their lengths together, besides one text's."""

    def __init__(self, limit: int = 1_000_000, most_bytes: int = 64 << 20):
        super().__init__()
        self.limit, self.most_bytes, self.held, self.hashes = limit, most_bytes, 0, np.zeros((1024, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes = np.vstack([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[at] = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape(word), 1)
        self[word] = at
        self.held += len(word)
        return at

    def features(self, text: bytes) -> np.ndarray:
        """Hashed features of a text, repeats included."""
        words = text.split()
        if len(self) > self.limit or self.held > self.most_bytes:
            self.clear()
            self.held = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        w, s = self.hashes[at].T
        again = np.zeros(len(at), bool)
        again[1:] = at[1:] == at[:-1]
        s = np.where(again, np.uint64(7), s)
        s2 = s[:-1] * MIX + s[1:]
        out = np.concatenate([w, w[:-1] * MIX + w[1:], s, s2, s2[:-1] * MIX + s[2:]])
        return ((out * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def words_memo() -> Words:
    return Words()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate sums z and n; weights follow from them. The last coordinate is the bias."""

    def __init__(self, z=None, n=None):
        self.z = np.zeros((1 << BITS) + 1) if z is None else z
        self.n = np.zeros((1 << BITS) + 1) if n is None else n

    def weights(self, at=slice(None)):
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - RULE["l1"], 0)
        return -shrunk / ((RULE["beta"] + np.sqrt(self.n[at])) / RULE["alpha"] + RULE["l2"])

    def learn(self, features: np.ndarray, label: int) -> None:
        at, count = np.unique(features, return_counts=True)
        x = np.append(count * (SPREAD / max(1, len(features))), 1.0)
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / RULE["alpha"] * w
        self.n[at] = grown


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 16_000, passes: int = 3) -> np.ndarray:
    """Weights from the labelled rows whose crc32 rule lets them train."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    share = min(1.0, train_rows / max(1, labels.count()))
    picked = labels.withColumn("_h", F.xxhash64("doc_id")).where(F.pmod("_h", F.lit(1_000_000)) < int(share * 1_000_000))
    # About train_rows small rows at most, so their broadcast is bounded by the parameter.
    sample = texts(docs).join(F.broadcast(picked.select("doc_id", "quality", "_h")), "doc_id")
    sample = stored(sample.select("doc_id", "text", "quality", "_h"), "quality-sample")
    schema = pa.schema([("z", pa.binary()), ("n", pa.binary())])

    def one_pass(state):
        def run(rows: pa.Table) -> pa.Table:
            model = Ftrl(*(np.frombuffer(x).copy() for x in state)) if state else Ftrl()
            memo = Words()
            order = np.lexsort([rows["doc_id"].to_numpy(zero_copy_only=False), rows["_h"].to_numpy()])
            text, label = rows["text"].cast(pa.binary()).to_pylist(), rows["quality"].to_pylist()
            for i in order:
                model.learn(memo.features(text[i]), label[i])
            return pa.table({"z": [model.z.tobytes()], "n": [model.n.tobytes()]}, schema=schema)

        return run

    state = None
    parted = sample.withColumn("_shard", F.pmod(F.shiftright("_h", 20), F.lit(SHARDS)))
    for _ in range(passes):
        # Fixed size: SHARDS states of 2**BITS numbers.
        parts = parted.groupBy("_shard").applyInArrow(one_pass(state), "z binary, n binary").collect()
        if not parts:
            break
        state = [np.mean([np.frombuffer(p[k]) for p in parts], axis=0).tobytes() for k in ("z", "n")]
    model = Ftrl(*(np.frombuffer(x) for x in state)) if state else Ftrl()
    return model.weights().astype(np.float32)


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % TEST_FOLDS == 0, F.lit(False))


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of docs and the score under the given name."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(text):
        import pandas as pd

        memo, w = words_memo(), sent.value
        out = []
        for t in text:
            f = memo.features(t.encode() if t else b"")
            out.append(SPREAD * float(w[f].mean(dtype=np.float64)) if len(f) else 0.0)
        return pd.Series(sigmoid(np.array(out) + float(w[-1])))

    return docs.withColumn(name, of("text"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that score THRESHOLD or more."""
    name = unused(docs, "quality_score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= THRESHOLD).select(docs.columns)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(texts(docs), train(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


@query("op9_ftrl_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
