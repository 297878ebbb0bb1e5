"""The classifier on planted labels, near-duplicates against all pairs."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from slotwise.llm import quality, simhash

from .conftest import local


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.randint(5, 120))]
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad and i % 8 else " ".join([w[0]] * len(w)) if bad else " ".join(w), int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = quality.classified(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert ((got.score >= 0.3) == got.predicted).all() and got.score.between(0, 1).all()


def test_held_out_labels_are_not_used(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (local(quality.classified(docs, x)) for x in (labels, turned))
    assert np.allclose(a.score, b.score)


def test_shapes():
    assert quality.shape(b"Anxt!!") == b"Aa!"
    assert quality.shape("É12".encode()) == b"a9"
    assert len(quality.Words().features(b"")) == 0
    assert len(quality.Words().features(b"one")) == 2


def test_classifier_edges(spark, edge_docs, no_docs, labelled):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(edge_docs, labels)
    assert got.count() == edge_docs.count() and got.where("score is null or held_out is null").count() == 0
    untrained = quality.classified(edge_docs, labels.where("false")).toPandas()
    assert (untrained.score == 0.5).all()
    assert quality.classified(no_docs, labels).collect() == []
    kept = quality.accepted(edge_docs, labels.where("false"))
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def slow_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i:i + 4]), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(prints, bits=4):
    """Index -> smallest index reachable, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints(edge_docs, prose):
    for df in (edge_docs, prose):
        texts = [r["text"] for r in df.collect()]
        assert [simhash.fingerprint((t or "").encode()) for t in texts] == [slow_print(t) for t in texts]


def test_components_of_texts(spark, prose):
    rows = sorted(map(tuple, prose.collect()))
    prints = [slow_print(t) for _, t in rows]
    got = local(simhash.near_duplicates(prose))
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == classes_of(prints)
    assert len(set(got.component_id)) < len(got)


@pytest.mark.parametrize("short", [48, 2])
def test_components_of_prints(spark, short, monkeypatch):
    r = random.Random(6)
    prints = [r.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains and balls of links, with signs of both kinds
        p = r.choice(prints)
        for bit in r.sample(range(64), r.randint(1, 5)):
            p ^= 1 << bit
        prints.append(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, print long").repartition(4)
    if short == 48:
        got = local(simhash.with_components(df))
        assert got.component_id.tolist() == classes_of(prints)
    members = np.unique(np.array(signed))
    edges = [(int(a), int(b)) for x, y in simhash.links_of(members, 4) for a, b in zip(x, y)]
    assert len(edges) < len(members)
    unsigned = [int(m) % (1 << 64) for m in members]
    want = classes_of(unsigned)
    place = {int(m): i for i, m in enumerate(members)}
    root = list(range(len(members)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        assert ((a ^ b) % (1 << 64)).bit_count() <= 4
        x, y = sorted((find(place[a]), find(place[b])))
        root[y] = x
    assert [find(i) for i in range(len(members))] == want


def test_long_chains_become_one_component(spark):
    r = random.Random(2)
    nodes = list(range(400))
    r.shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long").repartition(3)
    got = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    assert got == {n: 0 for n in range(400)}


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs)
    assert got.count() == edge_docs.count()
    assert {r["component_id"] for r in got.where("fingerprint = '0000000000000000'").collect()} == {0}
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert len(ids) == len(set(ids)) and 4 not in ids and 3 in ids and 0 in ids and 1 not in ids


def test_one_of_each_keeps_the_smallest(spark, prose):
    rows = sorted(map(tuple, prose.collect()))
    want = sorted(set(classes_of([slow_print(t) for _, t in rows])))
    doubled = prose.unionByName(prose.where("doc_id % 5 = 0"))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(doubled).collect()) == want


def test_shapes_of_whole_words():
    assert quality.shape(b"Anxt!!") == b"Aa!"
    long = b"a" * 200 + b"9" * 100 + b"!" + "é".encode() * 50
    assert quality.shape(long) == b"a9!a" and quality.shape(long + b"Z") == b"a9!aA"
    memo = quality.Words(most_bytes=1000)
    want = quality.Words().features(b"one two " + b"x" * 900 + b" one")
    assert (memo.features(b"one two " + b"x" * 900 + b" one") == want).all()
    memo.features(b"y" * 500)
    assert (memo.features(b"one two " + b"x" * 900 + b" one") == want).all() and memo.held < 1000
