"""Language-model scores against dictionaries; sketches against set differences."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from slotwise.llm import ngrams, sketches

from .conftest import local


def plain_model(rows, smoothing):
    words = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c, pairs, contexts = Counter(), Counter(), Counter()
    for (_, w), h in zip(words, held):
        if not h:
            c.update(w)
            pairs.update(zip([0, *w[:-1]], w))
            contexts.update([0, *w[:-1]])
    n, v = sum(c.values()), len(c)
    p = lambda x: (c[x] + 1) / (n + v + 1)
    out = []
    for (d, w), h in zip(words, held):
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((pairs[a, x] + smoothing * p(x)) / (contexts[a] + smoothing)) for a, x in zip([0, *w[:-1]], w))
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_scores(spark, prose, block, monkeypatch):
    monkeypatch.setattr(ngrams, "BUCKET", 4000)
    rows = prose.select(prose.doc_id, prose.text)
    got = local(ngrams.scored(rows.repartition(1 if block > 1000 else 7)))
    for g, w in zip(got.itertuples(), plain_model(sorted(map(tuple, rows.collect())), got.smoothing[0])):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], abs=1e-6) and g.score == pytest.approx(w[6], abs=1e-6)


def test_weights_of_a_state_sum_to_one(spark, prose):
    row = ngrams.blocks(prose.coalesce(1)).collect()[0].asDict()
    b = ngrams.Block(row)
    words, pairs = (b.totals(order, 1, []) for order in (1, 2))
    tokens, types = int(words.sum()), int((words > 0).sum())
    m = ngrams.Automaton(b, words, pairs, tokens, types)
    p = 10**m.root_arc
    unknown = 1 / (tokens + types + 1)
    assert p[words > 0].sum() + unknown == pytest.approx(1)
    h, w = np.divmod(m.codes, m.width)
    for state in (b.size, *np.flatnonzero(words[1:] > 3)[:5] + 1):
        arcs = np.flatnonzero((h == state) & m.arc_seen)
        rest = (words > 0) & ~np.isin(np.arange(len(words)), w[arcs])
        for g in range(len(ngrams.GRID)):
            total = (10 ** m.arc[arcs, g]).sum() + 10 ** m.failure[state, g] * (p[rest].sum() + unknown)
            assert total == pytest.approx(1)


def test_squeezed_numbers():
    a = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (ngrams.spread(ngrams.squeezed(a)) == a).all() and len(ngrams.spread(b"")) == 0


def test_score_edges(spark, edge_docs, no_docs):
    got = ngrams.scored(edge_docs).toPandas()
    want = plain_model([tuple(r)[:2] for r in edge_docs.collect()], got.smoothing[0])
    key = lambda r: (r[0] is None or r[0] != r[0], r[0] if r[0] == r[0] and r[0] is not None else 0, r[2])
    for g, w in zip(sorted(map(tuple, got.values), key=key), sorted(want, key=key)):
        assert g[2:5] == w[2:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])
    assert ngrams.scored(no_docs).collect() == []
    only_held = edge_docs.where("crc32(cast(doc_id as string)) % 7 = 2")
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in ngrams.scored(only_held).collect())


def test_differences_are_those_of_the_sets():
    r = random.Random(1)
    a, b = [], []
    for size in (0, 1, 5, 40, 400, 3000):
        for shared in (0.0, 0.5, 1.0):
            both = [r.getrandbits(64) for _ in range(int(size * shared))]
            a.append(np.array(both + [r.getrandbits(64) for _ in range(size - len(both))], np.uint64))
            b.append(np.array(both + [r.getrandbits(64) for _ in range(r.randint(0, 9))], np.uint64))
    for x, y, (only_x, only_y) in zip(a, b, sketches.differences(a, b)):
        assert set(only_x.tolist()) == set(x.tolist()) - set(y.tolist())
        assert set(only_y.tolist()) == set(y.tolist()) - set(x.tolist())


def likeness(x, y):
    x, y = (set(sketches.digests(t).tolist()) for t in (x, y))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def check_pairs(rows, got):
    rows = sorted(rows)
    for i, ((doc, text), g) in enumerate(zip(rows, got.itertuples())):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert (g.doc_id, g.n_chars, g.edited_sha256) == (doc, len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert g.near_edited == pytest.approx(likeness(text, changed)) and g.near_next == pytest.approx(likeness(text, following))
        assert g.fingerprint == sketches.fingerprints([sketches.digests(text)])[0]
        assert g.edited_fingerprint == sketches.fingerprints([sketches.digests(changed)])[0]


def test_neighbours_over_ranges(spark, prose):
    check_pairs([tuple(r) for r in prose.collect()], local(sketches.edited_pairs(prose)))


def test_sketch_edges(spark, edge_docs, no_docs):
    single = edge_docs.where("doc_id not in (7, 3)")
    rows = [(r["doc_id"], r["text"] or "") for r in single.collect()]
    check_pairs(rows, local(sketches.edited_pairs(single)))
    got = sketches.edited_pairs(edge_docs).toPandas()
    assert len(got) == edge_docs.count()
    assert got[got.doc_id == 7].near_next.max() == 1.0  # repeated rows are neighbours
    one = sketches.edited_pairs(edge_docs.where("doc_id = 10")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert sketches.edited_pairs(no_docs).collect() == []
    assert [sketches.paragraphs(t) for t in ("", "\n\n", "a\n\nb")] == [[], [], ["a", "b"]]
