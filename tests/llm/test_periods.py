"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from slotwise.llm import periods

from .conftest import local

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of all runs, period by period."""
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    out = []
    for q in range(1, len(ids) // 4 + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int)
        starts, stops = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(starts.tolist(), stops.tolist()):
            block = ids[a:a + q]
            if b - a + q >= max(6, 4 * q) and not any(q % d == 0 and (block == np.resize(block[:d], q)).all() for d in range(1, q)):
                out.append((a, b - a + q, q))
    return sorted(out)


def plain_row(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = set()
    for a, length, q in found:
        dropped |= set(range(a + q, a + length))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def stitched_here(ids, core):
    periods.CORE, old = core, periods.CORE
    try:
        found = [(q, first + a, first + b) for _, p, first, at, part in periods.tiles(ids, [len(ids)]) for q, a, b in periods.solved(part, p, at)]
    finally:
        periods.CORE = old
    out = []
    for q, a, b in sorted(found):
        if out and out[-1][0] == q and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([q, a, b])
    return sorted((a, b - a + q, q) for q, a, b in out if b - a + q >= max(6, 4 * q))


def test_tiles_find_all_runs():
    r = random.Random(11)
    for _ in range(1500):
        ids = []
        for _ in range(r.randint(1, 6)):
            kinds = r.choice([1, 2, 3, 50])
            block = [r.randrange(kinds) for _ in range(r.randint(1, r.choice([3, 8, 40])))]
            ids += block * r.choice([1, 1, 2, 4, 5, 9, 30]) + block[:r.randint(0, len(block))]
        ids = ids[:r.choice([5, 50, 500])]
        assert stitched_here(np.array(ids, np.int32), r.choice([12, 60, 3072])) == plain_runs(ids)


def test_documents_probed_together():
    """Tiles of documents that lie behind one another are those of each alone, whatever the parts."""
    r = random.Random(5)
    docs = []
    for _ in range(60):
        block = [r.randrange(4) for _ in range(r.randint(1, 12))]
        docs.append(np.array([r.randrange(30) for _ in range(r.randint(0, 40))] + block * r.choice([0, 1, 5, 9]) + [0] * r.choice([0, 7]), np.int32))
    flat = lambda t, d: (d, t[1], t[2], t[3].tolist(), t[4].tolist())
    alone = sorted(flat(t, i) for i, d in enumerate(docs) for t in periods.tiles(d, [len(d)]))
    old = periods.PART
    for part in (old, 7):
        periods.PART = part
        assert sorted(flat(t, t[0]) for t in periods.tiles(np.concatenate(docs), [len(d) for d in docs])) == alone
    periods.PART = old


def test_z_function():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randint(1, 40))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periods.z_function(s) == want


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r[0]: tuple(r) for r in periods.op11(spark, SF).collect()}
    assert got == {d: plain_row(d, t) for d, t in docs.items()}
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_a_long_document_is_dealt_to_many_tasks(spark):
    """Ten thousand words with runs in all octaves, one of them over the whole text but its edges."""
    r = random.Random(3)
    unit = [f"w{r.randrange(40)}" for _ in range(2300)] + ["a", "b"] * 9 + ["c"] * 50
    words = ["x", *unit * 5, "y"]
    docs = spark.createDataFrame([(7, " \t".join(words))], "doc_id long, text string")
    row = periods.runs(docs).first()
    assert [tuple(x) for x in row.runs] == plain_runs(words)
    assert max(x.period for x in row.runs) == len(unit) and row.n_words == len(words)
    tiles = periods.split(docs).where("octave IS NOT NULL")
    assert tiles.count() > 10
    assert "Exchange hashpartitioning" in periods.fragments(tiles)._jdf.queryExecution().executedPlan().toString()


def test_edges(spark, edge_docs, no_docs):
    got = periods.runs(edge_docs).collect()
    want = [(r.doc_id, (r.text or "").encode().split()) for r in edge_docs.collect()]
    assert sorted(((g.doc_id, g.n_words, str([tuple(x) for x in g.runs])) for g in got), key=str) == sorted(
        ((d, len(w), str(plain_runs(w))) for d, w in want), key=str
    )
    again = [g for g in got if g.doc_id == 8][0]
    assert [tuple(x) for x in again.runs] == [(0, 5000, 1)] and again.collapsed == "word"
    assert local(periods.runs(no_docs)).empty
    planted = periods.repeated_tails(edge_docs).collect()
    assert len(planted) == edge_docs.count()
