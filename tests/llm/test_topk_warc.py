"""Exact search against brute force, archives against their pages."""

import base64
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import common, topk, warc


def brute(rows, every, k):
    v = {}
    width = max((len(x) for _, x in rows), default=0)
    fine = [(i, np.pad(np.floor(1024 * np.array(x, float)).astype(np.int64), (0, width - len(x)))) for i, x in rows]
    out = []
    for i, q in fine:
        if i % every == 0:
            best = sorted((-int(q @ c), j) for j, c in fine if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(512, 8192), (3, 50)])
@pytest.mark.parametrize("kind", ["normal", "ties", "far"])
def test_search(spark, kind, blocks, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    r = np.random.default_rng(7)
    v = r.normal(size=(240, 6))
    if kind == "ties":
        v = np.round(v) / 2
        v[50:130] = v[50]
    if kind == "far":
        v[::9] *= 1000
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df, every=20).collect())
    assert got == brute(rows, 20, 10)


def test_search_edges(spark):
    schema = "vec_id long, embedding array<float>, score long, rank string"
    rows = [(0, [1.0, 2.0], 1, "a"), (100, [1.0], 1, "b"), (5, None, 1, None), (6, [None, 1.0], 1, ""), (7, [float("nan"), 1.0], 1, ""),
            (200, [float("inf"), 1.0], 1, ""), (9, [], 1, ""), (3, [-1.0, -1.0], 1, ""), (4, [0.0, 0.0], 1, ""), (None, [1.0, 1.0], 1, "")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(x) for x in topk.top_k(df).collect())
    want = brute([(i, x) for i, x, *_ in rows if i in (0, 100, 3, 4)], 100, 10)
    assert got == want
    assert topk.top_k(df.where("vec_id = 3")).collect() == [] and topk.top_k(df.where("false")).collect() == []
    repeated = topk.top_k(df.where("vec_id in (0, 3)").union(df.where("vec_id = 3"))).collect()
    assert [(x["vec_id"], x["rank"]) for x in sorted(repeated, key=lambda x: x["rank"])] == [(3, 1), (3, 2)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<float>"))


def test_bounds_skip_work(monkeypatch):
    r = np.random.default_rng(0)
    c = r.normal(size=(4000, 4)) * 500
    c = c.astype(np.int64)
    radius2 = float((c**2).sum(1).max())
    pivots = topk.far_apart(topk.lifted(c, radius2), 48)
    seen = []
    real = np.lexsort
    monkeypatch.setattr(topk.np, "lexsort", lambda keys: seen.append(len(keys[0])) or real(keys))
    topk.search_block(np.arange(5), c[:5], np.arange(4000), c, pivots, radius2, 10)
    assert sum(seen) < 5 * 4000 / 2


PAGES = [
    (1, "http://www.example.com/a?x=1#top", "same"), (2, "https://example.com/b", "same"), (3, "http://other.org/", ""), (4, None, None),
    (5, "http://example.com:80/c d\r\nX: y", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n" * 3), (6, "", "é😀\r\n\r\n"),
    (7, "http://[bad", "long " * 40_000), (2, "https://example.com/b", "same"), (9, "http://example.com/a", "same"), (9, "http://example.com/a", "same"),
    (None, "http://example.com/n", "same"), (None, None, "only here"),
]


def archived(spark, rows, least=0, segment=5000):
    target = common.folder(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("kind", F.lit("x"))
    warc.write(df.repartition(3), target, least, segment)
    return target, warc.merged(warc.read(spark, target)).collect()


@pytest.mark.parametrize("least", [0, 3, 5])
def test_archives(spark, least):
    target, got = archived(spark, PAGES, least)
    assert len(got) == len(PAGES)
    groups = {}
    for page, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page)
    want = []
    for payload, pages in groups.items():
        keep = max(pages, key=lambda p: -1 if p is None else p)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        responses = 0
        for p in sorted(pages, key=lambda p: (p == keep, p is not None, p or 0)):
            alone = len(payload) < least
            first = p == keep and not responses
            responses += first
            want.append((p, len(payload), digest, *(("response", None) if alone or first else ("revisit", keep))))
    plain = lambda x: tuple((v is None, "" if v is None else v) for v in x)
    have = [(g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got]
    assert sorted(have, key=plain) == sorted(want, key=plain)
    keys = [(g["url_key"], g["timestamp"], g["page_id"] is not None, g["page_id"] or 0) for g in got]
    assert keys == sorted(keys)
    for g in got:  # the index leads to the record
        with gzip.open(os.path.join(target.removeprefix("file:"), g["file"])) as f:
            f.seek(g["offset"])
            head = f.read(g["length"])
        assert head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n") and g["payload_digest"].encode() in head


def test_no_pages(spark):
    assert archived(spark, [])[1] == []


def test_loser_tree():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((r.randrange(50), i) for i in range(r.randint(0, 30))) for _ in range(n)]
        got = list(warc.LoserTree([[(x[0], (x, k)) for x in run] for k, run in enumerate(runs)]))
        want = sorted(((x, k) for k, run in enumerate(runs) for x in run), key=lambda e: (e[0][0], e[1]))
        assert [(x[0], k) for x, k in got] == [(x[0], k) for x, k in want]


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.com:443/A/b/?q=1#f") == "com,example)/a/b?q=1"
    assert warc.url_key(None) == "" and warc.url_key("http://x.org") == "org,x)/"


def test_a_changed_payload_is_noticed():
    record = warc.warc_record(1, "http://a.b/", b"payload", None, False, warc.base32_digest(b"payload"))
    rows = list(warc.records(gzip.compress(record + warc.BREAK + record + warc.BREAK)))
    assert [r[0] for r in rows] == [0, len(record) + 4]
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(record[:-3])))
