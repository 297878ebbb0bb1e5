"""Token ids, rANS blocks and packing against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from slotwise.llm import common, packing, rans
from slotwise.llm.tokens import END, WordIds, tokenizer_path


@pytest.fixture(scope="module")
def plain():
    encoder = Tokenizer.from_file(tokenizer_path())
    return lambda t: np.array(encoder.encode(t or "", add_special_tokens=False).ids + [END], "<u4")


def test_words_encode_like_whole_texts(plain):
    import random

    r, memo = random.Random(1), WordIds(tokenizer_path(), limit=300)
    pool = "abcXYZéÉßİıſKÅ'’.,!?<|>end 0123 \t\ń̇　中😀Σσςǅ_#%-@ "
    for _ in range(3000):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 14))) + ("<|endoftext|>." if r.random() < 0.1 else "")
        assert memo.text(s.encode()) == plain(s)[:-1].tobytes(), repr(s)
    assert len(memo) <= 301


def parts(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.cumsum([0, *map(len, texts)])


def test_texts_encode_together_like_one_by_one(plain):
    import random

    r, memo = random.Random(2), WordIds(tokenizer_path(), limit=300)
    pool = "abcXYZéÉÁáßİıſKÅÃÌ×÷'’.,!?<|>end 0123 \t\ń̇̌J　中😀Σσςǅ_#%-@ \x1c"
    ends = ["", "<|endoftext|>.", "<|ENDOFTEXT|>", "É" * 40 + ".", "x" * 64 + "!", "<", "|", "Don't."]
    for size in [0, 1, 2] + [40] * 60:
        texts = [("".join(r.choice(pool) for _ in range(r.randint(0, 14))) + r.choice(ends)).encode() for _ in range(size)]
        ids, n = memo.texts(*parts(texts))
        want = [plain(t.decode())[:-1] for t in texts]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w.tolist()]
    assert len(memo) <= 301


def test_texts_look_up_a_word_once():
    """Capitals and closing punctuation make no entries of their own."""
    memo = WordIds(tokenizer_path())
    memo.texts(*parts([f"{w}{end}".encode() for w in ("Wort", "wort", "WORT", "avió", "Avió") for end in ("", ",", ".", "!?")]))
    assert sorted(memo) == sorted(w.encode() for w in ("wort", "avió", ",", ".", "!?"))


def test_slices_keep_whole_texts_in_order(spark, prose, plain, monkeypatch):
    monkeypatch.setattr(rans, "SLICE", 700)
    texts = dict(map(tuple, prose.collect())) | {900: None, 901: "", 902: "Ä" * 3000 + " end", 903: " \n" * 2000, 904: "a. " * 999}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = rans.tokenized(docs, tokenizer_path()).collect()
    alone = rans.tokenized(docs.where("doc_id IN (900, 901)"), tokenizer_path()).collect()
    assert [(r["n_tokens"], r["order"]) for r in alone] == [(1, zlib.crc32(plain("").tobytes()))] * 2
    assert len(got) == len(texts)
    for row in got:
        ids = plain(texts[row["doc_id"]])
        assert (row["n_tokens"], bytes(row["ids"]), row["order"]) == (len(ids), ids.astype("<u2").tobytes(), zlib.crc32(ids.tobytes()))


@pytest.mark.parametrize("skew", [0.0, 0.9])
def test_blocks_round_trip_and_start_anywhere(skew):
    r = np.random.default_rng(3)
    ids = np.where(r.random(300_000) < skew, 7, r.integers(0, 5000, 300_000)).astype(np.uint32)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=5001)))
    for n in (0, 1, rans.LANES, rans.LANES + 1, 300_000):
        block = coder.encode(ids[:n])
        assert (coder.decode(block, n) == ids[:n]).all()
    for a, b in ((0, 5), (131_072, 131_080), (200_001, 299_999), (5, 5)):
        assert (coder.decode(block, 300_000, a, b) == ids[a:b]).all()
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert 8 * len(block["stream"]) / len(ids) < entropy + 0.3


def test_a_changed_block_is_noticed():
    coder = rans.Coder(rans.frequencies(np.array([5, 9, 1])))
    block = coder.encode(np.array([0, 1, 1, 2] * 30_000))
    block["stream"] = block["stream"][:-1] + bytes([block["stream"][-1] ^ 1])
    with pytest.raises(ValueError):
        coder.decode(block, 120_000)


@pytest.mark.parametrize("counts", [[0, 0], [1] * 40_000, [10**15, 1, 0, 3]])
def test_frequencies_fill_the_scale(counts):
    f = rans.frequencies(np.array(counts))
    assert f.sum() == ((1 << rans.SCALE) if sum(counts) else 0)
    assert ((f > 0) == (np.array(counts) > 0)).all()


def coded(spark, docs):
    target = common.folder(spark, "rans-test")
    rans.write(docs, target)
    return rans.read(spark, target).collect()


def test_documents_in_order(spark, prose, plain, monkeypatch):
    got = {r["doc_id"]: tuple(r)[1:] for r in coded(spark, prose)}
    start = 0
    for doc, text in sorted(map(tuple, prose.collect())):
        ids = plain(text)
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_edge_documents(spark, edge_docs, no_docs, plain):
    got = coded(spark, edge_docs)
    want = sorted((len(plain(r["text"])), zlib.crc32(plain(r["text"]).tobytes())) for r in edge_docs.collect())
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert coded(spark, no_docs) == []


def check_pieces(rows, texts, plain, limits):
    """texts: (doc_id, text) rows. Every id lies in one piece, sequences are gapless and keep the limits."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        documents.setdefault(r["doc_id"], []).append(r)
    for part in sequences.values():
        part.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in part] == np.cumsum([0, *(r["length"] for r in part)])[:-1].tolist()
        assert sum(r["length"] for r in part) <= limits.tokens and len(part) <= limits.segments
    want = {}
    for doc, text in texts:
        want.setdefault(doc, []).append(plain(text))
    assert sum(r["length"] for r in rows) == sum(len(i) for t in want.values() for i in t)
    for doc, part in documents.items():
        if len(want[doc]) > 1:
            continue
        part.sort(key=lambda r: r["start"])
        ids, at = want[doc][0], 0
        for r in part:
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return sequences


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=256, segments=4, loss=256), packing.Limits(tokens=512, segments=1000, loss=100)])
def test_pieces_of_documents(spark, prose, plain, limits):
    rows = packing.pack_documents(prose, limits, pool_items=16).collect()
    check_pieces(rows, [tuple(r) for r in prose.collect()], plain, limits)


def test_little_padding(spark, prose, plain):
    rows = packing.pack_documents(prose).collect()
    sizes = [sum(r["length"] for r in s) for s in check_pieces(rows, [tuple(r) for r in prose.collect()], plain, packing.Limits()).values()]
    padding = sum(packing.SEQUENCE - n for n in sizes if n & (n - 1))
    assert padding < 0.02 * sum(sizes)


def test_edge_pieces(spark, edge_docs, no_docs, plain):
    rows = packing.pack_documents(edge_docs).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in edge_docs.collect()], plain, packing.Limits())
    assert packing.pack_documents(no_docs).collect() == []


def test_examples_stay_whole(spark):
    r = np.random.default_rng(2)
    sizes = [(i, int(n), int(n * s * 0.65)) for i, (n, s) in enumerate(zip(r.integers(1, 90, 600), r.random(600)))] + [(600, None, None), (601, 100, 0)]
    limits = packing.Limits(tokens=100, segments=5, loss=60)
    rows = packing.pack_examples(spark.createDataFrame(sizes, "example_id long, n_tokens long, n_loss long").coalesce(2), limits, 64).collect()
    assert sorted(x["example_id"] for x in rows) == list(range(602))
    sequences = {}
    for x in rows:
        sequences.setdefault(x["sequence_id"], []).append(x)
    for part in sequences.values():
        assert sum(x["n_tokens"] for x in part) <= 100 and sum(x["n_loss"] for x in part) <= 60 and len(part) <= 5
    lower = max(sum(n or 0 for _, n, _ in sizes) / 100, sum(n or 0 for _, _, n in sizes) / 60)
    assert len(sequences) < 1.2 * lower + 2
    with pytest.raises(Exception, match="larger than a sequence"):
        packing.pack_examples(spark.createDataFrame([(1, 101, 0)], "example_id long, n_tokens long, n_loss long"), limits).collect()


def test_the_dot_product_chooses():
    pool = packing.Pool(packing.Limits(100, 10, 100), 4)
    for tokens, loss in ((60, 0), (50, 50), (30, 60)):
        pool.add(tokens, loss, tokens)
    # Much loss room and few tokens left: the item heavy in loss has the largest product.
    assert pool.what[pool.best(np.array([60.0, 10.0, 100.0]))] == 50
    assert pool.what[pool.best(np.array([40.0, 10.0, 100.0]))] == 30
    assert pool.best(np.array([20.0, 10.0, 100.0])) == -1


@pytest.mark.parametrize("segments", [1, 2, 3, 25])
def test_small_limits_on_segments_hold_to_the_end(segments):
    """What is left is dealt to powers of two within the limit, whole and in order."""
    items = [(i, 0, bytes(4 * n), n) for i, n in enumerate([7, 5, 1, 1, 9, 2, 1])]
    parts = list(packing._powers_of_two(items, segments))
    sizes = [sum(len(x[2]) // 4 for x in part) for part in parts]
    assert sum(sizes) == 26 and all(n & (n - 1) == 0 for n in sizes) and all(len(part) <= segments for part in parts)
    if segments == 25:
        assert sizes == [16, 8, 2]
