"""SentencePiece encoding against a plain dynamic program and the library's decoder."""

import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from slotwise.llm import pieces
from slotwise.llm.tokens import tokenizer_path

from .conftest import EDGE_TEXTS, local


@pytest.fixture(scope="module")
def machine():
    return pieces.Pieces(tokenizer_path(pieces.MODEL), limit=500)


@pytest.fixture(scope="module")
def scores():
    with open(tokenizer_path(pieces.MODEL), "rb") as f:
        return {p.piece: p.score for p in pb.ModelProto.FromString(f.read()).pieces if p.type == pieces.NORMAL}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))


def best_score(text, scores, worst):
    if not text:
        return 0
    w = "▁" + text.replace(" ", "▁")
    best = [0.0]
    for end in range(1, len(w) + 1):
        best.append(max([best[-1] + worst, *(best[i] + scores[w[i:end]] for i in range(max(0, end - 16), end) if w[i:end] in scores)]))
    return best[-1]


def check(text, machine, scores, library):
    ids, score = machine.encode(text.encode())
    ids = list(memoryview(ids).cast("I"))
    assert score == best_score(text, scores, machine.worst), repr(text)
    back = machine.decode(ids).decode()
    assert back == text.replace("▁", " ")
    assert library.decode(ids).lstrip(" ") == back.lstrip(" ")


def test_random_texts(machine, scores, library):
    r = random.Random(4)
    for _ in range(2000):
        check("".join(r.choice("abcthe  \n\tÉé😀文ﬁ▁0 1.,!") for _ in range(r.randint(0, 12))), machine, scores, library)


@pytest.mark.parametrize("text", [t for t in EDGE_TEXTS if t is not None])
def test_edge_texts(text, machine, scores, library):
    check(text, machine, scores, library)


def test_ties_take_the_longer_last_piece():
    m = pieces.Pieces.__new__(pieces.Pieces)
    import ahocorasick

    m.automaton, m.worst, m.byte_ids, m.unknown = ahocorasick.Automaton(), -100, {}, 0
    for i, (p, s) in enumerate({"a": -1, "b": -1, "c": -1, "ab": -2, "bc": -2}.items(), 1):
        m.automaton.add_word(p, (len(p), i, s))
    m.automaton.make_automaton()
    assert list(memoryview(m.viterbi("abc")[0]).cast("I")) == [1, 5]
    assert list(memoryview(m.viterbi("axc")[0]).cast("I")) == [1, 0, 3]


def test_tables(spark, edge_docs, no_docs):
    got = local(pieces.round_trip(edge_docs))
    texts = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    for r in got[got.doc_id.notna()].itertuples():
        text = texts[r.doc_id]
        assert r.round_trip == ("▁" not in text)
        assert r.decoded_sha256 == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
    assert len(got) == edge_docs.count()
    assert pieces.round_trip(no_docs).collect() == []
    ids = pieces.encoded(edge_docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(ids.where("doc_id is not null")).collect()}
    assert back == {k: v.replace("▁", " ") for k, v in texts.items() if k is not None}
