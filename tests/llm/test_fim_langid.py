"""Fill-in-middle against plain slices, language filters against exact sets and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import fim, langid

from .conftest import local

SF = "/root/testdata/sf0.01"
WORDS = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


def plain_form(doc, text, unit="word", rule=fim.Rule()):
    text = text or ""
    units = WORDS.findall(text) if unit == "word" else list(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_index_converts_both_ways():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab é€😀́") for _ in range(r.randint(0, 60)))
        index = fim.Multibyte(np.frombuffer(text.encode(), np.uint8))
        cuts = np.arange(len(text) + 1)
        at = np.array([len(text[:i].encode()) for i in cuts])
        assert (index.bytes(cuts) == at).all() and (index.chars(at) == cuts).all() and index.length() == len(text)
        assert len(index.at) == sum(ord(c) > 127 for c in text)


@pytest.mark.parametrize("unit", ["word", "char"])
def test_forms_and_restoration(spark, edge_docs, no_docs, unit):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("ab<é€ \n\x0b😀PSM>") for _ in range(r.randint(0, 40)))) for i in range(400)]
    rows += [(1000, "has <P> in it"), (1001, "<"), (None, "no id"), (7, None), (1002, " \t "), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    rule = fim.Rule(unit=unit)
    made = fim.transformed(docs, rule)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"), rule)).collect()
    want = [(plain_form(d, t, unit), t or "") for d, t in docs.collect()]
    key = lambda x: str(x)
    assert sorted(((g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output, g.back) for g in got), key=key) == sorted(
        ((*w, t) for w, t in want), key=key
    )
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    for g in got:
        if g.form != "plain":
            whole = g.back.encode()
            assert len(whole[:g.prefix_bytes].decode()) == g.prefix_chars
            assert len(whole[g.prefix_bytes:g.prefix_bytes + g.middle_bytes].decode()) == g.middle_chars
    assert local(fim.transformed(no_docs)).empty


def test_rules_are_checked(spark, edge_docs):
    for rule in (fim.Rule(unit="line"), fim.Rule(prefix=""), fim.Rule(prefix="<S>")):
        with pytest.raises(ValueError):
            fim.transformed(edge_docs, rule)


# ---- languages


def exact_sets(docs):
    """Language -> the hashes it contains, counted with dictionaries."""
    from collections import Counter

    counts: dict = {}
    for lang, text in docs:
        points = langid.spelled([text], langid.letters())[0]
        for parts in langid.grams(points):
            for size, (g, _) in enumerate(parts, 1):
                counts.setdefault((lang, size), Counter()).update(g.tolist())
    share = {(lang, g): n / c.total() for (lang, _), c in counts.items() for g, n in c.items()}
    top: dict = {}
    for (_, g), x in share.items():
        if x >= langid.MIN_SHARE:
            top[g] = max(top.get(g, 0), x)
    out: dict = {}
    for (lang, g), x in share.items():
        if x >= langid.MIN_SHARE and x * langid.RATIO >= top[g]:
            out.setdefault(lang, set()).add(g)
    return out


def strings(text):
    """Letter n-grams of a text, a space for a word's edge, by plain slices."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sorted(g for w in words for n in range(1, 5) for s in [f" {w} "] for g in (s[i:i + n] for i in range(len(s) - n + 1)) if g.strip() or n > 1)


def test_ngrams_are_those_of_plain_slices():
    """As many n-grams as slices, and equal hashes for equal slices only, over blocks of several texts."""
    texts = ["Äb ab-abc 12 x", "", "99", "ab", "Größe über alles über alles"]
    points, ends, lettered = langid.spelled(texts, langid.letters())
    assert lettered.tolist() == [True, False, False, True, True]
    found: list[list[int]] = [[] for _ in texts]
    for parts in langid.grams(points):
        for g, last in parts:
            for h, at in zip(g.tolist(), last.tolist()):
                found[np.searchsorted(ends, at, "right")].append(h)
    from collections import Counter

    for text, hashes in zip(texts, found):
        # A space that two words share is the edge of both.
        want = Counter(strings(text))
        assert sorted(Counter(hashes).values()) == sorted(want.values())


def test_filters_hold_what_languages_contain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    filters = langid.train(rows.select("doc_id", "lang", "text"))
    known = [(r.lang, r.text) for r in rows.where(~langid.held_out()).collect()]
    sets = exact_sets(known)
    assert filters.languages == sorted(sets)
    every = np.array(sorted(set().union(*sets.values())), np.uint64)
    masks = filters.masks(every)[0]
    wrong = total = 0
    for i, lang in enumerate(filters.languages):
        has = np.array([g in sets[lang] for g in every.tolist()])
        held = (masks >> i & 1).astype(bool)
        assert held[has].all()  # a Bloom filter forgets nothing
        wrong, total = wrong + int((held & ~has).sum()), total + int((~has).sum())
    assert wrong / total < 5e-3 and (filters.rates < 5e-3).all()
    # The correction takes the expected false positives away.
    crowded = langid.train(rows.select("doc_id", "lang", "text"), rows=1 << 15)
    strange = np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64)
    counts = crowded.counts(strange, np.zeros(len(strange), np.int64), 1)[0][:len(crowded.languages)]
    assert (crowded.rates > 0.01).any()
    assert np.allclose((counts - len(strange) * crowded.rates) / len(strange), 0, atol=0.02)


def test_held_out_accuracy(spark):
    made = langid.op13(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = made.merge(lang, on="doc_id")
    assert len(both) == len(lang) and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert len(held) > 250 and (held.lang_pred == held.lang).mean() > 0.99


def test_languages_of_edges(spark, edge_docs, no_docs):
    train = spark.createDataFrame([(None, "xx", "aaa bbb " * 50), (None, "yy", "ccc ddd " * 50), (None, None, "eee"), (None, "xx", None)], "doc_id long, lang string, text string")
    filters = langid.train(train)
    got = langid.identified(edge_docs, filters).collect()
    want_und = {r.doc_id for r in edge_docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert {g.doc_id for g in got if g.lang_pred == "und"} == want_und and len(got) == edge_docs.count()
    assert all(g.lang_pred in ("xx", "yy", "und") and 0 <= g.score <= 1 for g in got)
    asked = spark.createDataFrame([(1, "bbb"), (2, "ccc!"), (3, "zzz qqq"), (4, "1234"), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identified(asked, filters).collect()} == {1: "xx", 2: "yy", 3: "xx", 4: "und", 5: "und"}
    nothing = langid.train(train.where("false"))
    assert {r.lang_pred for r in langid.identified(asked, nothing).collect()} == {"und"}
    assert local(langid.identified(no_docs, filters)).empty


def test_long_texts_equal_their_parts(monkeypatch):
    """Counts do not depend on where stretches and blocks are cut."""
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcäöé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 80))) for _ in range(40)]
    filters = langid.Filters(["a", "b"], np.random.default_rng(3).integers(0, 4, (1, 1 << 12)).astype(np.uint8), np.array([0.1, 0.1]), np.array([1, 0]))
    whole = filters.decide(texts, langid.letters())
    for size in (16, 100, 1000):
        monkeypatch.setattr(langid, "BLOCK", size)
        cut = filters.decide(texts, langid.letters())
        assert cut[0] == whole[0] and np.allclose(cut[1], whole[1])


def test_many_languages(spark):
    """More than eight languages take more than one byte of the table; too many are refused."""
    names = [f"l{i:03d}" for i in range(30)]
    rows = [(3 * i, n, f"{chr(0x4E00 + i) * 3} {chr(0x5E00 + i) * 2} " * 20) for i, n in enumerate(names)]
    rows = [(d, n, t) for d, n, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = langid.train(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert filters.languages == names and filters.bits.shape[0] == 4
    assert filters.decide([t for _, _, t in rows], langid.letters())[0] == names
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.range(300).selectExpr("CAST(NULL AS BIGINT) doc_id", "CAST(id AS STRING) lang", "'a' text"))
