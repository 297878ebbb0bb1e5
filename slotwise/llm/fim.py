"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut into units: words with the white space before them (white space at the end is
a unit of its own), or code points. Two hashed draws choose where the prefix and where the
middle end; the rest is the suffix. Words are found as byte positions and reported in code
points, code-point units the other way round. Neither needs the text decoded: an index keeps
the position and the excess bytes of the multibyte characters alone, a binary search
in it tells how many bytes lie between, and stretches of ASCII are plain arithmetic.

Forms are written ``<P>prefix<S>suffix<M>middle`` (psm) and ``<S>suffix<P>prefix<M>middle`` (spm).
Empty texts, texts that hold a marker and those the draw leaves out stay as they are (plain).

Draws depend on the seed and doc_id alone: repeated rows get the same form, and rows of one id
with different texts the same draws. A null id is drawn as an empty one, a null text is empty,
and prefix and middle may be empty where both draws tie. Very long texts are cut whole, in time
linear in their length. An empty table gives an empty result. Only ``doc_id`` and ``text`` are
read, so other columns may have any name. All work is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, query, raw_texts, sized_pieces, table, texts

# White space of the contract: space and \x09 to \x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Rule:
    """How texts are cut and how often each form is used."""

    seed: int = 42
    unit: str = "word"  # or "char"
    cut_percent: int = 50
    spm_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def markers(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


class Multibyte:
    """The exceptions to one byte a character: where they stand and how many bytes they add."""

    def __init__(self, raw: np.ndarray):
        self.size = len(raw)
        self.at = np.flatnonzero(raw >= 0xC0)
        first = raw[self.at]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.grown = np.concatenate([[0], np.cumsum(excess)])
        self.points = self.at - self.grown[:-1]

    def chars(self, byte):
        """Code points before a byte position where a character begins."""
        return byte - self.grown[np.searchsorted(self.at, byte)]

    def bytes(self, char):
        """The byte position of a code point."""
        return char + self.grown[np.searchsorted(self.points, char)]

    def length(self) -> int:
        return self.size - int(self.grown[-1])


def word_ends(raw: np.ndarray) -> np.ndarray:
    """Byte positions at which the units of words end."""
    if not len(raw):
        return np.zeros(0, np.int64)
    white = WHITE[raw]
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.append(ends, len(raw))


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


def cut(text: bytes, doc_id: int | None, rule: Rule) -> tuple:
    """(units, form, byte and code-point lengths of prefix and middle, output) of one text."""
    raw = np.frombuffer(text, np.uint8)
    if rule.unit == "word":
        ends, index = word_ends(raw), None
        n = len(ends)
    else:
        index = Multibyte(raw)
        n = index.length()
    p, s, m = rule.markers()
    h1, h2, h3, h4 = draws(rule.seed, doc_id)
    if not text or h3 % 100 >= rule.cut_percent or p in text or s in text or m in text:
        return n, "plain", None, None, None, None, text
    units = np.sort([h1 % (n + 1), h2 % (n + 1)])
    index = Multibyte(raw) if index is None else index
    if rule.unit == "word":
        at = np.where(units > 0, ends[units - 1], 0)
        chars = index.chars(at)
    else:
        chars, at = units, index.bytes(units)
    (a, b), (x, y) = at.tolist(), chars.tolist()
    form = "spm" if h4 % 100 < rule.spm_percent else "psm"
    parts = [s, text[b:], p, text[:a], m, text[a:b]] if form == "spm" else [p, text[:a], s, text[b:], m, text[a:b]]
    return n, form, a, b - a, x, y - x, b"".join(parts)


MADE = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_bytes", pa.int64()), ("middle_bytes", pa.int64()),
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
])
MADE_DDL = (
    "doc_id long, n long, form string, prefix_bytes long, middle_bytes long, prefix_chars long, middle_chars long, output string"
)


def transformed(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per document its number of units, its form, the cuts (null if plain) and the output text."""
    if rule.unit not in ("word", "char"):
        raise ValueError("unit is word or char")
    if len(set(rule.markers())) < 3 or not all(rule.markers()):
        raise ValueError("three different markers are needed")

    def run(batches):
        def rows():
            for batch in batches:
                for doc, text in zip(cells(batch, "doc_id"), raw_texts(batch)):
                    yield doc, *cut(text, doc, rule)

        yield from sized_pieces(rows(), MADE)

    return texts(docs).mapInArrow(run, MADE_DDL)


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text rebuilt from output and form alone; markers occur once each in a form that is not plain."""
    def parts(first: str, second: str) -> tuple[Column, Column]:
        """What follows the first marker, and what follows the second up to the middle's."""
        head = F.substring_index(output, rule.middle, 1)
        return F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1)

    middle = F.substring_index(output, rule.middle, -1)
    prefix, suffix = parts(rule.prefix, rule.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = parts(rule.suffix, rule.prefix)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


# White space is spelled out: DuckDB's \s lacks the vertical tab.
SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text,
    regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
    ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
  FROM drawn
), placed AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM placed
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_fill_in_middle", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
