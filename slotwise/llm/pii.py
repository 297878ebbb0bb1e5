"""Personal data: fixed patterns, and spans added by a semi-Markov conditional random field.

The patterns are searched from left to right, one kind at a time, and matches that fail
a kind's check are dropped. The random field then reads regions: neighbouring chunks of a
text that hold a digit, an at sign or a bracketed "at" / "dot". It scores candidate
segments of at most LONGEST tokens as wholes (how many digits, which separators, checksum,
number of dotted parts, what stands next to the segment), and a dynamic program over
the tokens picks the best sequence of segments and single outside tokens. A segment it
finds is added if it meets no pattern's span; pattern spans stay.

Weights come from conditional likelihood on at most ``train_regions`` regions of about
``sample_docs`` documents chosen by a hash of doc_id. Pattern spans label them, together
with rewritten copies (phone without plus, spelled or bracketed separators) and broken
copies that are not personal data (wrong check digit, part above 255).

Null and empty texts have no spans. Long texts are read whole, and a region of any length is one
sequence to the dynamic program; all work is linear in their length (a logarithm of the number of
pattern spans besides). Of equal segmentations the one with fewer segments, then with the earlier start, is
taken. Repeated rows get the same spans. Without a region to learn from nothing is added. An empty table
gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, in_pieces, query, table, texts

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where its run of digits begins, so looking back changes no match
# and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]", re.I)
LONGEST, TRAIN_LENGTH = 24, 160
#: Candidate segments of a region are scored for so many end tokens at a time.
STRETCH = 512


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small_part(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(small_part, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = only_digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m.group())) <= 15]
    return ordered(out)


def ordered(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- regions and segments

CHUNK = re.compile(r"\S+")
SPELLED = re.compile(r"[\[({<](?:at|dot)[\])}>]", re.I)
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Neighbouring chunks that may hold personal data; a bracketed "at" or "dot" takes both
    its neighbours along. Only the surroundings of anchors are cut into chunks."""
    start = end = -1
    for m in ANY.finditer(text):
        if m.start() < end:
            continue
        spelled = m.group()[0] not in "0123456789@"
        a, b = _chunk(text, m.start())
        if spelled and text[a:b] == m.group():
            a = _chunk(text, a - 2)[0] if a > 1 and text[a - 1] == " " and text[a - 2] != " " else a
            b = _chunk(text, b + 1)[1] if b + 1 < len(text) and text[b] == " " and text[b + 1] != " " else b
        a = max(a, 0)
        if start >= 0 and a <= end + 1 and "\n" not in text[end:a]:
            end = max(end, b)
        else:
            if start >= 0:
                yield start, end
            start, end = max(a, end), b
    if start >= 0:
        yield start, end


def _chunk(text: str, at: int) -> tuple[int, int]:
    a = at
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    return a, CHUNK.match(text, a).end()


FEATURES = (
    "bias", "at", "spelled at", "plus first", "parenthesis", "dash", "dot", "space", "letters", "other sign",
    "under 7 digits", "7 to 9 digits", "10 digits", "11 to 13 digits", "14 to 16 digits", "17 to 19 digits", "over 19 digits",
    "checksum", "four parts", "four small parts", "bracketed dots", "domain end", "letters after digits only",
    "edge inside chunk left", "edge inside chunk right", "sign at right edge", "sign at left edge", "digit groups over 2", "one digit group",
    "date", "digits go on left", "digits go on right", "bracket goes on left", "bracket goes on right",
)
DATE = re.compile(r"(?<![0-9])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9])|[0-9]:[0-9]")
# Texts with digits that are not personal data.
PLAIN = (
    "2024-01-05 12:30:00", "2023-11-30", "12/31/2024 08:15", "05.07.2021 10:00", "2020-02-29 2021-03-01", "1,234,567.89",
    "3.14159265", "version 4.0.12", "978-3-16-148410-0", "1024 2048 4096", "10 20 30 40 50 60 70", "0.001 0.002 0.003",
)


def features(s: str, left: str, right: str) -> list[int]:
    """Places in FEATURES that hold for the whole segment ``s``, given two characters on either side."""
    digits = only_digits(s)
    n, groups = len(digits), re.findall("[0-9]+", s)
    plain = re.sub(r"[\[({<](?:dot|\.)[\])}>]|\s+dot\s+", ".", s, flags=re.I)
    plain_at = re.sub(r"\s*[\[({<](?:at|@)[\])}>]\s*", "@", re.sub(r"\s*[\[({<]dot[\])}>]\s*", ".", s, flags=re.I), flags=re.I)
    parts = plain.split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    domain = bool(re.search(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$", plain_at))
    size = 10 + (n >= 7) + (n >= 10) + (n >= 11) + (n >= 14) + (n >= 17) + (n >= 20)
    held = {
        0: True, 1: "@" in s, 2: bool(re.search(r"[\[({<](?:at|@)[\])}>]", s, re.I)), 3: s[0] == "+",
        4: "(" in s and ")" in s and not re.search("[A-Za-z]", s), 5: "-" in s, 6: "." in s, 7: " " in s,
        8: bool(re.search("[A-Za-z]", s)), 9: bool(re.search(r"[^A-Za-z0-9\s+().@_%\[\]{}<>-]", s)), size: True,
        17: n >= 14 and luhn(digits), 18: four, 19: four and all(map(small_part, parts)), 20: plain != s, 21: domain,
        22: bool(re.search("[0-9][A-Za-z]|[A-Za-z][0-9]", s)), 23: bool(left) and not left[-1].isspace(), 24: bool(re.match(r"[^\s.,;:!?]|[.,;:!?][^\s]", right)),
        25: not s[-1].isalnum(), 26: not s[0].isalnum() and s[0] not in "+(", 27: len(groups) > 2, 28: len(groups) == 1,
        29: bool(DATE.search(s)), 30: bool(re.search("[0-9][ .-]?$", left)) and s[0].isdigit(),
        31: bool(re.match("[ .-]?[0-9]", right)) and s[-1].isdigit(),
        32: bool(re.search(r"[\])}>]\s?$", left)), 33: bool(re.match(r"\s?[\[({<]", right)),
    }
    return [i for i, yes in held.items() if yes]


class Candidates:
    """The candidate segments of a text that end at some of its tokens, with their features."""

    def __init__(self, text: str, tokens: list, anchors: np.ndarray, first: int, last: int):
        """Segments whose last token is one of first to last - 1."""
        self.spans, rows = [], []
        for i in range(max(0, first - LONGEST + 1), last):
            a = tokens[i][0]
            if text[a].isspace():
                continue
            for j in range(max(i, first), min(i + LONGEST, last)):
                b = tokens[j][1]
                # A segment holds its digits or its at sign whole, so shorter ones cannot be any kind.
                if b - a < 7 or anchors[j + 1] == anchors[i] or text[tokens[j][0]].isspace():
                    continue
                self.spans.append((i, j + 1))
                rows.append(features(text[a:b], text[max(0, a - 2):a], text[b:b + 2]))
        self.x = np.zeros((len(rows), len(FEATURES)))
        for r, held in enumerate(rows):
            self.x[r, held] = 1


def token_table(text: str) -> tuple[list, np.ndarray]:
    """Tokens, and how many of those before each may stand in personal data."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    return tokens, np.cumsum([0, *(text[a] in "0123456789@" or text[a:b].lower() in ("at", "dot") for a, b in tokens)])


def segmented(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation of a whole text: (kind, start, end) of its segments.

    The dynamic program runs over all tokens at once; only the candidates' features are held for STRETCH
    end tokens at a time, so memory besides a few numbers a token does not grow with the text.
    """
    tokens, anchors = token_table(text)
    value, back = [0.0], [None]
    for first in range(0, len(tokens), STRETCH):
        last = min(first + STRETCH, len(tokens))
        found = Candidates(text, tokens, anchors, first, last)
        ends: list[list[int]] = [[] for _ in range(last - first)]
        for r, (_, j) in enumerate(found.spans):
            ends[j - 1 - first].append(r)
        scores = found.x @ weights.T
        kind, top = (scores.argmax(1), scores.max(1)) if len(scores) else ((), ())
        for at in ends:
            v, b = value[-1], None
            for r in at:
                i = found.spans[r][0]
                if (got := value[i] + top[r]) > v:
                    v, b = got, (int(kind[r]), i)
            value.append(v)
            back.append(b)
    out, j = [], len(tokens)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            k, i = back[j]
            out.append((k, tokens[i][0], tokens[j - 1][1]))
            j = i
    return out[::-1]


class Region(Candidates):
    """A short text to learn from, with all its candidate segments."""

    def __init__(self, text: str):
        self.tokens, anchors = token_table(text)
        super().__init__(text, self.tokens, anchors, 0, len(self.tokens))
        self.ends: list[list[int]] = [[] for _ in range(len(self.tokens) + 1)]
        for r, (_, j) in enumerate(self.spans):
            self.ends[j].append(r)

    def gradient(self, weights: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Gradient of the log-likelihood of the gold segments, by forward and backward sums."""
        scores = self.x @ weights.T
        n = len(self.tokens)
        mass = np.logaddexp.reduce(scores, axis=1)
        forward = np.full(n + 1, -np.inf)
        forward[0] = 0
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[self.spans[r][0]] + mass[r] for r in self.ends[j])])
        backward = np.full(n + 1, -np.inf)
        backward[n] = 0
        for j in range(n, 0, -1):
            backward[j - 1] = np.logaddexp(backward[j - 1], backward[j])
            for r in self.ends[j]:
                i = self.spans[r][0]
                backward[i] = np.logaddexp(backward[i], backward[j] + mass[r])
        at = np.array(self.spans)
        share = np.exp(forward[at[:, 0]][:, None] + scores + backward[at[:, 1]][:, None] - forward[n])
        want = np.zeros_like(share)
        for r, span in enumerate(self.spans):
            if span in gold:
                want[r, gold[span]] = 1
        return (want - share).T @ self.x


def gold_segments(region: Region, spans: list) -> dict[tuple[int, int], int]:
    starts, ends = {a: i for i, (a, _) in enumerate(region.tokens)}, {b: i + 1 for i, (_, b) in enumerate(region.tokens)}
    return {(starts[a], ends[b]): KINDS.index(k) for k, a, b in spans if a in starts and b in ends}


def variants(text: str, spans: list) -> Iterator[tuple[str, list]]:
    """The region itself, and for each span a rewritten and a broken copy."""
    yield text, spans
    for kind, a, b in spans:
        s = text[a:b]
        if kind == "phone":
            if (bare := s[1:].lstrip()) and len(only_digits(bare)) >= 10 and re.search(r"[().-]", bare):
                yield bare, [(kind, 0, len(bare))]
            if (local := re.sub(r"^\+[0-9]{1,3}\s*(?=\()", "", s)) != s:
                yield local, [(kind, 0, len(local))]
            dotted = re.sub(r"[\s()-]+", ".", s[1:]).strip(".")
            yield dotted, [(kind, 0, len(dotted))] if dotted.count(".") >= 2 else []
            yield only_digits(s)[:9], []
        elif kind == "email":
            for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", ".")):
                spelled = s.replace("@", at)
                head, tail = spelled.split(at, 1)
                spelled = head + at + tail.replace(".", dot)
                yield spelled, [(kind, 0, len(spelled))]
            yield s.replace("@", "."), []
        elif kind == "ip":
            yield s.replace(".", "[.]"), [(kind, 0, len(s.replace(".", "[.]")))]
            yield re.sub(r"^[0-9]+", "7" + s.split(".")[0].zfill(3), s), []
            yield ".".join(s.split(".")[:3]), []
        elif kind == "card":
            digits = only_digits(s)
            for sign in ".-":
                grouped = sign.join(digits[i:i + 4] for i in range(0, len(digits), 4))
                yield grouped, [(kind, 0, len(grouped))]
            yield digits[:-1] + str((int(digits[-1]) + 3) % 10), []


def fit(samples: list[tuple[str, list]], passes: int = 12, rate: float = 0.4, decay: float = 2e-4) -> np.ndarray:
    """Weights (kind x feature) by adaptive gradient steps on the conditional likelihood."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -4.0
    examples = []
    for text, spans in [*samples, *((t, []) for t in PLAIN * 4)]:
        for t, s in variants(text, spans):
            region = Region(t)
            if region.spans:
                examples.append((region, gold_segments(region, s)))
    if not any(gold for _, gold in examples):
        weights[:, 0] = -1e9
        return weights
    squares = np.full_like(weights, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(examples)):
            g = examples[i][0].gradient(weights, examples[i][1]) - decay * weights
            squares += g * g
            weights += rate * g / np.sqrt(squares)
    return weights


def train(docs: DataFrame, train_regions: int = 500, sample_docs: int = 20_000) -> np.ndarray:
    rows = texts(docs)
    share = min(1.0, sample_docs / max(1, rows.count()))
    picked = rows.withColumn("_h", F.xxhash64("doc_id")).where(F.pmod("_h", F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    schema = pa.schema([("h", pa.int64()), ("at", pa.int64()), ("region", pa.string()), ("spans", pa.string())])

    def run(batches):
        def rows():
            for batch in batches:
                for h, text in zip(cells(batch, "_h"), cells(batch, "text")):
                    spans = base_spans(text)
                    for a, b in regions(text):
                        if b - a <= TRAIN_LENGTH:
                            inside = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]
                            yield h, a, text[a:b], written(inside)

        yield from in_pieces(rows(), schema)

    found = picked.mapInArrow(run, "h long, at long, region string, spans string")
    # Half the regions have spans; both halves are bounded and in a fixed order.
    half = train_regions // 2
    taken = [
        r for want in ("spans <> ''", "spans = ''")
        for r in found.where(want).orderBy("h", "at", "region").limit(half).collect()
    ]
    parse = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    return fit([(r["region"], parse(r["spans"])) for r in taken])


def added_spans(text: str, base: list, weights: np.ndarray) -> list:
    """Segments the random field finds that meet no pattern span; ``base`` is in order of start."""
    starts = [a for _, a, _ in base]
    reached = list(accumulate((b for _, _, b in base), max))

    def reach(before: int) -> int:
        """Where the pattern spans that begin before a place end."""
        k = bisect_left(starts, before)
        return reached[k - 1] if k else -1

    out = []
    for a, b in regions(text):
        if b - a < 7 or reach(a + 1) >= b:
            continue
        for kind, p, q in segmented(text[a:b], weights):
            if reach(a + q) <= a + p:
                out.append((KINDS[kind], a + p, a + q))
    return out


FOUND = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()),
])
FOUND_DDL = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, counts and digest of the pattern spans, and all spans."""
    weights = train(docs) if weights is None else weights

    def run(batches):
        def rows():
            for batch in batches:
                for doc, text in zip(cells(batch, "doc_id"), cells(batch, "text")):
                    base = base_spans(text)
                    spans = ordered(base + added_spans(text, base, weights))
                    count = [sum(s[0] == k for s in base) for k in KINDS]
                    yield doc, *count, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)

        yield from in_pieces(rows(), FOUND)

    return texts(docs).mapInArrow(run, FOUND_DDL)


def redact_text(text: str, weights: np.ndarray) -> str:
    base = base_spans(text)
    out, done = [], 0
    for kind, a, b in ordered(base + added_spans(text, base, weights)):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The same rows and columns; each span in ``text`` gives way to its kind's name. A null text stays null."""
    weights = train(docs) if weights is None else weights

    @F.pandas_udf("string")
    def change(text):
        return text.map(lambda t: None if t is None else redact_text(t, weights))

    return docs.withColumn("text", change("text"))


@query("op2_semi_markov_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
