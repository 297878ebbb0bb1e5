"""Token ids of whole texts with a public tokenizer file, one encoding per distinct word."""

from __future__ import annotations

import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

END = 2
ENCODER = "word_bpe_49k.json"
CLOSING = string.punctuation
#: Letters below this code point are composed already and have simple lower-case forms.
SIMPLE = "\u0250"

# Of bytes: ASCII white space, closing punctuation, a letter's end, and lower case for ASCII.
SPACE, CLOSES, LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = CLOSES[list(CLOSING.encode())] = LETTER[list(string.ascii_letters.encode())] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The first byte, in UTF-8, of code points from U+0240 on: SIMPLE and all above it.
FAR = SIMPLE.encode()[0]


def tokenizer_path(name: str = ENCODER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """UTF-8 word -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer removes white space before it looks for tokens and none of its
    rules spans white space, so a text's ids are its words' ids in order. Words are
    cut at ASCII white space only; other white space stays inside a word and is
    left to the tokenizer. A word of plain Latin letters is looked up in lower case and
    without its closing punctuation, which is a token run of its own, and goes to the
    tokenizer's merge model at once. ``limit`` bounds the entries kept.
    """

    def __init__(self, path: str, limit: int = 1_000_000, longest: int = 64):
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        # Printable bytes stand for themselves in the model, the rest for code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def encode(self, word: bytes) -> bytes:
        return np.array(self.encoder.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, word: bytes) -> bytes:
        shown = word.decode() if word.isascii() else "".join(map(self.letters.__getitem__, word))
        return array("I", [t.id for t in self.encoder.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > self.longest:
            return self.encode(word)
        if len(self) >= self.limit:
            self.clear()
        if word.isalpha() and word.islower():  # of bytes: ASCII alone
            self[word] = out = self.merge(word)
            return out
        s = word.decode()
        if "<|" in s or max(s) >= SIMPLE:
            out = self.encode(word)
        elif s[-1] in CLOSING and (core := s.rstrip(CLOSING))[-1:].lower().isalpha():
            head = core.encode()
            out = self[head] + self[word[len(head):]]
        elif (low := s.lower()) != s and max(low) < SIMPLE:
            out = self[low.encode()]
        elif low == s and s.isalpha():
            out = self.merge(word)
        else:
            out = self.encode(word)
        self[word] = out
        return out

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts data[bounds[i]:bounds[i + 1]] in order, and how many each text has.

        The same as ``text``, but a word is looked up once for all texts, in lower case and without its
        closing punctuation already, by the rules of ``__missing__``.
        """
        solid = ~SPACE[data]
        if not solid.any():
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        opens[inner] = solid[inner]  # texts touch
        places = np.where(bounds > 0, np.cumsum(solid, dtype=np.int32)[bounds - 1], 0)
        data, first = data[solid], np.flatnonzero(opens[solid])
        last = np.append(first[1:], len(data))
        # Words that are left as they are.
        odd = data >= FAR
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        whole = last - first > self.longest
        whole[np.searchsorted(first, np.flatnonzero(odd), "right") - 1] = True
        # Where the closing punctuation behind a letter begins.
        core = np.maximum.accumulate(np.where(CLOSES[data], 0, np.arange(1, len(data) + 1, dtype=np.int32)))[last - 1]
        end = data[core - 1]
        letter = LETTER[end] | ((data[core - 2] == 0xC3) & (end >= 0x80) & (end != 0x97) & (end != 0xB7))  # not a sign
        cut = core[(core > first) & (core < last) & letter & ~whole]
        low = LOWER[data]
        if whole.any():
            kept = np.repeat(whole, last - first)
            low[kept] = data[kept]
        marks = np.zeros(len(data) + 1, bool)
        marks[first] = marks[cut] = marks[-1] = True
        at = np.flatnonzero(marks).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(low)]).dictionary_encode()
        found = list(map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which, ids = words.indices.to_numpy(), np.frombuffer(b"".join(found), "<u4")
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])]
        return out, np.diff(ends[np.searchsorted(at, places)])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memo for each Python worker."""
    return WordIds(path)
