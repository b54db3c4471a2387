"""Token ids by the ``tokenizers`` library, with a cache of words in front of it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

_SAFE = re.compile(r"(?<=\S)(?=\s)")
_LONG = 256
_SPACE = chr(256 + 32)  # what byte-level vocabularies write for a space
#: A word of letters, signs behind it, and the same again after a line's end: separate pieces for the pre-tokeniser.
_PARTS = re.compile(r"([^\W\d_]+)([^\w\s']*)(?:\n([^\W\d_]+)([^\w\s']*))?")
_PART, _BIG = 1 << 16, 1 << 21


class WordEncoder:
    """Encodes texts with a byte-level BPE file; the ids are those of encoding the whole text.

    The pre-tokeniser of such files always ends a piece before a space that follows a visible
    character, and before the last space of a run. A text without longer runs of white space can
    therefore be cut at every space, and each word looked up; words not seen before go to the
    library in batches, signs behind a word and a line's end by themselves. Texts with longer runs are encoded directly, in parts cut at safe places.
    The cache holds ``most`` words and is emptied when full.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.most, self.words, self.heads = most, {}, {}
        self.spaced = np.zeros(self.size, bool)  # ids that begin with a space
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(_SPACE)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: dict[str, bytes], new: set[str], before: str) -> None:
        """Words behind a space are encoded as one text, which the ids that begin with a space cut again."""
        names, per = list(new), 512 if before else 4096
        for at in range(0, len(names), per):
            part = names[at : at + per]
            if before:
                ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(part)], add_special_tokens=False)[0].ids, "<u4")
                data, cuts = ids.tobytes(), [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
                if len(cuts) == len(part) + 1:
                    words.update((w, data[a:b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))
                    continue
            words.update(zip(part, self._encode([before + w for w in part]), strict=True))

    def _direct(self, text: str) -> bytes:
        return b"".join(x for part in self._parts(text, _PART) for x in self._encode([part]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of unsigned 32-bit ids for each text; null and empty texts have none.

        Texts are taken some megabytes at a time, and a longer one in parts, so that memory follows
        the ids, not the words.
        """
        out, lot, size = [], [], 0
        for text in texts:
            if len(text or "") > _BIG:
                out += self._some(lot)
                lot, size = [], 0
                out.append(np.concatenate([self._some([part])[0] for part in self._parts(text, _BIG)]))
                continue
            lot.append(text)
            size += len(text or "")
            if size > _BIG:
                out += self._some(lot)
                lot, size = [], 0
        return out + self._some(lot)

    @staticmethod
    def _parts(text: str, size: int) -> Iterator[str]:
        at = 0
        while at < len(text):
            m = _SAFE.search(text, at + size) if at + size < len(text) else None
            to = m.start() if m else len(text)
            yield text[at:to]
            at = to

    def _some(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").split(" ") for t in texts]
        if len(self.words) > self.most:
            self.words.clear()
            self.heads.clear()
        new = set().union(*(s[1:] for s in split)).difference(self.words)
        odd = {w for w in new if not w or w[0].isspace() or len(w) > _LONG}  # white spaces meet before these, or too long to keep
        whole, parts, heads = [], [], {s[0] for s in split if len(s[0]) <= _LONG}
        for w in new - odd:
            m = None if w.isalpha() else _PARTS.fullmatch(w)
            if m is None or m.end(1) == len(w):
                whole.append(w)
            else:
                parts.append((w, m.groups()))
                whole.append(m[1])
                heads.update(m.group(2, 4) if m[3] is None else (m[2], "\n", m[3], m[4]))
        self._learn(self.words, set(whole).difference(self.words), " ")
        self._learn(self.heads, heads.difference(self.heads, (None,)), "")
        for w, (a, b, c, d) in parts:
            self.words[w] = self.words[a] + self.heads[b] + (b"" if c is None else self.heads["\n"] + self.heads[c] + self.heads[d])
        out = []
        for text, words in zip(texts, split, strict=True):
            head, words = words[0], words[1:]
            if odd and not odd.isdisjoint(words):
                ids = self._direct(text)
            else:
                ids = (self.heads[head] if len(head) <= _LONG else self._direct(head)) + b"".join(map(self.words.__getitem__, words))
            out.append(np.frombuffer(ids, "<u4"))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, then from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES: dict[str, list[bytes]] = {}


def id_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    if path not in _BYTES:
        tokenizer, byte = encoder(path).tokenizer, _byte_of_character()
        special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        table = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            table[i] = special.get(i) or bytes(byte[c] for c in token)
        _BYTES[path] = table
    return _BYTES[path]
