"""Token ids as the tokenizers library gives them, with the library asked once per pre-token.

Byte-level BPE encodes each pre-token by itself, so a text's ids are its
pre-tokens' ids in a row.  Pre-tokens repeat; the library's model encodes each new one,
and its answer is kept (at most ``keep`` of them).  The split below covers ASCII,
Latin letters and common punctuation; a text with anything else, or with a special
string, goes to the library whole.
"""

from __future__ import annotations

import re
from itertools import chain
from operator import itemgetter

import numpy as np

from sluice.llm.bpe_fst import byte_alphabet
from sluice.llm.common import model, pieces

LONG = 1 << 20  # characters
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNUSUAL = re.compile(rf"[^\t\n\r -~{LETTERS}¡§«­°·»¿–—‘-„…€]")
SPLIT = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
#: Byte -> the character that stands for it in a byte-level vocabulary.
SYMBOLS = {byte: shown for shown, byte in byte_alphabet().items()}


class Known(dict):
    """Pre-token -> its number; asking for a new one numbers it and notes it in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class LibraryIds:
    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        self.t, self.keep = Tokenizer.from_file(path), keep
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.model = self.t.model
        self.known = Known()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.n, (self.start, self.length, self.count) = 0, np.zeros((3, 1 << 16), np.int64)

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words without line feeds, each of which is one pre-token: the library's model gets them as it would from its own split."""
        symbols = "\n".join(words).encode().decode("latin-1").translate(SYMBOLS).split(SYMBOLS[10])
        found = [*map(self.model.tokenize, symbols)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((t.id for tokens in found for t in tokens), np.uint32, int(sizes.sum())), sizes

    def forget(self) -> None:
        """Of what is kept, only pre-tokens asked for again and again stay."""
        stay = np.flatnonzero(self.count[: self.n] >= 2)
        stay = stay[np.argsort(-self.count[stay], kind="stable")[: self.keep // 2]]
        words, known = list(self.known), Known()
        for i in stay.tolist():
            known[words[i]] = len(known)
        start, length = self.start[stay], self.length[stay]
        ends = np.cumsum(length)
        at = np.repeat(start - ends + length, length) + np.arange(int(length.sum()))
        self.pool, self.used, self.n = self.pool[at], len(at), len(stay)
        self.known, self.start, self.length, self.count = known, ends - length, length, self.count[stay] // 2

    def learn(self, words: list[str]) -> None:
        """Numbered words' ids go to the end of the pool, those of blanks last."""
        blank = [i for i, w in enumerate(words) if w.isspace()]
        solid = words
        if blank:
            drop = set(blank)
            solid = [w for i, w in enumerate(words) if i not in drop]
        got = [self.ask(solid[i : i + 8000]) for i in range(0, len(solid), 8000)]
        alone = [np.array(self.t.encode(words[i], add_special_tokens=False).ids, np.uint32) for i in blank]
        ids = np.concatenate([*(x[0] for x in got), *alone])
        sizes = np.concatenate([*(x[1] for x in got), np.array([len(x) for x in alone], np.int64)])
        first, last, upto = self.n, self.n + len(words), self.used + len(ids)
        if upto > len(self.pool):
            self.pool = np.resize(self.pool, 2 * upto)
        if last > len(self.start):
            self.start, self.length, self.count = (np.resize(x, 2 * last) for x in (self.start, self.length, self.count))
        self.pool[self.used : upto] = ids
        place = np.arange(first, last)
        if blank:
            place = np.concatenate([np.delete(place, blank), place[blank]])
        self.start[place] = self.used + np.cumsum(sizes) - sizes
        self.length[place] = sizes
        self.count[place] = 0
        self.n, self.used = last, upto

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """One uint32 array for each text; null counts as empty.  Long texts go piece by piece, which bounds all but their ids."""
        if any(t and len(t) > LONG for t in texts):
            return [np.concatenate([self.short([p])[0] for p in pieces(t, LONG)]) if t and len(t) > LONG else self.short([t])[0] for t in texts]
        return self.short(texts)

    def short(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.keep:
            self.forget()
        out: list = [None] * len(texts)
        words, owners = [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif UNUSUAL.search(t) or any(s in t for s in self.special):
                out[i] = np.array(self.t.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                words.append(SPLIT.findall(t))
                owners.append(i)
        if words:
            counts = [len(w) for w in words]
            found = (itemgetter(*w)(self.known) if len(w) > 1 else (self.known[w[0]],) for w in words)
            index = np.fromiter(chain.from_iterable(found), np.int64, sum(counts))
            if self.known.new:
                new, self.known.new = self.known.new, []
                self.learn(new)
            np.add.at(self.count, index, 1)
            sizes = self.length[index]
            ends = np.cumsum(sizes)
            flat = np.repeat(self.start[index] - ends + sizes, sizes)
            flat += np.arange(len(flat))
            flat = self.pool[flat]
            bounds = np.concatenate([[0], ends[np.cumsum(counts) - 1]])
            for k, i in enumerate(owners):
                out[i] = flat[bounds[k] : bounds[k + 1]]
        return out


@model
def library_ids(path: str, keep: int = 600_000) -> LibraryIds:
    """One for each worker process, file and size."""
    return LibraryIds(path, keep)
