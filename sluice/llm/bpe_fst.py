"""Byte-level BPE as a lazily determinised finite-state transducer.

Shared by the token counter (transitions carry emitted-token *counts*) and the
encoder (transitions carry the emitted *ids*).

Inside one pre-token the encoding of ``p + b`` is the encoding of some shorter
prefix ``q`` of ``p`` followed by one token; ``q`` is a place from which the rest
of ``p`` begins a vocabulary token.  A state therefore holds just those places:
for each, how far back it lies, the last token before it and the tokens not yet
common to all places.  Tokens common to all of them can't change any more and are
emitted, so lookahead is bounded by the longest token.  States with equal
contents are one state, which makes the machine finite; transitions are computed
the first time they're taken.

Around it, a second automaton over character classes cuts text into pre-tokens by
the pattern of byte-level BPE (contractions, letters, numbers, others, blanks).
Both are folded into one machine that reads code points.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

Ids = tuple[int, ...]


class Vocabulary:
    """Tokens as bytes, with the rank of each mergeable pair."""

    def __init__(self, tokens: dict[bytes, int], pair_rank: Callable[[bytes, bytes], int | None], specials: dict[str, int]):
        self.tokens, self.pair_rank, self.specials = tokens, pair_rank, specials
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.starts = {t[:k] for t in tokens for k in range(len(t))}  # proper beginnings of tokens

    def merge(self, piece: bytes) -> list[int]:
        """The plain merge loop; the transducer uses it on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.pair_rank(parts[i], parts[i + 1])) is not None]
            if not ranks:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.tokens[p] for p in parts]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


def from_tokenizer_json(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_alphabet()
    raw = lambda s: bytes(back[c] for c in s)
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    return Vocabulary(tokens, lambda a, b: ranks.get((a, b)), specials)


def from_ranks(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(ranks, lambda a, b: ranks.get(a + b), {})


#: The fresh inside of a pre-token: one place, nothing before it.
EMPTY = (b"", ((0, None, ()),))


class Segment:
    """Byte steps inside one pre-token."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[tuple[int, int], bool] = {}

    def follows(self, before: int | None, token: int) -> bool:
        """Whether the merge loop leaves these two neighbours (or the one) as they are."""
        if (known := self.fits.get((before, token))) is None:
            head = b"" if before is None else self.v.bytes_of[before]
            known = self.v.merge(head + self.v.bytes_of[token]) == [x for x in (before, token) if x is not None]
            self.fits[before, token] = known
        return known

    def step(self, state: tuple, b: int) -> tuple[tuple, Ids]:
        tail, places = state
        tail += bytes((b,))
        n = len(tail)
        new, end = [], None
        for back, last, held in places:
            piece = tail[n - back - 1 :]
            if end is None and (t := self.v.tokens.get(piece)) is not None and self.follows(last, t):
                end = (0, t, (*held, t))
            if piece in self.v.starts:
                new.append((back + 1, last, held))
        if end is None:
            raise ValueError("this vocabulary lacks single bytes")
        new.append(end)
        sure, shortest = 0, min(len(p[2]) for p in new)
        first = new[0][2]
        while sure < shortest and all(p[2][sure] == first[sure] for p in new):
            sure += 1
        out = end[2][:sure]
        # places are ordered from the farthest back to the end; the tail reaches to the farthest
        new_state = (tail[n - new[0][0] :] if new[0][0] else b"", tuple((k, last, held[sure:]) for k, last, held in new))
        return new_state, out

    def feed(self, state: tuple, text: str, out: list[int]) -> tuple:
        for b in text.encode("utf-8", "surrogatepass"):
            state, ids = self.step(state, b)
            out += ids
        return state

    @staticmethod
    def flush(state: tuple) -> Ids:
        return state[1][-1][2]


class Node(dict):
    """A state; its items are the transitions taken so far: code point -> (state, value)."""

    __slots__ = ("machine", "mode", "inner", "_final")

    def __init__(self, machine, mode, inner):
        super().__init__()
        self.machine, self.mode, self.inner, self._final = machine, mode, inner, None

    def __missing__(self, ch):
        self[ch] = got = self.machine.move(self, ch)
        return got

    @property
    def final(self):
        """The value for what is still held if the text ends here."""
        if self._final is None:
            self._final = self.machine.value(self.machine.at_end(self))
        return self._final


class Machine:
    """value(ids) is what a transition carries: ``len`` for counts, ``tuple`` for ids.

    kind(ch) gives the class of a code point: L, N, S or O.  At most ``limit``
    transitions are kept; beyond it, ``start`` begins anew with an empty table, so
    memory is bounded and results are the same.
    """

    def __init__(self, vocabulary: Vocabulary, kind: Callable[[str], str], value: Callable[[Ids], object], limit: int = 1_100_000):
        self.v, self._kind, self.value, self.limit = vocabulary, kind, value, limit
        self.kinds: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        self.seg = Segment(self.v)
        self.nodes: dict = {}
        self.moves = 0
        self.root = self.node("start", EMPTY)

    def start(self) -> Node:
        if self.moves > self.limit:
            self.reset()
        return self.root

    def node(self, mode: str, inner: tuple) -> Node:
        if (got := self.nodes.get((mode, inner))) is None:
            got = self.nodes[mode, inner] = Node(self, mode, inner)
        return got

    def kind(self, ch: str) -> str:
        if (k := self.kinds.get(ch)) is None:
            k = self.kinds[ch] = self._kind(ch)
        return k

    # modes: start; L, N, O: inside such a run; S + c: inside blanks, c the last, not yet fed;
    # ': an apostrophe that may begin a contraction; 'r, 'v, 'l: one that needs one more letter.
    def move(self, s: Node, ch: str):
        self.moves += 1
        out: list[int] = []
        nxt = self.advance(s.mode, s.inner, ch, out)
        return nxt, self.value(tuple(out))

    def fresh(self, ch: str, out: list[int]) -> Node:
        k = self.kind(ch)
        if k == "S":
            return self.node("S" + ch, EMPTY)
        if ch == "'":
            return self.node("'", EMPTY)
        return self.node(k, self.seg.feed(EMPTY, ch, out))

    def whole(self, text: str, out: list[int]) -> None:
        out += self.seg.flush(self.seg.feed(EMPTY, text, out))

    def advance(self, mode: str, inner: tuple, ch: str, out: list[int]) -> Node:
        k = self.kind(ch)
        if mode == "start":
            return self.fresh(ch, out)
        if mode in ("L", "N", "O"):
            if k == mode:
                return self.node(mode, self.seg.feed(inner, ch, out))
            out += self.seg.flush(inner)
            return self.fresh(ch, out)
        if mode[0] == "S":
            last = mode[1:]
            if k == "S":
                return self.node("S" + ch, self.seg.feed(inner, last, out))
            out += self.seg.flush(inner)
            if last == " ":
                return self.node(k, self.seg.feed(EMPTY, " " + ch, out))
            self.whole(last, out)
            return self.fresh(ch, out)
        if mode == "'":
            if ch in "stmd":
                self.whole("'" + ch, out)
                return self.node("start", EMPTY)
            if ch in "rvl":
                return self.node("'" + ch, EMPTY)
            if k == "O":
                return self.node("O", self.seg.feed(EMPTY, "'" + ch, out))
            self.whole("'", out)
            return self.fresh(ch, out)
        if ch == {"r": "e", "v": "e", "l": "l"}[mode[1]]:
            self.whole(mode + ch, out)
            return self.node("start", EMPTY)
        self.whole("'", out)
        return self.advance("L", self.seg.feed(EMPTY, mode[1], out), ch, out)

    def at_end(self, s: Node) -> Ids:
        out: list[int] = []
        if s.mode in ("L", "N", "O"):
            out += self.seg.flush(s.inner)
        elif s.mode[0] == "S":
            out += self.seg.flush(self.seg.feed(s.inner, s.mode[1:], out))
        elif s.mode[0] == "'":
            self.whole("'", out)
            if len(s.mode) > 1:
                self.whole(s.mode[1:], out)
        return tuple(out)


def encode(machine: Machine, text: str) -> list[int]:
    """Ids of a text; machine with value=tuple."""
    s, out = machine.start(), []
    for ch in text:
        s, ids = s[ch]
        if ids:
            out += ids
    out += s.final
    return out


def kinds_by_pattern() -> Callable[[str], str]:
    """Classes as the installed regex library has them."""
    import regex

    tests = [(k, regex.compile(p)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))]
    return lambda ch: next((k for k, p in tests if p.match(ch)), "O")


def kinds_by_library(pre_tokenizer) -> Callable[[str], str]:
    """Classes as a byte-level pre-tokenizer itself shows them: what joins a run is of its class."""

    def kind(ch: str) -> str:
        for k, probe in (("L", "a"), ("N", "1"), ("O", "!")):
            if len(pre_tokenizer.pre_tokenize_str(probe + ch)) == 1:
                return k
        return "S"

    return kind
