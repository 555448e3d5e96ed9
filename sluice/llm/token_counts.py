"""Token counts by a compiled finite-state transducer.

The byte-level BPE vocabulary becomes a deterministic transducer whose transitions
carry the number of tokens they emit (bpe_fst).  A text is cut into chunks; each
chunk becomes a map from entry state to (exit state, count), and the maps compose
through a parallel prefix scan.  A map needs no row for each state: the first blank
after a non-blank resets the transducer whatever came before, so a chunk is a head
(up to that blank, run from the entry state when maps meet) and a body with a fixed
count and exit state.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows and ids come back as
often as they went in; columns other than id and text are not read; an empty table
gives an empty one.  Very long texts are counted piece by piece (cut where no pre-token
can lie across), between which the bound on transitions holds.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm import bpe_fst
from sluice.llm.common import ids_and_texts, model, pieces, slices, sql_type, tokenizer_path, utf8


class Counter:
    def __init__(self, path: str, chunk_chars: int = 1 << 14):
        from tokenizers import Tokenizer

        vocabulary = bpe_fst.from_tokenizer_json(path)
        self.machine = bpe_fst.Machine(vocabulary, bpe_fst.kinds_by_library(Tokenizer.from_file(path).pre_tokenizer), len)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(vocabulary.specials, key=len, reverse=True)) or r"(?!)")
        self.chunk = chunk_chars

    def run(self, state, text: str):
        n = 0
        for ch in text:
            state, k = state[ch]
            n += k
        return state, n

    def chunk_map(self, text: str):
        """(head, None) if nothing resets the machine, else (head, (count, exit state))."""
        kind = self.machine.kind
        before = "S"
        for i, ch in enumerate(text):
            if (now := kind(ch)) == "S" and before != "S":
                body = self.run(self.machine.node("S" + ch, bpe_fst.EMPTY), text[i + 1 :])
                return text[: i + 1], (body[1], body[0])
            before = now
        return text, None

    def apply(self, m, state):
        head, body = m
        state, n = self.run(state, head)
        return (state, n) if body is None else (body[1], n + body[0])

    def compose(self, a, b):
        """The map of a's text followed by b's; associative."""
        if a[1] is None:
            return a[0] + b[0], b[1]
        state, n = self.apply(b, a[1][1])
        return a[0], (a[1][0] + n, state)

    def reduce(self, maps: list):
        """The scan's last map alone: the up-sweep."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def scan(self, maps: list) -> list:
        """Inclusive prefix scan in pairs: log2(len) rounds, each of independent compositions."""
        if len(maps) == 1:
            return maps
        pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
        up = self.scan(pairs)
        return [maps[0] if i == 0 else up[i // 2] if i % 2 else self.compose(up[i // 2 - 1], maps[i]) for i in range(len(maps))]

    def count_ordinary(self, text: str) -> int:
        """Pieces are independent, and between them the machine may forget its transitions; chunks of a piece compose."""
        total = 0
        for piece in pieces(text):
            root = self.machine.start()
            if len(piece) <= self.chunk:
                state, n = self.run(root, piece)
            else:
                state, n = self.apply(self.reduce([self.chunk_map(piece[i : i + self.chunk]) for i in range(0, len(piece), self.chunk)]), root)
            total += n + state.final
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.count_ordinary(p) for p in parts if p)


@model
def counter(path: str, chunk_chars: int = 1 << 14) -> Counter:
    return Counter(path, chunk_chars)


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def count(batches):
        c = counter(path)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [c(t) for t in texts]
            sizes = [len(t) for t in utf8(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = sql_type(df, id_col)
    return ids_and_texts(df, id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
