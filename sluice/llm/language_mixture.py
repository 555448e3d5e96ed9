"""Language identification as mixture inference.

Training counts hashed byte n-grams (three and four bytes of the lower-cased text) by
language over a sample of labelled rows; ``train_rows`` bounds its expected size and
is a parameter.  Counts are summed by Spark; the model is ``FEATURES`` x languages,
whatever the corpus.

A document's n-grams are drawn from a mixture of languages.  Expectation-maximisation
gives the proportions; the language set is the one with the best likelihood less a
penalty for each language (nested sets by proportion), refitted on that set alone; the
prediction is the largest share, and the score its share in the full mixture.  A row is
kept for its set: the share of the full mixture that the set's languages have together.

Null texts and texts without a letter are ``und`` with score 0; so is everything if
nothing was learned.  Rows with a null language or null id are not learned from.  Every
row is predicted by itself; ties between languages go to the first by name.  An empty
table gives an empty one.  Very long texts are counted piece by piece into the features,
so memory is bounded but for the text itself.  Only the columns named by parameters are
read; keep_identified returns all columns as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import slices, sql_type, task

FEATURES, LONG = 1 << 16, 1 << 18  # and characters from which a text's features are counted
STEPS, PENALTY = 8, 4.0


def hashed(b: np.ndarray) -> np.ndarray:
    """(places, 2): the features that begin at each place with four bytes left."""
    three = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16)
    four = three | b[3:] << np.uint32(24)
    h3, h4 = three * np.uint32(0x9E3779B1), (four ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)
    return (np.stack([h3, h4], axis=1) >> np.uint32(16)).astype(np.int32)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in a row, and where each text's begin (and the end)."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    b = np.frombuffer(b"".join(raw) + b"   ", np.uint8).astype(np.uint32)
    both = hashed(b)
    sizes = np.array([len(r) for r in raw])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.ones(len(both), bool)
    for k in (1, 2, 3):  # windows must not reach into the next text
        inside[bounds[1:] - k] = False
    upto = np.concatenate([[0], np.cumsum(inside)])
    return both[inside].ravel(), 2 * upto[bounds]


def counted(text: str, piece: int = 1 << 20) -> np.ndarray:
    """How often each feature occurs in a text, piece by piece."""
    counts, carry = np.zeros(FEATURES, np.int64), b" "
    for at in range(0, len(text), piece):
        b = carry + text[at : at + piece].lower().encode("utf-8", "surrogatepass") + (b"  " if at + piece >= len(text) else b"")
        counts += np.bincount(hashed(np.frombuffer(b, np.uint8).astype(np.uint32)).ravel(), minlength=FEATURES)
        carry = b[-3:]
    return counts


def letters(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts (FEATURES, languages)."""
        self.languages = languages
        smooth = counts + 0.2
        self.p = (smooth / smooth.sum(axis=0)).astype(np.float32) if languages else counts.astype(np.float32)
        self.p *= np.float32(FEATURES)  # keeps single precision away from denormals

    def mix(self, p: np.ndarray, w: np.ndarray, steps: int, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Steps of expectation-maximisation, and the log likelihood; times: how often each row of p occurs (else once)."""
        if times is not None:
            total = times.sum()
            for _ in range(steps):
                w = (w * (p.T @ (times / (p @ w))) / total).astype(np.float32)
            return w, float(times @ np.log(p @ w))
        for _ in range(steps):
            w = w * (p.T @ (1 / (p @ w))) / len(p)
        return w, float(np.log(p @ w).sum(dtype=np.float64))

    def proportions(self, features: np.ndarray, times: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
        """The chosen language set, largest share first, and the shares of the full mixture."""
        p, k = self.p[features], len(self.languages)
        size = len(p) if times is None else times.sum()
        w, full = self.mix(p, np.full(k, 1 / k, np.float32), STEPS, times)
        order = np.argsort(-w, kind="stable")
        best, chosen = -np.inf, order[:1]
        for n in range(1, k + 1):
            own = order[:n]
            if n == 1:
                fit = float(np.log(p[:, own[0]]).sum(dtype=np.float64) if times is None else times @ np.log(p[:, own[0]]))
            elif n == k:
                fit = full
            else:
                fit = self.mix(p[:, own], (w[own] / max(w[own].sum(), 1e-9)).astype(np.float32), 2, times)[1]
            value = fit - PENALTY * n * np.log(size)
            if value <= best:
                break
            best, chosen = value, own
        return chosen.tolist(), w

    def sets(self, texts: list) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """For each text the chosen set, the proportions refitted on it, and the shares of the full mixture; empty sets for ``und``."""
        out = []
        flat, bounds = ngrams([t if t and len(t) <= LONG else "" for t in texts])
        for i, t in enumerate(texts):
            if not self.languages or not letters(t):
                out.append(([], np.zeros(0), np.zeros(len(self.languages))))
                continue
            features, times = flat[bounds[i] : bounds[i + 1]], None
            if len(t) > LONG:
                counts = counted(t)
                features = np.flatnonzero(counts)
                times = counts[features].astype(np.float64)
            chosen, w = self.proportions(features, times)
            own = w[chosen] / max(w[chosen].sum(), 1e-9)
            if 1 < len(chosen) < len(w):
                own = self.mix(self.p[features][:, chosen], own.astype(np.float32), STEPS, times)[0]
            out.append((chosen, own, w))
        return out

    def named(self, chosen: list[int], w: np.ndarray) -> tuple[str, float]:
        return (self.languages[chosen[0]], float(min(1.0, max(0.0, w[chosen[0]])))) if chosen else ("und", 0.0)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        got = [self.named(chosen, w) for chosen, _, w in self.sets(texts)]
        return [n for n, _ in got], [x for _, x in got]


def train(df: DataFrame, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows with text, id and language; about train_rows of them, chosen by a hash of the id."""
    labelled = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).dropna()
    n = labelled.select("lang").count()
    if n > train_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * train_rows / n))

    @task
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            flat, bounds = ngrams([t if len(t) <= LONG else "" for t in texts])
            for k, (t, lang) in enumerate(zip(texts, b.column(1).to_pylist(), strict=True)):
                if lang not in totals:
                    totals[lang] = np.zeros(FEATURES, np.int64)
                totals[lang] += counted(t) if len(t) > LONG else np.bincount(flat[bounds[k] : bounds[k + 1]], minlength=FEATURES)
        for lang, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], names=["lang", "feature", "n"])

    few = labelled.repartition(8, F.xxhash64("id")).select("text", "lang")  # a bounded sample
    table = few.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(table.column("lang").unique().to_pylist())
    counts = np.zeros((FEATURES, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    counts[table.column("feature").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return Model(languages, counts)


def detect(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages: the chosen set, proportions: refitted on it)."""

    @task
    def run(batches):
        for b in slices(batches, 2 << 20):
            got = model.sets(b.column(1).to_pylist())
            names, scores = zip(*(model.named(chosen, w) for chosen, _, w in got), strict=True)
            sets = [[model.languages[k] for k in chosen] for chosen, _, _ in got]
            own = [shares.tolist() for _, shares, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(own, pa.list_(pa.float64()))], names=["id", "lang_pred", "score", "languages", "proportions"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {sql_type(df, id_col)}, lang_pred string, score double, languages array<string>, proportions array<double>")


def keep_identified(df: DataFrame, model: Model, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows whose language set has at least that share of the mixture, with all their columns."""
    at = df.columns.index(text_col)

    @task
    def run(batches):
        for b in slices(batches, 2 << 20):
            got = model.sets(b.column(at).to_pylist())
            yield b.filter(pa.array([bool(chosen) and float(w[chosen].sum()) >= least for chosen, _, w in got], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()))
    found = detect(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
