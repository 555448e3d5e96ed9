"""The operators against brute force, on a table with null, empty, long, tied and repeated rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import arrow_stream, bpe_codec, bpe_fst, flac, language_mixture, packing, quartile_digest, sharding, simhash, suffix_dedup, token_counts
from sluice.llm.common import pieces, tokenizer_path
from sluice.llm.library_ids import LibraryIds
from sluice.llm.queries import QUERIES

JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes string, id string, size double, shard int, fp long"


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id -> text, with hard cases; near copies, copies and shared passages."""
    rnd = random.Random(4)
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(70).collect()]
    passage = base[3][:200]
    texts = base + [None, "", "   ", "\n", "a", "ab", "é漢😀 ½ ²", "x" * 30_000, " " * 5000 + "end", "don't we'll 'sx <|endoftext|> \r\n\t zz", base[0], base[0], base[5][:400] + " edited " + base[5][400:], "1234567890 " * 300, base[9] + passage, passage + base[11], "0" * 49, "0" * 50, "0" * 51]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return {i * 3 + 1: texts[k] for i, k in enumerate(order)}


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    langs = dict(zip(docs, "en de en fr".split() * 99, strict=False))
    rows = [(i, t, langs[i] if i % 5 else None, "s", None, "x", "y", 1.5, 3, 9) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def hard(spark, docs, tmp_path_factory):
    """Empty, and one with null ids and repeated rows."""
    out = {}
    for name, rows in (("empty", []), ("tied", [(None, "null id", None, None, None, None, None, None, None, None), (5, "same", "en", "s", 4, "", "", 0.0, 0, 0), (5, "same", "en", "s", 4, "", "", 0.0, 0, 0), (5, "other text of five", "en", "s", 4, "", "", 0.0, 0, 0), (6, None, None, None, None, None, None, None, None, None)])):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out[name]}/documents.parquet")
    return out


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_and_tied_tables(spark, hard, name):
    assert QUERIES[name](spark, hard["empty"]).count() == 0
    got = QUERIES[name](spark, hard["tied"])
    assert (got.filter("start = 0").count() if name == "op1_packing" else got.count()) == 5


def test_pipeline_on_empty_and_tied(spark, hard):
    assert corpus_pipeline.run(spark, hard["empty"]).count() == 0
    assert corpus_pipeline.run(spark, hard["tied"]).count() >= 1


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(JSON)
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in docs.items()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_packing(spark, sf, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op1_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for i, x in ids.items():
        x, at = [*x, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), crc(x[at : at + r.length]))
            at += r.length
        assert at == len(x)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_closest_multiset_is_the_best():
    rnd = random.Random(2)
    for _ in range(200):
        counts = Counter(rnd.randint(1, 40) for _ in range(rnd.randint(1, 9)))
        cap = rnd.randint(1, 120)
        best = {0}
        for k, n in counts.items():
            best = {b + k * m for b in best for m in range(n + 1)}
        got = packing.closest_multiset(counts, cap)
        assert sum(k * n for k, n in got.items()) == max(b for b in best if b <= cap) and all(n <= counts[k] for k, n in got.items())


def test_packer_holds_few_pieces():
    p = packing.Packer(2048, 16, 0)
    for i in range(500):
        p.add(i, np.full(1500, 7, np.uint32))  # never fill a sequence exactly
        assert p.n_held <= 16
    p.finish()
    assert sum(r[2] for r in p.rows) == 500 * 1500


def test_packer_takes_the_closest_multiset(ids):
    """All sequences but the last few are full; the first is the longest remainder and the multiset closest to the rest."""
    p = packing.Packer(2048, 64, 0)
    for i, x in ids.items():
        p.add(i, np.array([*x, 1], np.uint32))
        assert p.n_held <= 64 + 2048
    held = {k: len(q) for k, q in p.held.items()}
    opener = max(held)
    held[opener] -= 1
    chosen = packing.closest_multiset({k: n for k, n in held.items() if n}, 2048 - opener)
    first = p.sequence
    p.finish()
    lengths = sorted((r[2] for r in p.rows if r[5] == first), reverse=True)
    made = Counter(lengths) - Counter({opener: 1})
    assert all(made[k] >= n for k, n in chosen.items())
    totals = Counter()
    for r in p.rows:
        totals[r[5]] += r[2]
    short = [n for n in totals.values() if n < 2048]
    assert len(short) <= 11 and all(n & (n - 1) == 0 for n in short)


def test_token_counts(spark, sf, docs, ids):
    for r in QUERIES["op2_token_counts"](spark, sf).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 1024)


def test_chunk_maps_compose(docs, ids):
    for size in (1, 7, 64):
        c = token_counts.Counter(JSON, size)
        for i in list(docs)[:40]:
            if len(docs[i] or "") < 6000:
                assert c(docs[i]) == len(ids[i])


def test_library_ids_forget(ids, docs):
    small = LibraryIds(JSON, keep=20)
    for i, x in docs.items():
        assert small([x])[0].tolist() == ids[i]


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_language"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_mixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_mixture.train(df)
    one, two = (df.filter(F.col("lang") == k).orderBy("doc_id").first().text[:400] for k in ("en", "fr"))
    flat, bounds = language_mixture.ngrams([one + " " + two, one])
    chosen, share = model.proportions(flat[: bounds[1]])
    assert {model.languages[k] for k in chosen} == {"en", "fr"} and all(0.4 < share[k] < 0.6 for k in chosen)
    assert [model.languages[k] for k in model.proportions(flat[bounds[1] :])[0]] == ["en"]
    assert model.predict([None, "", "12 -- !", "\n"]) == (["und"] * 4, [0.0] * 4)


def test_rows_are_kept_for_their_language_set(spark):
    """Three languages in even parts: none has a share of 0.4, the set has nearly all."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_mixture.train(df)
    parts = [df.filter(F.col("lang") == k).orderBy("doc_id").first().text[:400] for k in ("de", "en", "fr")]
    mixed = spark.createDataFrame([(1, " ".join(parts)), (2, "12 -- !"), (3, parts[0])], "doc_id long, text string")
    got = {r.id: r for r in language_mixture.detect(mixed, model).collect()}
    assert set(got[1].languages) == {"de", "en", "fr"} and all(0.25 < x < 0.4 for x in got[1].proportions) and got[1].score < 0.4
    assert got[2].languages == got[2].proportions == [] and got[3].languages == ["de"]
    assert [r.doc_id for r in language_mixture.keep_identified(mixed, model).orderBy("doc_id").collect()] == [1, 3]


def test_flac(spark, sf, docs):
    by_text = defaultdict(set)
    for r in QUERIES["op4_flac"](spark, sf).collect():
        raw = (docs[r.doc_id] or "").encode()
        want = flac.padded(raw)
        assert len(want) % 192 == 0 and (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        by_text[raw].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_flac_streams():
    rnd = random.Random(1)
    payloads = [flac.padded(bytes(rnd.randrange(256) for _ in range(n))) for n in (0, 1, 192, 193, 40_000)] + [b"\0" * 192, b"\0\xff" * 192, bytes(range(192)) * 300]
    streams = flac.encode_streams(payloads)
    for p, x in zip(payloads, flac.decode_streams(streams), strict=True):
        assert (x.view(np.uint8) ^ 128).tobytes() == p
    full = flac.decode_streams([streams[4]])[0]
    for a, n in ((0, 5), (13_000, 700), (len(full) - 3, 3)):
        assert (flac.read_samples(streams[4], a, n) == full[a : a + n]).all()
    broken = bytearray(streams[4])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(broken)])


def test_flac_blocks(spark, sf, docs):
    media = flac.flac_encode(spark.read.parquet(f"{sf}/documents.parquet"))
    got = defaultdict(bytes)
    for r in flac.flac_blocks(media, block_samples=1000).orderBy("id", "sample_offset").collect():
        assert len(got[r.id]) == r.sample_offset and len(r.pcm) == r.n_samples
        got[r.id] += bytes(r.pcm)
    for i, x in docs.items():
        assert bytes(b ^ 128 for b in got[i]) == flac.padded((x or "").encode())


def test_digests_step_by_step(docs):
    """Digests and likeness, one window and one bucket at a time."""

    def digest(raw):
        raw = raw.ljust(5, b"\0")
        counts = [0] * 256
        for end in range(4, len(raw)):
            for salt, places in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4)], 1):
                x = sum(raw[end - p] << 8 * k for k, p in enumerate(places)) + (salt << 24)
                x = x * 0x9E3779B1 % 2**32
                x ^= x >> 15
                counts[x * 0x85EBCA77 % 2**32 >> 24] += 1
        q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
        codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
        return codes, (q1 * 63 // max(q3, 1), q2 * 63 // max(q3, 1))

    def packed(codes):
        return bytes(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 256, 4))

    texts = [x.encode() for x in docs.values() if x and len(x) < 3000][:25]
    got = quartile_digest.digests(texts)
    for raw, d in zip(texts, got, strict=True):
        codes, ratios = digest(raw)
        steps = 0  # of a tenth of the length
        while 1.1 ** (steps + 1) <= len(raw) * (1 + 1e-12):
            steps += 1
        assert (d[0], tuple(d[1:3]), d[3:].tobytes()) == (min(steps, 255), ratios, packed(codes))
    for a, b, x, y in zip(texts, texts[1:], got, got[1:], strict=False):
        gaps = [abs(i - j) for i, j in zip(digest(a)[0], digest(b)[0], strict=True)]
        diff = sum(6 if g == 3 else g for g in gaps) + sum(abs(int(i) - int(j)) for i, j in zip(x[:3], y[:3], strict=True))
        assert quartile_digest.compare(x.tobytes().hex(), y.tobytes().hex()) == 1 - min(diff, 400) / 400


def test_mixture_step_by_step():
    """Proportions and the chosen set, one n-gram and one language at a time."""
    rng = np.random.default_rng(3)
    m = language_mixture.Model(list("abc"), rng.integers(0, 50, (language_mixture.FEATURES, 3)) * (rng.random((language_mixture.FEATURES, 3)) < 0.3))
    for size, mixed in ((300, (1, 0, 0)), (300, (0.5, 0.5, 0)), (400, (0.2, 0.3, 0.5))):
        p = m.p.astype(float) / m.p.astype(float).sum(axis=0)
        found = np.concatenate([rng.choice(language_mixture.FEATURES, int(size * share), p=p[:, k]) for k, share in enumerate(mixed)])

        def fit(own, w, steps):
            for _ in range(steps):
                new = dict.fromkeys(own, 0.0)
                for f in found:
                    total = sum(w[k] * m.p[f, k] for k in own)
                    for k in own:
                        new[k] += w[k] * m.p[f, k] / total / len(found)
                w = new
            return w, sum(float(np.log(sum(w[k] * m.p[f, k] for k in own))) for f in found)

        w, full = fit([0, 1, 2], dict.fromkeys([0, 1, 2], 1 / 3), language_mixture.STEPS)
        order, best, want = sorted(w, key=lambda k: -w[k]), -np.inf, None
        for n in (1, 2, 3):
            own = order[:n]
            start = {k: w[k] / sum(w[j] for j in own) for k in own}
            value = (full if n == 3 else fit(own, start, 2 if n > 1 else 0)[1]) - language_mixture.PENALTY * n * np.log(len(found))
            if value <= best:
                break
            best, want = value, own
        chosen, shares = m.proportions(found)
        assert chosen == want and np.allclose(shares, [w[k] for k in range(3)], atol=1e-3)
        assert sorted(chosen) == [k for k, share in enumerate(mixed) if share]


def test_features_sample_by_sample(docs):
    """The query's feature string, summed in plain integers."""
    for x in list(docs.values())[:30]:
        y = [b - 128 for b in flac.padded((x or "").encode())]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:], strict=False))
        want = f"rms={(sum(v * v for v in y) / len(y)) ** 0.5:.6f};mean={sum(y) / len(y):.6f};peak={max(map(abs, y))};crossings={crossings}"
        assert flac.features(np.array(y, np.int8)) == want


def test_pieces_of_long_texts(docs):
    """Cut into pieces, a text gives what it gives whole."""
    text = " ".join(x for x in docs.values() if x) * 3
    raw = text.encode()
    assert "".join(pieces(text, 500)) == text and max(map(len, pieces(text, 500))) < 40_000
    t, codec = Tokenizer.from_file(JSON), bpe_codec.Codec(RANKS)
    ids = t.encode(text, add_special_tokens=False).ids
    assert [i for p in pieces(text, 500) for i in t.encode(p, add_special_tokens=False).ids] == ids
    assert token_counts.Counter(JSON)(text) == len(ids)
    assert b"".join(codec.decode_bytes(codec.encode(p).astype(np.int64)) for p in pieces(text, 3000)) == raw
    assert (quartile_digest.bucket_counts([raw, b"", b"abc"], 999) == quartile_digest.bucket_counts([raw, b"", b"abc"])).all()
    flat, _ = language_mixture.ngrams([text])
    assert (language_mixture.counted(text, 777) == np.bincount(flat, minlength=language_mixture.FEATURES)).all()
    assert len(simhash.byte_pieces(raw, 700)) > 50
    whole = simhash.fingerprint(raw), simhash.wide_fingerprint(raw, 5)
    full, simhash.byte_pieces, simhash.PART = simhash.byte_pieces, lambda x: full(x, 700), 300
    try:
        assert (simhash.fingerprint(raw), simhash.wide_fingerprint(raw, 5)) == whole
    finally:
        simhash.byte_pieces, simhash.PART = full, 1 << 14
    lanes, flac.LANES = flac.LANES, 128
    try:
        payloads = [flac.padded(x) for x in (raw, b"", raw[:5000])]
        cut = flac.encode_streams(payloads)
        assert [(x.view(np.uint8) ^ 128).tobytes() for x in flac.decode_streams(cut)] == payloads
    finally:
        flac.LANES = lanes
    assert cut == flac.encode_streams(payloads)


def test_counted_features_predict_alike(spark):
    """A text of which the features are counted gets the set and the shares that it gets n-gram by n-gram."""
    found = language_mixture.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect():
        flat, _ = language_mixture.ngrams([r.text])
        counts = np.bincount(flat, minlength=language_mixture.FEATURES)
        at = np.flatnonzero(counts)
        (a, x), (b, y) = found.proportions(flat), found.proportions(at, counts[at].astype(float))
        assert a == b and np.allclose(x, y, atol=1e-4)


def test_quartile_digests(spark, sf, docs):
    order = sorted(docs)
    rows = {r.doc_id: r for r in QUERIES["op5_quartile_digest"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for k, i in enumerate(order):
        own, nxt, r = docs[i] or "", docs[order[(k + 1) % len(order)]] or "", rows[i]
        half = len(own) // 2
        changed = own[: len(own) - half] + nxt[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        one = [quartile_digest.digests([x.encode()])[0].tobytes().hex() for x in (own, changed, nxt)]
        assert [r.fingerprint, r.edited_fingerprint] == one[:2]
        assert abs(r.near_edited - quartile_digest.compare(one[0], one[1])) < 1e-9 and abs(r.near_next - quartile_digest.compare(one[0], one[2])) < 1e-9


def without_repeats(docs):
    owner, out = {}, {}
    for i in sorted(docs):
        t = (docs[i] or "").encode()
        for k in range(len(t) - 49):
            owner.setdefault(t[k : k + 50], i)
    for i, x in docs.items():
        t = (x or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if owner[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup(spark, sf, docs):
    want = without_repeats(docs)
    for size in (8 << 20, 20_000):
        rows = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"), batch_bytes=size).collect()
        assert len(rows) == len(docs) and all(tuple(r)[1:] == want[r.id][:4] for r in rows)


def suffix_steps(texts, folder, parts, batch_bytes, step=lambda name, run: run()):
    """The steps of op6 one after the other in this process; step is told each."""
    s, tables = suffix_dedup, lambda batches: pa.Table.from_batches(list(batches))
    rows = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()), pa.string())], names=["id", "text"])
    names = [b.column(0)[0].as_py() for b in s.write_batches(iter([rows]), folder, batch_bytes)]
    only = lambda t, c, v: t.filter(pa.array([x == v for x in t.column(c).to_pylist()], pa.bool_()))
    sent = pa.concat_tables([step("send", lambda n=n: tables(s.send_anchors([pa.RecordBatch.from_arrays([pa.array([n])], names=["batch"])], folder, parts))) for n in names])
    answers = pa.concat_tables([step("answer", lambda t=t: s.answer_anchors(t)) for p in range(parts) if len(t := only(sent, "part", p))])
    told = pa.concat_tables([step("use", lambda n=n: s.use_answers((pa.scalar(n),), only(answers, "batch", n), folder, parts)) for n in names])
    contexts = only(told, "kind", 1)
    told = pa.concat_tables([only(told, "kind", 0), *(step("compare", lambda t=t: s.compare_contexts(t)) for p in range(parts) if len(t := only(contexts, "part", p)))])
    return pa.concat_tables([step("finish", lambda n=n: s.finish_batch((pa.scalar(n),), only(told, "batch", n), folder, False)) for n in names]).to_pylist()


def test_suffix_dedup_in_shares(docs, tmp_path, monkeypatch):
    """What is sorted a share at a time makes no difference to what goes."""
    some = {i: docs[i] for i in sorted(docs)[:80]} | {-1: "", -2: "é" * 30, -3: "é" * 30 + "x" * 60, -4: "x" * 200}
    want = without_repeats(some)
    for n, most in enumerate((50, 700, 1 << 18)):
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", most, raising=False)
        for parts in (1, 5):
            rows = suffix_steps(some, (tmp_path / f"{n}-{parts}").as_uri(), parts, 30_000)
            assert len(rows) == len(some) and all(tuple(r.values())[1:] == want[r["id"]][:4] for r in rows)


def test_suffix_dedup_memory(tmp_path):
    """A worker's arrays in each step, as multiples of the bytes of a batch or, in its task, a part."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    passages = [" ".join(rnd.choices(words, k=30)) for _ in range(60)]
    texts = {i: " ".join([*rnd.choices(words, k=300), rnd.choice(passages), *rnd.choices(words, k=300)]) for i in range(1800)}
    size, peaks = sum(map(len, texts.values())), {}

    def step(name, run):
        tracemalloc.start()
        out = run()
        peaks[name] = max(peaks.get(name, 0), tracemalloc.get_traced_memory()[1] / size)
        tracemalloc.stop()
        return out

    rows = suffix_steps(texts, tmp_path.as_uri(), 1, 1 << 30, step)
    assert sum(r["n_removed"] for r in rows) > 1740 * 190
    most = {"send": 16, "answer": 8, "use": 16, "compare": 4, "finish": 3}
    assert all(peaks[k] < most[k] for k in most), peaks
    assert suffix_dedup.batch_size.__defaults__[1] <= 16 << 20


def test_deep_shallow_sort():
    rnd = random.Random(8)
    for _ in range(20):
        data = np.frombuffer(("".join(rnd.choice("ab") for _ in range(200)) * 3).encode(), np.uint8)
        start = np.array([rnd.randrange(550) for _ in range(300)])
        order, new = suffix_dedup.sort_windows(data, start)
        w = [data[s : s + 50].tobytes() for s in start[order]]
        assert w == sorted(w) and new.tolist() == [k == 0 or w[k] != w[k - 1] for k in range(len(w))]


def test_bpe_codec(spark, sf, docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe_fst.from_ranks(RANKS).tokens
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op7_bpe_codec"](spark, sf).collect():
        x = lib.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(x) and r.ids_sha256 == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
    rnd, c = random.Random(6), bpe_codec.Codec(RANKS)
    c.machine.limit = 50
    for _ in range(500):
        s = "".join(rnd.choice("  \n\t''srevlmdtabcABC12!?.-é漢😀½²x") for _ in range(rnd.randint(0, 30)))
        assert c.encode(s).tolist() == lib.encode_ordinary(s)


def test_streaming_utf8():
    rnd = random.Random(7)
    for _ in range(500):
        data = bytes(rnd.choice(b"a\xc3\xa9\xe6\xbc\xa2\xf0\x9f\x98\x80\xed\xa0\xc0\xff") for _ in range(rnd.randint(0, 12)))
        m, cut = bpe_codec.Utf8Machine(), rnd.randint(0, 12)
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.close() == data.decode("utf-8", "replace")


def test_encode_and_decode_tables(spark, sf, docs):
    encoded = bpe_codec.bpe_encode(spark.read.parquet(f"{sf}/documents.parquet"), RANKS)
    assert {r.doc_id: r.decoded for r in bpe_codec.bpe_decode(encoded, RANKS).collect()} == {i: x or "" for i, x in docs.items()}


def simhash_of(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if s and 2 * sum(x >> k & 1 for x in h) > len(s))


def test_simhash(spark, sf, docs):
    fp = {i: simhash_of(x) for i, x in docs.items()}
    smallest = {i: i for i in fp}
    for _ in fp:  # to a fixed point
        smallest = {i: min(smallest[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2) for i in fp}
    for r in QUERIES["op8_simhash"](spark, sf).collect():
        assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", smallest[r.doc_id])


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_links_by_either_way(spark, limit):
    rnd = random.Random(limit)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    for _ in range(150):  # chains and crowds of neighbours
        f = rnd.choice(fps)
        for _ in range(rnd.randint(1, 3)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), pair_limit=limit)
    got = {r.node: r.root for r in simhash.smallest_reachable(links).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_near_copies(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    base = [rnd.choice(words) for _ in range(300)]
    close = [[*base[:k], "edited", *base[k + 1 :]] for k in rnd.sample(range(300), 40)]
    far = [[rnd.choice(words) for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(x)) for i, x in enumerate([base, *close, *far, base])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (2, 100):
        assert sorted(r.doc_id for r in simhash.one_of_each(df, pair_limit=limit).collect()) == [0, *range(41, 81)]


def test_blocks_are_independent():
    """Texts of similarity s share a block with probability 1 - (1 - s ** 3) ** 12, not less."""
    rnd = random.Random(5)
    missed = 0
    for _ in range(400):
        own = [str(rnd.random()) for _ in range(170)]
        other = own[:60] + ["x"] + own[61:100] + ["y"] + own[101:]  # 156 of 176 shingles: 0.886
        a, b = (simhash.wide_fingerprint(" ".join(t).encode(), 5)[1] for t in (own, other))
        missed += not any(x == y for x, y in zip(a, b, strict=True))
    assert missed == 0


def test_wide_fingerprints_are_near():
    """Sets of similarity 0.8 and more are never further apart than the bound; sets far below it are."""
    rng = np.random.default_rng(7)
    words64 = (simhash.WORDS64, simhash.CROWD_WORDS64)
    wide = lambda h, w: np.array(simhash.wide_simhash(h, w), np.int64).view(np.uint8)
    apart = lambda a, b, w: int(np.unpackbits(wide(a, w) ^ wide(b, w)).sum())
    for n in (5, 6, 7, 8, 9, 12, 19, 40, 101, 146, 600):
        for _ in range(20):
            h = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
            both = -(-16 * n // 18)
            other = np.concatenate([h[:both], h[n : 2 * n - both]])  # as many, 0.8 alike
            for w in words64:
                most, few = simhash.bits_apart(0.8, w)
                assert apart(h[:n], other, w) <= (few if n < 9 else most)
                assert apart(h[:n], h[: -(-8 * n // 10)], w) <= (few if -(-8 * n // 10) < 9 else most)
            if n > 100:
                assert apart(h[:n], np.concatenate([h[: n // 2], h[n : 2 * n - n // 2]]), simhash.WORDS64) > simhash.bits_apart(0.8, simhash.WORDS64)[0]


def test_near_copies_in_crowds(spark):
    """Texts that share most of a passage and chains of edits: crowds give the groups of all pairs."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(110)]
    texts = []
    for _ in range(40):  # pairs whose texts are 0.9 alike, 0.5 and so like all others
        own = [word() for _ in range(50)]
        texts += [passage + own, passage + own[:40] + [word()] + own[41:]]
    chain = [word() for _ in range(170)]
    for k in range(30):  # each like the next, the ends unlike
        chain = chain[:6 * k % 170] + [word()] + chain[6 * k % 170 + 1 :]
        texts.append(chain)
    rnd.shuffle(texts)
    sets = [{" ".join(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.group for r in simhash.near_groups(df, pair_limit=8).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == group


def test_near_copies_at_the_bound(spark):
    """Texts of over 1000 words: 1200 of 1500 shingles is near enough, 1199 of 1500 isn't."""
    rnd = random.Random(11)
    rows, want = [], set()
    for k in range(24):
        own = [f"w{rnd.getrandbits(60)}" for _ in range(1504)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 1204 - k % 2]))]
        want |= set() if k % 2 else {2 * k + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id for r in simhash.near_groups(df).collect()} == want


def test_pairs_of_a_crowd(spark):
    """150 pairs of similarity 0.8, 0.76 like all others, almost all blocks crowds: no pair is lost."""
    rnd = random.Random(12)
    word = lambda: f"w{rnd.getrandbits(60)}"
    passage, texts = [word() for _ in range(160)], []
    for _ in range(150):
        shared = passage + [word() for _ in range(4)]
        texts += [shared + [word() for _ in range(20)], shared + [word() for _ in range(20)]]
    order = list(range(300))
    rnd.shuffle(order)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in zip(order, texts, strict=True)], "doc_id long, text string")
    got = {r.id: r.group for r in simhash.near_groups(df, pair_limit=2).collect()}
    assert got == {max(p): min(p) for p in zip(order[::2], order[1::2], strict=True)}


def test_near_copies_under_repeated_ids(spark):
    """One id, two texts: each is the head of its class and each has copies of its own."""
    rnd = random.Random(13)
    rows = []
    for k in range(8):
        for own in (3, 4):
            text = [f"w{rnd.getrandbits(60)}" for _ in range(100)]
            rows += [(10 * k, " ".join(text)), (10 * k + own, " ".join([*text, "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.group) for r in simhash.near_groups(df).collect()) == [(10 * k + own, 10 * k) for k in range(8) for own in (3, 4)]


def test_arrow_stream(spark, sf, ids):
    at = 0
    for r in QUERIES["op9_arrow_stream"](spark, sf).orderBy("doc_id").collect():
        x = [*ids[r.doc_id], 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), crc(x))
        at += len(x)


def test_random_access(spark, sf, ids, tmp_path):
    import pyarrow as pa

    folder = f"file://{tmp_path}/s"
    manifest = arrow_stream.write_streams(spark.read.parquet(f"{sf}/documents.parquet"), JSON, folder, length=128, rows=4, parts=1).collect()
    flat = [t for i in sorted(ids) for t in (*ids[i], 0)]
    with pa.memory_map(f"{tmp_path}/s/{manifest[0].ids_file}") as f:
        whole = f.read_buffer()
        schema = pa.ipc.open_stream(whole).schema
        for k in (0, 5, len(flat) // 128):
            got, mask = arrow_stream.read_sequence(whole, schema, manifest[0].offsets, 4, k)
            n = mask.true_count
            assert got.to_pylist()[:n] == flat[k * 128 : (k + 1) * 128] and n == len(flat[k * 128 : (k + 1) * 128])
            assert whole.address <= got.buffers()[1].address < whole.address + whole.size  # a view


def test_sharding(spark, sf, docs):
    rows = QUERIES["op10_sharding"](spark, sf).collect()
    size = {i: len((x or "").encode()) + 1 for i, x in docs.items()}
    shards, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and r.law == "bytes" and 0 <= r.shard < 8
        shards[r.shard].append(r)
        groups[docs[r.doc_id] or ""].add(r.shard)
    assert len(rows) == len(docs) and all(len(x) == 1 for x in groups.values())
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    sums = Counter()
    for i, x in docs.items():
        sums[hashlib.sha256((x or "").encode()).hexdigest()] += size[i]
    line = [sums[k] for k in sorted(sums)]

    def fits(cap):
        n, room = 1, cap
        for x in line:
            if x > room:
                n, room = n + 1, cap
            room -= x
            if room < 0:
                return False
        return n <= 8

    best = next(c for c in range(max(line), sum(line) + 1) if fits(c))
    assert max(sum(r["size"] for r in v) for v in shards.values()) == best


def test_capacity_search(spark):
    sizes = [7, 2, 5, 10, 8, 1, 1, 9]
    p, rows = 0, []
    for i, s in enumerate(sizes):
        rows.append((f"{i:064x}", 1, s, i, p))
        p += s
    df = spark.createDataFrame(rows, "g string, n long, size long, n0 long, p0 long")
    for k, best in ((1, 43), (2, 24), (3, 18), (8, 10)):
        assert sharding.smallest_capacity(df, k, probes=3)[0] == best


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    one = corpus_pipeline.near_dedup(spark, kept, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {i: x.lower().split() for i, x in texts.items()}
    shingles = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)} for i, w in words.items()}
    left = {r.doc_id for r in one.collect()}
    group = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and group[i] != group[j] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) - 1e-12:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    assert left == set(group.values())
    rest = {r.doc_id: r for r in corpus_pipeline.passage_dedup(spark, one, sf).collect()}
    want = without_repeats({i: texts[i] for i in left})
    for i, w in want.items():
        text = w[4].decode("utf-8", "ignore")
        assert (i not in rest) if w[1] == w[0] > 0 else (rest[i].text, rest[i].n_chars) == (text, len(text))
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert ids == rest.keys()
