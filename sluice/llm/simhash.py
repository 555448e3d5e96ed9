"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints within ``distance`` bits of each other agree on some choice of
``blocks - distance`` of the blocks their bits are split into, so each choice of
blocks gives a join key and pairs that share no key needn't be compared.  Copies are
one class before any join: rows with equal fingerprints meet in an aggregate.

A key shared by more than ``pair_limit`` fingerprints emits no pairs.  There, each
fingerprint sends its one-bit neighbourhood instead (two fingerprints within two bits
share a neighbour), in proportion to the group, and the fingerprints under one
neighbour are linked through the smallest of them after checking.  Both ways are
exact; the second gives the same components with fewer links.

Components: large-star/small-star rounds over the links, cut by staged tables; only
fingerprints with links take part.

Texts: A-Z in lower case, words between ASCII blanks, shingles of ``words`` words
(fewer: the whole sequence; none: fingerprint zero, linked like any other).  Null
counts as empty.  A null id counts as larger than any other.  Repeated rows come back
as often.  Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import drop_staged, ids_and_texts, slices, sql_type, staged, task, utf8


BLANK = re.compile(rb"[\x20\x09-\x0d]")


def byte_pieces(text: bytes, size: int = 1 << 20) -> list[bytes]:
    """A long text in pieces cut at blanks (a word that is longer stays whole)."""
    out, at = [], 0
    while len(text) - at > size and (m := BLANK.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Signed 64 bits."""
    from xxhash import xxh64_intdigest

    ones, n, carry = np.zeros(64, np.int64), 0, []
    for piece in byte_pieces(text):  # words of a piece, after the last ones before it
        w = carry + piece.lower().split()  # bytes: lower() takes A-Z, split() takes 0x20 and 0x09-0x0D
        shingles = [b" ".join(s) for s in zip(*(w[k:] for k in range(words)), strict=False)]
        carry = w[max(0, len(w) - words + 1) :]
        h = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(shingles)
    if not n and carry:  # fewer words than a shingle has
        h = np.array([xxh64_intdigest(b" ".join(carry), seed)], np.uint64)
        ones, n = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long)."""

    @task
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words, seed) for t in utf8(b.column(1).to_pylist())], pa.int64())], names=["id", "fp"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, f"id {sql_type(df, id_col)}, fp long")


def block_keys(distance: int, blocks: int):
    """A column for each choice of blocks: the bits of fp in them, with the choice's number."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).cast("byte").alias("n"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(classes: DataFrame, distance: int = 2, blocks: int = 5, pair_limit: int = 24) -> DataFrame:
    """Distinct links (a < b) whose components are those of all pairs of ``fp`` within ``distance`` bits."""
    if not 0 <= distance <= 2:
        raise ValueError("the neighbourhood way holds for up to two bits")
    keyed = classes.select("fp", F.explode(block_keys(distance, blocks)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = staged(keyed.join(sizes, "key").select("key", "size", "fp"), "simhash-keys")
    few = shared.filter(F.col("size") <= pair_limit).select("key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key")
        .filter((F.col("a") < F.col("b")) & near("a", "b", distance)).select("a", "b")
    )
    one_off = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)))
    crowd = shared.filter(F.col("size") > pair_limit).select("fp").distinct()
    spread = crowd.select("fp", F.explode(F.transform(one_off, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("hub"))
    hubs = spread.groupBy("hub").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("hub", "a")
    # all under a hub are within two bits of each other, so linking them to the smallest adds no false link
    through = spread.join(hubs, "hub").filter((F.col("fp") > F.col("a")) & near("a", "fp", distance)).select("a", F.col("fp").alias("b"))
    return staged(pairs.union(through).distinct(), "simhash-links")


def smallest_reachable(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node of the component."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark, old = None, None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = staged(small.filter("a != b").distinct(), "simhash-star")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if old is not None:
            drop_staged(old)
        if now == mark:
            break
        edges, old, mark = new, new, now
    else:
        raise RuntimeError("components did not settle")
    return new.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(df: DataFrame, words: int = 3, distance: int = 2, blocks: int = 5, pair_limit: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component: the smallest id of the documents reachable over links)."""
    rows = staged(fingerprints(df, words, 42, id_col, text_col), "simhash-rows")
    classes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    root = smallest_reachable(links(classes.select("fp"), distance, blocks, pair_limit))
    grouped = classes.join(root, classes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = grouped.groupBy("root").agg(F.min("least").alias("component"))
    label = grouped.join(best, "root").select("fp", "component")
    return rows.join(label, "fp").select("id", "fp", "component")


# --- near-duplicate groups by shingle similarity ---------------------------------------------------


TINY = 1e-9  # least shares times counts may be off by less
BLOCKS, SAMPLE = 12, 3  # of a wide fingerprint: blocks, and shingles in each
WORDS64, CROWD_WORDS64 = 16, 64  # and 64-bit words of bits: of all texts, and of those in crowds
PART = 1 << 14  # shingles worked on at once


def majority(h: np.ndarray) -> np.ndarray:
    """SimHash of each row of hashes, as signed 64 bits."""
    if h.shape[1] == 3:
        a, b, c = h.T
        return (a & b | a & c | b & c).view("<i8")
    ones = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(*h.shape, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > h.shape[1], axis=1, bitorder="little").view("<i8").ravel()


SEEDS = np.array([0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1 for k in range(CROWD_WORDS64)], np.uint64)


def mix(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Another hash of each hash.  Two rounds: with one, the order under different seeds would be correlated."""
    m = (h ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
    m = (m ^ (m >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return m ^ (m >> np.uint64(29))


def mixes(h: np.ndarray, words64: int = WORDS64) -> np.ndarray:
    """That many more hashes of each hash, a row each."""
    return mix(h[None, :], SEEDS[:words64, None])


def set_bits(mixed: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set, for 64 bits of each row."""
    raw, ones = np.ascontiguousarray(mixed.T).view(np.uint8), np.zeros(64 * len(mixed), np.int64)
    for at in range(0, len(raw), 255):
        ones += np.add.reduce(np.unpackbits(raw[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return ones


def packed(ones: np.ndarray, n: int) -> list[int]:
    """The bits set in over half of n, as signed words."""
    return np.packbits(2 * ones > n).view("<i8").tolist()


def wide_simhash(h: np.ndarray, words64: int = WORDS64) -> list[int]:
    return packed(sum(set_bits(mixes(h[at : at + PART], words64)) for at in range(0, len(h), PART)), len(h))


def bits_apart(least: float, words64: int) -> tuple[int, int]:
    """The most bits by which wide fingerprints of sets of that similarity differ, but for a chance of 3e-7: from nine shingles on, and below.

    A bit differs with probability acos(2s / (1 + s)) / pi at most; five deviations are
    added.  With fewer than nine shingles majorities tie often; measured: a quarter more.
    """
    p = float(np.arccos(min(1.0, 2 * least / (1 + least))) / np.pi)
    bits = 64 * words64
    return tuple(int(np.ceil(bits * q + 5 * np.sqrt(bits * q * (1 - q)))) for q in (p, min(0.5, 1.25 * p)))


def shingle_set(text: bytes, words: int) -> tuple[int, np.ndarray]:
    """A class of equal word sequences, and the sorted hashes of all shingles."""
    from xxhash import xxh64, xxh64_intdigest

    whole, carry, found = xxh64(seed=42), [], []
    for piece in byte_pieces(text):  # words of a piece, after the last ones before it
        w = piece.lower().split()
        if w:
            whole.update(b" ".join(w) if not carry else b" " + b" ".join(w))
        w = carry + w
        shingles = {b" ".join(s) for s in zip(*(w[k:] for k in range(words)), strict=False)}
        found.append(np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))))
        carry = w[max(0, len(w) - words + 1) :]
    h = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    if not len(h):
        h = np.array([xxh64_intdigest(b" ".join(carry), 42)], np.uint64)
    cls = whole.intdigest()
    return cls - (1 << 64) if cls >> 63 else cls, h


def wide_fingerprint(text: bytes, words: int) -> tuple[int, list[int], list[int], int]:
    """A class of equal word sequences, the blocks and the bits of its fingerprint, and the number of shingles.

    Block k is the SimHash of the SAMPLE shingles that come first under the k-th hash, so
    texts of similarity s share it with probability s ** SAMPLE.
    """
    cls, h = shingle_set(text, words)
    first, ones = np.zeros((BLOCKS, 0), np.uint64), np.zeros(64 * WORDS64, np.int64)
    for at in range(0, len(h), PART):
        own = h[at : at + PART]
        mixed = mixes(own)
        ones += set_bits(mixed)
        best = own[np.argpartition(mixed[:BLOCKS], SAMPLE, axis=1)[:, :SAMPLE]] if len(own) > SAMPLE else np.broadcast_to(own, (BLOCKS, len(own)))
        first = np.concatenate([first, best], axis=1)
    if first.shape[1] > SAMPLE:  # the sample is that of the parts' samples
        best = np.argpartition(mix(first, SEEDS[:BLOCKS, None]), SAMPLE, axis=1)[:, :SAMPLE]
        first = np.take_along_axis(first, best, axis=1)
    return cls, majority(first).tolist(), packed(ones, len(h)), len(h)


def exact_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of whole shingle sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(cls, n, at, key, prefix): the first of each class's shingles, those in fewest classes first; at: the place; prefix: all of the class's keys.

    Sets of similarity ``least`` have a shingle in common among them: of n, no more than
    n - least * n can be missing from the other.
    """

    @task
    def run(batches):
        for b in slices(batches, 1 << 20):
            h = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(1)]
            n = np.array([len(x) for x in h], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(h))], names=["cls", "n", "key"])

    shingles = sets.select("cls", "set").mapInArrow(run, "cls long, n int, key long")
    common = shingles.groupBy("key").agg(F.count("*").alias("classes"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy("classes", "key")) - 1
    first = shingles.join(common, "key").withColumn("at", place).filter(F.col("n") - F.col("at") >= least * F.col("n") - TINY)
    lists = first.filter("classes > 1").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("prefix"))
    return lists.select("cls", "n", F.col("prefix.key").alias("prefix"), F.explode("prefix").alias("one")).select("cls", "n", "one.at", "one.key", "prefix")


def hamming(least: float, words64: int = WORDS64):
    """Whether the rows' fingerprints fp_1, fp_2 are within the bits that similarity ``least`` allows."""
    if words64 <= WORDS64:
        apart = sum((F.bit_count(F.col("fp_1")[k].bitwiseXOR(F.col("fp_2")[k])) for k in range(1, words64)), F.bit_count(F.col("fp_1")[0].bitwiseXOR(F.col("fp_2")[0])))
    else:  # too long a method for the JVM's compiler if written out
        apart = F.aggregate(F.zip_with("fp_1", "fp_2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most, most_few = bits_apart(least, words64)
    return apart <= F.when(F.least("n_1", "n_2") < 9, most_few).otherwise(most)


def possible_pairs(keyed: DataFrame, least: float, words64: int = WORDS64) -> DataFrame:
    """Pairs (a < b) of different parts under a key whose fingerprints are near and that can be ``least`` alike.

    Sets of m and n shingles have least / (1 + least) * (m + n) in common, and none of those
    before their first key in common.  So the smaller one has that key near its front: only
    such rows start pairs.  Rows of one key are dealt over tasks.  With a column prefix, a pair
    is made under the first key that both have, and under no other.
    """
    share = least / (1 + least)
    front = F.col("n") - F.col("at") >= 2 * share * F.col("n") - TINY
    deal = F.ceil(F.col("size") / 256).cast("int")
    own = ("cls", "part", "n", "at", "fp", *(("prefix",) if "prefix" in keyed.columns else ()))
    one = keyed.filter(front).select("key", F.pmod(F.xxhash64("cls"), deal).cast("int").alias("salt"), *(F.col(c).alias(f"{c}_1") for c in own))
    two = keyed.select("key", F.explode(F.sequence(F.lit(0), deal - 1)).alias("salt"), *(F.col(c).alias(f"{c}_2") for c in own))
    if "prefix" in own:  # small rows, much to compare: not to be put together into few tasks
        tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        one, two = one.repartition(tasks, "key", "salt"), two.repartition(tasks, "key", "salt")
    joined = one.join(two, ["key", "salt"]).filter("part_1 <> part_2 AND (n_1 < n_2 OR n_1 = n_2 AND cls_1 < cls_2)")
    joined = joined.filter(F.least(F.expr("n_1 - at_1"), F.expr("n_2 - at_2")) >= share * F.expr("n_1 + n_2") - TINY)
    if "prefix" in own:
        joined = joined.filter(F.array_intersect("prefix_1", "prefix_2")[0] == F.col("key"))
    joined = joined.filter(hamming(least, words64))
    return joined.select(F.least("cls_1", "cls_2").alias("a"), F.greatest("cls_1", "cls_2").alias("b"))


def near_groups(df: DataFrame, words: int = 5, least: float = 0.8, pair_limit: int = 24, stars: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group) for rows that aren't the smallest id of their group of near copies.

    Fingerprints have BLOCKS blocks, each of a few sampled shingles, and WORDS64 words of
    SimHash over all shingles (CROWD_WORDS64 in crowds).  Candidates share a block; in the same join
    their Hamming distance is verified (see bits_apart), and what passes on whole shingle sets.

    A block with more than ``pair_limit`` classes (a crowd) emits no pairs: each class is
    compared with one of them, the centre.  The classes of crowds that then hold more
    than one group are joined once more, exactly: on the rarest of their shingles (see
    prefixes).  A shingle's crowd has other centres first, ``stars`` times, to bring
    copies together; then all its pairs of different groups that can be near are compared.
    """
    kind = sql_type(df, id_col)
    texts = ids_and_texts(df, id_col, text_col).filter("id is not null")

    @task
    def run(batches):
        for b in slices(batches):
            cls, blocks, fp, n = zip(*(wide_fingerprint(t, words) for t in utf8(b.column(1).to_pylist())), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(fp, pa.list_(pa.int64())), pa.array(n, pa.int32())], names=["id", "cls", "blocks", "fp", "n"])

    @task
    def shingle(batches):
        for b in slices(batches, 1 << 20):
            cls, sets = zip(*(shingle_set(t, words) for t in utf8(b.column(1).to_pylist())), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names=["cls", "set"])

    @task
    def widen(batches):
        for b in slices(batches, 1 << 20):
            fp = [wide_simhash(np.frombuffer(x.as_buffer(), "<u8"), CROWD_WORDS64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.list_(pa.int64()))], names=["cls", "fp"])

    @task
    def verify(batches):
        for b in slices(batches):
            yes = [exact_similarity(x.as_buffer(), y.as_buffer()) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    def whole_sets(wanted):
        """(cls, set) of the wanted classes, from the texts of their heads."""
        ids = heads.join(wanted, "cls", "left_semi").select(F.col("head").alias("id"))
        sets = texts.join(ids, "id", "left_semi").mapInArrow(shingle, "cls long, set binary")
        return staged(sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "near-sets")

    def both(pairs, table, col):
        return pairs.join(table.select(F.col("cls").alias("a"), F.col(col).alias("sa")), "a").join(table.select(F.col("cls").alias("b"), F.col(col).alias("sb")), "b").select("a", "b", "sa", "sb")

    rows = staged(texts.mapInArrow(run, f"id {kind}, cls long, blocks array<long>, fp array<long>, n int"), "near-rows")
    heads = staged(rows.groupBy("cls").agg(F.min("id").alias("head"), *(F.first(c).alias(c) for c in ("n", "blocks", "fp"))), "near-heads")
    prints = heads.select("cls", "fp")
    # part: the group known so far; two of one part needn't be compared
    keyed = heads.select("cls", F.col("cls").alias("part"), "n", F.lit(0).alias("at"), F.posexplode("blocks").alias("k", "bits")).select("cls", "part", "n", "at", F.xxhash64("k", "bits").alias("key"))
    root, sets, crowds, level, words64 = None, None, None, 0, WORDS64
    while True:
        crowded = F.col("size") > pair_limit if level <= stars else F.lit(False)
        center = F.min_by(F.struct("cls", "part", "n"), F.struct(F.xxhash64("cls", F.lit(level)), "cls")) if level else F.min(F.struct("cls", "part", "n"))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), center.alias("center"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        shared = staged(keyed.join(sizes.filter("lo < hi").select("key", "size", "center"), "key"), "near-keys")
        if crowds is not None:
            drop_staged(crowds)
        pairs = possible_pairs(shared.filter(~crowded).drop("center").join(prints, "cls"), least, words64)
        star = shared.filter(crowded & (F.col("part") != F.col("center.part"))).select("cls", F.col("center.cls").alias("mid"), F.col("n").alias("n_1"), F.col("center.n").alias("n_2")).distinct()
        star = star.join(prints.select("cls", F.col("fp").alias("fp_1")), "cls").join(prints.select(F.col("cls").alias("mid"), F.col("fp").alias("fp_2")), "mid").filter(hamming(least, words64))
        star = star.select(F.least("cls", "mid").alias("a"), F.greatest("cls", "mid").alias("b"))
        likely = staged(pairs.union(star).distinct(), "near-likely")
        wanted = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct()
        own = whole_sets(wanted) if sets is None else sets
        found = staged(both(likely, own, "set").mapInArrow(verify, "a long, b long"), "near-links")
        drop_staged(likely)
        if sets is None:
            drop_staged(own)
        if root is None:
            root = smallest_reachable(found)
        elif not found.isEmpty():
            old, root = root, smallest_reachable(root.toDF("a", "b").union(found))
            drop_staged(old)
        drop_staged(found)
        now = shared.filter(crowded).drop("part", "size", "center").join(root, F.col("cls") == root.node, "left").select(*(c for c in shared.columns if c not in ("part", "size", "center")), F.coalesce("root", "cls").alias("part"))
        mixed = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
        crowds = keyed = staged(now.join(mixed, "key", "left_semi"), "near-crowds")
        drop_staged(shared)
        if keyed.isEmpty():
            break
        level += 1
        if level == 1:
            members = staged(keyed.groupBy("cls").agg(F.min("part").alias("part")), "near-members")
            sets = whole_sets(members.select("cls"))
            prints, words64 = staged(sets.mapInArrow(widen, "cls long, fp array<long>"), "near-wide"), CROWD_WORDS64
            keyed = staged(prefixes(sets, least).join(members, "cls"), "near-prefixes")
            drop_staged(crowds)
            drop_staged(members)
            crowds = keyed
    if sets is not None:
        drop_staged(sets)
    grouped = staged(heads.select("cls", "head").join(root, F.col("cls") == root.node, "left").select("cls", "head", F.coalesce("root", "cls").alias("root")), "near-grouped")
    drop_staged(root)
    least_ids = grouped.groupBy("root").agg(F.min("head").alias("group"))
    return rows.select("id", "cls").join(grouped.join(least_ids, "root").select("cls", "group"), "cls").filter("id != group").select("id", "group")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows without near copies of a smaller id; rows with equal ids stay or go together, null ids stay."""
    gone = near_groups(df, id_col=id_col, text_col=text_col, **how).select(F.col("id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)


def op8_simhash(spark, sf_dir):
    got = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
