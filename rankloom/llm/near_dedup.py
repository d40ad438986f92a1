"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A document's set is its distinct SHINGLE-word shingles as 64-bit hashes. Two permutations give the whole signature:
sigma places a shingle in a circle of 2 ** CIRCLE places, and coordinate k of the signature is the shingle with the
least pi(sigma(x) + k), pi being one fixed permutation that is shifted round the circle for each coordinate. Of several
shingles in one place the least hash counts, so that sets larger than the circle are told apart as well as small ones.
Signatures of BANDS x ROWS coordinates are banded; two sets of Jaccard similarity 0.75 share no band with
probability (1 - 0.75 ** ROWS) ** BANDS, under 3e-7.

Equal sets are one node (its smallest id). Buckets never give all their pairs. Links are sought in rounds:
1. each node against the leader (a random member) that it shares most bands with; 2. against the leaders of its
other buckets, where the two are not yet in one group; 3. in buckets that still hold several groups, members outside the
largest group against all, in blocks of at most BLOCK by BLOCK. A block compares signatures first (pairs that agree in
fewer than MAYBE of the coordinates are 4 deviations below the threshold), then whole sets cut to 32 bits a shingle,
each pair in the first bucket that its two members share; only pairs that come within NEAR of the threshold leave it.
Every proposal is decided on the full sets. Groups are connected components,
found by alternating large-star and small-star steps over tables; nothing is gathered on the driver.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; fewer than SHINGLE
words are one shingle; a very long text is compared by its whole set; rows that share an id are one document, for whose
links the text with the least hash counts, while each row states its own n_shingles; a row with a null id has component
null and is kept; a similarity of exactly the threshold links; an empty table gives an empty result; extra columns are
ignored, also those named as the results are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_text, batched, gram_hashes, mixed, remove, settle, trim, written

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, CIRCLE = 40, 4, 20
MAYBE = 0.60
#: Ids up to this many are sent to all executors to pick their texts (8 bytes each); more are joined by shuffle.
MAX_BROADCAST_IDS = 500_000
#: Rows of a side of a block in round 3. Sets of 32-bit hashes tell a similarity to within NEAR: two of a few thousand
#: shingles collide once in 1,000 pairs.
BLOCK, BLOCK_SHINGLES, NEAR = 512, 4_000_000, 0.005
#: Tasks over which the neighbours of one node are dealt.
SALTS = 8


@functools.cache
def circle() -> np.ndarray:
    """pi over the circle, one signature's length longer, as rows of consecutive values."""
    pi = np.random.default_rng(20240229).permutation(1 << CIRCLE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: BANDS * ROWS]]), BANDS * ROWS)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Each text's set, sorted."""
    words = Words(pc.ascii_lower(texts))
    hashes = words.hashes()
    grams = gram_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(mixed(gram_hashes(hashes[a:b], int(b - a)) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


@functools.cache
def place_of() -> np.ndarray:
    """The inverse of pi."""
    pi = circle()[: 1 << CIRCLE, 0]
    out = np.empty(1 << CIRCLE, np.int64)
    out[pi] = np.arange(1 << CIRCLE)
    return out


def signature(shingle: np.ndarray) -> np.ndarray:
    """The shingle of each coordinate, from a sorted set."""
    table, places = circle(), (mixed(shingle) >> np.uint64(64 - CIRCLE)).astype(np.int64)
    order = np.argsort(places, kind="stable")
    places = places[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    places, owner = places[first], shingle[order[first]]
    least = table[places[:512]].min(0)
    for at in range(512, len(places), 512):
        np.minimum(least, table[places[at : at + 512]].min(0), out=least)
    where = (place_of()[least] - np.arange(BANDS * ROWS)) & ((1 << CIRCLE) - 1)
    return owner[np.searchsorted(places, where)]


def sketch(docs: DataFrame) -> DataFrame:
    """(id, h, n, key, bands, sig) of documents (id, text): hash of the text, set size, hash of the set, band hashes, 16 bits a
    coordinate."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(as_text(batch.column("text")))
        keys, bands, sigs = [], [], []
        salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for s in sets:
            if not len(s):
                keys.append(None), bands.append(None), sigs.append(None)
                continue
            sig = mixed(signature(s))
            rows = sig.reshape(BANDS, ROWS)
            h = salt.copy()
            for r in range(ROWS):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            bands.append(h.astype(np.int64))
            sigs.append(sig.astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["id", "h", "n", "key", "bands", "sig"],
        )

    return batched(docs.select("id", "text", F.xxhash64("text").alias("h")), run, "id bigint, h bigint, n bigint, key binary, bands array<bigint>, sig binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with `linked`: whether the full sets are similar enough. texts: (id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = shingles(as_text(batch.column("text_a"))), shingles(as_text(batch.column("text_b")))
        linked = []
        for x, y in zip(left, right):
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return batched(both.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a, b): the smallest id of its connected component."""
    spark = links.sparkSession
    paths: list[str] = []
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges", paths)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        spread = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))  # a node may have any number of neighbours
        large = spread.join(copies.hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select("u", "v")  # every edge points to a smaller id
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        own: list[str] = []
        edges = written(small, "edges", own)
        for p in paths:
            remove(spark, p)
        paths = own
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def _with_group(rows: DataFrame, groups: DataFrame | None, id_col: str, name: str) -> DataFrame:
    if groups is None:
        return rows.withColumn(name, F.col(id_col))
    g = groups.select(F.col("id").alias(id_col), F.col("root").alias("__root"))
    return rows.join(g, id_col, "left").withColumn(name, F.coalesce("__root", id_col)).drop("__root")


def compared(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of a block of one bucket to verify: rows id, grp, side (1 left, 2 right, 3 both), sig, cut."""
    sig = np.frombuffer(b"".join(block["sig"]), "<u2").reshape(len(block["id"]), BANDS, ROWS)
    ids, grp, side = np.array(block["id"]), np.array(block["grp"]), np.array(block["side"])
    cut = [np.frombuffer(c, "<u4") for c in block["cut"]]
    own_band = (sig == sig[0]).all(2).all(0).argmax()  # the first band that all share
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    out_a, out_b = [], []
    for x in left:
        other = right[(grp[right] != grp[x]) & ~((side[right] == 3) & (side[x] == 3) & (ids[right] < ids[x]))]
        if not len(other):
            continue
        same = sig[other] == sig[x]
        other = other[(same.mean((1, 2)) >= MAYBE) & (same.all(2).argmax(1) == own_band)]
        joined = set()
        for y in other:
            if grp[y] in joined:
                continue
            a, b = (cut[x], cut[y]) if len(cut[x]) <= len(cut[y]) else (cut[y], cut[x])
            if 100 * len(a) < (PERCENT - 1) * len(b):
                continue
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = np.count_nonzero(b[at] == a)
            alike = both / (len(a) + len(b) - both)
            if alike < PERCENT / 100 - NEAR:
                continue
            out_a.append(min(ids[x], ids[y])), out_b.append(max(ids[x], ids[y]))
            if alike >= PERCENT / 100 + NEAR:  # surely linked: one link joins x to the group
                joined.add(grp[y])
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _proposals(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify, from the sorted blocks of _open_blocks."""
    names = ["id", "grp", "side", "sig", "cut"]

    def run(batches):
        held, key = {c: [] for c in names}, None

        def done():
            a, b = compared(held) if held["id"] else ((), ())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in names}
            for r, k in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")))):
                if k != key:
                    yield from done()
                    held, key = {c: [] for c in names}, k
                for c in names:
                    held[c].append(cols[c][r])
        yield from done()
        trim()

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def cut_sets(texts: DataFrame) -> DataFrame:
    """(id, cut): each set as sorted 32-bit hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in shingles(as_text(batch.column("text")))]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cut, pa.binary())], names=["id", "cut"])

    return batched(texts, run, "id bigint, cut binary")


def _open_blocks(members: DataFrame, groups: DataFrame | None, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks of the buckets that hold several groups: members outside the largest on the left, all on the right."""
    rows = _with_group(members.select("bucket", "id", "size"), groups, "id", "grp")
    by_group = rows.groupBy("bucket", "grp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    about = by_group.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "grp", "size")).alias("big"), F.count("*").alias("n_groups")).where("n_groups > 1")
    cells = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    size = about.select("bucket", F.col("big.grp").alias("big"), cells(F.col("n") - F.col("big.n"), F.col("size") - F.col("big.size")).alias("n_i"), cells(F.col("n"), F.col("size")).alias("n_j"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    at = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    zero, outside = F.lit(0), F.col("grp") != F.col("big")
    to_left = F.transform(F.sequence(zero, F.col("n_j") - 1), lambda j: at(1, place("n_i"), j))
    to_right = F.transform(F.sequence(zero, F.col("n_i") - 1), lambda i: at(2, i, place("n_j")))
    one = F.when(outside, F.array(at(3, zero, zero))).otherwise(F.array(at(2, zero, zero)))
    to = F.when((F.col("n_i") == 1) & (F.col("n_j") == 1), one).when(outside, F.concat(to_left, to_right)).otherwise(to_right)
    dealt = rows.join(size, "bucket").select("bucket", "id", "grp", F.explode(to).alias("to")).select("bucket", "to.i", "to.j", "id", "grp", "to.side")
    held = nodes.join(cut_sets(texts), "id")
    return dealt.join(held, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: id, n_shingles, component_id (smallest id of its group), kept (it is that document)."""
    spark = docs.sparkSession
    scratch: list[str] = []
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(sketch(rows), "sketches", scratch)
    by_id = sketches.where("id is not null").groupBy("id").agg(F.min(F.struct("h", "key")).alias("m")).select("id", F.col("m.h").alias("h"), F.col("m.key").alias("key"))
    by_id = written(by_id, "ids", scratch)
    first = written(by_id.where("key is not null").groupBy("key").agg(F.min(F.struct("id", "h")).alias("m")).select("key", F.col("m.id").alias("node"), F.col("m.h").alias("h")), "nodes", scratch)
    nodes = sketches.select("id", "h", "n", "bands", "sig").join(first.select(F.col("node").alias("id"), "h"), ["id", "h"], "left_semi").dropDuplicates(["id"])
    nodes = written(nodes.select("id", "n", "bands", "sig"), "banded", scratch)

    buckets = nodes.select("id", F.col("n").alias("size"), F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id")).alias("l")).where("n > 1")
    members = written(buckets.join(leaders.select("bucket", F.col("l.id").alias("leader")), "bucket"), "members", scratch)
    ids = written(members.select("id").distinct(), "candidates", scratch)
    n_ids = ids.count()
    picked = F.broadcast(ids) if n_ids <= MAX_BROADCAST_IDS else ids
    texts = rows.join(picked, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = written(texts, "texts", scratch)
    settle(spark)

    stars = members.where("id != leader").groupBy("id", "leader").agg(F.count("*").alias("bands"))
    stars = written(stars.select("id", "leader", "bands", F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")), "stars", scratch)
    groups: DataFrame | None = None
    for step in (1, 2, 3) if n_ids else ():
        if step == 1:
            best = stars.groupBy("id").agg(F.max_by("leader", F.struct("bands", F.xxhash64("id", "leader"))).alias("leader"))
            pairs = tried = best.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        elif step == 2:
            pairs = stars.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
            pairs = _with_group(_with_group(pairs, groups, "a", "ga"), groups, "b", "gb").where("ga != gb").select("a", "b")
        else:
            pairs = _proposals(_open_blocks(members, groups, nodes.select("id", "sig"), texts))
        pairs = written(pairs, "pairs", scratch)
        tried = pairs if step == 1 else tried
        links = written(verified(pairs, texts).where("linked").select("a", "b"), "links", scratch)
        if step == 1 or not links.isEmpty():
            groups = components(links if groups is None else links.unionByName(groups.select(F.col("id").alias("a"), F.col("root").alias("b"))))
        settle(spark)

    every = by_id.join(first.select("key", "node"), "key", "left").select("id", "node")
    found = _with_group(every, groups, "node", "root") if groups is not None else every.withColumn("root", F.col("node"))
    out = sketches.select("id", "n").join(found.select("id", "root").hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("root") == F.col("id"), F.lit(True)).alias("kept"))
    out = written(out, "groups")
    for p in scratch:
        remove(spark, p)
    return out
