"""Exact removal of repeated word spans with suffix automata.

A window of SPAN words is removed where the same words start earlier: in a document with a smaller id, or before in
the same one. What a window says of its own place is kept small by an anchor: of its runs of GRAM words, the one with
the least hash (the first of equals). Equal windows have equal anchors, so a window can only repeat among windows with
the anchor's hash, and the consecutive windows of one anchor are a segment of at most 2 * SPAN words.

1. Anchor hashes that occur once are dropped (counted with a combine before the shuffle).
2. Copies of a segment are put together before the shuffle of their words: one row with their first place, which every
   other place repeats whole.
3. The different segments of an anchor hash are a reference shard: in order of place each goes through the suffix
   automaton of those before it, and where the matching statistic reaches SPAN the window is a repeat. A shard holds
   MAX_SEGMENTS segments at most; what belongs to a larger one is dealt anew, by the hashes of its windows' two, four,
   eight and at last all least runs, until its parts are shards: so a passage in any number of texts, or a frequent run
   of words, is split as far as its surroundings differ, and put together where they do not.
4. Documents are joined with their repeats, and the words under them are left out.

Rows of an anchor with more than its share of all (one in HOT_PARTS, so at most HOT_PARTS anchors, which are sent to all
executors) are dealt over several tasks wherever they are joined.

Automata travel with their shard and not to every task: with the corpus as its own reference, broadcasting each to
each document would take time and memory that grow with the square of the corpus. `against_reference` is the form
with a given reference, whose automata are broadcast, as many at a time as a task can hold.

Words are compared by 64-bit hashes. Defined results: a null or empty text has no words; rows with a null id are
kept whole and repeat nothing; rows that share an id are one document, for which the text with the least hash stands,
and what it loses goes at the same places from each of them; of equal windows the one with the smallest id, then start, stays; a very
long text is searched whole; extra columns are ignored, also those named as the results are; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_text, batched, gram_hashes, mixed, remove, settle, written

SPAN, GRAM = 20, 8
#: Different segments in a shard, and the least runs that deal a larger one anew, in turn.
MAX_SEGMENTS, DEALS = 2000, (2, 4, 8, SPAN - GRAM + 1)
#: A key of more rows than this share of all and this many more is dealt over several tasks.
HOT_PARTS, HOT_LEAST = 10_000, 1000
#: Words of a given reference in one automaton, and automata that are broadcast at a time.
SHARD_WORDS, SHARDS_AT_ONCE = 250_000, 8


class SuffixAutomaton:
    """Of sequences of hashable words; each is added after a break that nothing matches."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for w in words:
            if w in nxt[last]:  # the prefix so far is known from an earlier sequence
                p, q = last, nxt[last][w]
                if length[q] == length[p] + 1:
                    last = q
                    continue
                last = self._clone(p, q, w)
                continue
            cur = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def statistics(self, words) -> list[int]:
        """For each word, the length of the longest match that ends there."""
        nxt, link, length, state, n, out = self.next, self.link, self.length, 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            out.append(n)
        return out


def segments(hashes: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """All segments of a batch of texts: text, anchor hash, first window's start in the text, windows, and a key.

    The key stands for the segment's words and the anchor's place in them: its first and last window cover it.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("text", "start", "n")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "key")}
    if len(hashes) < SPAN:
        return empty
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams, width = gram_hashes(hashes, GRAM), SPAN - GRAM + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.concatenate([views[a : a + 200_000].argmin(1) for a in range(0, len(views), 200_000)]) + np.arange(len(views))
    whole = np.flatnonzero(owner[: len(at)] == owner[SPAN - 1 :])
    if not len(whole):
        return empty
    anchor = at[whole]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[whole[1:]] != owner[whole[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    windows = gram_hashes(hashes, SPAN)
    n, text = last - first + 1, owner[whole[first]]
    shape = (n * 64 + anchor[first] - whole[first]).astype(np.uint64)
    key = mixed(mixed(windows[whole[first]]) + windows[whole[last]] * np.uint64(3) + mixed(shape + np.uint64(1)))
    return {"text": text, "anchor": grams[anchor[first]], "start": whole[first] - bounds[text], "n": n, "key": key}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, n): occurrences of each anchor hash, summed within a batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(as_text(batch.column("text")))
        h, n = np.unique(segments(words.hashes(), words.bounds)["anchor"], return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(h), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return batched(docs.select("text"), run, "anchor bigint, n bigint")


def places(docs: DataFrame) -> DataFrame:
    """(anchor, seg, id, start, n) of every segment."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(as_text(batch.column("text")))
        s = segments(words.hashes(), words.bounds)
        ids = batch.column("id").to_numpy(zero_copy_only=False)[s["text"]]
        return pa.RecordBatch.from_arrays([_signed(s["anchor"]), _signed(s["key"]), pa.array(ids, pa.int64()), pa.array(s["start"].astype(np.int32)), pa.array(s["n"].astype(np.int32))], names=["anchor", "seg", "id", "start", "n"])

    return batched(docs, run, "anchor bigint, seg bigint, id bigint, start int, n int")


def _contents(texts: DataFrame) -> DataFrame:
    """The words of segments, from (id, text, of: array of (anchor, seg, start, n))."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(as_text(batch.column("text")))
        h, rows = words.hashes(), []
        for doc, a, b, of in zip(batch.column("id").to_pylist(), words.bounds[:-1], words.bounds[1:], batch.column("of").to_pylist()):
            own = h[a:b]
            rows += [(s["anchor"], s["seg"], doc, s["start"], s["n"], own[s["start"] : s["start"] + s["n"] + SPAN - 1].tobytes()) for s in of]
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "seg", "id", "start", "n", "words"])

    return batched(texts, run, "anchor bigint, seg bigint, id bigint, start int, n int, words binary")


def _by_automaton(rows: DataFrame) -> DataFrame:
    """(anchor, seg, mask) from (shard, anchor, seg, id, start, j, n, words): bit j + i says that window i of the words
    occurs earlier in its shard."""
    names = ("shard", "anchor", "seg", "j", "n", "words")

    def run(batches):
        key, automaton = None, None
        for batch in batches:
            out = []
            for shard, anchor, seg, j, n, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                if shard != key:
                    key, automaton = shard, SuffixAutomaton()
                words = np.frombuffer(raw, np.uint64).tolist()
                reach = automaton.statistics(words)
                out.append((anchor, seg, sum(1 << i for i in range(n) if reach[i + SPAN - 1] >= SPAN) << j))
                automaton.add(words)
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "seg", "mask"])

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "id", "start")
    return dealt.select(*names).mapInArrow(run, "anchor bigint, seg bigint, mask bigint").where("mask != 0")


def _dealt_anew(rows: DataFrame, runs: int) -> DataFrame:
    """The segments of large shards, cut where the hashes of their windows' least `runs` runs change: these make the new
    shard; key stands for the words."""
    names = ("anchor", "seg", "id", "start", "j", "n", "words")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for anchor, seg, doc, start, j, n, raw in zip(*(batch.column(c).to_pylist() for c in names)):
            grams = gram_hashes(np.frombuffer(raw, np.uint64), GRAM)
            views = np.lib.stride_tricks.sliding_window_view(grams, SPAN - GRAM + 1)[:n]
            least = np.sort(views, 1)[:, :runs]
            with np.errstate(over="ignore"):
                shard = mixed((mixed(least) * (2 * np.arange(1, runs + 1, dtype=np.uint64) + np.uint64(1))).sum(1, dtype=np.uint64)).view(np.int64)
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = raw[8 * a : 8 * (b + SPAN - 1)]
                out.append((int(shard[a]), xxhash.xxh3_64_intdigest(part) - 2**63, anchor, seg, doc, start + a, j + a, b - a, part))
        cols = list(zip(*out)) or [[]] * 9
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "key", *names])

    return batched(rows.select(*names), run, "shard bigint, key bigint, anchor bigint, seg bigint, id bigint, start int, j int, n int, words binary")


def _dealt_join(many: DataFrame, few: DataFrame, keys: list[str], by: str, rows: str) -> DataFrame:
    """An inner join with few, which has a row for each key and how many rows of many have it (column rows), read from a
    written table: a key with more than its share of all is dealt over several tasks by a hash of `by`."""
    share = (few.agg(F.sum(rows)).first()[0] or 0) // HOT_PARTS + HOT_LEAST
    salts = F.ceil(F.col(rows) / share).cast("int")
    hot = F.broadcast(few.where(F.col(rows) > share).select(*keys, salts.alias("__salts")))  # fewer than HOT_PARTS
    spread = many.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(by, *keys), F.coalesce("__salts", F.lit(1))).cast("int"))
    dealt = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return spread.drop("__salts").join(dealt.hint("merge"), [*keys, "__salt"]).drop("__salt")


def _masks(content: DataFrame, scratch: list[str]) -> DataFrame:
    """(anchor, seg, mask) of segments (shard, anchor, seg, id, start, j, n, words) whose words differ within a shard."""
    found, rows = [], content
    for runs in (*DEALS, None):
        sizes = written(rows.groupBy("shard").agg(F.count("*").alias("segs")), "sizes", scratch)
        sized = _dealt_join(rows, sizes, ["shard"], "seg", "segs")
        own = sized.where(F.col("segs") <= MAX_SEGMENTS) if runs else sized  # by all runs a shard is one window
        found.append(written(_by_automaton(own), "masks", scratch))
        if not runs or sizes.where(F.col("segs") > MAX_SEGMENTS).isEmpty():
            break
        parts = written(_dealt_anew(sized.where(F.col("segs") > MAX_SEGMENTS), runs), "parts", scratch)
        lead = parts.groupBy("shard", "key").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("copies"))
        lead = written(lead, "lead", scratch)
        parts = _dealt_join(parts, lead, ["shard", "key"], "seg", "copies")
        first = F.expr("id = first.id and start = first.start")
        whole = parts.where(~first).select("anchor", "seg", F.expr("shiftleft(shiftleft(1L, n) - 1L, j)").alias("mask"))
        found.append(written(whole, "whole", scratch))
        several = written(lead.groupBy("shard").agg(F.count("*").alias("keys")), "several", scratch)
        rows = _dealt_join(parts.where(first).drop("first", "copies", "key"), several, ["shard"], "seg", "keys").where("keys > 1").drop("keys")
        rows = written(rows, "shards", scratch)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("anchor", "seg").agg(F.bit_or("mask").alias("mask"))


def repeats(docs: DataFrame, scratch: list[str]) -> DataFrame:
    """(id, start, n, mask): segments of documents (id, text) with windows to remove; mask null: all of them."""
    spark = docs.sparkSession
    docs = docs.where("id is not null")
    shared = written(docs.groupBy("id").count().where("count > 1").select("id"), "shared", scratch)
    if not shared.isEmpty():
        one = docs.join(shared, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        docs = docs.join(shared, "id", "left_anti").unionByName(one)
    flagged = written(anchors(docs).groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1"), "anchors", scratch)
    found = written(_dealt_join(places(docs), flagged, ["anchor"], "id", "times"), "places", scratch)
    settle(spark)
    first = found.groupBy("anchor", "seg").agg(F.min(F.struct("id", "start")).alias("p"), F.max("n").alias("n"), F.count("*").alias("copies"))
    first = written(first.select("anchor", "seg", "n", "copies", F.col("p.id").alias("id"), F.col("p.start").alias("start")), "segments", scratch)
    several = written(first.groupBy("anchor").agg(F.count("*").alias("segs")), "several", scratch)
    open_ = _dealt_join(first, several, ["anchor"], "seg", "segs").where("segs > 1")
    wanted = open_.groupBy("id").agg(F.collect_list(F.struct("anchor", "seg", "start", "n")).alias("of"))
    content = written(_contents(docs.join(wanted.hint("merge"), "id")).withColumn("shard", F.col("anchor")).withColumn("j", F.lit(0)), "contents", scratch)
    settle(spark)
    masks = written(_masks(content, scratch), "masks", scratch)
    settle(spark)
    lead = first.join(masks.hint("merge"), ["anchor", "seg"], "left").select("anchor", "seg", "copies", F.col("id").alias("lead_id"), F.col("start").alias("lead_start"), F.coalesce("mask", F.lit(0).cast("bigint")).alias("lead_mask"))
    lead = written(lead, "leads", scratch)
    own = F.expr("id = lead_id and start = lead_start")
    out = _dealt_join(found.select("anchor", "seg", "id", "start", "n"), lead, ["anchor", "seg"], "id", "copies").select("id", "start", "n", F.when(own, F.col("lead_mask")).alias("mask"))
    return out.where("mask is null or mask != 0")


def removed_words(n_words: int, spans: list[dict]) -> np.ndarray:
    """Which words the windows of the spans (start, n, mask) cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans:
        at, n, mask = s["start"], s["n"], s["mask"]
        for a, b in [(at, at + n)] if mask is None else [(at + j, at + j + 1) for j in range(n) if mask >> j & 1]:
            if a < n_words:
                edge[a] += 1
                edge[min(b + SPAN - 1, n_words)] -= 1
    return np.cumsum(edge)[:-1] > 0


def _cut(joined: DataFrame, keep: list[str], with_text: bool) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_text(batch.column("__text"))
        n, gone, sha, left = [], [], [], []
        for text, spans in zip(texts.to_pylist(), batch.column("__spans").to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()
            out = removed_words(len(words), spans) if spans else np.zeros(0, bool)
            kept = [w for w, x in zip(words, out) if not x] if spans else words
            n.append(len(words)), gone.append(len(words) - len(kept))
            joined_ = b" ".join(kept)
            sha.append(hashlib.sha256(joined_).hexdigest())
            left.append(joined_.decode("utf-8", "surrogatepass") if gone[-1] else text)
        cols = [*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
        names = [*keep, "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array(left, pa.string())], [*names, "kept_text"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return batched(joined, run, f"{kinds}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """For each document: id, keep, n_words, n_removed, kept_sha256 (of the kept words joined by a space).

    with_text adds kept_text: the text as it was where nothing is removed, else the kept words joined by a space.
    """
    scratch: list[str] = []
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = written(repeats(rows, scratch).groupBy("id").agg(F.collect_list(F.struct("start", "n", "mask")).alias("__spans")), "spans")
    for path in scratch:
        remove(docs.sparkSession, path)
    columns = [id_col, *keep]
    base = docs.select(*columns, F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("bigint").alias("__id"))
    return _cut(base.join(spans, base["__id"] == spans["id"], "left").select(*columns, "__text", "__spans"), columns, with_text)


def _automata(reference: DataFrame) -> DataFrame:
    """(states, links): the pickled automata of a reference (text), each of about SHARD_WORDS words, built on executors."""

    def run(batches):
        one, room = None, 0
        for batch in batches:
            for text in as_text(batch.column("text")).to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()
                if one is not None and room < len(words):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((one.next, one.link, one.length))], pa.binary())], names=["automaton"])
                    one = None
                if one is None:
                    one, room = SuffixAutomaton(), SHARD_WORDS
                one.add(words)
                room -= len(words)
        if one is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((one.next, one.link, one.length))], pa.binary())], names=["automaton"])

    return reference.mapInArrow(run, "automaton binary")


def against_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id, n_words, n_removed, kept_text): without the maximal spans of `span` words or more that the reference holds.

    Documents are streamed past SHARDS_AT_ONCE broadcast automata at a time: a reference of any size takes so many more
    passes. A text of the reference with more than SHARD_WORDS words makes one automaton of its own.
    """
    spark, scratch = docs.sparkSession, []
    texts = reference.select(F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    shards = written(_automata(texts).withColumn("nth", F.monotonically_increasing_id()), "automata", scratch)
    order = [r.nth for r in shards.select("nth").orderBy("nth").toLocalIterator()]  # a number for each 250,000 words
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("gone"))

    def passed(rows: DataFrame, sent) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            automata = []
            for raw in sent.value:
                one = SuffixAutomaton()
                one.next, one.link, one.length = pickle.loads(raw)
                automata.append(one)
            out = []
            for text, before in zip(as_text(batch.column("text")).to_pylist(), batch.column("gone").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for one in automata:
                    for e, m in enumerate(one.statistics(words)):
                        if m >= span:
                            edge[e + 1 - m] += 1
                            edge[e + 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                out.append(np.packbits(gone | np.unpackbits(np.frombuffer(before, np.uint8), count=len(words)).astype(bool) if before else gone).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(out, pa.binary())], names=["id", "text", "gone"])

        return batched(rows, run, f"id {kind}, text string, gone binary")

    for at in range(0, len(order), SHARDS_AT_ONCE):
        some = shards.where(F.col("nth").isin(order[at : at + SHARDS_AT_ONCE])).select("automaton").toArrow()
        rows = passed(rows, spark.sparkContext.broadcast([x for x in some.column(0).to_pylist()]))
        if at + SHARDS_AT_ONCE < len(order):
            rows = written(rows, "passed", scratch)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, left, removed = [], [], []
        for text, gone in zip(as_text(batch.column("text")).to_pylist(), batch.column("gone").to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()
            out = np.unpackbits(np.frombuffer(gone or b"", np.uint8), count=len(words)) if gone else np.zeros(len(words), bool)
            n.append(len(words)), removed.append(int(out.sum()))
            left.append(b" ".join(w for w, x in zip(words, out) if not x).decode("utf-8", "surrogatepass") if removed[-1] else text)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    out = written(batched(rows, cut, f"id {kind}, n_words bigint, n_removed bigint, kept_text string"), "kept")
    for path in scratch:
        remove(spark, path)
    return out.withColumnRenamed("id", id_col)
