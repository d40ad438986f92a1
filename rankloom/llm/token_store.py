"""Token ids in a binary format with a shared zstandard dictionary.

A store is a folder: `dictionary.bin` and numbered shard files. A shard holds documents in ascending id order,
each compressed on its own against the shared dictionary, so that one short document is read with one seek:

    magic 8 bytes | sha256 of the dictionary, 32 bytes | frames ... | index | index offset u64 | documents u64 | magic

The index has for each document: id i64, offset of its frame u64, frame bytes u32, tokens u32. A frame is a
zstandard frame of the ids as little-endian unsigned 32-bit integers, split in byte planes (all lowest bytes
first), which is what the dictionary is trained on.

Defined results: a null or empty text holds the end id alone; a null id is kept and sorts first; equal ids keep every
row, in order of their text hash, however they are dealt over shards; a very long text is one frame; extra columns are
ignored, also those named as the results are; an empty table gives a store without shards. A shard is written under a name of
its own attempt and renamed, so repeated or speculative tasks leave whole files.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_text, new_folder, trim

MAGIC = b"RLTOKS01"
ENTRY = struct.Struct("<qQII")
TAIL = struct.Struct("<QQ8s")
END_ID = 2
#: Stands for a null id in the index: the smallest, as nulls sort first.
NULL_ID = -(2**63)
#: The dictionary's size, and what it is trained on: of the first documents by hash of id a piece of so many characters
#: from a place that the hash picks. The sample decides how well frames compress and nothing else.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 64 * 1024, 600, 8000
#: Bytes of text in a shard, and the most shards (the driver holds a row for each); beyond it shards grow.
SHARD_BYTES, MAX_SHARDS = 16 << 20, 50_000
#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 700_000
#: Letters that no normal form changes (ASCII, Latin-1 and Latin Extended-A without the dotted capital I) between ASCII
#: punctuation but the apostrophe and what may make up a special token.
_WORD = r"^(?P<a>[!-&(-/:;=?@\[-`{-~]*)(?P<b>[A-Za-zÀ-ÖØ-öø-\x{012f}\x{0131}-\x{017f}]+)(?P<c>[!-&(-/:;=?@\[-`{-~]*)$"
LEVEL = 3


class Encoder:
    """Encodes texts word by word: the tokenizer never joins across ASCII white space, so a word's ids are kept.

    A word of letters between ASCII punctuation is cut there, as the pre-tokenizer does, and its letters are kept on
    their own; words with an apostrophe or anything else are encoded as they are. All this holds for tokenizers
    whose pre-tokenizer parts letters from punctuation and drops white space (tried out when it is loaded; others
    get whole texts). A worker process keeps what it has encoded from task to task.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.clear()
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word_split = all("<" in t or ">" in t for t in specials) and ids("a b\n\tC, (d)...") == [*ids("a"), *ids("b"), *ids("c"), *ids(","), *ids("("), *ids("d"), *ids(")...")]

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}  # a word or part of one -> its place in size and first
        self.size, self.first, self.flat = array.array("q", [0]), array.array("q", [0]), array.array("I")

    def _put(self, name: str, ids) -> None:
        self.at[name] = len(self.size)
        self.first.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)

    def _places(self, names: list[str], letters: bool) -> np.ndarray:
        """The place of each name; new ones are encoded. letters: many can be read as one text, a pre-token each."""
        fresh = [x for x in names if x not in self.at]
        for k in range(0, len(fresh), 1000):
            part = fresh[k : k + 1000]
            if letters:
                got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                ids, owner = np.array(got.ids, np.uint32), np.array(got.word_ids, np.int64)
                cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(ids))
                if len(cuts) == len(part) + 1:
                    at = len(self.size)
                    self.at.update(zip(part, range(at, at + len(part))))
                    self.first.extend((cuts[:-1] + len(self.flat)).tolist())
                    self.size.extend(np.diff(cuts).tolist())
                    self.flat.extend(ids.tolist())
                    continue
            for name, got in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                self._put(name, got.ids)
        return np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))

    def _parts(self, dictionary: pa.Array) -> np.ndarray:
        """For each word the places of what stands before its letters, them, and what follows."""
        cut = pc.extract_regex(dictionary, _WORD)
        whole = pc.is_null(cut).to_numpy(zero_copy_only=False)
        out = np.zeros((len(dictionary), 3), np.int64)
        out[whole, 1] = self._places(dictionary.filter(pa.array(whole)).to_pylist(), False)
        cut = cut.filter(pa.array(~whole))
        for k, name in enumerate("abc"):
            part = pc.struct_field(cut, name)
            if name == "b":
                part = pc.if_else(pc.string_is_ascii(part), pc.ascii_lower(part), part)
            coded = part.dictionary_encode()
            places = self._places(coded.dictionary.to_pylist(), name == "b")
            out[~whole, k] = places[coded.indices.to_numpy(zero_copy_only=False)] if len(part) else 0
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its ids with the end id."""
        if not self.word_split:
            got = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return [np.array([*x.ids, self.end_id], np.uint32) for x in got]
        words = Words(texts)
        if len(self.at) > CACHE_WORDS:
            self.clear()
        parts = self._parts(words.dictionary).ravel()
        size, first, flat = np.array(self.size, np.int64), np.array(self.first, np.int64), np.array(self.flat, np.uint32)
        ids = flat[_runs(first[parts], size[parts])]  # of the batch's distinct words, one after another
        sizes = size[parts].reshape(-1, 3).sum(1)
        starts = np.cumsum(sizes) - sizes
        out = []
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            w = words.ids[a:b]
            own = ids[_runs(starts[w], sizes[w])]
            out.append(np.append(own, np.uint32(self.end_id)))
        return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the next."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def planes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most `size` bytes; empty where there is too little to train on."""
    samples = [s for s in samples if len(s) > 8]
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def codec(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write_shard(folder: str, name: str, dictionary: bytes, documents) -> tuple[int, int]:
    """documents: (id, ids) in ascending order. Returns how many documents and ids there were."""
    fs, root = pafs.FileSystem.from_uri(folder)
    attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
    pack, index, n_ids, at = codec(dictionary)[0], [], 0, len(MAGIC) + 32
    with fs.open_output_stream(attempt) as f:
        f.write(MAGIC + hashlib.sha256(dictionary).digest())
        for doc_id, ids in documents:
            frame = pack.compress(planes(ids))
            f.write(frame)
            index.append(ENTRY.pack(NULL_ID if doc_id is None else doc_id, at, len(frame), len(ids)))
            at, n_ids = at + len(frame), n_ids + len(ids)
        f.write(b"".join(index) + TAIL.pack(at, len(index), MAGIC))
    fs.move(attempt, f"{root}/{name}")
    return len(index), n_ids


class Shard:
    """Random access to one shard."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        fs, root = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        index_at, n, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC) + 32, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} is no shard of this dictionary")
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.size, index_at), np.dtype([("id", "<i8"), ("at", "<u8"), ("bytes", "<u4"), ("n", "<u4")]))
        self.unpack = codec(dictionary)[1]

    def read(self, row: int) -> np.ndarray:
        e = self.index[row]
        ids = unplanes(self.unpack.decompress(self.file.read_at(int(e["bytes"]), int(e["at"])), max_output_size=4 * int(e["n"])))
        if len(ids) != e["n"]:
            raise ValueError(f"document {e['id']} is cut short")
        return ids

    def lookup(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id, by binary search in the index."""
        a, b = np.searchsorted(self.index["id"], doc_id, "left"), np.searchsorted(self.index["id"], doc_id, "right")
        return [self.read(r) for r in range(a, b)]


def read_bytes(path: str) -> bytes:
    fs, p = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(p) as f:
        return f.read()


class Store:
    """A written store: `shards` is a table (shard, documents, tokens, first) with the ids before each shard."""

    def __init__(self, spark: SparkSession, folder: str, shards: DataFrame):
        self.spark, self.folder, self.shards = spark, folder, shards

    def documents(self) -> DataFrame:
        """Every document as read back: shard, row, doc_id, start, n_tokens, ids_crc32. Shards are read in parallel."""
        folder = self.folder

        def read(batches):
            dictionary = read_bytes(f"{folder}/dictionary.bin")
            for batch in batches:
                for name, first in zip(batch.column("shard").to_pylist(), batch.column("first").to_pylist()):
                    shard = Shard(folder, name, dictionary)
                    n = shard.index["n"].astype(np.int64)
                    start = first + np.cumsum(n) - n
                    for a in range(0, len(n), 5000):
                        rows = range(a, min(a + 5000, len(n)))
                        own = shard.index["id"][a : a + 5000]
                        crc = [zlib.crc32(shard.read(r).tobytes()) for r in rows]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own, mask=own == NULL_ID), pa.array(start[a : a + len(crc)]), pa.array(n[a : a + len(crc)]), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

        return self.shards.select("shard", "first").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_store(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Encode every text and write the store. Spark range-partitions by id, so that shard k precedes shard k + 1."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    sample = rows.select(F.xxhash64("id").alias("h"), "id", F.col("text").substr(place + 1, F.lit(SAMPLE_CHARS)).alias("text")).orderBy("h", "id", "text").limit(SAMPLE_DOCS)

    def serialise(batches):
        coder = encoder(tokenizer, end_id)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([planes(x) for x in coder.encode(as_text(batch.column("text")))], pa.binary())], names=["raw"])

    dictionary = train_dictionary([bytes(r.raw) for r in sample.mapInArrow(serialise, "raw binary").collect()])
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.bin") as f:
        f.write(dictionary)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        coder, name, dic = encoder(tokenizer, end_id), f"shard-{part:06d}.bin", read_bytes(f"{folder}/dictionary.bin")

        def documents():
            for batch in itertools.chain([first], batches):
                for at in range(0, batch.num_rows, 5000):
                    some = batch.slice(at, 5000)
                    yield from zip(some.column("id").to_pylist(), coder.encode(as_text(some.column("text"))))

        n, n_ids = write_shard(folder, name, dic, documents())
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "shard", "documents", "tokens"])

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, min(MAX_SHARDS, -(-size // SHARD_BYTES)))
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())  # parts equal rows
    shards = keyed.repartitionByRange(parts, "id", "h", "nth").sortWithinPartitions("id", "h", "nth").select("id", "text").mapInArrow(write, "part int, shard string, documents bigint, tokens bigint")
    made, first, table = sorted(map(tuple, shards.collect())), 0, []  # a row a shard
    for _, name, n, n_ids in made:
        table.append((name, n, n_ids, first))
        first += n_ids
    frame = spark.createDataFrame(table, "shard string, documents bigint, tokens bigint, first bigint")
    return Store(spark, folder, frame.repartition(max(1, len(table)), "shard") if table else frame)
