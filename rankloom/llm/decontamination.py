"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts become words, each hashed once; hashes of runs of words are put together from those of halves. Of every
SPAN - GRAM + 1 runs of GRAM words in a row the smallest hash is kept as a fingerprint. Any SPAN words in a row that a
document shares with an item lie over at least one fingerprint that both have, so a join on fingerprints misses no
document. In the documents that it finds, each place of a shared fingerprint is extended: by 0 to SPAN - GRAM words
to the left and the rest to the right, to each window of SPAN words over it, and those that an item has are hits.
Fingerprints that meet by chance extend to nothing, and windows away from any fingerprint are not looked at.

An item shorter than SPAN words is one window of its own length, which is its fingerprint; documents are searched for
it at every place (there are at most SPAN - 1 such lengths). Windows are compared by 128 bits of hash.

Items that hold the same window are kept as one class of items; documents with the same classes are named items once.
Items are sent to all executors only while their windows number at most MAX_BROADCAST, found documents only while there
are at most MAX_FOUND; beyond that the joins shuffle.

Defined results: a null or empty text has no words and no hits; an item without words matches nothing; several
items that hold one window are all named, repeated items once; rows with the same id and text give one row, rows with a
null id too; a very long text is searched whole; an empty table of documents gives an empty result, one of items no
hits; clashing extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

GRAM, SPAN = 5, 10
#: Windows of items of 16 bytes and a class, and documents of 16 bytes, that are sent to all executors at most.
MAX_BROADCAST, MAX_FOUND = 1_000_000, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[0-9a-z\\x{80}-\\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only. A text of ASCII characters alone takes the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _runs(rows: DataFrame, words: str, size: int, out: str, join) -> DataFrame:
    """Adds `out`: join() over each run of `size` neighbours of the array `words`, element i from i on. Runs of powers of
    two are made once and put together as size's bits ask."""
    made, reach = {1: words}, 1

    def add(name: str, left: str, right: str, shift: int) -> str:
        nonlocal rows
        shifted = F.slice(right, shift + 1, F.greatest(F.size(right), F.lit(1)))
        rows = rows.withColumn(name, F.zip_with(left, shifted, join))
        return name

    while reach * 2 <= size:
        made[reach * 2] = add(f"{out}_{reach * 2}", made[reach], made[reach], reach)
        reach *= 2
    have, last = reach, made[reach]
    while have < size:
        part = max(r for r in made if r <= size - have)
        last = add(f"{out}_{have + part}_", last, made[part], have)
        have += part
    cut = F.slice(last, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return rows.withColumn(out, cut).drop(*(c for c in rows.columns if c.startswith(f"{out}_")))


def _hashed(rows: DataFrame, size: int, out: str, words: str = "h") -> DataFrame:
    return _runs(rows, words, size, out, lambda a, b: F.xxhash64(a, b))


def with_fingerprints(rows: DataFrame, short: list[int], all_windows: bool) -> DataFrame:
    """Adds `h`, the hash of each word, and `fp`, the distinct fingerprints of `words`.

    short: lengths of items below SPAN words; such windows are fingerprints in full, of documents (all_windows) at
    every place, of items only where the item has that length.
    """
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    rows = _runs(_hashed(rows, GRAM, "grams"), "grams", SPAN - GRAM + 1, "least", lambda a, b: F.least(a, b))
    parts = [F.array_distinct("least")]
    for n in short:
        rows = _hashed(rows, n, f"own{n}")
        length = F.lit(n)
        own = F.transform(f"own{n}", lambda x: F.xxhash64(length, x))  # noqa: B023
        parts.append(own if all_windows else F.when(F.size("words") == n, own).otherwise(F.array().cast("array<bigint>")))
    return rows.withColumn("fp", parts[0] if len(parts) == 1 else F.array_distinct(F.concat(*parts))).drop("grams", "least", *(f"own{n}" for n in short))


def _with_keys(rows: DataFrame, size: int) -> DataFrame:
    """Adds `k1` and `k2`: two hashes of each window of `size` words, from `h` and a second hash of each word."""
    rows = rows.withColumn("h2", F.transform("words", lambda w: F.xxhash64(F.lit("second"), w)))
    return _hashed(_hashed(rows, size, "k1"), size, "k2", "h2")


def _windows(rows: DataFrame, sizes: list[int], keep: tuple[str, ...]) -> DataFrame:
    """A row for each window of items: keep, size, k1, k2. A short item is one window only."""
    out = None
    for n in sizes:
        some = _with_keys(rows.where(F.size("words") == n if n < SPAN else F.size("words") >= n), n)
        part = some.select(*keep, F.lit(n).alias("size"), F.explode(F.arrays_zip("k1", "k2")).alias("k")).select(*keep, "size", "k.k1", "k.k2")
        out = part if out is None else out.unionByName(part)
    return out


def _extended(rows: DataFrame, prints: DataFrame, short: list[int]) -> DataFrame:
    """(id, version, start, size, k1, k2): the windows over each place at which a document has a print (fp)."""
    keep = ("id", "version")
    grams = _with_keys(_hashed(rows.where(F.size("words") >= SPAN), GRAM, "grams"), SPAN)
    starts = F.sequence(F.greatest(F.col("at") - (SPAN - GRAM), F.lit(0)), F.least("at", F.size("k1") - 1))
    hits = grams.select(*keep, F.posexplode("grams").alias("at", "fp")).join(prints, "fp", "left_semi")
    hits = hits.groupBy(*keep).agg(F.collect_list("at").alias("ats"))  # at most the document's words
    spans = grams.select(*keep, "k1", "k2").join(hits.select(F.col("id").alias("i"), F.col("version").alias("v"), "ats"), F.expr("id <=> i and version = v"))
    spans = spans.select(*keep, "k1", "k2", F.explode("ats").alias("at")).select(*keep, F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.get("k1", s).alias("k1"), F.get("k2", s).alias("k2")))).alias("w"))
    out = spans.select(*keep, "w.start", F.lit(SPAN).alias("size"), "w.k1", "w.k2")
    for n in short:
        own = _with_keys(rows.where(F.size("words") >= n), n).select(*keep, F.posexplode(F.arrays_zip("k1", "k2")).alias("start", "k"))
        out = out.unionByName(own.select(*keep, "start", F.lit(n).alias("size"), "k.k1", "k.k2"))
    return out.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    words = words_of(F.col("text"))
    listed = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).repartition(docs.sparkSession.sparkContext.defaultParallelism, "item")
    listed = written(listed.select("item", words.alias("words")).where(F.size("words") > 0), "items")
    short = sorted(r[0] for r in listed.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())  # at most SPAN - 1 numbers
    prints = written(with_fingerprints(listed, short, False).select(F.explode("fp").alias("fp")).distinct().withColumn("known", F.lit(True)), "prints")
    holders = _windows(with_fingerprints(listed, [], False), [SPAN, *short], ("item",)).groupBy("size", "k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    holders = written(holders.withColumn("class", F.sha2(F.array_join(F.transform("items", lambda x: F.concat(F.octet_length(x), F.lit(":"), x)), ","), 256)), "holders")
    classes = holders.groupBy("class").agg(F.first("items").alias("items"))
    targets = holders.select("size", "k1", "k2", "class")
    small = targets.count() <= MAX_BROADCAST
    sent = F.broadcast if small else (lambda x: x)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("version", F.xxhash64("text"))
    printed = with_fingerprints(keyed.select("id", "version", words.alias("words")), short, True)
    stats = (
        printed.select("id", "version", F.size("words").cast("bigint").alias("n_words"), F.explode_outer("fp").alias("fp"))
        .join(sent(prints), "fp", "left")
        .groupBy("id", "version")
        .agg(F.max("n_words").alias("n_words"), F.max(F.coalesce("known", F.lit(False))).alias("found"))
    )
    stats = written(stats, "stats")  # a few numbers a document, so that fingerprints are taken once
    found = stats.where("found").select("id", "version")
    found = F.broadcast(found) if found.count() <= MAX_FOUND else found
    suspects = keyed.alias("d").join(found.alias("f"), F.expr("d.id <=> f.id and d.version = f.version"), "left_semi").dropDuplicates(["id", "version"])
    suspects = written(suspects.select("id", "version", words.alias("words")), "suspects")
    hits = (
        _extended(suspects.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))), sent(prints), short)
        .join(sent(targets), ["size", "k1", "k2"])
        .groupBy("id", "version")
        .agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.sort_array(F.collect_set("class")).alias("classes"))
    )
    hits = written(hits, "hits")
    sets = hits.select("classes").distinct()
    named = sets.select("classes", F.explode("classes").alias("class")).join(classes, "class").select("classes", F.explode("items").alias("item"))
    named = named.groupBy("classes").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = hits.join(named, "classes")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(s["start"], acc["end"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    none = F.array().cast("array<string>")
    hits = hits.select(F.col("id").alias("hit_id"), F.col("version").alias("hit_version"), covered.alias("n_hit"), "items")
    joined = stats.join(hits, F.expr("id <=> hit_id and version = hit_version"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
