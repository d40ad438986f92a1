"""Language identification as a mixture of languages.

Each language is a multinomial over hashed character trigrams (lower-cased letters; every run of other characters
is one space). For a document, expectation-maximisation estimates in what proportions the languages make up its
trigrams; the set of languages is chosen by penalised likelihood: starting with the likeliest, the language that has
the largest share among all is added as long as that raises the log-likelihood by more than PENALTY * ln(trigrams);
nothing else bounds the set. EM runs until the log-likelihood is within TOLERANCE of its maximum: as it is concave
in the shares, the largest sum of posterior ratios less the trigrams bounds what is missing.

Counts are taken over all training documents, in fixed arrays of 2 ** BITS buckets a language, so that the model's
size is languages x 256 KB whatever the corpus; a lang column with over MAX_LANGUAGES values raises ValueError, as no
such model would fit a task. Texts are processed whole.

Defined results: a null text or one without a letter is `und` with score 0 and no languages; without any training
row (an empty table too) every text is `und`; ties go to the language that sorts first; rows with a null language do
not train; repeated rows train once each and are judged alike, rows that share an id give a row each; a very long
text is judged by all its trigrams; an empty table gives an empty result; columns that are not asked for are ignored,
also those named as the results are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, batched, trim

BITS = 16
SMOOTHING = 0.5
PENALTY = 4.0
#: EM ends within this many nats of the largest log-likelihood (and the float's own error), or after so many rounds.
TOLERANCE, ROUNDS = 0.05, 400
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Texts whose trigrams are in memory at once; a batch's arrays take some hundred bytes a character.
CHUNK = 200


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each trigram whose middle is a letter."""
    lowered = [t.lower() for t in texts]
    raw = np.frombuffer(("  " + "  ".join(lowered) + "  ").encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 2)
    owner = np.concatenate([owner, [max(len(texts) - 1, 0)] * (len(raw) - len(owner))])
    is_letter = letters()[raw]
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]  # a letter, or the first of a run of others
    c = np.where(is_letter, raw, np.uint32(32))[kept].astype(np.uint64)
    owner, is_letter = owner[kept], is_letter[kept]
    if len(c) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.concatenate([[np.uint64(32)], c[:-1]]), np.concatenate([c[1:], [np.uint64(32)]])
    mid = is_letter
    h = (before[mid] * np.uint64(0x9E3779B97F4A7C15) + c[mid] * np.uint64(0xC2B2AE3D27D4EB4F) + after[mid] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD)
    return owner[mid], (h >> np.uint64(64 - BITS)).astype(np.int64)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log-probability of each bucket in each: float32 [2 ** BITS, languages]."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    n_lang = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_lang > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang_col}: not languages, or a model too large for a task")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                who, what = trigrams(as_text(part.column("text")).to_pylist())
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    own = np.bincount(what[(langs == lang)[who]], minlength=1 << BITS) if len(what) else np.zeros(1 << BITS, np.int64)
                    sums[lang] = sums.get(lang, 0) + own
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    made = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(made.column("lang").to_pylist()))
    n = np.zeros((1 << BITS, len(names)))
    which = {x: i for i, x in enumerate(names)}
    n[made.column("bucket").to_numpy(), [which[x] for x in made.column("lang").to_pylist()]] = made.column("n").to_numpy()
    return names, np.log((n + SMOOTHING) / (n + SMOOTHING).sum(0, keepdims=True)).astype(np.float32)


def _sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bounds, axis=0)


def mixture(count: np.ndarray, prob: np.ndarray, bounds: np.ndarray, allowed: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """EM over many documents at once.

    count, prob: of each (document, bucket), prob scaled so that its largest is 1; bounds: where each document
    starts; allowed: the languages of each document's set; wanted: a log-likelihood of each document, which ends
    its rounds as soon as it is reached or known to be out of reach. Returns proportions and the log-likelihood.
    """
    sizes = np.diff(np.append(bounds, len(count)))
    total = _sum(count, bounds).astype(np.float64)
    shares = allowed / allowed.sum(1, keepdims=True).astype(np.float64)
    likes = np.full(len(bounds), -np.inf)
    live = np.arange(len(bounds))  # documents whose rounds go on, and what is theirs
    c, p, at, n = count, prob, bounds, sizes
    for _ in range(ROUNDS):
        share = shares[live]
        fit_ = np.maximum((p * np.repeat(share, n, axis=0)).sum(1), 1e-30)
        like = _sum(c * np.log(fit_), at)
        ratio = _sum((c / fit_)[:, None] * p, at)
        missing = np.where(allowed[live] > 0, ratio, 0).max(1) - total[live]
        done = missing <= TOLERANCE + 1e-6 * total[live]
        if wanted is not None:
            done |= (like > wanted[live]) | (like + missing <= wanted[live])
        likes[live] = like
        shares[live] = share * ratio / total[live][:, None]
        if done.all():
            break
        if 4 * done.sum() >= len(live):
            own = np.repeat(~done, n)
            live, c, p, n = live[~done], c[own], p[own], n[~done]
            at = np.cumsum(n) - n
    return shares / shares.sum(1, keepdims=True), likes


def infer(texts: list[str], log_prob: np.ndarray) -> np.ndarray:
    """Each text's proportions over the languages; all 0 where nothing can be said."""
    n_lang = log_prob.shape[1]
    out = np.zeros((len(texts), n_lang), np.float64)
    who, what = trigrams(texts)
    if not len(who) or not n_lang:
        return out
    key = np.sort((who.astype(np.uint32) << np.uint32(BITS)) | what.astype(np.uint32))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first]
    doc, logs = (key >> np.uint32(BITS)).astype(np.int64), log_prob[key & np.uint32((1 << BITS) - 1)]
    top = logs.max(1)
    prob = np.exp(logs - top[:, None])
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    docs = doc[starts]
    n = _sum(count, starts)
    single = _sum(count[:, None] * (logs - top[:, None]), starts)
    best = single.argmax(1)
    chosen = np.zeros((len(docs), n_lang), np.float32)
    chosen[np.arange(len(docs)), best] = 1
    share, like = chosen.astype(np.float64), single.max(1)
    if n_lang > 1:
        price = PENALTY * np.log(n + 1)
        whole, reach = mixture(count, prob, starts, np.ones_like(chosen), like + price)
        more = reach > like + price  # no set of languages can gain more than all of them
        if more.any():  # these need their shares in full
            rows = np.concatenate([np.arange(a, a + k) for a, k in zip(starts[more], np.diff(np.append(starts, len(count)))[more])])
            own = np.diff(np.append(starts, len(count)))[more]
            whole[more] = mixture(count[rows], prob[rows], np.cumsum(own) - own, np.ones_like(chosen[more]))[0]
        ends = np.append(starts[1:], len(count))
        for _ in range(n_lang - 1):
            todo = np.flatnonzero(more)
            if not len(todo):
                break
            rows = np.concatenate([np.arange(starts[d], ends[d]) for d in todo])
            bounds = np.concatenate([[0], np.cumsum((ends - starts)[todo])[:-1]])
            add = np.where(chosen[todo] > 0, -1, whole[todo]).argmax(1)  # the largest share outside the set
            tried = chosen[todo].copy()
            tried[np.arange(len(todo)), add] = 1
            new_share, new_like = mixture(count[rows], prob[rows], bounds, tried)
            good = new_like > like[todo] + price[todo]
            hit = todo[good]
            chosen[hit], share[hit], like[hit] = tried[good], new_share[good], new_like[good]
            more[todo[~good]] = False
            more[hit[chosen[hit].all(1)]] = False
    out[docs] = share
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, languages): the largest share's language, that share, and the chosen set with shares.

    Columns named in keep are passed through.
    """
    names, log_prob = model
    sent = docs.sparkSession.sparkContext.broadcast((names, log_prob))
    schema = docs.select(F.col(id_col).alias("id"), *keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, log_prob = sent.value
        texts = as_text(batch.column("__text")).to_pylist()
        share = np.concatenate([infer(texts[a : a + CHUNK], log_prob) for a in range(0, len(texts), CHUNK)] or [np.zeros((0, len(names)))])
        top = share.argmax(1) if names else np.zeros(len(texts), int)
        value = share.max(1) if names else np.zeros(len(texts))
        pred = [names[i] if v > 0 else UNKNOWN for i, v in zip(top, value)]
        mix = [[{"lang": names[j], "share": float(row[j])} for j in np.flatnonzero(row)] for row in share]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        base = [c for c in batch.schema.names if c != "__text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in base), pa.array(pred, pa.string()), pa.array(np.clip(value, 0, 1)), pa.array(mix, kind)], names=[*base, "lang_pred", "score", "languages"])

    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("__text"))
    out = batched(rows, run, f"{kinds}, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
    return out.withColumnRenamed("id", id_col)
