"""Learnt models against plain versions of their method, and sketches against the sets they stand for."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

language_id = pytest.importorskip("rankloom.llm.language_id")
from rankloom.llm import near_dedup, quality_model  # noqa: E402


def language(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 8))) for _ in range(30)]
    return lambda n, k: " ".join(random.Random(k).choices(words, k=n))


def learnt(langs):
    n = np.zeros((1 << language_id.BITS, len(langs)))
    for i, say in enumerate(langs):
        n[:, i] = np.bincount(language_id.trigrams([say(3000, i)])[1], minlength=len(n))
    return np.log((n + 0.5) / (n + 0.5).sum(0, keepdims=True)).astype(np.float32)


def plain_em(text, log_prob, allowed, rounds=3000):
    """One document, one trigram at a time."""
    counts = Counter(language_id.trigrams([text])[1].tolist())
    share = {j: 1 / len(allowed) for j in allowed}
    for _ in range(rounds):
        new = dict.fromkeys(allowed, 0.0)
        for b, c in counts.items():
            p = {j: share[j] * math.exp(log_prob[b, j]) for j in allowed}
            z = sum(p.values())
            for j in allowed:
                new[j] += c * p[j] / z
        total = sum(counts.values())
        moved = max(abs(new[j] / total - share[j]) for j in allowed)
        share = {j: new[j] / total for j in allowed}
        if moved < 1e-9:
            break
    return share, sum(c * math.log(sum(share[j] * math.exp(log_prob[b, j]) for j in allowed)) for b, c in counts.items()), sum(counts.values())


def plain_choice(text, log_prob):
    """The set of languages by the penalised likelihood, added one at a time."""
    every = list(range(log_prob.shape[1]))
    alone = {j: plain_em(text, log_prob, [j])[1] for j in every}
    chosen = [max(every, key=lambda j: (alone[j], -j))]
    whole = plain_em(text, log_prob, every)[0]
    share, like, n = plain_em(text, log_prob, chosen)
    while len(chosen) < len(every):
        more = [*chosen, max((j for j in every if j not in chosen), key=lambda j: (whole[j], -j))]
        new, new_like, _ = plain_em(text, log_prob, more)
        if new_like - like <= language_id.PENALTY * math.log(n + 1):
            break
        chosen, share, like = more, new, new_like
    return share


def test_language_shares_are_those_of_plain_em():
    langs = [language(k) for k in range(6)]
    log_prob = learnt(langs)
    texts = [langs[2](40, 7), langs[1](50, 8) + " " + langs[5](25, 9), " ".join(langs[k](15, k) for k in (0, 3, 4)), langs[0](2, 1), " ".join(langs[k](60, 100 + k) for k in range(6))]
    got = language_id.infer(texts, log_prob)
    for text, row in zip(texts, got):
        want = plain_choice(text, log_prob)
        assert set(np.flatnonzero(row)) == set(want)
        assert all(abs(row[j] - s) < 0.01 for j, s in want.items())
    assert (got[4] > 0.1).all()  # no bound on the set but the penalty


def plain_ftrl(rows, passes):
    z, n, w = {}, {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality_model.L1:
            return 0.0
        return -(z[i] - math.copysign(quality_model.L1, z[i])) / ((quality_model.BETA + math.sqrt(n[i])) / quality_model.ALPHA + quality_model.L2)

    for _ in range(passes):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality_model.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_weights_are_those_of_plain_ftrl(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices("good fine nice clear" .split() if i % 2 else "spam junk buy now".split(), k=rnd.randint(1, 12))) + rnd.choice([".", "!!", ""]), i % 2) for i in range(24)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    got = quality_model.fit(docs, labels, "quality")
    import xxhash

    order = sorted(rows, key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
    vectors = []
    for _, text, y in order:
        at, x, _ = quality_model.features(pa.array([text], pa.large_string()))
        one = {}
        for i, v in zip(at.tolist(), x.tolist()):
            one[i] = one.get(i, 0.0) + v
        vectors.append(({i: float(np.float32(v)) for i, v in one.items()}, y))
    want = plain_ftrl(vectors, quality_model.MOST_EPOCHS)
    dense = np.zeros(len(got))
    dense[list(want)] = list(want.values())
    assert np.allclose(got, dense, atol=1e-5) and np.count_nonzero(got) > 10
    scored = {r.doc_id: r.score for r in quality_model.score(docs, got).collect()}
    for (i, _, _), (x, _) in zip(order, vectors):
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-sum(want[j] * v for j, v in x.items()))), abs=1e-4)


def test_labels_that_disagree_do_not_depend_on_their_order(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c") for i in range(6)], "doc_id bigint, text string")
    pairs = [(i, i % 2) for i in range(6)] + [(3, 0), (4, 1)]
    fit = lambda rows: quality_model.fit(docs, spark.createDataFrame(rows, "doc_id bigint, quality int").repartition(3), "quality")
    assert (fit(pairs) == fit(pairs[::-1])).all()


@pytest.mark.parametrize("size", [50, 3000, 400_000])
def test_signatures_agree_as_often_as_sets(size):
    rnd = np.random.default_rng(size)
    a, b, both = (np.unique(rnd.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(3))
    x, y = near_dedup.signature(a), near_dedup.signature(b)
    assert np.mean(x == y) < 0.05
    x, y = near_dedup.signature(np.union1d(a, both)), near_dedup.signature(np.union1d(b, both))
    assert abs(np.mean(x == y) - 1 / 3) < 0.2


def test_links_lost_near_the_threshold(spark):
    """400 pairs of similarity 0.75 to 0.80 and 400 just below: none may be lost, none may be made."""
    rnd, rows, want = random.Random(11), [], {}
    for k in range(800):
        n = rnd.randint(12, 160)  # shingles of the first
        words = [f"k{k}w{i}" for i in range(n + 4)]
        least = math.ceil(n * 3 / 4)  # a prefix of so many shingles has similarity least / n
        cut = min(n, least + rnd.randint(0, max(0, n // 20))) if k % 2 == 0 else least - 1
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: cut + 4]))]
        want[2 * k + 1] = 2 * k if 100 * cut >= 75 * n else 2 * k + 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    lost = [i for i, c in want.items() if c != i and got[i] != c]
    made = [i for i, c in want.items() if c == i and got[i] != i]
    assert sum(c != i for i, c in want.items()) == 400 and (len(lost), len(made)) == (0, 0)
