"""The ten queries and the pipeline against SQL or brute force on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

pytest.importorskip("rankloom.llm.queries")
from rankloom.llm import html_crf, language_id, queries, sentencepieces, token_store  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()


def test_op1_is_the_article(spark, sf_dir):
    got = {r.page_id: r for r in queries.op1_html_extraction(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.split("</article>", p.html.split("<article>", 1)[1])[0]
        want = "\n".join(b.text for b in html_crf.blocks(body))
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_op4_reads_back_what_the_tokenizer_gives(spark, sf_dir):
    from tokenizers import Tokenizer

    got = {r.doc_id: r for r in queries.op4_token_store(spark, sf_dir).collect()}
    tok, start = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json")), 0
    for d in documents(spark, sf_dir):
        ids = np.array(tok.encode(d.text, add_special_tokens=False).ids + [2], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def held_out(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_op5_separates_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest has 68 rows to learn from and 19 held out
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, sf_dir).collect()}
    assert len(got) == len(documents(spark, sf_dir)) and all(r.held_out == (held_out(i, 5) == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    labels = [x for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[x.doc_id].held_out]
    assert np.mean([got[x.doc_id].predicted == x.quality for x in labels]) >= 0.95


def test_op6_names_held_out_languages(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, sf_dir).collect()}
    docs = documents(spark, sf_dir)
    assert all(got[d.doc_id].held_out == (held_out(d.doc_id, 3) == 1) and 0 <= got[d.doc_id].score <= 1 for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]) >= 0.95


def best_segmentation(text, scores, byte_cost):
    """Viterbi over all substrings."""
    best, back = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 40), end):
            s = scores.get(text[start:end], byte_cost if end - start == 1 else -np.inf)
            if best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, start
    return best[-1]


def test_op10_gives_the_librarys_ids(spark, sf_dir):
    import sentencepiece

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op10_sentencepiece(spark, sf_dir).collect()}
    docs = documents(spark, sf_dir)
    assert len(got) == len(docs)
    for d, ids in zip(docs, sp.encode([d.text or "" for d in docs], num_threads=1)):
        r = got[d.doc_id]
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_op10_gives_the_librarys_ids_of_odd_texts():
    import random

    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp, coder, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Pieces.load(path), random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "\t", "é", "日", "①", "ﬁ", "\x00", "<s>", "1", "23", "é", "\u0301", "😀", "qu", "ß", ".", "...", "xyz"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(3000)] + [" " * k + "x" for k in range(60)] + ["a" * k for k in range(80)] + ["the" * k for k in range(40)]
    assert [x.tolist() for x in coder.encode_batch(texts)] == sp.encode(texts, num_threads=1)


def test_op10_by_scores_is_the_best_segmentation(spark, sf_dir):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Pieces.load(path)
    coder.merges = False  # as for a unigram model
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for d in documents(spark, sf_dir)[:40]:
        text = d.text[:300]
        ids = coder.encode_batch([text])[0].tolist()
        by_bytes = sum((b & 0xC0) != 0x80 for b in (int(sp.id_to_piece(i)[1:-1], 16) for i in ids if sp.is_byte(i)))  # characters, by their first byte
        total = sum(sp.get_score(i) for i in ids if not sp.is_byte(i)) + coder.byte_cost * by_bytes
        assert total == pytest.approx(best_segmentation("▁" + text.replace(" ", "▁"), scores, coder.byte_cost), abs=1e-6)


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == sizes[4] and out.where("not round_trip").count() == 0
    # what is left has no window of 20 words twice
    seen, twice = set(), 0
    for r in docs.orderBy("doc_id").collect():
        w = r.text.encode().split()
        assert r.n_chars == len(r.text)
        for i in range(len(w) - 19):
            k = hashlib.md5(b" ".join(w[i : i + 20])).digest()
            twice += k in seen
            seen.add(k)
    assert twice == 0


def test_store_gives_single_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 7)) for i in range(300)], "doc_id bigint, text string")
    store = token_store.write_store(docs, queries.tokenizer_file("word_bpe_49k.json"), f"file://{tmp_path}/store")
    dictionary = token_store.read_bytes(f"{store.folder}/dictionary.bin")
    names = [r.shard for r in store.shards.collect()]
    found = [x for n in names for x in token_store.Shard(store.folder, n, dictionary).lookup(17)]
    assert len(found) == 1 and found[0][-1] == 2
    with pytest.raises(ValueError):
        token_store.Shard(store.folder, names[0], dictionary + b"x")


def test_mixture_of_two_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, log_prob = language_id.fit(docs)
    pick = {lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).limit(3).collect())[:1500] for lang in ("de", "es")}
    share = language_id.infer([pick["de"] + " " + pick["es"], pick["de"]], log_prob)
    both, alone = dict(zip(names, share[0])), dict(zip(names, share[1]))
    assert both["de"] > 0.3 and both["es"] > 0.3 and both["de"] + both["es"] > 0.9 and alone["de"] > 0.9
