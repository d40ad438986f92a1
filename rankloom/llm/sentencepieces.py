"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

All pieces are in one automaton. Reading a text once, each position gets the pieces that end there (the automaton's
output links, longest first), and each relaxes the best way to reach that position from the best of where it starts.
What is best depends on the model's kind. In a unigram model it is the largest sum of scores; in a BPE model, whose
scores are merge ranks, it is the only way that merging in order of rank leaves: a piece may follow another if merging
their joint text gives these two again, and of the pieces that end at a position exactly one may follow the best one
where it starts. Either way the ids are the library's. Characters in no piece fall back to their UTF-8 bytes, or to
the unknown id in a model without byte pieces (decoding then gives U+2047 between spaces for it, as the library does).

No piece has a space inside a word and none holds a line feed, so the best segmentation of a text is that of its
words side by side (checked when the model is loaded): words are segmented once each and remembered.

Only models whose normaliser is the identity are loaded, others raise ValueError; a space is put before the text if the
model says so. Decoding is exact: decode(encode(text)) == text for every text of a model with byte pieces. A literal
U+2581 in a text, which stands for a space among pieces, is encoded by its bytes to keep this; there alone ids differ
from the library's, which reads it as a space.

Defined results: a null text is encoded like an empty one, no ids; a very long text is encoded whole, in time
proportional to its length; ties between scores go to the piece that starts first; repeated rows and null ids give a
row each; an empty table gives an empty result; further columns are ignored, also those named as the results are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, batched

SPACE = "▁"
#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 200_000
_START = 0x110000


#: Pairs of pieces whose merging a task remembers before it starts anew.
CACHE_PAIRS = 2_000_000
#: What the library writes for an unknown id.
UNKNOWN = " \u2047 "


class Pieces:
    """A vocabulary of pieces with scores, as an automaton."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], merges: bool = True, unknown: int = 0, lead: bool = True):
        """pieces: (piece, score, id) of ordinary pieces; byte_ids: the id of each byte's piece; merges: scores are the
        ranks of merges (BPE), not logarithms of probabilities; unknown: the id for what has no bytes' pieces; lead: a
        space is put before a text."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score, i in pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        if pieces:
            self.automaton.make_automaton()
        self.merges, self.unknown, self.lead = merges, unknown, lead
        self.rank = {p: s for p, s, _ in pieces}
        self.text_of = {i: p for p, _, i in pieces}
        self.byte_ids = byte_ids
        self.byte_cost = min((s for _, s, _ in pieces), default=0.0) - 10.0
        texts = [p for p, _, _ in pieces]
        inner = any(SPACE in p.lstrip(SPACE) for p in texts)
        self.cut = re.compile("(?s).+") if inner else re.compile(" +[^ ]*|[^ ]+") if any("\n" in p for p in texts) else re.compile(" +[^ \n]*|\n|[^ \n]+")
        top = max([i for _, _, i in pieces] + list(byte_ids.values()) + [unknown, 0])
        self.out = [b""] * (top + 1)
        self.out[unknown] = UNKNOWN.encode()
        for p, _, i in pieces:
            self.out[i] = p.replace(SPACE, " ").encode()
        for b, i in byte_ids.items():
            self.out[i] = bytes([b])
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit integers, a quarter of a list's memory
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: the model's normaliser changes texts")
        if kind not in (proto.trainer_spec.UNIGRAM, proto.trainer_spec.BPE):
            raise ValueError(f"{path}: neither a unigram nor a BPE model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, by_byte = [], {}
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                by_byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((sp.id_to_piece(i), sp.get_score(i), i))
        return cls(plain, by_byte, kind == proto.trainer_spec.BPE, sp.unk_id(), norm.add_dummy_prefix)

    def merged(self, text: str) -> list[str]:
        """A short text merged in order: the best-ranked neighbours first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b side by side. A negative number is a character that is no piece (~code
        point); 0x110000 in the place of a is the start of a text."""
        left = "" if a == _START else chr(~a) if a < 0 else self.text_of[a]
        right = chr(~b) if b < 0 else self.text_of[b]
        return self.merged(left + right) == ([left, right] if left else [right])

    def viterbi(self, text: str) -> list[int]:
        """The best segmentation of a text in which spaces are spaces."""
        shown = text.replace(SPACE, "\0").replace(" ", SPACE)  # neither U+2581 nor U+0000 of a text is in a piece
        steps = (self._in_order if self.merges else self._by_score)(shown)
        ids: list[int] = []
        n = len(shown)
        while n:
            size, i = steps[n]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids.get(b, self.unknown) for b in reversed(text[n - 1].encode("utf-8", "surrogatepass")))
            elif not (ids and ids[-1] == self.unknown):  # neighbours without a piece are one unknown
                ids.append(self.unknown)
            n -= size
        return ids[::-1]

    def _in_order(self, shown: str) -> list[tuple[int, int]]:
        """For each position the size and id of the last piece of what merging gives up to there."""
        pairs, last, at = self.pairs, [(0, _START)] * (len(shown) + 1), 0
        for end, (size, _, i) in self.automaton.iter(shown) if len(self.automaton) else ():
            end += 1
            while at < end - 1:  # positions at which no piece may end
                at += 1
                last[at] = (1, ~ord(shown[at - 1]))
            if at == end:
                continue  # settled by a longer piece
            key = (last[end - size][1], i)
            fits = pairs.get(key)
            if fits is None:
                fits = pairs[key] = self.may_follow(*key)
            if fits:
                last[end], at = (size, i), end
        while at < len(shown):
            at += 1
            last[at] = (1, ~ord(shown[at - 1]))
        return last

    def _by_score(self, shown: str) -> list[tuple[int, int]]:
        """For each position the size and id of the last piece of the largest sum of scores up to there."""
        n, at = len(shown), 0
        best, last = [0.0] * (n + 1), [None] * (n + 1)

        def bytes_upto(end: int) -> None:  # positions that no piece has reached yet fall back to a byte cost
            nonlocal at
            while at < end:
                at += 1
                fall = best[at - 1] + self.byte_cost
                if last[at] is None:
                    best[at], last[at] = fall, (1, -1)

        for end, (size, score, i) in self.automaton.iter(shown) if len(self.automaton) else ():
            bytes_upto(end)
            total = best[end + 1 - size] + score
            if last[end + 1] is None or total > best[end + 1]:
                best[end + 1], last[end + 1] = total, (size, i)
        bytes_upto(n)
        return last

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        known, out, lead = self.known, [], " " * self.lead
        for text in texts:
            words = self.cut.findall(lead + text) if text else []
            for w in words:
                if w not in known:
                    known[w] = np.array(self.viterbi(w), "<i4").tobytes()
            out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4"))
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.out.__getitem__, ids))
        return raw.decode("utf-8", "surrogatepass" if self.byte_ids else "replace")[self.lead :]  # without the space put before the first word


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip, ids): round_trip says that decoding the ids gives the text again."""
    kind = docs.schema[id_col].dataType.simpleString()
    loaded: dict[str, Pieces] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = loaded.get(model) or loaded.setdefault(model, Pieces.load(model))
        texts = as_text(batch.column("text")).to_pylist()
        ids = coder.encode_batch(texts)
        same = [coder.decode(x.tolist()) == t for x, t in zip(ids, texts)]
        cols = [batch.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
        names = ["id", "n_pieces", "ids_crc32", "round_trip"]
        if with_ids:
            cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    out = batched(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, n_pieces bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids."""
    kind = rows.schema[id_col].dataType.simpleString()
    loaded: dict[str, Pieces] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = loaded.get(model) or loaded.setdefault(model, Pieces.load(model))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([coder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["id", "text"])

    return batched(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)
