"""Merge-type sub-word encoding by a prefix table, and decoding, for SentencePiece BPE models with byte fallback.

For merges ranked by the merged piece, a split of a text is its encoding exactly if every two neighbouring pieces are
compatible: the two, joined and merged alone, give those two again.  So each prefix of a text has one last piece.  The
table stores it: an automaton lists the pieces that end at each position, and the one whose start holds a compatible last
piece (or the text's start) is kept; ids are recovered backwards from the end.  No merge queue over the text is needed.

A piece never holds the space mark after another character (checked when the model is read), so texts are cut before each
run of marks and equal words share one table.  Characters outside the vocabulary become their bytes' pieces.

Defined results: a null text is empty; the empty text has only the begin and end ids and decodes to itself.  Texts are
encoded whole, whatever their length.  Repeated rows each give their row.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, per_worker

MARK = "▁"
CACHED_BYTES = 64 << 20   # of words and their ids in a worker's cache, with WORD_BYTES for the objects that hold a word
WORD_BYTES = 200
CACHED_PAIRS = 400_000


class PrefixTableBpe:
    """Encoder and decoder of one model (its serialised protocol buffer)."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.normalizer_spec.precompiled_charsmap \
                or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no text normalisation is needed")
        self.score, self.ids, self.byte_ids, self.bos, self.eos = {}, {}, {}, 1, 2
        self.surface: list[bytes] = []
        for i, p in enumerate(spec.pieces):
            self.surface.append(b"")
            if p.type == 1:
                self.score[p.piece], self.ids[p.piece] = p.score, i
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface[i] = bytes([value])
            elif p.type == 2:
                self.surface[i] = b" \xe2\x81\x87 "
            elif p.type == 4:
                raise ValueError("user-defined pieces are not supported")
            if p.piece == "<s>":
                self.bos = i
            elif p.piece == "</s>":
                self.eos = i
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds the space mark after another character")
        if any(c not in self.score for p in self.score for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.alphabet = {p for p in self.score if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or self._merge(p) == [p]:  # a piece that merging never gives is no last piece
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.names = [p.piece for p in spec.pieces]
        self.joined: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _merge(self, text: str) -> list[str]:
        """Merges of a short text, best score first and leftmost among equals; used on pairs of pieces only."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay apart when their text is merged alone."""
        return self._merge(left + right) == [left, right]

    def _table(self, word: str) -> list[int] | None:
        """Ids of a piece of text between cuts, by its table of last pieces; None if a character is not a piece."""
        n, joined = len(word), self.joined
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (width, piece) in self.automaton.iter(word):
            if size[end + 1]:
                continue  # a prefix has one last piece
            start = end + 1 - width
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 32 | piece
                fits = joined.get(key)
                if fits is None:
                    fits = joined[key] = self.compatible(self.names[before], self.names[piece])
                if not fits:
                    continue
            last[end + 1], size[end + 1] = piece, width
        out = []
        while n:
            if not size[n]:
                return None
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        if len(self.joined) > CACHED_PAIRS:
            self.joined.clear()
        if self.alphabet.issuperset(word):
            return np.array(self._table(word), "<u4").tobytes()
        # Characters outside the vocabulary never merge with a neighbour unless a piece holds them; each gives its bytes.
        out: list[int] = []
        for run in self._runs(word):
            out.extend(self._table(run) if run[0] in self.alphabet else [self.byte_ids[b] for b in run.encode()])
        return np.array(out, "<u4").tobytes()

    def _runs(self, word: str) -> list[str]:
        """Runs of characters inside the vocabulary, and single characters outside it."""
        out, run = [], ""
        for c in word:
            if c in self.alphabet:
                run += c
            else:
                out += [run, c] if run else [c]
                run = ""
        return [*out, run] if run else out

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        head, tail = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        if not text:
            return head + tail
        words = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        if "" in words:
            cut, run = [], 0
            for w in words:
                run += 1
                if w:
                    cut.append(MARK * (run - 1) + w)
                    run = 0
            if run:
                cut.append(MARK * (run - 1))
            words = cut
        known = self.words
        if self.held > CACHED_BYTES:
            known.clear()
            self.held = 0
        found = list(map(known.get, words))
        if None in found:
            for n, ids in enumerate(found):
                if ids is None:
                    w = words[n]
                    if w not in known:
                        known[w] = self._word(MARK + w)
                        self.held += len(known[w]) + 4 * len(w) + WORD_BYTES
                    found[n] = known[w]
        return b"".join((head, *found, tail))

    def decode(self, ids: bytes) -> str:
        """The text of ids: begin and end ids give nothing, the dummy space is taken off, bytes are joined to characters."""
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return _characters(raw[1:] if raw[:1] == b" " else raw)


def _characters(raw: bytes) -> str:
    return raw.decode("utf-8", errors="replace")


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, and with ``keep_ids`` also (ids, decoded).

    One narrow pass; the model is a file of under a MB and goes to each worker once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = per_worker(("piece-bpe", hashlib.md5(shared.value).hexdigest()), lambda: PrefixTableBpe(shared.value))
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
            texts = [codec.decode(x) for x in ids]
            out = {"doc_id": part.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                   "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]}
            yield out | ({"ids": ids, "decoded": texts} if keep_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
