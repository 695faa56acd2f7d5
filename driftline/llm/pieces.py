"""Encoding to, and decoding from, the pieces of a SentencePiece model.

An Aho-Corasick automaton over the pieces reads a text once. At every position
it gives the pieces that end there, longest first along its output links, and
each relaxes the best score of a segmentation up to that position (Viterbi). A
character that no piece covers falls back to its UTF-8 bytes at a cost below
that of any piece. Of equal scores the segmentation with the longest last piece
stands.

A unigram model's scores are log-probabilities, and the best sum wins. A
byte-pair model's scores are the order of its merges. There a piece relaxes a
position only if the merges leave it apart from the piece before; of the pieces
that end at a position just one is so, and the same pass gives the ids of the
merges, which are those of the model's own encoder.

Spaces are written as U+2581, and one stands before the text. No piece has a
space after another character, so a text is cut before each run of spaces and
the parts, which repeat often, are segmented once in a worker's cache. A U+2581
of the text itself is encoded as bytes, so every text decodes to itself. Models
that change texts before they cut them, have no piece for some byte, or have
pieces that their own merges can't reach in order are refused.

Defined cases: a null or empty text has no ids; repeated rows give one row
each; a null id stays null; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import slices, texts_of

MARK = "▁"
#: Stands for a U+2581 of the text; no piece holds it.
_FOREIGN = "￿"
#: Parts kept in one worker; the cache starts anew beyond it, which changes no result.
CACHE_PARTS = 250_000
#: Pairs of pieces whose border is known in one worker; likewise.
CACHE_PAIRS = 500_000
#: In place of the id of a piece: no segmentation up to here yet, and bytes of a character.
_NONE, _BYTES = -2, -1
_UNIGRAM = 1
_PARTS = re.compile(r" *[^ ]+| +")
ENCODED = "doc_id long, ids array<int>, n_fallback long, score double"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            at += size
            yield tag >> 3, data[at - size : at]


def model_type(proto: bytes) -> int:
    """The type that a model's trainer settings state: 1 is unigram, 2 byte pairs."""
    trainer = dict(proto_fields(proto)).get(2, b"")
    return dict(proto_fields(trainer)).get(3, _UNIGRAM)


def refusal(proto: bytes) -> str | None:
    """Why the texts of a model can't be cut and restored here, if so."""
    fields = dict(proto_fields(proto))
    normaliser, trainer = dict(proto_fields(fields.get(3, b""))), dict(proto_fields(fields.get(2, b"")))
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        return "this model's normaliser changes texts"
    if trainer.get(24, 0):
        return "this model writes spaces behind words"
    return None


class Merges:
    """The merges of a byte-pair model: best score first, of equal pairs the leftmost."""

    def __init__(self, scores: dict[str, float]):
        self.rank = {p: r for r, (p, _) in enumerate(sorted(((p, s) for p, s in scores.items() if len(p) > 1), key=lambda x: (-x[1], x[0])))}
        self.halves: dict[str, list[str]] = {}
        for piece, rank in self.rank.items():
            row, halves = self.merged(piece)
            if len(row) == 1:
                self.halves[piece] = halves
                if any(self.rank.get(h, -1) > rank for h in halves):
                    raise ValueError(f"the merges of this model make {piece!r} of a later piece")

    def merged(self, text: str) -> tuple[list[str], list[str]]:
        """The pieces of a text, merge by merge, and the two that were joined last."""
        row, last, none = list(text), [], len(self.rank)
        while len(row) > 1:
            rank, at = min((self.rank.get(row[i] + row[i + 1], none), i) for i in range(len(row) - 1))
            if rank == none:
                break
            last = row[at : at + 2]
            row[at : at + 2] = ["".join(last)]
        return row, last

    def apart(self, left: str, right: str) -> bool:
        """Whether the merges of both texts together leave the border between two pieces.

        The two pieces at the border are followed back in time: the one made later gives way to
        its half at the border. If the two make a piece whose turn came before either was taken
        up by its own, they were joined. Of equal turns the one further left came first.
        """
        rank, halves, until = self.rank, self.halves, len(self.rank)
        while True:
            if rank.get(left + right, until) < until:
                return False
            made_left, made_right = rank.get(left, -1), rank.get(right, -1)
            if made_left > made_right:
                left, until = halves[left][1], made_left
            elif made_right >= 0:
                right, until = halves[right][0], made_right + 1
            else:
                return True


class PieceModel:
    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=proto) if proto else SentencePieceProcessor(model_file=path)
        proto = model.serialized_model_proto()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [-1] * 256
        self.surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece, plain = model.id_to_piece(i), not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
            if plain:
                self.pieces[piece] = (i, model.get_score(i))
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            self.surface.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode() if plain else b"")
        if min(self.byte_ids) < 0:
            raise ValueError("this model has no piece for some byte")
        if why := refusal(proto):
            raise ValueError(why)
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece of this model spans words, so its texts can't be cut at spaces")
        self.fallback = min(s for _, s in self.pieces.values()) - 10
        self._merges = None
        if model_type(proto) != _UNIGRAM:
            if any(model.is_unused(i) for i in range(model.get_piece_size())) or not set("".join(self.pieces)) <= self.pieces.keys():
                raise ValueError("a byte-pair model needs a piece for each of its characters and no unused ones")
            self._merges = Merges({p: s for p, (_, s) in self.pieces.items()})
            self.pieces = {p: own for p, own in self.pieces.items() if len(p) == 1 or p in self._merges.halves}
        self._text = {i: p for p, (i, _) in self.pieces.items()}
        self._automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self._automaton.add_word(piece, (i, len(piece), score))
        self._automaton.make_automaton()
        self._parts: dict[str, tuple[bytes, int, float]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _joins(self, before: int, i: int) -> bool:
        """Whether the merges of a byte-pair model would not leave these two pieces beside each other."""
        if before < 0:
            return False
        found = self._pairs.get((before, i))
        if found is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            found = self._pairs[before, i] = not self._merges.apart(self._text[before], self._text[i])
        return found

    def segment(self, part: str) -> tuple[list[int], int, float]:
        """Ids of a part, how many of them are bytes, and the score."""
        text = part.replace(MARK, _FOREIGN).replace(" ", MARK)
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [(_NONE, 1)] * (n + 1)
        fallback, done, merging = self.fallback, 0, self._merges is not None
        for end, (i, length, score) in self._automaton.iter(text):
            stop = end + 1
            while done < end:  # positions before this one have all their pieces
                done += 1
                if best[done - 1] + fallback > best[done] and (not merging or back[done][0] == _NONE):
                    best[done], back[done] = best[done - 1] + fallback, (_BYTES, 1)
            total = best[stop - length] + score
            if total > best[stop] and not (merging and self._joins(back[stop - length][0], i)):
                best[stop], back[stop] = total, (i, length)
        while done < n:
            done += 1
            if best[done - 1] + fallback > best[done] and (not merging or back[done][0] == _NONE):
                best[done], back[done] = best[done - 1] + fallback, (_BYTES, 1)
        ids: list[int] = []
        n_bytes, at = 0, n
        while at:
            i, length = back[at]
            if i >= 0:
                ids.append(i)
            else:
                own = part[at - 1].encode()
                n_bytes += len(own)
                ids += [self.byte_ids[b] for b in reversed(own)]
            at -= length
        return ids[::-1], n_bytes, best[n]

    def encode(self, text: str) -> tuple[bytes, int, float]:
        """Packed 32-bit ids of the whole text, how many of them are bytes, and the score."""
        if not text:
            return b"", 0, 0.0
        known, out, n_bytes, score = self._parts, [], 0, 0.0
        for part in _PARTS.findall(" " + text):
            found = known.get(part)
            if found is None:
                if len(known) >= CACHE_PARTS:
                    known.clear()
                ids, k, s = self.segment(part)
                found = known[part] = (array("i", ids).tobytes(), k, s)
            out.append(found[0])
            n_bytes += found[1]
            score += found[2]
        return b"".join(out), n_bytes, score

    def decode(self, ids) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def piece_model(path: str | None = None) -> PieceModel:
    return PieceModel(path or default_path())


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_fallback, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in slices(batches):
            found = [pieces.encode(t) for t in texts_of(batch)]
            ends = [0]
            for ids, _, _ in found:
                ends.append(ends[-1] + len(ids) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(f[0] for f in found))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "ids", "n_fallback", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in slices(batches):
            texts = [pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_fallback, score, restored): restored says that the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids, n_bytes, score = pieces.encode(text)
                rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), n_bytes, score, pieces.decode(array("i", ids)) == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["doc_id", "n_ids", "ids_crc32", "n_fallback", "score", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_fallback long, score double, restored boolean")
