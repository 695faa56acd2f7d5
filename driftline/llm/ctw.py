"""Language-model scoring by context-tree weighting.

A text is its lower-cased (A-Z) words with single spaces between them, and one
end mark; end marks stand before its first byte. A byte is eight binary
decisions, each in a context of up to ``depth`` bytes before it, whatever words
they belong to. Every node of this context tree has a Krichevsky-Trofimov
estimate of its decisions, and the weighting of each node with its children
mixes the estimates of all depths. The tree is learned from the training rows
and then fixed, so a byte's code length depends on its context alone.

The tree is held as counts of grams (``depth`` bytes and the next one):

* Each task cuts its texts into groups of bounded bytes and counts every
  group's distinct grams and words, sorted and packed, dealt into parts by the
  ``SPLIT`` bytes nearest to the predicted one. Groups follow the order in
  which rows come, so neither ids nor repeated rows nor null ids crowd one.
* The counts of a part are merged, ``FAN_IN`` groups at a time, and the part's
  subtrees are weighted from the leaves up to depth ``SPLIT``; the few levels
  above are DataFrame aggregations, and their mixtures flow down by joins.
* Parts answer each group with the code lengths of its grams and the counts of
  its words, and each group scores its own texts.

Nothing is gathered that grows with the input but the counts themselves, which
stay dealt; the driver sees two numbers of them.

Defined cases: a null or empty text has the end mark alone; a null id is
training text; repeated rows count as often as they occur; ids may be any
longs; with no training text every decision is even; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import crc_remainder, release_memory, slices, stored, texts_of

DEPTH = 7
#: Bytes of context that deal grams into parts.
SPLIT = 3
#: Bytes of text to a group at most (one longer text is a group of its own), and to a packed row.
GROUP_BYTES, CHUNK_BYTES = 40_000_000, 1_500_000
#: Groups whose counts are merged at once.
FAN_IN = 64
#: Ranges in which a task holds its grams, and distinct grams that wait for a merge in one of them.
RANGES, PENDING = 16, 200_000
#: Code lengths are handed on as multiples of this share of a decimal digit: an error of at most 5e-7 for each byte.
LOG_STEP = 2.0**-20
_END = b"\n"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
_TEXTS, _GRAMS, _WORDS = 0, 1, 2
_ROWS = "grp long, kind int, part long, ids array<long>, held array<boolean>, texts binary, keys binary, counts binary"
_U8 = np.uint64(8)


# --- packing


def _zip(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _pack_numbers(values: np.ndarray) -> bytes:
    """Numbers by byte planes, so that equal high bytes lie together."""
    return _zip(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def _unpack_numbers(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(_unzip(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_grams(keys: np.ndarray) -> bytes:
    """Ascending unsigned integers by their differences."""
    return _pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_numbers(data, "<u8"), dtype=np.uint64)


def _pack_words(words: list[bytes]) -> bytes:
    """Words hold no line end; the end mark is the empty one."""
    return _zip(b"\n".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    return _unzip(data).split(b"\n")


# --- grams of texts


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of the texts, one text after another, and each text's first place.

    A gram's highest byte is the one just before the predicted byte, its lowest
    the predicted byte itself.
    """
    pad = _END * depth
    flat = np.frombuffer(pad + pad.join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.zeros(len(flat), bool)
    starts = depth + np.cumsum(lengths + depth) - lengths - depth
    edges = np.zeros(len(flat) + 1, np.int8)
    edges[starts] += 1
    edges[starts + lengths] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    keys = np.zeros(len(flat) - depth, np.uint64)
    for back in [*range(1, depth + 1), 0]:
        keys = (keys << _U8) | flat[depth - back : len(flat) - back]
    return keys[inside[depth:]], np.cumsum(lengths) - lengths


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of several ascending lists, with their counts added up."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.nonzero(np.r_[True, every[1:] != every[:-1]])[0] if len(every) else np.zeros(0, np.int64)
    return every[starts], np.add.reduceat(n[order], starts) if len(every) else n


def _parts_of(keys: np.ndarray, depth: int, split: int, parts: int) -> np.ndarray:
    """The part of each gram, by its nearest ``split`` bytes of context."""
    near = keys >> np.uint64(8 * (depth + 1 - split))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


class _Group:
    """Counts of the texts of one group so far; grams lie in ranges, so that a merge touches few of them."""

    def __init__(self, depth: int):
        self.depth, self.bytes = depth, 0
        self.words: Counter = Counter()
        self.seen: set[bytes] = set()
        self.edges: np.ndarray | None = None
        self.ranges: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(RANGES)]
        self.waiting = [0] * RANGES

    def _merge(self, r: int) -> None:
        if len(self.ranges[r]) > 1:
            self.ranges[r] = [merge_counts(*map(list, zip(*self.ranges[r])))]
        self.waiting[r] = 0

    def add(self, texts: list[bytes], held: list[bool]) -> None:
        for is_held in (False, True):
            own = [t for t, h in zip(texts, held) if h == is_held]
            if not own:
                continue
            keys, n = np.unique(gram_keys(own, self.depth)[0], return_counts=True)
            n = np.zeros(len(n), np.uint32) if is_held else n.astype(np.uint32)
            if self.edges is None:
                self.edges = keys[np.linspace(0, len(keys) - 1, RANGES + 1).astype(int)[1:-1]]
            cuts = [0, *np.searchsorted(keys, self.edges), len(keys)]
            for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    self.ranges[r].append((keys[a:b].copy(), n[a:b].copy()))
                    self.waiting[r] += b - a
                    if self.waiting[r] > PENDING:
                        self._merge(r)
            for text in own:
                words = text[:-1].split(b" ")  # no word gives the end mark alone
                if text != _END:
                    words.append(b"")
                (self.seen if is_held else self.words).update(words)
        self.bytes += sum(map(len, texts))

    def rows(self, parts: int, split: int) -> Iterator[tuple]:
        """(kind, part, keys, counts), packed."""
        for r in range(RANGES):
            self._merge(r)
        held = [x for r in self.ranges for x in r]
        self.ranges = []
        keys, n = (np.concatenate(x) for x in zip(*held))
        del held
        part = _parts_of(keys, self.depth, split, parts).astype(np.uint32)
        for p in np.unique(part):
            own = np.nonzero(part == p)[0]
            yield _GRAMS, int(p), pack_grams(keys[own]), _pack_numbers(n[own].astype(np.int64))
        del keys, n, part
        import zlib

        dealt: dict[int, list[bytes]] = {}
        for word in self.seen.union(self.words):
            dealt.setdefault(zlib.crc32(word) % parts, []).append(word)
        for p, words in dealt.items():
            words.sort()
            yield _WORDS, p, _pack_words(words), _pack_numbers(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))


def _arrow_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _ROWS.split(", ")])


def _count_groups(depth: int, split: int, parts: int, group_bytes: int):
    """Rows (doc_id, held_out, text) to the packed texts and counts of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, group = TaskContext.get().partitionId() << 32, _Group(depth)
        ids, held, texts, size = [], [], [], 0

        def text_row() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if texts:
                group.add(texts, held)
                yield _arrow_rows([(at, _TEXTS, None, list(ids), list(held), _zip(b"".join(texts), 3), None, None)])
            ids.clear(), held.clear(), texts.clear()
            size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal at, group
            yield from text_row()
            if group.bytes:
                for row in group.rows(parts, split):
                    yield _arrow_rows([(at, row[0], row[1], None, None, None, *row[2:])])
            at, group = at + 1, _Group(depth)
            release_memory()

        for batch in slices(batches):
            for doc_id, is_held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts_of(batch)):
                if group.bytes + size + len(text) > group_bytes and texts:
                    yield from close()
                ids.append(doc_id)
                held.append(is_held)
                texts.append(b" ".join(text.encode().lower().split()) + _END)
                size += len(texts[-1])
                if size > CHUNK_BYTES:
                    yield from text_row()
        yield from close()

    return run


# --- the tree


_TABLE = np.arange(1 << 16)
_LOG_GAMMA_HALF = np.array([math.lgamma(i + 0.5) for i in _TABLE.tolist()])
_LOG_GAMMA_ONE = np.array([math.lgamma(i + 1.0) for i in _TABLE.tolist()])


def _log_gamma(n: np.ndarray, table: np.ndarray, offset: float) -> np.ndarray:
    """ln Gamma(n + offset) of counts: a table, and Stirling's series beyond it."""
    out = table[np.minimum(n, len(table) - 1)]
    large = np.nonzero(n >= len(table))[0]
    if len(large):
        z = n[large] + offset
        out[large] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return _log_gamma(n0, _LOG_GAMMA_HALF, 0.5) + _log_gamma(n1, _LOG_GAMMA_HALF, 0.5) - _log_gamma(n0 + n1, _LOG_GAMMA_ONE, 1.0) - math.log(math.pi)


class Subtrees:
    """The subtrees below depth ``split`` of one part's grams.

    Level d has the distinct (d bytes of context, predicted byte) of the part,
    sorted; the nodes of decision k are runs of equal context and first k bits.
    Decisions do not touch each other's nodes, so they are worked one by one.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, split: int):
        self.depth, self.split = depth, split
        self.keys, self.counts, self.parent = {depth: keys}, {depth: counts}, {}
        for d in range(depth - 1, split - 1, -1):
            below = self.keys[d + 1]
            shorter = ((below >> np.uint64(16)) << _U8) | (below & np.uint64(255))
            self.keys[d], self.parent[d + 1] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.parent[d + 1], self.counts[d + 1], len(self.keys[d])).astype(np.int64)

    def nodes(self, k: int) -> dict[int, dict[str, np.ndarray]]:
        """Decision k's nodes by level: ``row`` (the first of the run), ``at`` (each row's node), counts, log_w, share."""
        out: dict[int, dict[str, np.ndarray]] = {}
        for d in range(self.depth, self.split - 1, -1):
            keys, counts = self.keys[d], self.counts[d]
            run = keys >> np.uint64(8 - k)
            first = np.r_[True, run[1:] != run[:-1]]
            row = np.nonzero(first)[0]
            ones = (keys >> np.uint64(7 - k)) & np.uint64(1) == 1
            total, n1 = np.add.reduceat(counts, row), np.add.reduceat(np.where(ones, counts, 0), row)
            node = {"row": row, "at": np.cumsum(first) - 1, "n0": total - n1, "n1": n1}
            own = _log_kt(node["n0"], n1)
            if d == self.depth:
                node |= {"log_w": own, "share": np.ones(len(row))}
            else:
                below = out[d + 1]
                below["up"] = node["at"][self.parent[d + 1][below["row"]]]
                children = np.bincount(below["up"], below["log_w"], len(row))
                node |= {"log_w": np.logaddexp(own, children) - math.log(2), "share": 1 / (1 + np.exp(np.minimum(700.0, children - own)))}
            out[d] = node
        return out

    def top_keys(self, k: int, row: np.ndarray) -> np.ndarray:
        """Node keys at depth ``split``: the context, and below it a one and the first k bits."""
        keys = self.keys[self.split][row]
        return ((keys >> _U8) << _U8) | np.uint64(1 << k) | ((keys & np.uint64(255)) >> np.uint64(8 - k))

    def tops(self) -> dict[str, np.ndarray]:
        """Nodes at depth ``split``: key, n0, n1, log_w, share."""
        found = []
        for k in range(8):
            node = self.nodes(k)[self.split]
            found.append((self.top_keys(k, node["row"]), node["n0"], node["n1"], node["log_w"], node["share"]))
        return dict(zip(("key", "n0", "n1", "log_w", "share"), (np.concatenate(c) for c in zip(*found))))

    def code_lengths(self, keys: np.ndarray, mix: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each gram's probability, given the mixtures down to depth ``split`` by sorted node keys."""
        total = np.zeros(len(self.keys[self.depth]))
        for k in range(8):
            nodes = self.nodes(k)
            at = np.searchsorted(keys, self.top_keys(k, nodes[self.split]["row"]))
            m, r = mix[at], rest[at]
            for d in range(self.split + 1, self.depth + 1):
                node = nodes[d]
                one = (node["n1"] + 0.5) / (node["n0"] + node["n1"] + 1)
                m, r = m[node["up"]] + r[node["up"]] * node["share"] * one, r[node["up"]] * (1 - node["share"])
            m = m[nodes[self.depth]["at"]]
            ones = (self.keys[self.depth] >> np.uint64(7 - k)) & np.uint64(1) == 1
            total += np.log10(np.where(ones, m, 1 - m))
        return total


def _log_gamma_column(x: Column) -> Column:
    """ln Gamma for x of 0.5 and more: Stirling's series six steps up."""
    z = x + 6
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(product)


def _log_kt_column() -> Column:
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    return _log_gamma_column(n0 + 0.5) + _log_gamma_column(n1 + 0.5) - _log_gamma_column(n0 + n1 + 1) - math.log(math.pi)


def _one() -> Column:
    """The Krichevsky-Trofimov estimate that the next decision is a one."""
    return (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)


def _shorter(key: str) -> Column:
    """The node of the same decision whose context lacks the farthest byte."""
    return F.shiftleft(F.shiftright(key, 16), 8).bitwiseOR(F.col(key).bitwiseAND(F.lit(255).cast("long")))


def upper_mixtures(tops: DataFrame, split: int) -> DataFrame:
    """(part, key, mix, rest) of the nodes at depth ``split``: the mixture so far, and the weight left for deeper nodes."""
    levels = {split: tops}
    for d in range(split - 1, -1, -1):
        below = levels[d + 1].groupBy(_shorter("key").alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("children"))
        own = below.withColumn("own", _log_kt_column())
        top = F.greatest("own", "children")
        weighted = top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("children") - top)) - math.log(2)
        share = 1 / (1 + F.exp(F.least(F.lit(700.0), F.col("children") - F.col("own"))))
        levels[d] = own.select("key", "n0", "n1", weighted.alias("log_w"), share.alias("share"))
    mixed = levels[0].select("key", (F.col("share") * _one()).alias("mix"), (1 - F.col("share")).alias("rest"))
    for d in range(1, split + 1):
        up = mixed.select(F.col("key").alias("parent"), F.col("mix").alias("mix_up"), F.col("rest").alias("rest_up"))
        joined = levels[d].withColumn("parent", _shorter("key")).join(up, "parent")
        mixture, rest = F.col("mix_up") + F.col("rest_up") * F.col("share") * _one(), F.col("rest_up") * (1 - F.col("share"))
        mixed = joined.select(*(["part"] if d == split else []), "key", mixture.alias("mix"), rest.alias("rest"))
    return mixed


# --- parts


def _merged(kind: int, keys: list[bytes], counts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray | list[bytes]]:
    """Packed keys, added counts and the keys of several packed rows of one part."""
    numbers = [_unpack_numbers(c, "<i8") for c in counts]
    if kind == _GRAMS:
        found, n = merge_counts([unpack_grams(x) for x in keys], numbers)
        return pack_grams(found), n, found
    total: dict[bytes, int] = {}
    for words, own in zip(map(_unpack_words, keys), numbers):
        for w, x in zip(words, own.tolist()):
            total[w] = total.get(w, 0) + x
    found = sorted(total)
    return _pack_words(found), np.fromiter(map(total.__getitem__, found), np.int64, len(found)), found


_PACKED = "kind int, part long, grp long, keys binary, counts binary"


def _merge_some(rows: pa.Table) -> pa.Table:
    kind = rows.column("kind")[0].as_py()
    keys, n, _ = _merged(kind, rows.column("keys").to_pylist(), rows.column("counts").to_pylist())
    return pa.table({"kind": pa.array([kind], pa.int32()), "part": rows.column("part").slice(0, 1), "grp": rows.column("grp").slice(0, 1), "keys": pa.array([keys], pa.binary()), "counts": pa.array([_pack_numbers(n)], pa.binary())})


_PARTS = "kind int, part long, keys binary, counts binary, types long, tokens long, key long, n0 long, n1 long, log_w double, share double"


def _grow(depth: int, split: int):
    """Rows of a part to one row with its counts and, of grams, a row for each node at depth ``split``."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        keys, n, found = _merged(kind, rows.column("keys").to_pylist(), rows.column("counts").to_pylist())
        tops = Subtrees(found, n, depth, split).tops() if kind == _GRAMS else {c: np.zeros(0) for c in ("key", "n0", "n1", "log_w", "share")}
        m = len(tops["key"])
        one = lambda x, t: pa.array([x] + [None] * m, t)
        after = lambda c, t: pa.concat_arrays([pa.nulls(1, t), pa.array(tops[c].astype(np.int64 if t == pa.int64() else np.float64), t)])
        return pa.table({
            "kind": pa.array(np.full(m + 1, kind, np.int32)), "part": pa.array(np.full(m + 1, rows.column("part")[0].as_py(), np.int64)),
            "keys": one(keys, pa.binary()), "counts": one(_pack_numbers(n), pa.binary()), "types": one(int((n > 0).sum()), pa.int64()), "tokens": one(int(n.sum()), pa.int64()),
            **{c: after(c, pa.int64()) for c in ("key", "n0", "n1")}, **{c: after(c, pa.float64()) for c in ("log_w", "share")},
        })

    return run


def _answer(depth: int, split: int):
    """Rows of groups, and their part's counts and mixtures, to the groups' rows with the values of their keys."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"grp": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "found": pa.array([], pa.binary())})
        kind = asked.column("kind")[0].as_py()
        is_counts = known.column("keys").is_valid()
        own = known.filter(is_counts)
        n = _unpack_numbers(own.column("counts")[0].as_py(), "<i8")
        if kind == _GRAMS:
            above = known.filter(pa.compute.invert(is_counts)).sort_by("key")
            keys = unpack_grams(own.column("keys")[0].as_py())
            values = Subtrees(keys, n, depth, split).code_lengths(above.column("key").to_numpy().astype(np.uint64), above.column("mix").to_numpy(), above.column("rest").to_numpy())
            values = np.rint(values / -LOG_STEP).astype(np.int32)
            found = [_pack_numbers(values[np.searchsorted(keys, unpack_grams(x))]) for x in asked.column("keys").to_pylist()]
        else:
            count_of = dict(zip(_unpack_words(own.column("keys")[0].as_py()), n.tolist()))
            found = [_pack_numbers(np.array([count_of[w] for w in _unpack_words(x)], np.int64)) for x in asked.column("keys").to_pylist()]
        return pa.table({"grp": asked.column("grp"), "kind": asked.column("kind"), "part": asked.column("part"), "keys": asked.column("keys"), "found": pa.array(found, pa.binary())})

    return run


class _Lookup:
    """Code lengths of a group's grams, by part."""

    def __init__(self, depth: int, split: int, parts: int):
        self.of = lambda keys: _parts_of(keys, depth, split, parts).astype(np.int64)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The code lengths of distinct keys."""
        out, part = np.zeros(len(keys), np.int64), self.of(keys)
        order = np.argsort(part, kind="stable")
        edges = np.nonzero(np.r_[True, np.diff(part[order]) > 0, True])[0]
        for a, b in zip(edges, edges[1:]):
            own = order[a:b]
            known, logs = self.held[int(part[own[0]])]
            out[own] = logs[np.searchsorted(known, keys[own])]
        return out


def _score_group(depth: int, split: int, parts: int, n_train: int, n_types: int):
    """Packed texts of a group and the answers to it to one row for each text."""
    names = [f.split()[0] for f in SCORES.split(", ")]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        lookup, count_of = _Lookup(depth, split, parts), {}
        for k in range(answers.num_rows):
            kind, part, keys, found = (answers.column(c)[k].as_py() for c in ("kind", "part", "keys", "found"))
            if kind == _GRAMS:
                lookup.held[part] = unpack_grams(keys), _unpack_numbers(found, "<i4")
            else:
                count_of.update(zip(_unpack_words(keys), _unpack_numbers(found, "<i8").tolist()))
        out: list[tuple] = []
        for k in range(texts.num_rows):
            ids, held, packed = (texts.column(c)[k].as_py() for c in ("ids", "held", "texts"))
            own = [t + _END for t in _unzip(packed).split(_END)[:-1]]
            places, firsts = gram_keys(own, depth)
            distinct, back = np.unique(places, return_inverse=True)
            scores = np.add.reduceat(lookup[distinct][back], firsts) * -LOG_STEP
            for doc_id, is_held, text, score in zip(ids, held, own, scores.tolist()):
                words = text[:-1].split(b" ") if text != _END else []
                words.append(b"")
                n = np.fromiter(map(count_of.__getitem__, words), np.float64, len(words))
                base = float(np.log10((n + 1) / (n_train + n_types + 1)).sum())
                out.append((doc_id, is_held, len(words), int((n > 0).sum()), n_train, base, score, len(text), -score / math.log10(2) / len(text)))
        lookup.held.clear()
        count_of.clear()
        release_memory()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)

    return run


def score(docs: DataFrame, depth: int = DEPTH, modulus: int = 7, held_out_remainder: int = 2, group_bytes: int = GROUP_BYTES, parts: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Base and context-tree log10 probabilities of every text, and its bits per byte; see ``SCORES``."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7, so that a gram fits 64 bits")
    split = min(SPLIT, depth - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_remainder("doc_id", modulus) == held_out_remainder).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # Distinct grams grow more slowly than texts, so the parts do too: about half a million grams to each.
    parts = parts or max(1, round(64 * (size / (1 << 30)) ** 0.6))
    tasks = max(1, -(-size // group_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (group_bytes // 10 + 1))))
    counted = stored(rows.coalesce(tasks).mapInArrow(_count_groups(depth, split, parts, group_bytes), _ROWS))
    packed = counted.filter("keys is not null").select("kind", "part", "grp", "keys", "counts")
    groups = counted.select("grp").distinct().count()
    merged, fan = packed, groups
    while fan > fan_in:
        fan = -(-fan // fan_in)
        merged = merged.groupBy("kind", "part", F.pmod(F.xxhash64("grp"), F.lit(fan))).applyInArrow(_merge_some, _PACKED)
    grown = stored(merged.groupBy("kind", "part").applyInArrow(_grow(depth, split), _PARTS))
    totals = grown.filter(f"kind = {_WORDS}").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()  # one row
    own = grown.filter("keys is not null").select("kind", "part", "keys", "counts", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("mix"), F.lit(None).cast("double").alias("rest"))
    above = upper_mixtures(grown.filter("key is not null").select("part", "key", "n0", "n1", "log_w", "share"), split)
    above = above.select(F.lit(_GRAMS).alias("kind"), "part", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), "key", "mix", "rest")
    # A part answers some hundred groups in one task, and is copied to as many tasks as that takes.
    slots = max(1, -(-groups // (4 * fan_in)))
    known = own.unionByName(above).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    asked = packed.drop("counts").withColumn("slot", F.pmod(F.xxhash64("grp"), F.lit(slots)).cast("int"))
    by = ["kind", "part", "slot"]
    answers = asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(_answer(depth, split), "grp long, kind int, part long, keys binary, found binary")
    texts = counted.filter(f"kind = {_TEXTS}").select("grp", "ids", "held", "texts")
    return texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_score_group(depth, split, parts, totals["tokens"] or 0, totals["types"] or 0), SCORES)
