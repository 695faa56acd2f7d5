"""Best-fit packing of documents into training sequences.

Hierarchical residual packing. Pieces are dealt into groups of bounded size;
each group packs its own pieces best-fit, largest first, and emits the bins
that are nearly full or cannot merge any more. The others become items of the
next round, in which eight groups meet in one, and so on until one is left.

A document's tokens are its ids and one end token. Only documents longer than
a sequence are cut: the first piece takes the remainder, all others are full.

Defined cases: a null or empty text is one piece that holds the end token
alone; rows with equal ids or equal texts are packed as separate documents; a
null id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import materialise, slices, texts_of
from driftline.llm.tokens import byte_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = "pack_group long, room long, open boolean, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
_ITEMS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))
#: Items that one task packs at a time: about 100 bytes each.
GROUP_ITEMS = 16_384
#: A bin with this share of its tokens or fewer left is emitted at once.
NEARLY_FULL = 1 / 256
#: Groups of one round that meet in a group of the next.
FAN_IN = 8
#: Bins over half full that a group hands on, the roomiest first, beside its one bin that may be emptier.
#: A merge needs a bin at most half full, of which each group has at most one, so each round uses at
#: most ``FAN_IN`` of the others, and a roomier one always does as well: this many serve 16 rounds,
#: which is 8**16 groups. A group after the first round so has at most 8 * 129 items.
PARTNERS = 128


def cut_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, control: bool = False) -> DataFrame:
    """One row for each piece of each document, with the checksum of its ids."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, width = byte_bpe(tokenizer, control), 4 * capacity
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = bpe.encode(text) + end
                first = len(ids) % width or width
                cuts = [0, *range(first, len(ids), width), len(ids)]
                out += [(doc_id, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin, by index; ties by index.

    ``open_at[r]`` holds the bins with r tokens of room; the set bits of one
    integer say which r have any, so the tightest fit is its lowest set bit
    from the item's size on.
    """
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            open_at.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def _pack_round(items: DataFrame, capacity: int, slack: int, last: bool) -> DataFrame:
    """Items (pack_group, room, items) of each group best-fit into bins of the same form.

    ``open`` marks the bins that go on to the next round: the roomiest, unless
    nearly full. ``pack_group`` is then the group that they go to.
    """

    def pack(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("room").to_pylist(), group.column("items").to_pylist()), key=lambda r: (r[0], [(x["doc_id"] is None, x["doc_id"] or 0, x["piece"], x["start"], x["ids_crc32"]) for x in r[1]]))
        packed = best_fit([capacity - room for room, _ in rows], capacity)
        merged = [[x for i in b for x in rows[i][1]] for b in packed]
        rooms = []
        for b in merged:
            used = 0
            for x in b:
                x["offset"], used = used, used + x["length"]
            rooms.append(capacity - used)
        roomiest = [] if last else sorted(range(len(rooms)), key=lambda i: -rooms[i])[: 1 + PARTNERS]
        going = [False] * len(rooms)
        for i in roomiest:
            going[i] = rooms[i] > slack
        parent = [group.column("pack_group")[0].as_py() // FAN_IN] * len(rooms)
        return pa.table({"pack_group": pa.array(parent, pa.int64()), "room": pa.array(rooms, pa.int64()), "open": pa.array(going, pa.bool_()), "items": pa.array(merged, _ITEMS)})

    return items.groupBy("pack_group").applyInArrow(pack, _BIN)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_items: int = GROUP_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``."""
    pieces = materialise(pieces)
    groups = max(1, -(-pieces.count() // group_items))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    # The place of a row in the checkpoint deals equal rows to different groups, and is the same when read again.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    bins = pieces.select(place.alias("pack_group"), (F.lit(capacity) - F.col("length")).alias("room"), F.array(item).alias("items"))
    slack, sequences = int(capacity * nearly_full), None
    while True:
        packed = materialise(_pack_round(bins, capacity, slack, last=groups == 1))
        final = packed.filter(~F.col("open")).select("items")
        sequences = final if sequences is None else sequences.unionByName(final)
        if groups == 1:
            break
        bins = packed.filter("open").select("pack_group", "room", "items")
        groups = -(-groups // FAN_IN)
    sequences = sequences.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    return sequences.select("sequence_id", F.explode("items").alias("of")).select("of.doc_id", "of.piece", "of.start", "of.length", "of.ids_crc32", "sequence_id", "of.offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, control: bool = False) -> DataFrame:
    """The pieces of ``docs`` with their places; ``control``: strings of special tokens are those tokens, not text."""
    return pack_pieces(cut_pieces(docs, capacity, tokenizer, control=control), capacity)
