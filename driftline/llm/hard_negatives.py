"""Hard negatives by integer products over bit planes.

Components are whole numbers. A block of rows holds them as bit planes: plane j
has bit j of every component (above the smallest one), eight components to a
byte. A product with an anchor grows plane by plane from the highest; what the
planes not yet read can still add lies between bounds that halve with each, so
every pair of an anchor and a row has an interval for its score. A pair is
dropped once its interval cannot reach a window that the anchor asks for, or
lies below as many certain ones as are asked for. While many pairs are alive a
plane is one matrix product; later planes are read for the pairs left alone.

Positives are the first rows of the anchor's own label, one open window; they
set the windows of the negatives: scores from ``low`` to ``high`` hundredths of
the positive's. Rows are dealt into blocks by label, so the anchors of a label
meet only blocks that hold it when positives are looked for.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; an empty or zero vector scores zero; a shorter vector is
padded with zeros; an id on several rows is several anchors and several rows, and
a row is never its own positive; ties go to the smaller id; a negative positive
has no window; an empty table gives no rows; other columns are ignored. Products
that could pass 2^62 are an error before any work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm import vector_tiles as tiles
from driftline.llm.shared import stored

#: Rows of a block and of a tile of anchors, and of both that are compared at a time.
BLOCK, TILE, ROWS, ANCHORS = 65_536, 2_048, 4_096, 128
#: Share of pairs alive below which planes are read for pairs alone, and planes left from which intervals are worth a look.
SPARSE, LATE = 1 / 16, 4
#: Bound of no window.
FAR = float(2**62)


class Planes:
    """Bit planes of rows of whole numbers, highest first."""

    def __init__(self, packed: bytes, rows: int, width: int, low: int, bits: int):
        self.low, self.bits, self.width = low, bits, width
        self.packed = np.frombuffer(packed, np.uint8).reshape(bits, rows, -(-width // 8))

    @staticmethod
    def pack(numbers: np.ndarray, low: int, bits: int) -> bytes:
        above = numbers - low
        return b"".join(np.packbits(((above >> j) & 1).astype(np.uint8), axis=1).tobytes() for j in reversed(range(bits)))

    def plane(self, i: int, at: slice | np.ndarray, kind: type) -> np.ndarray:
        return np.unpackbits(self.packed[i][at], axis=1, count=self.width).astype(kind)


def in_windows(anchors: np.ndarray, planes: Planes, at: slice, alive: np.ndarray, lower: np.ndarray, upper: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of pairs among which the first ``n`` of every window are.

    ``alive`` (anchors, rows) has the pairs that may be; ``lower`` and ``upper``
    (anchors, windows) bound the windows, and ``lower`` is raised in place.
    """
    kind = anchors.dtype.type
    up, down = np.maximum(anchors, 0).sum(axis=1), np.maximum(-anchors, 0).sum(axis=1)
    score = np.repeat((planes.low * anchors.sum(axis=1))[:, None], alive.shape[1], axis=1)

    def drop(j: int) -> None:
        """Raise lower bounds by what is certain, then drop what no interval reaches."""
        nonlocal alive
        least, most = score - ((1 << j) - 1) * down[:, None], score + ((1 << j) - 1) * up[:, None]
        reached = np.zeros_like(alive)
        for w in range(lower.shape[1]):
            low, high = lower[:, w, None], upper[:, w, None]
            certain = np.where(alive & (least >= low) & (most <= high), least, kind(-FAR))
            if certain.shape[1] >= n:
                np.maximum(lower[:, w], np.partition(certain, certain.shape[1] - n, axis=1)[:, -n], out=lower[:, w])
            reached |= (most >= lower[:, w, None]) & (least <= high)
        alive = alive & reached

    for i in range(planes.bits):
        j = planes.bits - 1 - i
        score += (1 << j) * (anchors @ planes.plane(i, at, kind).T)
        if j > LATE:
            continue
        drop(j)
        a, r = np.nonzero(alive)
        if len(a) <= SPARSE * alive.size:
            break
    rows = np.arange(at.start, at.stop)
    left = score[a, r]
    for i in range(i + 1, planes.bits):
        j = planes.bits - 1 - i
        left = left + (1 << j) * np.concatenate([np.einsum("ij,ij->i", anchors[a[s : s + 65_536]], planes.plane(i, rows[r[s : s + 65_536]], kind)) for s in range(0, len(a), 65_536)] or [left])
        least, most = left - ((1 << j) - 1) * down[a], left + ((1 << j) - 1) * up[a]
        some = ((most[:, None] >= lower[a]) & (least[:, None] <= upper[a])).any(axis=1)
        a, r, left = a[some], r[some], left[some]
    return a, rows[r], left


def _packed_rows(width: int, low: int, bits: int, scale: int):
    def pack(group: pa.Table) -> dict[str, object]:
        label = group.column("label").to_numpy().astype(np.int64)
        numbers = np.floor(scale * tiles.matrix(group.column("embedding"), width)).astype(np.int64)
        return {"ids": group.column("vec_id").to_numpy().astype(np.int64), "rows": group.column("row").to_numpy().astype(np.int64), "row_labels": label, "labels": np.unique(label).tolist(), "planes": Planes.pack(numbers, low, bits)}

    return pack


def _packed_anchors(width: int, scale: int):
    def pack(group: pa.Table) -> dict[str, object]:
        label = group.column("label").to_numpy().astype(np.int64)
        scores = group.column("scores").to_pylist() if "scores" in group.column_names else [[]] * len(label)
        count = max(map(len, scores), default=0)
        known = np.array([x + [-1] * (count - len(x)) for x in scores], np.int64).reshape(len(label), count)
        return {
            "ids": group.column("vec_id").to_numpy().astype(np.int64), "rows": group.column("row").to_numpy().astype(np.int64), "row_labels": label, "labels": np.unique(label).tolist(),
            "numbers": np.floor(scale * tiles.matrix(group.column("embedding"), width)).astype(np.int64), "windows": count, "scores": known,
        }

    return pack


_FOUND = "row long, anchor_id long, window int, vec_id long, score long"


def _scored(width: int, low: int, bits: int, exact: type, n: int, same: bool, hundredths: tuple[int, int]):
    """Anchors of a tile against rows of a block: the first ``n`` of each window."""

    def run(tile: dict, block: dict) -> dict[str, np.ndarray]:
        get = lambda pack, name: np.frombuffer(pack[name], np.int64)
        numbers, known = get(tile, "numbers").reshape(-1, width).astype(exact), get(tile, "scores").reshape(-1, tile["windows"]) if tile["windows"] else None
        rows, ids, labels = get(block, "rows"), get(block, "ids"), get(block, "row_labels")
        planes = Planes(block["planes"], len(rows), width, low, bits)
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "anchor_id", "window", "vec_id", "score")}
        for start in range(0, len(numbers), ANCHORS):
            part = slice(start, start + ANCHORS)
            own, own_id, own_label = (get(tile, name)[part] for name in ("rows", "ids", "row_labels"))
            if same:
                lower, upper = np.full((len(own), 1), -FAR), np.full((len(own), 1), FAR)
            else:
                # scores are whole, so bounds are rounded inwards; a negative positive has none
                least, most = -(-hundredths[0] * known[part] // 100), hundredths[1] * known[part] // 100
                lower, upper = np.where(known[part] >= 0, least, 1).astype(float), np.where(known[part] >= 0, most, 0).astype(float)
                lower, upper = np.where(upper >= lower, lower, FAR), np.where(upper >= lower, upper, -FAR)
            lower, upper = lower.astype(exact), upper.astype(exact)
            asked, got = lower.copy(), []
            for first in range(0, len(rows), ROWS):
                at = slice(first, min(first + ROWS, len(rows)))
                alive = (own_label[:, None] == labels[None, at]) & (own[:, None] != rows[None, at]) if same else own_label[:, None] != labels[None, at]
                if alive.any():
                    got.append(in_windows(numbers[part], planes, at, alive, lower, upper, n))
            if not got:
                continue
            a, r, score = (np.concatenate(x) for x in zip(*got))
            for w in range(lower.shape[1]):
                inside = np.nonzero((score >= asked[a, w]) & (score <= upper[a, w]))[0]
                by = inside[np.lexsort((ids[r[inside]], -score[inside], a[inside]))]
                place = np.arange(len(by)) - np.searchsorted(a[by], a[by])
                by = by[place < n]
                for k, v in (("row", own[a[by]]), ("anchor_id", own_id[a[by]]), ("window", np.full(len(by), w)), ("vec_id", ids[r[by]]), ("score", score[by].astype(np.int64))):
                    out[k].append(v)
        return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}

    return run


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, hundredths: tuple[int, int] = (30, 90), scale: int = 256, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, embedding, label) of which ``anchors`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = stored(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & tiles.finite(F.col("embedding"))).withColumn("row", F.monotonically_increasing_id()))
    whole = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    reach = rows.select("asks", F.size("embedding").alias("width"), F.array_min(whole).alias("low"), F.array_max(whole).alias("high"))
    size = reach.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asked"), F.max("width").alias("width"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if not size["asked"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(size["width"], 1)
    low, high = int(min(size["low"] or 0, 0)), int(max(size["high"] or 0, 0))
    bits, most = max((high - low).bit_length(), 1), max(high, -low)
    bound = width * most * (1 << bits) * 2
    if bound >= 2**62:
        raise ValueError(f"components up to {most} have products that might not fit a long")
    exact = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    order = ["label", "row"]
    place = lambda df, name, parts: df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id())
    blocks = stored(tiles.packed(stored(place(rows, "block", tiles.parts_of(rows, size["n"], block))), "block", _packed_rows(width, low, bits, scale), "ids binary, rows binary, row_labels binary, labels array<long>, planes binary"))
    asked = stored(place(rows.filter("asks"), "tile", tiles.parts_of(rows, size["asked"], tile, 128)))
    schema = "ids binary, rows binary, row_labels binary, labels array<long>, numbers binary, windows int, scores binary"
    scored = lambda n, same: _scored(width, low, bits, exact, n, same, hundredths)

    packs = tiles.packed(asked, "tile", _packed_anchors(width, scale), schema)
    sharing = stored(packs.select("tile", F.explode("labels").alias("label")).join(blocks.select("block", F.explode("labels").alias("label")), "label").select("tile", "block").distinct())
    same = tiles.meet(packs.join(sharing, "tile"), blocks.join(sharing, "block"), scored(positives, True), _FOUND)
    first = stored(tiles.first_ones(same, positives, ["row"], [F.col("score").desc(), F.col("vec_id")], "window").select("row", "anchor_id", (F.col("window") - 1).alias("window"), "vec_id", "score"))

    numbers = first.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "score"))), lambda x: x["score"]).alias("scores"))
    packs = tiles.packed(asked.join(numbers, "row"), "tile", _packed_anchors(width, scale), schema)
    n_blocks, n_tiles = (df.agg(F.max(name)).first()[0] + 1 for df, name in ((blocks, "block"), (asked, "tile")))
    other = tiles.meet(tiles.everywhere(packs, "block", n_blocks), tiles.everywhere(blocks, "tile", n_tiles), scored(negatives, False), _FOUND)
    ranked = tiles.first_ones(other, negatives, ["row", "window"], [F.col("score").desc(), F.col("vec_id")]).select("row", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return first.join(ranked, ["row", "window"]).select("anchor_id", F.col("vec_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
