"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on leading principal axes, which never lengthens a
distance; the length of what the projection leaves out is one more such axis.
Grid cells of width epsilon on the first few axes give the order of one long
sequence; it is dealt into ranges and cut into blocks, at borders of cells where
it can be, with bounding boxes. Pairs of intervals of the sequence are halved
level by level on ids and boxes alone, and a pair whose boxes are farther apart
than epsilon is dropped with all below it. Vectors move only for pairs of
blocks that are left: pairs meet by tiles of blocks, to which each block of
them is sent once, and are joined there, again by halves, down to small matrix
products in double precision.

Equal vectors are one class with a count. A task emits link counts and a
spanning set of links, never the pairs themselves, so a large group of near
copies costs no more rows than it has members; no link is lost to the counts or
to the components.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; a vector shorter than the longest is padded with
zeros; a row with a null id takes no part and is returned with no links, a null
component and kept false; an id on several rows counts once for each row; an
empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.graph import components
from driftline.llm.shared import materialise, stored
from driftline.llm.simhash import spanning_links

#: Vectors in a block, and rows below which a pair of intervals is multiplied out.
BLOCK, LEAF = 512, 128
#: Bytes of vectors in a tile, about; two tiles are in a task's memory at a time.
TILE_BYTES = 16_000_000
#: Principal axes whose cells give the order, and axes that bounding boxes have.
GRID_AXES, BOX_AXES = 6, 16
#: Intervals that one interval of the next level holds, as a power of two.
FAN_BITS = 3


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, width: int, axes: int) -> np.ndarray:
    """(width, axes): leading eigenvectors of the unit vectors' second moments, over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            u = np.hstack([_unit(_matrix(batch.column(0), width)), np.ones((batch.num_rows, 1))])
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "x"])

    rows = vectors.select("embedding").mapInArrow(moments, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # (width + 1) squared rows
    total = np.zeros((width + 1) ** 2)
    for at, x in rows:
        total[at] = x
    total = total.reshape(width + 1, width + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    _, found = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return found[:, ::-1][:, :axes]


def _boxed(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, and the length of the rest: no two rows are farther apart in these than they are."""
    p = unit @ axes
    return np.hstack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1, keepdims=True)))])


def _projected(axes: np.ndarray, epsilon: float, grid: int):
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _boxed(_unit(_matrix(batch.column("embedding"), width)), axes)
            cells = np.floor(p[:, :grid] / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells)), pa.array(list(p))], names=[*batch.schema.names, "cell", "projected"])

    return run


def _blocks(width: int, block: int):
    """Sorted rows of a range to blocks: place, bounding box, and packed ids, counts and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = 0

        def emit(rows: pa.Table) -> pa.RecordBatch:
            nonlocal place
            p = np.stack(rows.column("projected").combine_chunks().to_numpy(zero_copy_only=False))
            v = _matrix(rows.column("embedding").combine_chunks(), width)
            out = [rows.column("range")[0].as_py(), place, p.min(axis=0), p.max(axis=0), rows.column("rep").to_numpy().astype(np.int64).tobytes(), rows.column("copies").to_numpy().astype(np.int64).tobytes(), v.tobytes()]
            place += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=["range", "place", "lo", "hi", "ids", "copies", "vectors"])

        def cut(rows: pa.Table) -> int:
            """Rows of the first block: up to the last border of cells in its second half, if there is one."""
            cells = np.stack(rows.slice(block // 2, block - block // 2 + 1).column("cell").combine_chunks().to_numpy(zero_copy_only=False))
            borders = np.nonzero((cells[1:] != cells[:-1]).any(axis=1))[0]
            return block // 2 + 1 + int(borders[-1]) if len(borders) else block

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            while rows.num_rows > block:
                n = cut(rows)
                yield emit(rows.slice(0, n))
                rows = rows.slice(n)
            held = rows.to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield emit(rows)

    return run


_BLOCK_SCHEMA = "range long, place long, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary"


def _near(a: str, b: str, epsilon: float) -> Column:
    """Whether two boxes are within epsilon."""
    gaps = F.zip_with(
        F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        lambda x, y: F.pow(F.greatest(x, y), F.lit(2)),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g) <= epsilon * epsilon


def _interval_pairs(boxes: DataFrame, bits: int, epsilon: float) -> DataFrame:
    """Pairs (a, b), a <= b, of block places whose boxes are within epsilon, by descent from the whole sequence."""
    levels = [boxes.select("place", F.struct("lo", "hi").alias("box"))]
    edge = lambda side, pick: F.array(*[pick(F.col(f"box.{side}")[i]) for i in range(BOX_AXES + 1)])
    shift = 0
    while shift < bits:
        shift += FAN_BITS
        levels.append(levels[-1].groupBy(F.shiftright("place", FAN_BITS).alias("place")).agg(F.struct(edge("lo", F.min).alias("lo"), edge("hi", F.max).alias("hi")).alias("box")))
    pairs = levels[-1].select(F.col("place").alias("a"), F.col("place").alias("b"))
    for level in reversed(levels[:-1]):
        left = level.select(F.shiftright("place", FAN_BITS).alias("a"), F.col("place").alias("a_in"), F.col("box").alias("a_box"))
        right = level.select(F.shiftright("place", FAN_BITS).alias("b"), F.col("place").alias("b_in"), F.col("box").alias("b_box"))
        pairs = pairs.join(left, "a").join(right, "b").filter("a_in <= b_in").filter(_near("a_box", "b_box", epsilon)).select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
    return pairs


class _Block:
    """Unpacked block; ``order`` axes bound the halves."""

    def __init__(self, ids: bytes, copies: bytes, vectors: bytes, axes: np.ndarray):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.unit = _unit(np.frombuffer(vectors, np.float64).reshape(len(self.ids), len(axes)))
        self.projected = _boxed(self.unit, axes)


def join_blocks(a: _Block, b: _Block, same: bool, least: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Row indices (i, j) of all pairs with cosine at least ``least``; i < j where the blocks are the same."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and j1 <= i0 + 1:
            continue
        p, q = a.projected[i0:i1], b.projected[j0:j1]
        gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
        if gap @ gap > epsilon * epsilon:
            continue
        if max(i1 - i0, j1 - j0) > LEAF:
            if i1 - i0 >= j1 - j0:
                mid = (i0 + i1) // 2
                todo += [(i0, mid, j0, j1), (mid, i1, j0, j1)]
            else:
                mid = (j0 + j1) // 2
                todo += [(i0, i1, j0, mid), (i0, i1, mid, j1)]
            continue
        i, j = np.nonzero(a.unit[i0:i1] @ b.unit[j0:j1].T >= least)
        i, j = i + i0, j + j0
        found.append((i[i < j], j[i < j]) if same else (i, j))
    if not found:
        return (np.zeros(0, np.int64),) * 2
    i, j = zip(*found)
    return np.concatenate(i), np.concatenate(j)


def _join_tiles(axes: np.ndarray, least: float, epsilon: float):
    """Pairs (a, b) of blocks in two tiles, and the blocks (place, ids, copies, vectors), to link counts and spanning edges."""

    def run(pairs: pa.Table, packed: pa.Table) -> pa.Table:
        blocks = {place: _Block(*own, axes) for place, *own in zip(*(packed.column(c).to_pylist() for c in ("place", "ids", "copies", "vectors")))}
        firsts, n = {}, 0
        for place, own in blocks.items():
            firsts[place], n = n, n + len(own.ids)
        if not n or not pairs.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        ids = np.concatenate([own.ids for own in blocks.values()])
        links, root = np.zeros(n, np.int64), np.arange(n)
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            left, right = blocks[a], blocks[b]
            i, j = join_blocks(left, right, a == b, least, epsilon)
            if not len(i):
                continue
            links += np.bincount(i + firsts[a], right.copies[j], n).astype(np.int64) + np.bincount(j + firsts[b], left.copies[i], n).astype(np.int64)
            k, to = spanning_links(n, root[i + firsts[a]], root[j + firsts[b]])
            low = np.arange(n)
            low[k] = to
            root = low[root]
        edge = np.nonzero(root != np.arange(n))[0]
        some = np.nonzero(links)[0]
        out_ids = np.concatenate([ids[some], ids[edge]])
        other = np.concatenate([np.full(len(some), -1), ids[root[edge]]])
        return pa.table({"id": pa.array(out_ids, pa.int64()), "links": pa.array(np.concatenate([links[some], np.zeros(len(edge), np.int64)]), pa.int64()), "other": pa.array(other, pa.int64(), mask=np.arange(len(out_ids)) < len(some))})

    return run


def block_pairs(classes: DataFrame, width: int, rows: int, axes: np.ndarray, epsilon: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks (place, ids, copies, vectors) of the classes, and pairs (a, b) of places whose boxes are within epsilon."""
    placed = classes.mapInArrow(_projected(axes, epsilon, GRID_AXES), "embedding array<double>, rep long, copies long, cell array<long>, projected array<double>")
    ranges = max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (4 * block))))
    order = ["cell", "projected", "rep"]
    sequence = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("range"), "rep", "copies", "embedding", "projected", "cell")
    blocks = stored(sequence.mapInArrow(_blocks(width, block), _BLOCK_SCHEMA))
    most = blocks.agg(F.max("range").alias("range"), F.max("place").alias("place")).first()
    place_bits = int(most["place"]).bit_length()
    blocks = blocks.withColumn("place", F.shiftleft("range", place_bits).bitwiseOR(F.col("place")))
    pairs = _interval_pairs(blocks.select("place", "lo", "hi"), int(most["range"]).bit_length() + place_bits, epsilon)
    return blocks.select("place", "ids", "copies", "vectors"), pairs


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & _usable(F.col("embedding"))
    classes = stored(rows.filter(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    empty = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not size["n"]:
        return empty
    width = size["width"]
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * least_cosine))) + 1e-9
    axes = principal_axes(classes, width, min(width, BOX_AXES))
    axes = np.hstack([axes, np.zeros((width, BOX_AXES - axes.shape[1]))])
    blocks, pairs = block_pairs(classes, width, size["n"], axes, epsilon, block)
    tile_bits = max(0, int(TILE_BYTES // (block * width * 8)).bit_length() - 1)
    tiled = stored(pairs.select("a", "b", F.shiftright("a", tile_bits).alias("ta"), F.shiftright("b", tile_bits).alias("tb")))
    needed = tiled.select((F.col("ta") + 0).alias("left"), (F.col("tb") + 0).alias("right"), F.explode(F.array("a", "b")).alias("place")).distinct().join(blocks, "place")
    found = stored(tiled.groupBy("ta", "tb").cogroup(needed.groupBy("left", "right")).applyInArrow(_join_tiles(axes, least_cosine, epsilon), "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.filter("other is not null"), "id", "other")
    by_class = (
        classes.join(links, classes["rep"] == links["id"], "left").drop("id").join(linked, F.col("rep") == linked["id"], "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component"))
    )
    out = rows.withColumn("key", F.when(usable, F.col("embedding"))).join(by_class.withColumnRenamed("embedding", "key"), "key", "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
