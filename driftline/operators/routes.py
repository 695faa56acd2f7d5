"""Shortest ways over passable grid cells, for many starts and areas at once.

Cells are dealt into square tiles. A start's reach grows in rounds: each tile
that has been told of new or shorter ways settles itself in a task of its own
(one row for each start and tile), and tells its neighbours what crosses the
border. So the rounds are as many as tiles a way crosses, and no task holds
more than a tile. Ways are counts of straight and diagonal steps, so lengths
compare exactly however they were summed.

If the cut-off is short, no way leaves the tiles around its start's own: then
a task takes these together with the starts of one, and there are no rounds.

As in a directed search, a way is dropped once its length and the straight
distance to the goals of its start pass the cut-off, and a pair whose ends lie
in different components is not searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftline.operators.graph import connected
from driftline.operators.lineage import written

#: Moves by the bit of their number: four straight ones, then four diagonal ones.
MOVES = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))
_SELF = 1 << len(MOVES)
#: Cells along a tile's side, and tiles that are settled together.
SIDE, TOGETHER = 32, 64
_FAR = 60_000
#: Tiles to each side of a start's own that one task holds, and columns of a tile whose starts it takes.
AROUND, COLUMNS = 2, 8


def passable_moves(cells: DataFrame) -> DataFrame:
    """(area, x, y, moves): the moves open from each of the distinct ``cells``; a diagonal one needs both cells beside it."""
    told = F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(1 << i).alias("bit")) for i, (dx, dy) in enumerate(MOVES)], F.struct("x", "y", F.lit(_SELF).alias("bit")))
    around = cells.select("area", F.explode(told).alias("c")).groupBy("area", "c.x", "c.y").agg(F.bit_or("c.bit").alias("bits")).filter(F.col("bits") >= _SELF)
    open_ = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    beside = {i: [j for j in range(4) if MOVES[j] in ((dx, 0), (0, dy))] for i, (dx, dy) in enumerate(MOVES) if dx and dy}
    moves = [F.when(reduce(lambda a, j: a & open_(j), beside.get(i, []), open_(i)), 1 << i).otherwise(0) for i in range(len(MOVES))]
    return around.select("area", "x", "y", reduce(lambda a, b: a + b, moves).alias("moves"))


def _tile(name: str):
    return F.floor(F.col(name) / SIDE).cast("long")


def tiled(moves: DataFrame) -> DataFrame:
    """(area, tx, ty, moves): a byte for each cell of a tile; 0 for one that can't be passed or left."""

    def pack(group: pa.Table) -> pa.Table:
        out = np.zeros((SIDE, SIDE), np.uint8)
        x, y = (group.column(c).to_numpy() % SIDE for c in ("x", "y"))
        out[x, y] = group.column("moves").to_numpy().astype(np.uint8)
        first = group.slice(0, 1)
        return pa.table({"area": first.column("area"), "tx": first.column("tx"), "ty": first.column("ty"), "moves": pa.array([out.tobytes()])})

    kind = dict(moves.dtypes)["area"]
    return moves.withColumns({"tx": _tile("x"), "ty": _tile("y")}).groupBy("area", "tx", "ty").applyInArrow(pack, f"area {kind}, tx long, ty long, moves binary")


def components(moves: DataFrame) -> DataFrame:
    """(area, x, y, component) of cells that have a move; cells that reach each other have one component.

    Cells are joined inside tiles first, so what contracts across tiles are
    pieces of tiles, not cells.
    """
    kind = dict(moves.dtypes)["area"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for area, tx, ty, packed in zip(*(batch.column(c).to_pylist() for c in ("area", "tx", "ty", "moves"))):
                open_ = np.frombuffer(packed, np.uint8).reshape(SIDE, SIDE)
                label = np.arange(SIDE * SIDE).reshape(SIDE, SIDE)
                while True:
                    before = label.copy()
                    for i, (here, there) in enumerate(_SLICES):
                        ok = (open_[here] >> i) & 1 == 1
                        low = np.minimum(label[here], label[there])
                        label[here] = np.where(ok, low, label[here])
                        label[there] = np.where(ok, low, label[there])
                    if (label == before).all():
                        break
                x, y = np.nonzero(open_)
                px, py = np.divmod(label[x, y], SIDE)
                yield pa.RecordBatch.from_pydict({"area": pa.array([area] * len(x), batch.column("area").type), "x": x + tx * SIDE, "y": y + ty * SIDE, "px": px + tx * SIDE, "py": py + ty * SIDE, "moves": open_[x, y].astype(np.int32)})

    found = written(tiled(moves).mapInArrow(pieces, f"area {kind}, x long, y long, px long, py long, moves int").select("area", "x", "y", F.struct("area", "px", "py").alias("piece"), "moves"))
    crossing = F.filter(F.array(*[F.when(F.col("moves").bitwiseAND(F.lit(1 << i)) != 0, F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))) for i, (dx, dy) in enumerate(MOVES)]), lambda n: n.isNotNull() & ((F.floor(n["x"] / SIDE) != _tile("x")) | (F.floor(n["y"] / SIDE) != _tile("y"))))
    out = found.select("area", F.col("piece").alias("a"), F.explode(crossing).alias("n")).select("area", "a", "n.x", "n.y")
    edges = out.join(found.select("area", "x", "y", F.col("piece").alias("b")), ["area", "x", "y"]).select("a", "b")
    whole = connected(edges).select(F.col("id").alias("piece"), "component")
    return found.join(whole, "piece", "left").select("area", "x", "y", F.coalesce("component", "piece").alias("component"))


def _cut(d: int, at: int) -> slice:
    return slice(max(0, at * d), SIDE + min(0, at * d))


#: For each move the cells of a tile that it leaves from, and those that it comes to, inside the tile.
_SLICES = [((_cut(dx, -1), _cut(dy, -1)), (_cut(dx, 1), _cut(dy, 1))) for dx, dy in MOVES]


def settle(moves: np.ndarray, straight: np.ndarray, diagonal: np.ndarray, ahead: np.ndarray, limit: float) -> None:
    """Shortest ways inside tiles (n, side, side), in place: counts of steps, beside what lies ahead at least."""
    length = straight + diagonal * sqrt(2)
    changed = True
    while changed:
        changed = False
        for i, (here, there) in enumerate(_SLICES):
            here, there = (slice(None), *here), (slice(None), *there)
            a, b = straight[here] + (i < 4), diagonal[here] + (i >= 4)
            way = a + b * sqrt(2)
            better = ((moves[here] >> i) & 1 == 1) & (way < length[there]) & (way + ahead[there] <= limit)
            if better.any():
                changed = True
                straight[there], diagonal[there], length[there] = (np.where(better, new, old) for new, old in ((a, straight[there]), (b, diagonal[there]), (way, length[there])))


def _settled(limit: float, area_type: pa.DataType):
    """Tiles with news to their new state (told null) and to what they tell other tiles (state null)."""
    cells = np.arange(SIDE)

    def chunk(rows: dict[str, list]) -> dict[str, list]:
        n = len(rows["area"])
        tx, ty = np.array(rows["tx"]), np.array(rows["ty"])
        box = np.array([[*b.values()] for b in rows["goals"]])
        x, y = tx[:, None] * SIDE + cells, ty[:, None] * SIDE + cells
        out_x, out_y = (np.maximum(0, np.maximum(box[:, k, None] - v, v - box[:, k + 1, None])) for k, v in ((0, x), (2, y)))
        ahead = np.hypot(out_x[:, :, None], out_y[:, None, :])
        moves = np.stack([np.frombuffer(m, np.uint8).reshape(SIDE, SIDE) for m in rows["moves"]])
        state = np.stack([np.full((2, SIDE, SIDE), _FAR) if s is None else np.frombuffer(s, np.uint16).reshape(2, SIDE, SIDE).astype(int) for s in rows["state"]])
        old = state[:, 0] + state[:, 1] * sqrt(2)
        for i, seeds in enumerate(rows["seeds"]):
            for seed in seeds:
                at, now = (i, slice(None), seed["x"] % SIDE, seed["y"] % SIDE), np.array([seed["way"]["straight"], seed["way"]["diagonal"]])
                if now @ (1, sqrt(2)) < state[at] @ (1, sqrt(2)):
                    state[at] = now
        straight, diagonal = state[:, 0].copy(), state[:, 1].copy()
        settle(moves, straight, diagonal, ahead, limit)
        better = straight + diagonal * sqrt(2) < old
        out: dict[str, list] = {k: [] for k in ("area", "sx", "sy", "tx", "ty", "x", "y", "straight", "diagonal", "state")}

        def add(i: np.ndarray, tiles, at, ways, states) -> None:
            for k in ("area", "sx", "sy"):
                out[k] += [rows[k][j] for j in i]
            for k, v in zip(("tx", "ty", "x", "y", "straight", "diagonal", "state"), (*tiles, *at, *ways, states)):
                out[k] += list(v)

        none = [None] * n
        add(np.arange(n), (tx.tolist(), ty.tolist()), (none, none), (none, none), [np.stack(s).astype(np.uint16).tobytes() for s in zip(straight, diagonal)])
        for k, (dx, dy) in enumerate(MOVES):
            i, cx, cy = np.nonzero(better & ((moves >> k) & 1 == 1))
            to_x, to_y = cx + dx, cy + dy
            leaves = (to_x < 0) | (to_x >= SIDE) | (to_y < 0) | (to_y >= SIDE)
            i, cx, cy, to_x, to_y = (v[leaves] for v in (i, cx, cy, to_x, to_y))
            wx, wy = to_x + tx[i] * SIDE, to_y + ty[i] * SIDE
            a, b = straight[i, cx, cy] + (k < 4), diagonal[i, cx, cy] + (k >= 4)
            rest = np.hypot(*(np.maximum(0, np.maximum(box[i, j] - v, v - box[i, j + 1])) for j, v in ((0, wx), (2, wy))))
            near = a + b * sqrt(2) + rest <= limit
            i, wx, wy, a, b = (v[near] for v in (i, wx, wy, a, b))
            add(i, ((wx // SIDE).tolist(), (wy // SIDE).tolist()), (wx.tolist(), wy.tolist()), (a.tolist(), b.tolist()), [None] * len(i))
        return out

    names = ("area", "sx", "sy", "goals", "tx", "ty", "moves", "state", "seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                out = chunk({k: part.column(k).to_pylist() for k in names})
                kinds = {"area": area_type, "state": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def _searched(grid: np.ndarray, spots: np.ndarray, goals: np.ndarray, of: np.ndarray, limit: float) -> np.ndarray:
    """(goals, 2) steps from spots (n, 2) to goals (m, 2), the goals of spot ``of`` in its order, over moves with a free rim; ``_FAR`` where none.

    Cells that became nearer tell their neighbours, for all spots at once; a
    cell that no goal can gain by is not gone on with.
    """
    wide, n = grid.shape[1], len(spots)
    moves, at = grid.ravel(), (lambda p: p[:, 0] * wide + p[:, 1])
    first = np.searchsorted(of, np.arange(n))
    low, high = np.minimum.reduceat(goals, first), np.maximum.reduceat(goals, first)
    steps = np.full((2, n, moves.size), _FAR, np.int32)
    length, waits = np.full((n, moves.size), np.inf), np.zeros((n, moves.size), bool)
    bound, s, c = np.full(n, limit), np.arange(n), at(spots)
    steps[:, s, c], length[s, c] = 0, 0.0
    while s.size:
        now, open_, told = steps[:, s, c], moves[c], []
        for i, (dx, dy) in enumerate(MOVES):
            ok = (open_ >> i) & 1 == 1
            t, to = s[ok], c[ok] + dx * wide + dy
            a, b = now[0, ok] + (i < 4), now[1, ok] + (i >= 4)
            way = a + b * sqrt(2)
            out = [np.maximum(0, np.maximum(low[t, k] - v, v - high[t, k])) for k, v in enumerate(np.divmod(to, wide))]
            ahead = np.maximum(*out) + (sqrt(2) - 1) * np.minimum(*out)
            nearer = (way < length[t, to]) & (way + ahead <= bound[t])
            t, to = t[nearer], to[nearer]
            steps[0, t, to], steps[1, t, to], length[t, to] = a[nearer], b[nearer], way[nearer]
            new = ~waits[t, to]
            waits[t, to] = True
            told.append((t[new], to[new]))
        s, c = (np.concatenate(v) for v in zip(*told))
        waits[s, c] = False
        bound = np.minimum(limit, np.maximum.reduceat(length[of, at(goals)], first) + 1e-9)
    return steps[:, of, at(goals)].T


def _near_ways(tiles: DataFrame, ends: DataFrame, limit: float, around: int, kind: str) -> DataFrame:
    """``ends`` with the steps of ways that reach their goal, where no way leaves the ``around`` tiles on each side of its start's."""
    side = range(-around, around + 1)
    own = ["area", "tx", "ty"]
    given = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in side for dy in side])).alias("d")
    held = tiles.select("*", given).select("area", (F.col("tx") - F.col("d.dx")).alias("tx"), (F.col("ty") - F.col("d.dy")).alias("ty"), F.struct("d.dx", "d.dy", "moves").alias("tile")).groupBy(*own).agg(F.collect_list("tile").alias("tiles"))
    asked = ends.withColumns({"tx": F.floor(F.col("sx") / SIDE), "ty": F.floor(F.col("sy") / SIDE), "part": F.floor(F.col("sx") / COLUMNS)})
    asked = asked.groupBy(*own, "part").agg(F.sort_array(F.collect_list(F.struct("sx", "sy", "gx", "gy"))).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for area, tx, ty, tiles, pairs in zip(*(batch.column(c).to_pylist() for c in ("area", "tx", "ty", "tiles", "ends"))):
                grid = np.zeros(((2 * around + 1) * SIDE + 2,) * 2, np.uint8)
                for t in tiles:
                    x, y = ((t[d] + around) * SIDE + 1 for d in ("dx", "dy"))
                    grid[x : x + SIDE, y : y + SIDE] = np.frombuffer(t["moves"], np.uint8).reshape(SIDE, SIDE)
                places = np.array([[p[c] for c in ("sx", "sy", "gx", "gy")] for p in pairs])
                corner = np.array([tx - around, ty - around]) * SIDE - 1
                spots, of = np.unique(places[:, :2], axis=0, return_inverse=True)
                of, found = of.ravel(), []
                for start in range(0, len(spots), TOGETHER):
                    mine = (of >= start) & (of < start + TOGETHER)
                    found.append(_searched(grid, spots[start : start + TOGETHER] - corner, places[mine, 2:] - corner, of[mine] - start, limit))
                steps = np.concatenate(found).astype(np.int64)
                there = steps[:, 0] < _FAR
                out = np.column_stack([places, steps])[there]
                yield pa.RecordBatch.from_arrays([pa.array([area] * len(out), batch.column("area").type), *(pa.array(v) for v in out.T)], names=["area", "sx", "sy", "gx", "gy", "straight", "diagonal"])

    return asked.join(held, own).select(*own, "tiles", "ends").mapInArrow(run, f"area {kind}, sx long, sy long, gx long, gy long, straight long, diagonal long")


def _far_ways(moves: DataFrame, ends: DataFrame, limit: float, kind: str) -> DataFrame:
    """``ends`` with the steps of their ways, in rounds over tiles."""
    spark = moves.sparkSession
    piece = components(moves.filter("moves <> 0"))
    at = lambda x, y: piece.select("area", F.col("x").alias(x), F.col("y").alias(y), F.col("component").alias(f"of_{x}"))
    ends = written(ends.join(at("sx", "sy"), ["area", "sx", "sy"]).join(at("gx", "gy"), ["area", "gx", "gy"]).filter("of_sx = of_gx").select("area", "sx", "sy", "gx", "gy"))
    starts = written(ends.groupBy("area", "sx", "sy").agg(F.struct(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1")).alias("goals")))
    tiles = written(tiled(moves))
    own, of = ["area", "sx", "sy"], ["area", "sx", "sy", "tx", "ty"]
    told = starts.select(*own, F.floor(F.col("sx") / SIDE).alias("tx"), F.floor(F.col("sy") / SIDE).alias("ty"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(0).cast("long").alias("straight"), F.lit(0).cast("long").alias("diagonal"))
    state, rounds = spark.createDataFrame([], f"area {kind}, sx long, sy long, tx long, ty long, state binary, round int"), 0
    last = lambda: state.groupBy(*of).agg(F.max_by("state", "round").alias("state"))
    schema = f"area {kind}, sx long, sy long, tx long, ty long, x long, y long, straight long, diagonal long, state binary"
    area_type = to_arrow_type(moves.schema["area"].dataType)
    while not told.isEmpty():
        way = F.struct((F.col("straight") + F.col("diagonal") * sqrt(2)).alias("steps"), "straight", "diagonal")
        seeds = told.groupBy(*of, "x", "y").agg(F.min(way).alias("way")).groupBy(*of).agg(F.collect_list(F.struct("x", "y", "way")).alias("seeds"))  # cells of a tile's border at most
        news = seeds.join(starts, own).join(last(), of, "left").join(tiles, ["area", "tx", "ty"])
        out = written(news.select(*own, "goals", "tx", "ty", "moves", "state", "seeds").mapInArrow(_settled(limit, area_type), schema))
        state, rounds = state.unionByName(out.filter("state IS NOT NULL").select(*of, "state", F.lit(rounds).alias("round"))), rounds + 1
        told = out.filter("state IS NULL").drop("state")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(s, np.uint16).reshape(2, SIDE, SIDE)[:, x % SIDE, y % SIDE] for s, x, y in zip(*(batch.column(c).to_pylist() for c in ("state", "gx", "gy")))]
            found = np.array(got, np.int64).reshape(-1, 2)
            gone = found[:, 0] >= _FAR
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("area", "sx", "sy", "gx", "gy")), *(pa.array(found[:, k], mask=gone) for k in (0, 1))], names=["area", "sx", "sy", "gx", "gy", "straight", "diagonal"])

    return ends.withColumns({"tx": F.floor(F.col("gx") / SIDE), "ty": F.floor(F.col("gy") / SIDE)}).join(last(), of).select(*own, "gx", "gy", "state").mapInArrow(read, f"area {kind}, sx long, sy long, gx long, gy long, straight long, diagonal long")


def shortest_ways(cells: DataFrame, pairs: DataFrame, cell_m: float, max_m: float) -> DataFrame:
    """``pairs`` (area, sx, sy, gx, gy, ...) with ``straight`` and ``diagonal`` steps and ``metres`` of the shortest way over ``cells`` (area, x, y).

    They are null where an end can't be passed, no way joins the ends, or the
    shortest is longer than ``max_m``; rows with a null among the five stay with
    nulls. Repeated cells and pairs are no harm.
    """
    limit = max_m / cell_m + 1e-9
    if limit >= _FAR:
        raise ValueError("the cut-off spans too many cells")
    kind = dict(cells.dtypes)["area"]
    place = lambda x, y: [F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")]
    moves = written(passable_moves(cells.select("area", *place("x", "y")).dropna().distinct()))
    ends = pairs.select("area", *[F.col(c).cast("long").alias(c) for c in ("sx", "sy", "gx", "gy")]).dropna().distinct()
    still = ends.filter("sx = gx AND sy = gy").join(moves.select("area", F.col("x").alias("sx"), F.col("y").alias("sy")), ["area", "sx", "sy"], "left_semi")
    # no way is shorter than the one over open cells
    dx, dy = F.abs(F.col("gx") - F.col("sx")), F.abs(F.col("gy") - F.col("sy"))
    ends = ends.filter("NOT (sx = gx AND sy = gy)").filter(F.greatest(dx, dy) + (sqrt(2) - 1) * F.least(dx, dy) <= limit)
    own, around = ["area", "sx", "sy"], -(-int(limit) // SIDE)
    reached = _near_ways(tiled(moves), ends, limit, around, kind) if around <= AROUND else _far_ways(moves, ends, limit, kind)
    zero = F.lit(0).cast("long")
    known = reached.unionByName(still.select(*own, "gx", "gy", zero.alias("straight"), zero.alias("diagonal")))
    metres = ((F.col("straight") + F.col("diagonal") * sqrt(2)) * cell_m).alias("metres")
    return pairs.join(known, [*own, "gx", "gy"], "left").select(*pairs.columns, "straight", "diagonal", metres)
