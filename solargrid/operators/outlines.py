"""Outlines: the rings around components of pixels, and the union of polygons that touch.

Both cancel what two neighbours share, name the edge that follows each remaining one, and string edges together:

* A tile's pixels, with those of the tiles around it that touch it, give the boundary edges inside the tile, and each edge's
  successor follows from three neighbours alone. Edges are strung together within the tile, so only pieces that leave it take
  part in the join over tiles.
* Polygons' edges are split where a vertex of a neighbour lies on them; an edge that stands there in both directions is
  inside the union and goes.

The inside lies to the left: outer rings run counter-clockwise (x to the right, y up) and holes clockwise. Where two corners
meet in a point the outline turns left, so rings touch but never cross. A ring is put in order by one task, since it is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.functions import shapes
from solargrid.operators import spatial as S
from solargrid.operators.components import cut_lineage
from solargrid.operators.pixels import SIDE, TILE

#: Sides of a pixel in the order of its outline: bottom, right, top, left; the neighbour there, and the side's first corner.
NEIGHBOUR = ((0, -1), (1, 0), (0, 1), (-1, 0))
CORNER = ((0, 0), (1, 0), (1, 1), (0, 1))
#: Pixels are numbered from here, so that those left of or below the origin have a positive number too.
SHIFT = 1 << 28


def _side_ids(x: np.ndarray, y: np.ndarray, side: np.ndarray) -> np.ndarray:
    return (((y + SHIFT) << 30) + x + SHIFT) * 4 + side


def tile_outline(f: pd.DataFrame) -> pd.DataFrame:
    """Pieces of outline in one tile. f: x, y, component and own (else the pixel lies in another tile)."""
    x, y = f["x"].to_numpy(), f["y"].to_numpy()
    x0, y0 = x.min() - 2, y.min() - 2
    there = np.zeros((y.max() - y0 + 3, x.max() - x0 + 3), dtype=bool)
    there[y - y0, x - x0] = True
    own = np.zeros(there.shape, dtype=bool)
    component = np.zeros(there.shape, dtype=np.int64)
    mine = f["own"].to_numpy()
    own[y[mine] - y0, x[mine] - x0] = True
    component[y[mine] - y0, x[mine] - x0] = f["component"].to_numpy()[mine]
    moved = lambda side: np.roll(there, (-NEIGHBOUR[side][1], -NEIGHBOUR[side][0]), axis=(0, 1))
    open_ = [there & ~moved(side) for side in range(4)]
    edges: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    for side in range(4):
        after, before = (side + 1) % 4, (side - 1) % 4
        py, px = np.nonzero(open_[side] & own)
        qx, qy = px + NEIGHBOUR[after][0], py + NEIGHBOUR[after][1]
        sx, sy = qx + NEIGHBOUR[side][0], qy + NEIGHBOUR[side][1]
        turn, straight = open_[after][py, px], open_[side][qy, qx]
        nx, ny = np.where(turn, px, np.where(straight, qx, sx)), np.where(turn, py, np.where(straight, qy, sy))
        ns = np.where(turn, after, np.where(straight, side, before))
        edges.update(zip(zip(px.tolist(), py.tolist(), [side] * len(px), strict=True), zip(nx.tolist(), ny.tolist(), ns.tolist(), strict=True), strict=True))
    heads = edges.keys() - set(edges.values())
    rows = []

    def string(first: tuple[int, int, int]) -> None:
        xs, ys, at, last = [], [], first, None
        while at in edges:
            if at[2] != last:
                xs.append(at[0] + CORNER[at[2]][0] + x0)
                ys.append(at[1] + CORNER[at[2]][1] + y0)
            last, at = at[2], edges.pop(at)
        rows.append((component[first[1], first[0]], *first, *at, xs, ys))

    for head in sorted(heads):
        string(head)
    while edges:
        string(min(edges))
    out = pd.DataFrame(rows, columns=["key", "x", "y", "side", "nx", "ny", "nside", "xs", "ys"])
    ids = [_side_ids(out[a].to_numpy(np.int64) + x0, out[b].to_numpy(np.int64) + y0, out[c].to_numpy(np.int64)) for a, b, c in (("x", "y", "side"), ("nx", "ny", "nside"))]
    return pd.DataFrame({"key": out["key"].astype("int64"), "id": ids[0], "next": ids[1], "xs": out["xs"], "ys": out["ys"]})


PIECES = "key long, id long, next long, xs array<double>, ys array<double>"


def pixel_pieces(mask: DataFrame, alone: bool = False) -> DataFrame:
    """Pieces of the outlines of a mask (component, ix, iy, r, c); with alone, each tile is outlined as if it were the only one."""
    m = mask.select("component", *TILE, (F.col("ix") * SIDE + F.col("c")).alias("x"), (F.col("iy") * SIDE + F.col("r")).alias("y"), F.lit(True).alias("own"))
    if not alone:
        near = lambda k: F.sequence(F.floor((F.col(k) - 1) / SIDE), F.floor((F.col(k) + 1) / SIDE))
        edge = m.where((F.col("x") % SIDE).isin(0, SIDE - 1) | (F.col("y") % SIDE).isin(0, SIDE - 1))
        other = edge.select("component", "x", "y", F.explode(near("x")).alias("tx"), "ix", "iy").withColumn("ty", F.explode(near("y"))).where("tx <> ix OR ty <> iy")
        m = m.unionByName(other.select("component", F.col("tx").cast("int").alias("ix"), F.col("ty").cast("int").alias("iy"), "x", "y", F.lit(False).alias("own")))
    return m.groupBy(*TILE).applyInPandas(lambda f: tile_outline(f), PIECES)


def ring_of(ids: list, nexts: list, xs: list, ys: list) -> tuple[list, list, float]:
    """x and y of the pieces of one ring in order, without points on a straight line, and twice the signed area."""
    if len(ids) > 1:
        follow = {k: i for i, k in enumerate(ids)}
        at, order = follow[min(ids)], []
        for _ in ids:
            order.append(at)
            at = follow.get(nexts[at])
            if at is None:  # the ring does not close: its polygons overlap
                break
        x, y = (np.array([v for i in order for v in c[i]], dtype=np.float64) for c in (xs, ys))
    else:
        x, y = np.array(xs[0], dtype=np.float64), np.array(ys[0], dtype=np.float64)
    ux, uy = x - x.take(range(-1, len(x) - 1)), y - y.take(range(-1, len(y) - 1))
    vx, vy = np.append(ux[1:], ux[:1]), np.append(uy[1:], uy[:1])
    bend = np.abs(ux * vy - uy * vx) > 1e-12 * np.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    x, y = x[bend], y[bend]
    if not len(x):
        return [], [], 0.0
    first = int(np.lexsort((y, x))[0])
    x, y = np.append(x[first:], x[:first]), np.append(y[first:], y[:first])
    ox, oy = x - x[0], y - y[0]
    return x.tolist(), y.tolist(), float((ox[:-1] * oy[1:] - ox[1:] * oy[:-1]).sum())


def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings of rows (key, id, next, xs, ys, ring) that come sorted by ring; one ring at a time is held."""
    ring, held = None, []

    def done() -> tuple:
        _, ids, nexts, xs, ys = (list(c) for c in zip(*held, strict=True))
        return (held[0][0], *ring_of(ids, nexts, xs, ys))

    for b in batches:
        out = []
        for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if held and row[5] != ring:
                out.append(done())
                held = []
            ring = row[5]
            held.append(row[:5])
        yield _ring_batch(out)
    if held:
        yield _ring_batch([done()])


RINGS = "key long, xs array<double>, ys array<double>, area2 double"


def _ring_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "xs", "ys", "area2"])


def ring_names(pieces: DataFrame) -> DataFrame:
    """id and ring (the smallest id) of pieces (id, next) that follow each other in rings.

    Each round doubles the stretch of the ring over which a piece knows the smallest id, so a ring of n pieces takes log2 n rounds.
    """
    step = cut_lineage(pieces.select("id", F.col("next").alias("to"), F.col("id").alias("ring")))
    while True:
        far = step.select(F.col("id").alias("to"), F.col("to").alias("farther"), F.col("ring").alias("other"))
        moved = (F.col("other") < F.col("ring")).alias("moved")
        after = cut_lineage(step.join(far, "to").select("id", F.col("farther").alias("to"), F.least("ring", "other").alias("ring"), moved))
        if after.where("moved").isEmpty():
            return after.select("id", "ring")
        step = after.drop("moved")


def strung(pieces: DataFrame) -> DataFrame:
    """key, xs, ys, area2 of the rings that pieces (key, id, next, xs, ys) make."""
    p = cut_lineage(pieces)
    open_ = p.where("id <> next")
    whole = p.where("id = next").withColumn("ring", F.col("id")).mapInArrow(ordered, RINGS)
    linked = open_.join(ring_names(open_), "id").select(*p.columns, "ring")
    strung_ = linked.repartition("ring").sortWithinPartitions("ring").mapInArrow(ordered, RINGS)
    return whole.unionByName(strung_).where("size(xs) > 2")


def polygons(rings: DataFrame, key: str, x0: float = 0.0, y0: float = 0.0, step: float = 1.0) -> DataFrame:
    """key and rings (outer ones first, then by their first point), with coordinates x0 + step x; one row for each key."""
    points = F.zip_with("xs", "ys", lambda x, y: F.struct((x0 + step * x).alias("x"), (y0 + step * y).alias("y")))
    r = rings.select("key", F.struct((F.col("area2") < 0).alias("hole"), points.alias("points")).alias("r"))
    return r.groupBy(F.col("key").alias(key)).agg(F.transform(F.array_sort(F.collect_list("r")), lambda s: s["points"]).alias("rings"))


def pixel_rings(mask: DataFrame) -> DataFrame:
    """key (the component), xs, ys and area2 of every ring of a mask (component, ix, iy, r, c), in pixels."""
    return strung(pixel_pieces(mask))


def _directed_edges(df: DataFrame) -> DataFrame:
    """Edges (key, ax, ay, bx, by) of polygons (key, rings), with the inside to the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = shapes.Edges(b.column(1))
            back = (e.areas() < 0)[e.row]
            ax, bx = np.where(back, e.bx, e.ax), np.where(back, e.ax, e.bx)
            ay, by = np.where(back, e.by, e.ay), np.where(back, e.ay, e.by)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(e.row)), *[pa.array(v) for v in (ax, ay, bx, by)]], ["key", "ax", "ay", "bx", "by"])

    return df.mapInArrow(run, "key long, ax double, ay double, bx double, by double")


def _split(edges: DataFrame, size: float) -> DataFrame:
    """Edges cut at the vertices of their own key that lie on them."""
    low, high = lambda a: F.least(f"a{a}", f"b{a}"), lambda a: F.greatest(f"a{a}", f"b{a}")
    boxed = edges.select(*[F.col(c).alias(f"r_{c}") for c in edges.columns], low("x").alias("r_xmin"), low("y").alias("r_ymin"), high("x").alias("r_xmax"), high("y").alias("r_ymax"))
    v = edges.select(F.col("key").alias("l_key"), F.col("ax").alias("l_xmin"), F.col("ay").alias("l_ymin"), F.col("ax").alias("l_xmax"), F.col("ay").alias("l_ymax")).distinct()
    ux, uy, px, py = F.expr("r_bx - r_ax"), F.expr("r_by - r_ay"), F.expr("l_xmin - r_ax"), F.expr("l_ymin - r_ay")
    along, length2 = ux * px + uy * py, ux * ux + uy * uy
    on = (F.col("l_key") == F.col("r_key")) & (F.abs(ux * py - uy * px) <= 1e-12 * length2) & (along > 0) & (along < length2)
    cuts = S.box_pairs(v, boxed, size, on).select(*[F.col(f"r_{c}").alias(c) for c in edges.columns], F.struct((along / length2).alias("t"), F.col("l_xmin").alias("x"), F.col("l_ymin").alias("y")).alias("cut"))
    cuts = cuts.groupBy(*edges.columns).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    ends = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"))), F.coalesce("cuts", F.expr("CAST(array() AS array<struct<t:double,x:double,y:double>>)")), F.array(F.struct(F.lit(1.0).alias("t"), F.col("bx").alias("x"), F.col("by").alias("y"))))
    cut = edges.join(cuts, edges.columns, "left").select("key", ends.alias("p")).select("key", F.explode(F.expr("transform(sequence(0, size(p) - 2), i -> struct(p[i] AS a, p[i + 1] AS b))")).alias("e"))
    return cut.select("key", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def dissolved(df: DataFrame, size: float = 0.01) -> DataFrame:
    """key, xs, ys and area2 of the rings around the union of each key's polygons (key long, rings), which may touch, not overlap.

    size is the side of the cells by which vertices meet the edges they lie on: about the length of an edge.
    """
    e = _split(cut_lineage(_directed_edges(df.select("key", "rings"))), size)
    forward = F.expr("ax < bx OR (ax = bx AND ay < by)")
    ends = {"px": F.when(forward, F.col("ax")).otherwise(F.col("bx")), "py": F.when(forward, F.col("ay")).otherwise(F.col("by")), "qx": F.when(forward, F.col("bx")).otherwise(F.col("ax")), "qy": F.when(forward, F.col("by")).otherwise(F.col("ay"))}
    left = e.select("key", *[c.alias(n) for n, c in ends.items()], F.when(forward, 1).otherwise(-1).alias("way")).groupBy("key", *ends).agg(F.sum("way").alias("way")).where("way <> 0")
    pick = lambda a, b: F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b))
    e = left.select("key", pick("px", "qx").alias("ax"), pick("py", "qy").alias("ay"), pick("qx", "px").alias("bx"), pick("qy", "py").alias("by"))
    e = cut_lineage(e.withColumn("id", F.xxhash64("key", "ax", "ay", "bx", "by")))
    out = e.select(F.col("key").alias("o_key"), F.col("ax").alias("bx"), F.col("ay").alias("by"), (F.col("bx") - F.col("ax")).alias("vx"), (F.col("by") - F.col("ay")).alias("vy"), F.col("id").alias("next"))
    met = e.join(out, (F.col("key") == F.col("o_key")) & (e["bx"] == out["bx"]) & (e["by"] == out["by"])).select("key", "id", "ax", "ay", e["bx"], e["by"], "vx", "vy", "next")
    # Of several edges that go on from a point, the outline takes the one furthest to the left.
    turn = F.expr("atan2((bx - ax) * vy - (by - ay) * vx, (bx - ax) * vx + (by - ay) * vy)")
    follow = met.groupBy("key", "id", "ax", "ay").agg(F.max_by("next", turn).alias("next"))
    return strung(follow.select("key", "id", "next", F.array("ax").alias("xs"), F.array("ay").alias("ys")))
