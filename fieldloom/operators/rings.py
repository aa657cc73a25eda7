"""Sums of point values by rings around balls, without a row for each pair.

Points and balls meet by grid cells, as in ``spatial.ball_join``. A cell's points are cut into small boxes; a box that lies within one ring of a ball
adds its totals, and only the points of the boxes that an edge crosses are measured, as a matrix of squared distances. A ball's rings hold just the
points that ``r = d / unit`` puts there: each edge becomes the least squared distance whose r is beyond it. The work is still that of all pairs near an edge,
but a cell returns a row per ball and ring, so what is shuffled grows with points and balls, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOX_SIZE
from .spatial import CENTRE, POINT, expand_balls, point_cell

#: Cells along one side of the box, points that a small box holds in the mean, balls measured at a time, and balls that go through the boxes together.
CELLS, BOX_POINTS, BALLS, CHUNK = 10, 160, 1024, 8192


def least_square(unit: np.ndarray, edge: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """The least q for which sqrt(q) / unit is at least ``edge``, or above it where ``beyond`` is set."""
    past = lambda q: np.where(beyond, np.sqrt(q) / unit > edge, np.sqrt(q) / unit >= edge)
    guess = np.square(np.maximum(edge, 0.0) * unit)
    low, high = (guess * (1 - 1e-12)).view(np.int64), (guess * (1 + 1e-12) + 5e-324).view(np.int64)  # doubles of one sign order as their bits do
    while (high - low > 1).any():
        middle = low + (high - low) // 2
        hit = past(middle.view(np.float64))
        low, high = np.where(hit, low, middle), np.where(hit, middle, high)
    out = np.where(past(low.view(np.float64)), low, high).view(np.float64)
    return np.where(past(np.zeros_like(guess)), 0.0, out)


def thresholds(unit: np.ndarray, radius: np.ndarray, edges: Sequence[float], side: str) -> np.ndarray:
    """(balls, edges): squared distances at which the rings begin, none beyond the ball; as ``functions.bins`` takes the edges."""
    e = np.asarray(edges, dtype=float)
    beyond = np.full(len(e), side == "right")
    if side == "hist":
        beyond[-1] = True
    (units, of), k = np.unique(unit, return_inverse=True), len(e)
    table = least_square(np.repeat(units, k).astype(float), np.tile(e, len(units)), np.tile(beyond, len(units))).reshape(-1, k)
    reaches, at = np.unique(radius, return_inverse=True)
    top = least_square(np.ones(len(reaches)), reaches.astype(float), np.ones(len(reaches), dtype=bool))
    return np.minimum(table[of], top[at][:, None])


def small_boxes(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, cuts, places, sides): points ordered by the small boxes of a grid, where each box that holds some begins and ends, its place on the
    three axes, and the (axis, m + 1) sides of the grid."""
    m = int(np.clip(round((len(xyz) / BOX_POINTS) ** (1 / 3)), 1, 64))
    low, span = xyz.min(axis=0), np.maximum(np.ptp(xyz, axis=0), 1e-300)
    place = np.minimum(((xyz - low) / span * m).astype(np.int64), m - 1)
    box = (place[:, 0] * m + place[:, 1]) * m + place[:, 2]
    order = np.argsort(box, kind="stable")
    box = box[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(box)) + 1, [len(box)]])
    return order, cuts, place[order[cuts[:-1]]], low[:, None] + span[:, None] * np.arange(m + 1) / m


def squared(centre: np.ndarray, points: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Squared distances (centre, point), summed in the order of ``geometry.norm3``; ``room`` is two rows of scratch space, the first for the result."""
    shape, n = (len(centre), len(points)), len(centre) * len(points)
    q, d = (x[:n].reshape(shape) for x in room) if room is not None and n <= room.shape[1] else (np.empty(shape), np.empty(shape))
    c, p = np.ascontiguousarray(centre.T)[:, :, None], np.ascontiguousarray(points.T)
    np.subtract(c[0], p[0], out=q)
    np.multiply(q, q, out=q)
    for a in (1, 2):
        np.subtract(c[a], p[a], out=d)
        np.multiply(d, d, out=d)
        np.add(q, d, out=q)
    return q


def near_far(centre: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(axis, place, ball): parts of bounds below and above the squared distances from each centre; those of a box are the sums of its three."""
    low, high = sides[:, :-1, None] - centre.T[:, None, :], centre.T[:, None, :] - sides[:, 1:, None]
    near = np.square(np.maximum(np.maximum(low, high), 0.0)) * (1 - 1e-9) - 1e-9
    far = np.square(np.maximum(np.abs(low), np.abs(high))) * (1 + 1e-9) + 1e-9
    return near, far


def met_boxes(bounds: np.ndarray, places: np.ndarray, near: np.ndarray, far: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, balls, first ring, last ring, near, far) for each box and the balls it may reach into; ``cut`` is (edge, ball)."""
    count = lambda q, edges: np.add.reduce(edges <= q, axis=0, dtype=np.int8)
    for i, j, (x, y, z) in zip(bounds[:-1].tolist(), bounds[1:].tolist(), places.tolist()):
        if not i or (x, y) != column:
            column, flat = (x, y), near[0, x] + near[1, y]
            balls = np.flatnonzero(flat < cut[-1])
            low, high, edges, heights = flat[balls], (far[0, x] + far[1, y])[balls], cut[:, balls], (near[2][:, balls], far[2][:, balls])
        if len(balls):
            q0, q1 = low + heights[0][z], high + heights[1][z]
            met = np.flatnonzero(q0 < edges[-1])
            if len(met):
                part, q0, q1 = edges[:, met], q0[met], q1[met]
                yield i, j, balls[met], count(q0, part).astype(np.int64), count(q1, part).astype(np.int64), q0, q1


def ring_sums(xyz: np.ndarray, weights: np.ndarray, centre: np.ndarray, cut: np.ndarray, ends: Ends | None = None) -> np.ndarray:
    """(ball, ring, weight): sums over the points of ring k, those at cut[:, k - 1] or beyond and below cut[:, k]. ``ends`` is given the points as well."""
    k_all = cut.shape[1]
    out = np.zeros((len(centre), k_all + 1, weights.shape[1]))
    order, bounds, places, sides = small_boxes(xyz)
    xyz, weights = xyz[order], weights[order]
    for start in range(0, len(centre), CHUNK):
        here = slice(start, start + CHUNK)
        _chunk_sums(xyz, weights, centre[here], cut[here], out[here], (bounds, places, *near_far(centre[here], sides)), ends and ends.part(here, order))
    return out


def _chunk_sums(xyz: np.ndarray, weights: np.ndarray, centre: np.ndarray, cut: np.ndarray, out: np.ndarray, boxes: tuple, ends: Ends | None) -> None:
    edges, k_all, room = np.ascontiguousarray(cut.T), cut.shape[1], np.empty((2, BALLS * 2 * BOX_POINTS))
    for i, j, balls, first, last, _, _ in met_boxes(*boxes, edges):
        points, w = xyz[i:j], weights[i:j]
        whole = first == last
        out[balls[whole], first[whole]] += w.sum(axis=0)
        crossed = np.flatnonzero(~whole)
        for at in range(0, len(crossed), BALLS):
            some = crossed[at : at + BALLS]
            some = some[np.argsort(first[some] - last[some], kind="stable")]  # those crossed by most edges first
            rows, k0, end = balls[some], first[some], last[some]
            width, q = end - k0, squared(centre[rows], points, room)
            inner = None
            for step in range(int(width[0]) + 1):
                n = int(np.searchsorted(-width, -step, side="right"))
                k, rows, k0, end, width, q = k0[:n] + step, rows[:n], k0[:n], end[:n], width[:n], q[:n]
                edge = np.where(k < end, cut[rows, np.minimum(k, k_all - 1)], np.inf)
                below = q < edge[:, None]
                part = below > inner[:n] if step else below
                keep = k < k_all  # beyond the last edge nothing is summed
                if keep.all():
                    out[rows, k] += part.astype(np.float64) @ w
                    if ends:
                        ends.take(rows, k, part, q, i, j)
                elif keep.any():
                    out[rows[keep], k[keep]] += part[keep].astype(np.float64) @ w
                    if ends:
                        ends.take(rows[keep], k[keep], part[keep], q[keep], i, j)
                inner = below
    if ends:  # of the boxes that no edge crosses, those that may hold a nearer or a farther point
        for i, j, balls, first, last, near, far in met_boxes(*boxes, edges):
            use = np.flatnonzero((first == last) & ((near <= ends.near[balls, first]) | (far >= ends.far[balls, first])))
            for at in range(0, len(use), BALLS):
                rows = balls[use[at : at + BALLS]]
                q = squared(centre[rows], xyz[i:j], room)
                ends.take(rows, first[use[at : at + BALLS]], np.ones(q.shape, dtype=bool), q, i, j)


class Ends:
    """(ball, ring): r of the nearest point with its value (the least of equal ones), and of the farthest; infinities where the ring is empty.

    ``near`` and ``far`` are the squared distances at which a point would change them: most boxes are passed over by two comparisons.
    """

    def __init__(self, value: np.ndarray, unit: np.ndarray, rings: int) -> None:
        self.value, self.unit, shape = value, unit, (len(unit), rings)
        self.low, self.held, self.high = (np.full(shape, x) for x in (np.inf, np.inf, -np.inf))
        self.near, self.far = np.full(shape, np.inf), np.full(shape, -1.0)

    def part(self, balls: slice, order: np.ndarray) -> Ends:
        """Some of the balls, with the points in another order; what it finds is found here."""
        out = Ends.__new__(Ends)
        out.value, out.unit = self.value[order], self.unit[balls]
        for name in ("low", "held", "high", "near", "far"):
            setattr(out, name, getattr(self, name)[balls])
        return out

    def take(self, rows: np.ndarray, k: np.ndarray, part: np.ndarray, q: np.ndarray, i: int, j: int) -> None:
        """The points i..j at the squared distances ``q`` from the balls ``rows``; ``part`` says which of them are in the rings ``k``."""
        beyond = q <= self.near[rows, k][:, None]
        beyond |= q > self.far[rows, k][:, None]
        beyond &= part
        new = np.flatnonzero(beyond.any(axis=1))
        if not len(new):
            return
        rows, k = rows[new], k[new]
        r0, v, r1, least, most = _measure(part[new], q[new], self.value[i:j], self.unit[rows])
        nearer = (r0 < self.low[rows, k]) | ((r0 == self.low[rows, k]) & (v < self.held[rows, k]))
        self.low[rows[nearer], k[nearer]], self.held[rows[nearer], k[nearer]] = r0[nearer], v[nearer]
        self.high[rows, k] = np.maximum(self.high[rows, k], r1)
        # squares that may round to the least r are looked at
        self.near[rows, k] = np.minimum(self.near[rows, k], least * (1 + 1e-14))
        self.far[rows, k] = np.maximum(self.far[rows, k], most)


def _measure(part: np.ndarray, q: np.ndarray, value: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Least r of the points in ``part``, its value (the least among equal r) and the largest r, and the least and largest q; infinities where there is none."""
    inside = np.where(part, q, np.inf)
    at = inside.argmin(axis=1)
    least = np.take_along_axis(inside, at[:, None], axis=1)[:, 0]
    held = np.where(np.isfinite(least), value[at], np.inf)
    for i in np.flatnonzero((inside <= (least * (1 + 1e-14))[:, None]).sum(axis=1) > 1):  # squares that may round to one r
        if np.isfinite(least[i]):
            held[i] = value[part[i] & (np.sqrt(q[i]) / unit[i] == np.sqrt(least[i]) / unit[i])].min()
    most = np.where(part, q, -np.inf).max(axis=1)
    with np.errstate(invalid="ignore"):
        return np.sqrt(least) / unit, held, np.where(most >= 0, np.sqrt(most) / unit, -np.inf), least, most


def _split(value: np.ndarray, null: np.ndarray) -> list[np.ndarray]:
    """Finite part of a value, and counts of its NULLs, NaNs and infinities."""
    bad = null | ~np.isfinite(value)
    return [np.where(bad, 0.0, value), null * 1.0, (np.isnan(value) & ~null) * 1.0, (value == np.inf) * 1.0, (value == -np.inf) * 1.0]


def in_rings(
    points: DataFrame, balls: DataFrame, radius: Column, unit: str, edges: Sequence[float], side: str, by: str | None, keys: Sequence[str],
    values: dict[str, Column], max_radius: float, box: float = BOX_SIZE, cells: int = CELLS, ends: bool = False,
) -> DataFrame:
    """(keys, by, bin, n, values): counts and sums of the points by rings of ``edges`` in ``unit``, within ``radius`` of each ball.

    Point coordinates lie in [0, box). ``keys`` are columns of the balls, ``by`` one of the points. Balls of one key are summed up; rings without points have no row.
    With ``ends`` there are r_first, first and r_last too: r of the nearest point with its first value (the least of equal ones), and of the farthest.
    """
    n = F.lit(cells).cast("long")
    names = list(values)
    measured = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    left = measured.select(point_cell(POINT, n, box).alias("_cell"), *POINT, *([F.col(by)] if by else []), *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())])
    ok = F.col("_radius") <= F.lit(max_radius * (1 + 1e-9))
    sized = balls.withColumn("_radius", radius).withColumn("_unit", F.col(unit)).where((F.col("_radius") >= 0) & (F.col("_unit") > 0))
    sized = sized.withColumn("_radius", F.when(ok, F.col("_radius")).otherwise(F.raise_error(F.lit("ball radius above max_radius"))))
    sized = sized.select(*keys, *CENTRE, "_radius", "_unit")
    right = expand_balls(sized, F.col("_radius"), n, box).select("_cell", *keys, "_radius", "_unit", "_c0", "_c1", "_c2")
    kinds = dict(points.select(by).dtypes) if by else {}
    types = {**dict(balls.dtypes), **kinds}
    group = [*keys, *([by] if by else [])]
    shape = ", ".join([*(f"`{c}` {types[c]}" for c in group), "bin int", "n long", *(f"_v{i} double" for i in range(len(names))), *(["r_first double", "first double", "r_last double"] if ends else [])])
    n_rings = len(edges) - 1

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            number = lambda t, c: t.column(c).to_numpy()
            centre = np.column_stack([number(b, f"_c{k}") for k in range(3)])
            cut = thresholds(number(b, "_unit"), number(b, "_radius"), edges, side)
            code = a.column(by).combine_chunks().dictionary_encode(null_encoding="encode") if by else None
            of = code.indices.to_numpy(zero_copy_only=False) if by else np.zeros(a.num_rows, np.int32)
            xyz = np.column_stack([number(a, c) for c in POINT])
            parts = [_split(number(a, f"_v{i}").astype(float), a.column(f"_v{i}").combine_chunks().is_null().to_numpy(zero_copy_only=False)) for i in range(len(names))]
            odd = [any(x.any() for x in p[1:]) for p in parts]
            weights = np.column_stack([np.ones(a.num_rows), *(x for p, o in zip(parts, odd) for x in (p if o else p[:1]))])
            for g in np.unique(of):
                mine = (of == g) & np.isfinite(xyz).all(axis=1)
                if not mine.any():
                    continue
                found = None
                if ends:
                    missing = a.column("_v0").combine_chunks().is_null().to_numpy(zero_copy_only=False)
                    found = Ends(np.where(missing, -np.inf, number(a, "_v0").astype(float))[mine], number(b, "_unit"), cut.shape[1] + 1)  # NULLs come first
                sums = ring_sums(xyz[mine], weights[mine], centre, cut, found)[:, 1 : n_rings + 1]
                ball, ring = np.nonzero(sums[:, :, 0])
                s, at = sums[ball, ring], 1
                cols = [b.column(c).combine_chunks().take(pa.array(ball)) for c in keys]
                if by:
                    cols.append(code.dictionary.take(pa.array(np.full(len(ball), g))))
                cols += [pa.array(ring.astype(np.int32)), pa.array(s[:, 0].astype(np.int64))]
                for o in odd:
                    v, none = s[:, at], np.zeros(len(s), dtype=bool)
                    if o:
                        none = s[:, at + 1] == s[:, 0]
                        nan, up, down = (s[:, at + k] > 0 for k in (2, 3, 4))
                        v = np.where(nan | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, v)))
                    cols.append(pa.array(v, mask=none))
                    at += 5 if o else 1
                if found:
                    low, held, high = (x[:, 1 : n_rings + 1][ball, ring] for x in (found.low, found.held, found.high))
                    cols += [pa.array(low), pa.array(held, mask=held == -np.inf), pa.array(high)]
                out.append(pa.Table.from_arrays(cols, [*group, "bin", "n", *(f"_v{i}" for i in range(len(names))), *(["r_first", "first", "r_last"] if ends else [])]))
        return pa.concat_tables(out) if out else empty

    empty = points.sparkSession.createDataFrame([], shape).toArrow()
    found = left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(run, shape)
    sums = [F.sum("n").alias("n"), *[F.sum(f"_v{i}").alias(c) for i, c in enumerate(names)]]
    if ends:
        nearest = F.min(F.struct("r_first", "first"))
        sums += [nearest["r_first"].alias("r_first"), nearest["first"].alias("first"), F.max("r_last").alias("r_last")]
    return found.groupBy(*group, "bin").agg(*sums)
