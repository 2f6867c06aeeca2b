"""Operator 11: near duplicates among vectors by dual traversal of cover trees.

A tree has nested nets: net 0 keeps vectors at least RADII[0] apart (chords of the unit sphere), each further net halves
that and contains the net before; a node covers its descendants within a measured radius. Two nodes further apart than
both radii and the threshold's chord have no link between them; two nodes that lie within the chord in spite of both
radii link completely, and are counted without visiting their vectors. Only what is left is opened, down to the vectors,
whose cosines are computed in double precision. The links found are exactly those at or above the threshold.

The upper part of the tree comes from a bounded sample and is known everywhere: its nodes are cells, every vector goes
to its nearest one. Cells are compared first, then single vectors with cells, then blocks of at most BLOCK_ROWS vectors,
each with its own lower tree, in pairs.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut
from .components import components
from .vectors import binary_rows, matrix, part, rows_of, units, width

#: Separation of the nets, halving; rows of a block; rows that the upper tree is fitted on; most cells of each kind.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Nets of this separation or more are kept only where they halve the number of nodes.
WIDE = 1.0
BLOCK_ROWS, SAMPLE_ROWS, MOST_CELLS, MOST_DENSE = 8192, 4096, 1024, 256
#: Slack of bounds in double and in single precision.
SLACK, SLACK32 = 1e-9, 1e-5


def chord(cosine) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def nearest(points: np.ndarray, centres: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Of each point, the most similar centre and its cosine."""
    best, found = np.empty(len(points)), np.empty(len(points), np.int64)
    for i in range(0, len(points), step):
        s = points[i : i + step] @ centres.T
        found[i : i + step] = s.argmax(axis=1)
        best[i : i + step] = s[np.arange(len(s)), found[i : i + step]]
    return found, best


def net(points: np.ndarray, centres: list[int], radius: float, step: int = 512) -> list[int]:
    """``centres`` and further points, so that every point is within ``radius`` of one and the new ones are further apart."""
    least, out = 1 - radius * radius / 2, list(centres)
    for i in range(0, len(points), step):
        chunk = points[i : i + step]
        open_ = (chunk @ points[out].T).max(axis=1) < least if out else np.ones(len(chunk), bool)
        if not open_.any():
            continue
        left = np.flatnonzero(open_)
        near = chunk[left] @ chunk[left].T >= least
        open_ = np.ones(len(left), bool)
        for j in range(len(left)):
            if open_[j]:
                out.append(i + int(left[j]))
                open_ &= ~near[j]
    return out


@dataclass
class Level:
    """One net: the node of each point, and per node its centre (a point), covering radius, weight and number of points."""

    node: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    weight: np.ndarray
    size: np.ndarray


def build(points: np.ndarray, weight: np.ndarray) -> list[Level]:
    """Levels of the cover tree of unit vectors, the coarsest net first, the points themselves last."""
    nets, centres = [], []
    for radius in RADII:
        centres = net(points, centres, radius)
        if radius == WIDE / 2 and 2 * len(nets[-1]) > len(centres):
            nets.pop()  # a wide net that hardly joins anything: its balls would meet everywhere and decide nothing
        nets.append(np.array(centres))
        if len(centres) == len(points):
            break
    if len(nets[-1]) < len(points):  # the points that no net holds
        nets.append(np.concatenate([nets[-1], np.setdiff1d(np.arange(len(points)), nets[-1])]))
    order = np.empty(len(points), np.int64)
    order[nets[-1]] = np.arange(len(points))
    levels, node = [], order
    for k in range(len(nets) - 1, -1, -1):
        if k < len(nets) - 1:  # a centre of this net is its own parent, others go to the nearest
            n, below = len(nets[k]), len(nets[k + 1])
            parent = np.arange(below)
            parent[n:] = nearest(points[nets[k + 1][n:]], points[nets[k]])[0]
            node = parent[node]
        centre = nets[k]
        size = np.bincount(node, minlength=len(centre))
        away = chord(np.einsum("ij,ij->i", points, points[centre[node]]))
        away[size[node] == 1] = 0.0
        radius = np.zeros(len(centre))
        np.maximum.at(radius, node, away)
        levels.append(Level(node, centre, radius, np.bincount(node, weight, len(centre)), size))
    return levels[::-1]


def _children(upper: Level, lower: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of ``lower`` ordered by their parent, and each parent's first place and number."""
    parent = upper.node[lower.centre]
    order = np.argsort(parent, kind="stable")
    n = np.bincount(parent, minlength=len(upper.centre))
    return order, np.cumsum(n) - n, n


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component under the links a-b."""
    top = np.arange(n)
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return top
        np.minimum.at(top, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := top[top]).tobytes() != top.tobytes():
            top = up


def traverse(a: np.ndarray, a_levels: list[Level], b: np.ndarray, b_levels: list[Level], cosine: float, most: int = 4_000_000):
    """Linked weight of each point of ``a`` in ``b`` and the reverse, and each point's component (over a's and then b's points).

    With the same block twice, pass the same levels: each point then counts its own weight too. ``most`` bounds the components held at once.
    """
    same, limit = a_levels is b_levels, float(chord(np.float64(cosine)))
    step, slack32 = max(1000, most // a.shape[1]), max(SLACK32, 1.2e-7 * a.shape[1])
    depth = max(len(a_levels), len(b_levels))
    a_levels, b_levels = (x + [x[-1]] * (depth - len(x)) for x in (a_levels, b_levels))
    count_a, count_b, links = np.zeros(len(a)), np.zeros(len(b)), []
    shift = 0 if same else len(a)

    def settle(k: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node pairs of level ``k``: counts the complete ones, returns the undecided."""
        x, y = a_levels[k], b_levels[k]
        s = np.einsum("ij,ij->i", a[x.centre[p]], b[y.centre[q]])
        both = x.radius[p] + y.radius[q]
        d = chord(s)
        full = np.where(both == 0, s >= cosine, d + both <= limit - SLACK)
        if full.any():
            fp, fq = p[full], q[full]
            count_a[:] += np.bincount(fp, y.weight[fq], len(x.centre))[x.node]
            links.append((x.centre[fp], y.centre[fq] + shift))
            held = [(x, fp, 0)] if same else [(x, fp, 0), (y, fq, shift)]
            if not same:
                count_b[:] += np.bincount(fq, x.weight[fp], len(y.centre))[y.node]
            for level, at, by in held:
                hit = np.zeros(len(level.centre), bool)
                hit[at] = True
                points = np.flatnonzero(hit[level.node])
                links.append((points + by, level.centre[level.node[points]] + by))
        open_ = ~full & (both > 0) & (d <= both + limit + SLACK)
        return p[open_], q[open_]

    def descend(k: int, p: np.ndarray, q: np.ndarray) -> None:
        p, q = settle(k, p, q)
        if not len(p) or k + 1 == depth:
            return
        (ao, a0, an), (bo, b0, bn) = _children(a_levels[k], a_levels[k + 1]), _children(b_levels[k], b_levels[k + 1])
        n = an[p] * bn[q]
        for lo, hi in _runs(n, step):
            m = n[lo:hi]
            pair = np.repeat(np.arange(lo, hi), m)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
            descend(k + 1, ao[a0[p[pair]] + at // bn[q[pair]]], bo[b0[q[pair]] + at % bn[q[pair]]])

    # the coarsest nets meet whole, in single precision; nodes without radius have one bound for all
    x, y = a_levels[0], b_levels[0]
    for xs, ys in ((u, v) for u in _by_radius(x) for v in _by_radius(y)):
        left, right = a[x.centre[xs]].astype(np.float32), b[y.centre[ys]].astype(np.float32).T.copy()
        own, other = x.radius[xs].astype(np.float32), (y.radius[ys] + limit + SLACK).astype(np.float32)
        rows = max(1, most // 8 // max(1, len(ys)))
        plain = not own.any() and not y.radius[ys].any()
        for i in range(0, len(xs), rows):
            s = left[i : i + rows] @ right
            if plain:
                p, q = np.divmod(np.flatnonzero(s >= np.float32(cosine - slack32)), len(ys))
            else:
                least = own[i : i + rows, None] + other[None, :]
                least *= least
                least *= -0.5
                least += np.float32(1 - slack32)
                p, q = np.divmod(np.flatnonzero(s >= least), len(ys))
            p, q = xs[p + i], ys[q]
            for j in range(0, len(p), step):
                descend(0, p[j : j + step], q[j : j + step])
    n = len(a) if same else len(a) + len(b)
    ends = [np.concatenate(c) for c in zip(*links, strict=True)] if links else [np.zeros(0, np.int64)] * 2
    return count_a, count_b, roots(n, *ends)


def _by_radius(level: Level) -> list[np.ndarray]:
    """The nodes without and with a radius (those that there are)."""
    return [x for x in (np.flatnonzero(level.radius == 0), np.flatnonzero(level.radius > 0)) if len(x)]


def _runs(n: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose numbers sum up to about ``most`` (at least one each)."""
    group = np.cumsum(n) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def choose_cells(sample: np.ndarray, n_rows: int) -> np.ndarray:
    """Centres of the cells: the first nodes of the sample's tree, and its nodes that stand for many sampled vectors."""
    levels = build(sample, np.ones(len(sample)))
    wanted = int(min(MOST_CELLS, max(1, n_rows // BLOCK_ROWS)))
    chosen = levels[-1].centre[:wanted].tolist()
    for level in levels:
        dense = np.flatnonzero((level.size >= max(8, len(sample) // 256)) & (2 * level.radius <= 0.9))
        chosen += level.centre[dense[np.argsort(-level.size[dense], kind="stable")]][:MOST_DENSE].tolist()
    return sample[list(dict.fromkeys(chosen))]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Two rows link if the cosine of their vectors, in double precision, is at least ``cosine``; component_id is the least id reachable
    by links and kept marks the row that has it. Vectors that are null, zero, or hold null or non-finite components, and rows
    without an id, link with nothing (n_links 0; a row without an id has no component and is not kept). Vectors of
    different lengths are compared as if the shorter ended in zeros. Repeated rows, and rows that share an id, are rows of
    their own. Other columns are ignored; an empty table gives no rows.

    Equal vectors are one class with a weight, so copies are never paired. Node pairs, not vector pairs, carry what is dense. Vectors far from each other in
    many dimensions cannot be told apart by bounds: there, blocks of BLOCK_ROWS meet pairwise, and the work grows with the square of
    the distinct vectors.
    """
    dim = max(1, width(vectors, column))

    def encode(batches):
        for batch in batches:
            x, ok = matrix(batch.column("v"), dim)
            ok &= (x != 0).any(axis=1) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            blobs = binary_rows(units(np.where(ok[:, None], x, 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(ok), blobs], ["vec_id", "ok", "x"])

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    rows = cut(rows.mapInArrow(encode, "vec_id long, ok boolean, x binary").withColumn("row", F.monotonically_increasing_id()), "tree-rows")
    keyed = rows.filter("ok").select("row", "vec_id", F.unhex(F.md5("x")).alias("h"))
    classes = keyed.groupBy("h").agg(F.min("row").alias("c"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
    members = cut(keyed.join(classes, "h").select("row", "vec_id", "c", "low", "n"), "tree-members")
    heads = members.filter("row = c").select("c", "low", "n")
    base = cut(rows.select("row", "x").join(heads, F.col("row") == F.col("c")).select("c", "n", "x"), "tree-base")
    n_rows = base.count()
    links = _links(base, n_rows, dim, cosine)
    ties = components(links.select(F.col("c").alias("a"), F.col("root").alias("b")))
    lowest = ties.join(heads, F.col("id") == F.col("c")).groupBy("component").agg(F.min("low").alias("least"))
    ties = ties.join(lowest, "component").select(F.col("id").alias("c"), "least")
    counts = links.groupBy("c").agg(F.sum("w").alias("w"))
    found = members.join(counts, "c", "left").join(ties, "c", "left")
    found = found.select("row", (F.coalesce("w", F.lit(0.0)).cast("long") + F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    out = rows.select("row", "vec_id").join(found, "row", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(base: DataFrame, n_rows: int, dim: int, cosine: float) -> DataFrame:
    """c, w, root (written): weight of others linked with c found in one place, and a class of its component."""
    spark = base.sparkSession
    sample = bounded_sample(base.select("c", "x"), 41, SAMPLE_ROWS, "c").orderBy("c").collect()
    if not sample:
        return spark.createDataFrame([], "c long, w double, root long")
    centres = choose_cells(np.stack([np.frombuffer(r.x) for r in sample]), n_rows)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell, s = nearest(rows_of(batch.column("x"), float, dim), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(chord(s))], ["c", "n", "x", "cell", "away"])

    placed = cut(base.select("c", "n", "x").mapInArrow(assign, "c long, n long, x binary, cell int, away double"), "tree-cells")
    stats = placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("k"), F.sum("n").alias("w"), F.min("c").alias("c")).orderBy("cell").collect()
    cells = np.array([r.cell for r in stats])
    radius, weight, first = (np.array([r[x] for r in stats]) for x in ("r", "w", "c"))
    middle, limit = centres[cells], float(chord(np.float64(cosine)))
    apart, both = chord(middle @ middle.T), radius[:, None] + radius[None, :]
    np.fill_diagonal(apart, 0.0)
    # chords near 0 carry the square root of the rounding error, hence the wider slack here
    full = apart + both <= limit - 1e-6
    undecided = ~full & (apart <= both + limit + 1e-6)
    at = np.full(len(centres), -1)
    at[cells] = np.arange(len(cells))
    whole = (full * weight[None, :]).sum(axis=1)  # weight that every vector of a cell links with, itself included
    group = roots(len(cells), *np.nonzero(full))
    root = first[[min(np.flatnonzero(group == g), key=lambda j: first[j]) for g in group]]
    splits = np.array([-(-r.k // BLOCK_ROWS) for r in stats])

    def settle_cells(batches):
        for batch in batches:
            cell = at[batch.column("cell").to_numpy()]
            n, c = batch.column("n").to_numpy(), batch.column("c").to_numpy()
            w = whole[cell] - np.where(full[cell, cell], n, 0)
            hit = np.flatnonzero(w > 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(w[hit].astype(float)), pa.array(root[cell[hit]])], ["c", "w", "root"])

    def live(batches):
        """Vectors that may link with one of an undecided cell; their cell and its part as numbers below len(cells)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, x = at[batch.column("cell").to_numpy()], rows_of(batch.column("x"), float, dim)
            reach = chord(x @ middle.T) <= radius[None, :] + limit + 1e-6
            keep = np.flatnonzero((undecided[cell] & reach).any(axis=1))
            some = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column("c"), some.column("n"), some.column("x"), pa.array(cell[keep].astype(np.int32))], ["c", "n", "x", "cell"])

    parts = F.element_at(F.array(*[F.lit(int(k)) for k in splits]), F.col("cell") + 1) if len(splits) <= 64 else F.expr(f"element_at(from_json('{splits.tolist()}', 'array<int>'), cell + 1)")
    blocks = placed.select("c", "n", "x", "cell").mapInArrow(live, "c long, n long, x binary, cell int").withColumn("split", part("c", parts))

    def plant(table: pa.Table) -> pa.Table:
        x, n, c = rows_of(table["x"], float, dim), table["n"].to_numpy(), table["c"].to_numpy()
        blob = pickle.dumps((c, n, x, build(x, n)), protocol=5)
        return pa.table({"cell": table["cell"][:1], "split": table["split"][:1], "blob": pa.array([blob], pa.binary())})

    blocks = cut(blocks.groupBy("cell", "split").applyInArrow(plant, "cell int, split int, blob binary"), "tree-blocks")

    def partners(batches):
        """Each block for all pairs that it belongs to: (cell, split) of the smaller block, of the other, and its side."""
        for batch in batches:
            for cell, split in zip(batch.column("cell").to_pylist(), batch.column("split").to_pylist(), strict=True):
                own = (cell, split)
                others = [(j, s) for j in np.flatnonzero(undecided[cell]).tolist() for s in range(splits[j])]
                pairs = [(*min(own, o), *max(own, o)) for o in others]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int32()) for v in zip(*[(cell, split, *p) for p in pairs], strict=True)], ["cell", "split", "a", "i", "b", "j"])

    pairs = blocks.select("cell", "split").mapInArrow(partners, "cell int, split int, a int, i int, b int, j int").join(blocks, ["cell", "split"])
    one = pairs.filter("cell = a AND split = i").select("a", "i", "b", "j", F.col("blob").alias("left"))
    two = pairs.filter("cell = b AND split = j").select("a", "i", "b", "j", F.when(F.expr("a <> b OR i <> j"), F.col("blob")).alias("right"))

    def compare(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                c, n, x, levels = pickle.loads(left.as_buffer())
                if not right.is_valid:
                    w, _, top = traverse(x, levels, x, levels, cosine)
                    w = w - n
                else:
                    c2, n2, y, levels2 = pickle.loads(right.as_buffer())
                    w, w2, top = traverse(x, levels, y, levels2, cosine)
                    c, w = np.concatenate([c, c2]), np.concatenate([w, w2])
                hit = np.flatnonzero(w > 0)
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(w[hit]), pa.array(c[top[hit]])], ["c", "w", "root"])

    inner = one.join(two, ["a", "i", "b", "j"]).select("left", "right").mapInArrow(compare, "c long, w double, root long")
    return cut(placed.select("c", "n", "cell").mapInArrow(settle_cells, "c long, w double, root long").union(inner), "tree-links")
