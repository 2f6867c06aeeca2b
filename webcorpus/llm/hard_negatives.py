"""Operator 12: hard negatives by threshold joins over an inverted index of dimensions (in the manner of L2AP).

Scores are integer inner products. Dimensions are ordered by their energy over all rows. A block of rows is indexed
dimension by dimension, in strips of STRIP dimensions; from the strip on where the norm of what is left of a row, times
the longest such rest of an anchor, stays under the lowest threshold asked for, the row is not indexed. Partial scores are
accumulated strip by strip, rows whose remaining norm cannot lift any anchor over its threshold are dropped, and only
pairs that can still reach it are completed. A task keeps the best rows of each window: once there are enough of them, the
last one's score is the threshold. Before, thresholds start high and are lowered for those windows that are not yet full,
down to the window's own lower end; so what is left out is never wanted.

Anchors are a stated query set. They are taken in rounds of bounded size: a round's anchors are sent to all executors, each
task reads its rows once for the positives and once for the negatives, and gives at most the rows that the windows take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ragged_take, shared_path
from .vectors import binary_rows, matrix, part, rows_of, width

#: Rows of a block, anchors of a round, dimensions of a strip, anchors and rows accumulated at once.
BLOCK_ROWS, BLOCK_ANCHORS, STRIP, ANCHORS_AT_ONCE, ROWS_AT_ONCE = 8192, 16384, 8, 256, 2048
#: A round has fewer anchors if their components would be larger than this.
ROUND_BYTES = 16 << 20
#: A round's rows are read by at most so many tasks a core, or LEAST_TASKS; each gives the windows' best rows once.
TASKS_PER_CORE, LEAST_TASKS = 2, 24
#: Thresholds as shares of the highest score that norms and the window's upper end allow.
LEVELS = (0.6, 0.4, 0.25, 0.15)
NO_SCORE, ANY_SCORE = -(1 << 62), 1 << 62
PAIRS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of what follows each strip's start (strips + 1 columns, the last 0), rounded up a little."""
    square = np.add.reduceat(x * x, np.arange(0, x.shape[1], STRIP), axis=1)
    tail = np.cumsum(square[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([tail, np.zeros((len(x), 1))])) * (1 + 1e-9)


def pairs_reaching(x: np.ndarray, rest: np.ndarray, q: np.ndarray, q_rest: np.ndarray, threshold: np.ndarray):
    """(row, anchor, score) of every pair whose inner product is at least the anchor's threshold (-inf: all pairs).

    ``x`` and ``q`` hold whole numbers small enough for exact sums of doubles, ``rest`` and ``q_rest`` their suffix norms.
    """
    lowest, longest = threshold.min(), q_rest.max(axis=0)
    indexed = (rest[:, :-1] * longest[:-1] >= lowest).sum(axis=1)  # strips of a row in the index
    order = np.argsort(-indexed, kind="stable")  # a strip's postings are the first rows then
    rows, strips = order[: int((indexed > 0).sum())], indexed[order]
    acc = np.zeros((len(rows), len(q)))
    alive = len(rows)
    for s in range(int(strips[0]) if len(rows) else 0):
        alive = int(np.searchsorted(-strips[: len(rows)], -s, side="left"))
        if s % 2 == 0 and s:  # remaining norms: rows that no anchor can want any more
            hope = (acc[:alive] + rest[rows[:alive], s, None] * q_rest[None, :, s] >= threshold[None, :]).any(axis=1)
            if hope.sum() < 0.7 * alive:
                keep = np.concatenate([np.flatnonzero(hope), np.arange(alive, len(rows))])
                rows, acc, strips = rows[keep], acc[keep], strips[keep]
                alive = int(hope.sum())
        at = slice(s * STRIP, (s + 1) * STRIP)
        acc[:alive] += x[rows[:alive], at] @ q[:, at].T
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    done = strips[: len(rows)]
    bound = rest[rows, done][:, None] * q_rest[:, done].T
    i, j = np.nonzero(acc + bound >= threshold[None, :])
    score = acc[i, j]
    for s in np.unique(done[done < rest.shape[1] - 1]).tolist():  # the dimensions that were not indexed
        some = np.flatnonzero(done[i] == s)
        for a in range(0, len(some), 50_000):
            k = some[a : a + 50_000]
            score[k] += np.einsum("ij,ij->i", x[rows[i[k]], s * STRIP :], q[j[k], s * STRIP :])
    hit = score >= threshold[j]
    return rows[i[hit]], j[hit], score[hit].astype(np.int64)


def first_of_group(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each group: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    since = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    return order[since < k]


class Block:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x.astype(float)
        self.rest = suffix_norms(self.x)


def blocks(batches, most: int, dim: int, order: np.ndarray):
    """A task's rows in blocks of ``most`` (the last one may be smaller), their dimensions in the given order."""

    def block() -> Block:
        t = pa.Table.from_batches(held)
        return Block(t["vec_id"].to_numpy(), t["label"].to_numpy(), rows_of(t["x"], np.int64, dim)[:, order])

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, most - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == most:
                yield block()
                held, n = [], 0
    if n:
        yield block()


class Best:
    """The ``k`` best rows so far of each of ``n`` windows: highest score, then smallest id; NO_SCORE fills what is left."""

    def __init__(self, n: int, k: int):
        self.ids, self.score = np.zeros((n, k), np.int64), np.full((n, k), NO_SCORE)

    def joined(self, window: np.ndarray, ids: np.ndarray, score: np.ndarray):
        """The windows that occur, and their ids and scores with these rows."""
        held, into = np.unique(window, return_inverse=True)
        k = self.ids.shape[1]
        group = np.concatenate([np.repeat(np.arange(len(held)), k), into])
        ids, score = np.concatenate([self.ids[held].ravel(), ids]), np.concatenate([self.score[held].ravel(), score])
        best = first_of_group(group, ids, score, k)
        return held, ids[best].reshape(-1, k), score[best].reshape(-1, k)

    def rows(self):
        """(window, id, score) of all that were found, some windows at a time."""
        for a in range(0, len(self.ids), 4096):
            window, c = np.nonzero(self.score[a : a + 4096] > NO_SCORE)
            yield a + window, self.ids[a + window, c], self.score[a + window, c]


def search(ids, x, rest, q, q_rest, wanted, best: Best, window, anchor, least, most):
    """Puts rows of ``x`` with least <= score <= most into ``best``; ``anchor``: the places in ``q`` of the windows.

    ``wanted(i, j)``: which pairs of a row and an anchor count.
    """
    k = best.ids.shape[1]
    top = np.minimum(most, q_rest[anchor, 0] * rest[:, 0].max())
    for share in (*LEVELS, None):
        kth = best.score[window, -1]
        floor = np.maximum(least, kth)  # lower scores are not wanted
        who, at = np.unique(anchor, return_inverse=True)
        theta = np.full(len(who), np.inf)
        np.minimum.at(theta, at, floor if share is None else np.where(kth > NO_SCORE, floor, np.maximum(floor, share * top)))
        i, j, score = pairs_reaching(x, rest, q[who], q_rest[who], theta)
        counts = wanted(i, who[j])
        i, j, score = i[counts], j[counts], score[counts]
        by = np.lexsort((ids[i], -score, j))
        i, j, score = i[by], j[by], score[by]
        steps = np.unique(score)
        step = at * (len(steps) + 1) + len(steps)
        key = j * (len(steps) + 1) + len(steps) - 1 - np.searchsorted(steps, score)  # ascends: an anchor's highest score first
        first, last = np.searchsorted(key, step - np.searchsorted(steps, most, "right")), np.searchsorted(key, step - np.searchsorted(steps, floor))
        n = np.clip(last - first, 0, k)
        hit = ragged_take(np.arange(len(key)), first, n)
        held, its_ids, its_score = best.joined(np.repeat(window, n), ids[i[hit]], score[hit])
        done = theta[at] <= floor
        place = np.searchsorted(window, held)
        done[place] |= its_score[:, -1] >= theta[at[place]]
        put = done[place]
        best.ids[held[put]], best.score[held[put]] = its_ids[put], its_score[put]
        window, anchor, least, most, top = (a[~done] for a in (window, anchor, least, most, top))
        if not len(window):
            return


def positives(rows: Block, anchors: Block, best: Best) -> None:
    """Puts into ``best``, whose windows are the anchors, other rows of an anchor's label."""
    for label in np.intersect1d(rows.labels, anchors.labels):
        mine, todo = np.flatnonzero(rows.labels == label), np.flatnonzero(anchors.labels == label)
        ids, x, rest = rows.ids[mine], rows.x[mine], rows.rest[mine]
        for a in range(0, len(todo), ANCHORS_AT_ONCE):
            at = todo[a : a + ANCHORS_AT_ONCE]
            q, q_rest, q_ids, all_of = anchors.x[at], anchors.rest[at], anchors.ids[at], np.ones(len(at), np.int64)
            for r in range(0, len(mine), ROWS_AT_ONCE):
                s = slice(r, r + ROWS_AT_ONCE)
                other = lambda i, j, some=ids[s], q_ids=q_ids: some[i] != q_ids[j]
                search(ids[s], x[s], rest[s], q, q_rest, other, best, at, np.arange(len(at)), NO_SCORE * all_of, ANY_SCORE * all_of)


def negatives(rows: Block, anchors: Block, best: Best, anchor: np.ndarray, positive: np.ndarray, low: int, high: int) -> None:
    """Puts into ``best`` rows of other labels with low * positive <= 100 * score <= high * positive.

    ``anchor`` (ascending) and ``positive`` hold the place of a window's anchor and its positive's score.
    """
    least, most = -((-low * positive) // 100), (high * positive) // 100  # least > most for positives below 0: none
    todo = np.flatnonzero(least <= most)
    edges = np.searchsorted(anchor[todo], np.arange(0, len(anchors.ids) + ANCHORS_AT_ONCE, ANCHORS_AT_ONCE))
    for a, (first, last) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        window, at = todo[first:last], slice(a * ANCHORS_AT_ONCE, (a + 1) * ANCHORS_AT_ONCE)
        if not len(window):
            continue
        q, q_rest, q_labels = anchors.x[at], anchors.rest[at], anchors.labels[at]
        for r in range(0, len(rows.ids), ROWS_AT_ONCE):
            s = slice(r, r + ROWS_AT_ONCE)
            other = lambda i, j, some=rows.labels[s], q_labels=q_labels: some[i] != q_labels[j]
            search(rows.ids[s], rows.x[s], rows.rest[s], q, q_rest, other, best, window, anchor[window] - a * ANCHORS_AT_ONCE, least[window], most[window])


def mine(vectors: DataFrame, anchors, k_positives: int = 5, k_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors``: vec_id, embedding, label; ``anchors``: SQL condition on vec_id that chooses them. A component x counts as
    floor(scale * x), a score is the integer inner product with the anchor, higher ones come first, ties go to the smaller id. An anchor's positives are
    its ``k_positives`` best other rows of its label; for each, the ``k_negatives`` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; all, if fewer. A positive of negative score has
    no such rows, one of score 0 only those of score 0.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; zero and empty vectors do (score 0).
    Of rows that share an id, one counts (the least label, then the least bytes of its scaled components). Vectors of different lengths are compared as if the
    shorter ended in zeros. Components beyond the size whose products sum up exactly in doubles (2^26 / sqrt(length) after
    scaling) count as that size. Other columns are ignored; an empty table gives no rows.
    """
    dim = max(1, width(vectors, "embedding"))
    most = float(int(2**26 / np.sqrt(dim)))

    def encode(batches):
        for batch in batches:
            x, ok = matrix(batch.column("v"), dim)
            ok &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(ok)
            whole = np.clip(np.floor(scale * x[keep]), -most, most).astype(np.int64)
            some = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), binary_rows(whole)], ["vec_id", "label", "x"])

    def energy(batches):
        """Sum of squares of each dimension over a task's rows."""
        total = np.zeros(dim)
        for batch in batches:
            total += (rows_of(batch.column("x"), np.int64, dim).astype(float) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], ["d", "e"])

    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.mapInArrow(encode, "vec_id long, label long, x binary")
    rows = cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.*"), "mine-rows")
    asked = rows.filter(anchors)
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], PAIRS)
    total = rows.select("x").mapInArrow(energy, "d int, e double").groupBy("d").agg(F.sum("e").alias("e")).collect()
    order = np.array([r.d for r in sorted(total, key=lambda r: (-r.e, r.d))])
    rounds = -(-n_asked // max(1, min(BLOCK_ANCHORS, ROUND_BYTES // (8 * dim))))
    read = rows.coalesce(max(LEAST_TASKS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    most_rows, out = BLOCK_ROWS, shared_path(spark, "mine-pairs")

    def one_round(some: DataFrame) -> None:
        """Writes the rows of these anchors. Only they and their windows come to the driver and go to the executors."""
        table = some.toArrow().sort_by("vec_id")
        if not table.num_rows:
            return
        ids = table["vec_id"].to_numpy()
        query = spark.sparkContext.broadcast((ids, table["label"].to_numpy(), rows_of(table["x"], np.int64, dim)[:, order].astype(np.int32)))

        def find_positives(batches):
            q = Block(*query.value)
            best = Best(len(q.ids), k_positives)
            for block in blocks(batches, most_rows, dim, order):
                positives(block, q, best)
            for a, i, score in best.rows():
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[a]), pa.array(i), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])

        found = read.mapInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
        nearest = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        chosen = cut(found.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k_positives).drop("r"), "mine-positives")
        table = chosen.select("anchor_id", "positive_score").distinct().toArrow().sort_by([("anchor_id", "ascending"), ("positive_score", "ascending")])
        windows = spark.sparkContext.broadcast((np.searchsorted(ids, table["anchor_id"].to_numpy()), table["positive_score"].to_numpy()))

        def find_negatives(batches):
            q, (anchor, positive) = Block(*query.value), windows.value
            best = Best(len(anchor), k_negatives)
            for block in blocks(batches, most_rows, dim, order):
                negatives(block, q, best, anchor, positive, low, high)
            for w, i, score in best.rows():
                columns = [pa.array(q.ids[anchor[w]]), pa.array(positive[w]), pa.array(i), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_score", "negative_id", "negative_score"])

        found = read.mapInArrow(find_negatives, "anchor_id long, positive_score long, negative_id long, negative_score long")
        best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k_negatives)
        pairs = found.join(chosen.hint("merge"), ["anchor_id", "positive_score"])
        pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").option("compression", "zstd").parquet(out)
        query.destroy()
        windows.destroy()

    for r in range(rounds):
        one_round(asked.filter(part("vec_id", rounds) == r))
    return spark.read.schema(PAIRS).parquet(out)
