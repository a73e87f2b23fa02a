"""Vector search for many queries: a stored nearest-neighbour index, and an exact similarity threshold join.

Both deal rows out to tiles of bounded size: a task holds the left rows of a tile as one matrix, and the right ones
pass by it in slices, so that its memory does not grow with the input; only what is found, or counted, leaves it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import checkpoint

#: Rows of a group of a threshold join and of a part of a cell, at most; queries that a task holds, at most.
BLOCK, QUERIES = 65_536, 16_384
#: Rows that pass by at a time, and left rows that they meet at a time: 4 MB of similarities.
SLICE, LEFT = 256, 4096
#: Groups that a threshold join aims at, if they are of SMALL rows or more; pairs of rows that are work for a task.
GROUPS, SMALL, WORK = 16, 1024, 50_000_000
#: Rows that cells are fitted on, at most; pivots of a threshold join, and the sample that they are of.
SAMPLE, PIVOTS, PIVOT_SAMPLE = 20_000, 8, 512


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(column) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _parted(df: DataFrame, group: list[str], size: int) -> DataFrame:
    """df(id, group columns, ...) with part: a group of any size is cut into as many parts of about size rows as it needs."""
    counts = df.groupBy(*group).agg(F.count("*").alias("__n"))
    return df.join(counts.hint("merge"), group).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / size))).drop("__n")


def _meetings(batches):
    """Of rows (tile, side, id, n, v) in order of tile and side: (tile, side, left, right), each of them ids, numbers and
    unit vectors; left holds all rows of the tile's side 0, right the next few of its side 1 (or 2: the left rows anew)."""
    tile, left, parts = None, None, []
    for b in batches:
        if not b.num_rows:
            continue
        tiles, side = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(tiles) != 0) | (np.diff(side) != 0)) + 1), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if tiles[lo] != tile:
                tile, left, parts = tiles[lo], None, []
            if side[lo] != 0 and left is None and parts:
                left, parts = _held(parts), []
            for at in range(lo, hi, SLICE):  # numbers of double precision are made of a slice, not of a batch
                own = b.slice(at, min(SLICE, hi - at))
                few = own.column(2).to_numpy().copy(), own.column(3).to_numpy().copy(), _matrix(own.column(4))
                if side[lo] == 0:
                    parts.append((*few[:2], few[2].astype(np.float32)))
                elif left is not None:
                    yield tile, side[lo], left, (*few[:2], _unit(few[2]))


def _held(parts):
    """Slices of ids, numbers and vectors (of floats) as one each, with unit vectors; the slices go while they are read."""
    ids, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    m, at = np.empty((len(ids), parts[0][2].shape[1])), len(ids)
    while parts:
        v = _unit(parts.pop()[2].astype(float))
        m[at - len(v) : at], at = v, at - len(v)
    return ids, n, m


def _by_tile(rows: DataFrame, tiles: int, work: float) -> DataFrame:
    """rows(tile, side, id, n, v) in order, in as many partitions as the work needs; a tile is in one of them."""
    n = max(1, min(tiles, math.ceil(work / WORK)))
    dealt = rows.select("tile", "side", "id", "n", "v").repartitionById(n, F.pmod("tile", F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("tile", "side", "id")


# --- nearest neighbours -------------------------------------------------------------------------------


def store(corpus: DataFrame, path: str, cells: int, key: str = "vec_id", vec: str = "embedding", seed: int = 1) -> None:
    """Writes the index of a corpus: k-means cells, fitted on SAMPLE rows or fewer (those whose key hashes
    smallest), and all rows (cell, part, id, v), in order of cells, whose parts have about BLOCK rows. Null and zero
    vectors, which are near to nothing, are left out."""
    rows = corpus.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).where(F.exists("v", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("v").alias("features"))
    spark = corpus.sparkSession
    if rows.isEmpty():
        centres: list = []
        celled = rows.withColumn("cell", F.lit(0))
    else:
        model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        celled = model.setPredictionCol("cell").transform(rows.withColumn("features", array_to_vector("v"))).drop("features")
    # From Arrow, as rows would take Python workers that only hold memory from then on.
    held = pa.table({"cell": pa.array([i for i, _ in centres], pa.int32()), "centre": pa.array([c for _, c in centres], pa.list_(pa.float64()))})
    spark.createDataFrame(held).write.mode("overwrite").parquet(f"{path}/cells")
    parted = _parted(checkpoint(celled), ["cell"], BLOCK).select("cell", "part", "id", "v")
    parted.repartitionByRange("cell", "part", "id").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{path}/vectors")


def _nearest(batches, k: int):
    """(query ids, ids, similarities) of the k nearest right rows of every left row of a tile (_meetings), ties to the
    smaller id. As right rows pass in order of id, one that is as near as the last one kept is too late."""
    last, best = None, None

    def found():
        names, s, i = best
        real = s > -np.inf
        return np.repeat(names, real.sum(axis=1)), i[real], s[real]

    for tile, _, (qi, _, qv), (xi, _, xv) in _meetings(batches):
        if tile != last:
            if best is not None:
                yield found()
            last, best = tile, (qi, np.full((len(qi), k), -np.inf), np.zeros((len(qi), k), dtype=np.int64))
        for at in range(0, len(qi), LEFT):
            own, kept, names = qi[at : at + LEFT], best[1][at : at + LEFT], best[2][at : at + LEFT]
            s = qv[at : at + LEFT] @ xv.T
            s[own[:, None] == xi[None, :]] = -np.inf
            near = s > kept[:, -1:]
            if np.count_nonzero(near) > k * len(own):  # of no row more than k, also while little is kept
                first = np.argsort(np.where(near, -s, np.inf), axis=1, kind="stable")[:, :k]
                nearest = np.zeros_like(near)
                np.put_along_axis(nearest, first, True, axis=1)
                near &= nearest
            i, j = np.nonzero(near)
            if len(i):
                todo = np.unique(i)
                q = np.concatenate([np.repeat(todo, k), i])
                value, row = np.concatenate([kept[todo].reshape(-1), s[i, j]]), np.concatenate([names[todo].reshape(-1), xi[j]])
                order = np.lexsort((row, -value, q))
                q, value, row = q[order], value[order], row[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, value, row, rank = (x[rank < k] for x in (q, value, row, rank))
                kept[q, rank], names[q, rank] = value, row
    if best is not None:
        yield found()


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, <key>, similarity, rank) of the k nearest stored rows of every query, itself left out, among the
    ``probes`` cells nearest to it; similarities are exact. Up to QUERIES queries meet a part of a cell at once."""
    # As many rows as there are cells, a parameter of the index.
    centres = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    names, m = np.array([r.cell for r in centres], dtype=np.int32), _unit(np.array([r.centre for r in centres] or [[0.0]], dtype=float))

    def probe(batches):
        n = min(probes, len(names))
        for b in batches:
            for at in range(0, b.num_rows if n else 0, SLICE):  # a query is repeated for each of its cells
                part = b.slice(at, SLICE)
                near = np.argsort(-(_unit(_matrix(part.column(1))) @ m.T), axis=1, kind="stable")[:, :n]
                row = pa.array(np.repeat(np.arange(len(near)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(names[near.reshape(-1)])], ["id", "v", "cell"])

    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).where(F.exists("v", lambda x: x != 0))
    asked = _parted(checkpoint(asked.mapInArrow(probe, "id long, v array<float>, cell int")), ["cell"], QUERIES).withColumnRenamed("part", "q")
    stored = spark.read.parquet(f"{path}/vectors").select("cell", "part", "id", "v")
    parts = stored.groupBy("cell", "part").agg(F.count("*").alias("rows"))
    tiles = checkpoint(asked.groupBy("cell", "q").agg(F.count("*").alias("asked")).join(parts.hint("merge"), "cell").withColumn("tile", F.monotonically_increasing_id()))
    size = tiles.agg(F.count("*").alias("n"), F.sum(F.col("asked") * F.col("rows")).alias("work")).first()
    left = asked.join(tiles.select("cell", "q", "tile").hint("merge"), ["cell", "q"]).select("tile", F.lit(0).alias("side"), "id", F.lit(1).alias("n"), "v")
    right = stored.join(tiles.select("cell", "part", "tile").hint("merge"), ["cell", "part"]).select("tile", F.lit(1).alias("side"), "id", F.lit(1).alias("n"), "v")

    def product(batches):
        for found in _nearest(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", key, "similarity"])

    met = _by_tile(left.unionByName(right), size.n, size.work or 0).mapInArrow(product, f"query_id long, {key} long, similarity double")
    by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key)
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


# --- threshold join -----------------------------------------------------------------------------------


def _pivots(rows: DataFrame) -> np.ndarray:
    """Unit vectors far from each other, of a bounded sample."""
    sample = _unit(np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()], dtype=float))
    out = [0]
    while len(out) < min(PIVOTS, len(sample)):
        out.append(int(np.argmin((sample @ sample[out].T).max(axis=1))))
    return sample[out]


def _tiled(rows: DataFrame, least: float) -> DataFrame:
    """rows(id, n, v), no zero vectors, dealt to tiles so that any two rows with a cosine of at least ``least`` > 0 meet in
    one of them, once: (tile, side, id, n, v), in order; side 0 meets side 1, or itself as side 2.

    Unit vectors whose cosine is that large are at most r = sqrt(2 - 2 least) apart, and so are their distances
    to any pivot. Rows are dealt into shells of width r around the first pivot; groups of one shell and
    nearest pivot meet those of the same and the next shell, if no other pivot's distances rule that out. How
    much is ruled out depends on the data: the more so, the higher the threshold and the more they cluster. A
    group has BLOCK rows at most, and the fewer groups, the less often a row is sent.
    """
    pivots, r = _pivots(rows), float(np.sqrt(max(2 - 2 * least, 0))) + 1e-9
    n = len(pivots)

    def measure(batches):
        for b in batches:
            d = np.sqrt(np.maximum(2 - 2 * _unit(_matrix(b.column(2))) @ pivots.T, 0)) if b.num_rows else np.zeros((0, n))
            arrays = [b.column(0), b.column(1), b.column(2), pa.array(np.floor(d[:, 0] / r).astype(np.int64)), pa.array(d.argmin(axis=1).astype(np.int32) if len(d) else np.zeros(0, np.int32)), *(pa.array(d[:, i]) for i in range(n))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "v", "shell", "near", *(f"d{i}" for i in range(n))])

    measured = rows.select("id", F.col("n").cast("long").alias("n"), "v").mapInArrow(measure, f"id long, n long, v array<float>, shell long, near int, {', '.join(f'd{i} double' for i in range(n))}")
    measured = checkpoint(measured)
    group = ["shell", "near", "part"]
    dealt = _parted(measured, group[:2], min(BLOCK, max(SMALL, math.ceil(measured.count() / GROUPS))))
    ranges = {f"lo{i}": F.min(f"d{i}") for i in range(n)} | {f"hi{i}": F.max(f"d{i}") for i in range(n)}
    groups = checkpoint(dealt.groupBy(*group).agg(F.count("*").alias("rows"), *(c.alias(x) for x, c in ranges.items())))
    left = groups.select(*(F.col(c).alias(f"l_{c}") for c in groups.columns)).withColumn("meets", F.explode(F.array(F.col("l_shell"), F.col("l_shell") + 1)))
    once = (F.col("shell") > F.col("l_shell")) | (F.col("near") > F.col("l_near")) | ((F.col("near") == F.col("l_near")) & (F.col("part") >= F.col("l_part")))
    on = (F.col("meets") == F.col("shell")) & once
    for i in range(n):
        on &= (F.col(f"l_lo{i}") - F.col(f"hi{i}") <= r) & (F.col(f"lo{i}") - F.col(f"l_hi{i}") <= r)
    tiles = checkpoint(left.join(groups.hint("merge"), on).select("l_shell", "l_near", "l_part", *group, (F.col("l_rows") * F.col("rows")).alias("work")).withColumn("tile", F.monotonically_increasing_id()))
    size = tiles.agg(F.count("*").alias("n"), F.sum("work").alias("work")).first()
    same = (F.col("shell") == F.col("l_shell")) & (F.col("near") == F.col("l_near")) & (F.col("part") == F.col("l_part"))
    sides = tiles.select(*(F.col(f"l_{c}").alias(c) for c in group), "tile", F.lit(0).alias("side")).unionByName(tiles.select(*group, "tile", F.when(same, 2).otherwise(1).alias("side")))
    return _by_tile(dealt.join(sides.hint("merge"), group), size.n, size.work or 0)


def _hits(same: bool, left, right, least: float):
    """(positions in left, positions in right, cosines) of the pairs at or above the threshold; same: of two equal sides,
    each pair once. Single precision finds what may be, and double precision decides."""
    (li, _, lv), (ri, _, rv) = left, right
    slack, small = (lv.shape[1] + 8) * 2.0**-22, rv.astype(np.float32).T.copy()
    for at in range(0, len(li), LEFT):
        own = lv[at : at + LEFT]
        i, j = np.divmod(np.flatnonzero((own.astype(np.float32) @ small) >= np.float32(least - slack)), len(ri))
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            s = np.einsum("ij,ij->i", own[a], rv[b])
            real = (s >= least) & (li[a + at] < ri[b]) if same else s >= least
            yield a[real] + at, b[real], s[real]


def pairs_above(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of rows(id, v) with a cosine of at least ``least`` > 0: exact (_tiled)."""
    rows = rows.where(F.exists("v", lambda x: x != 0))
    if rows.isEmpty():
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity"))

    def product(batches):
        for _, side, left, right in _meetings(batches):
            for i, j, s in _hits(side == 2, left, right, least):
                a, b = left[0][i], right[0][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["a", "b", "similarity"])

    return _tiled(rows.select("id", F.lit(1).alias("n"), "v"), least).mapInArrow(product, "a long, b long, similarity double")


def _linked(rows: DataFrame, least: float) -> DataFrame:
    """(id, others) of rows(id, n, v) that have any: the sum of n over all other rows with a cosine of at least ``least``.
    Pairs are counted where they are found, a tile hands on a row for each of its rows at most."""

    def product(batches):
        last, held, others, rest = None, None, None, []

        def counted():
            ids, n = (np.concatenate(x) for x in zip(*[(held, others), *rest]))
            return pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["id", "others"])

        for tile, side, left, right in _meetings(batches):
            if tile != last:
                if last is not None:
                    yield counted()
                last, held, others, rest = tile, left[0], np.zeros(len(left[0]), dtype=np.int64), []
            more = np.zeros(len(right[0]), dtype=np.int64)
            for i, j, _ in _hits(side == 2, left, right, least):
                np.add.at(others, i, right[1][j])
                np.add.at(more, j, left[1][i])
            rest.append((right[0][more > 0], more[more > 0]))
        if last is not None:
            yield counted()

    return _tiled(rows, least).mapInArrow(product, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def links_above(corpus: DataFrame, least: float, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(<key>, same_as, n_links) of every row: the smallest key with an equal vector, and how many other rows have
    a cosine of at least ``least`` > 0. Equal vectors are one row of the join, however many they are; rows
    without a direction (null or zero vectors) have no links and are the same as themselves."""
    rows = corpus.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v"))
    direct = F.exists("v", lambda x: x != 0)
    distinct = checkpoint(rows.where(direct).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    if distinct.isEmpty():
        return rows.select(F.col("id").alias(key), F.col("id").alias("same_as"), F.lit(0).cast("long").alias("n_links"))
    other = checkpoint(_linked(distinct, least))
    classes = distinct.join(other.hint("merge"), "id", "left").select("v", F.col("id").alias("same_as"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    found = rows.join(classes.hint("merge"), "v", "left")
    return found.select(F.col("id").alias(key), F.coalesce("same_as", "id").alias("same_as"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
