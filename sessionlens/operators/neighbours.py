"""Exact nearest neighbours inside each class.

Rows of a class are placed in the cell of their closest pivot. A cell is cut into shells of about ``block_rows`` rows by
the distance to its pivot, and a shell that holds more rows than that (equal distances) into parts by hash: a block. A row
first finds its best candidates in its own block, which bounds how far its k-th neighbour can be. By the triangle
inequality a block whose shell lies further than that from the row can't improve it.

Consecutive blocks lie in a bundle: an eighth of a class, at most about twice ``BLOCK_ROWS`` rows. The bundles with blocks that
are left are visited in rounds, the one with the nearest block first and twice as many each time. After every round the k-th
distance is smaller, and later visits are dropped by it. The visits of a round are found when it begins and are never
stored for later ones. A row goes to a bundle once, with one bit for each of its blocks that is left, so vectors travel by rows
and bundles and not by rows and blocks, and no pair is looked at twice. Bundles answer with at most k candidates per visitor,
none beyond its bound: pairs are compared inside tasks and never emitted, and no task holds more than one bundle and one
batch of visitors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions.scalars import digest
from sessionlens.operators.ordering import has_large_group
from sessionlens.session import stage

BLOCK_ROWS = 2_000
MOST_PIVOTS, MOST_SHELLS = 256, 64
#: Bundles that a class has at least, if it has as many blocks.
LEAST_BUNDLES = 8
#: Visits of a task, pairs that are compared at once, and candidates of a row above which its k-th is looked for first.
TASK_VISITS, PAIRS, MANY = 100_000, 1 << 18, 64
#: What a computed distance may be off by.
SLACK = 1e-9


def _block_of(row_id: str, blocks):
    return F.pmod(F.xxhash64(row_id), blocks).cast("int")


def nearest_in_class(
    df: DataFrame, label: str, row_id: str, vector: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(row_id, nn_rank 1..k, nn_id, distance)``; ties go to the smaller id. ``row_id`` is a bigint."""
    base = df.select(F.col(label).alias("cls"), F.col(row_id).cast("long").alias("id"), F.col(vector).alias("x"))
    if not has_large_group(base, ["cls"], block_rows):
        whole = base.select("cls", F.lit(0).alias("bundle"), F.lit(0).alias("block"), "id", "x")
        return _within_blocks(whole, k).select(F.col("id").alias(row_id), "nn_rank", "nn_id", "distance")

    pivots = _pivots(base, block_rows)
    placed = stage(_closest_pivot(base.repartition(_tasks(base), "id"), pivots), "cells")
    blocked, shells = _blocks(placed, block_rows)
    best = stage(_within_blocks(blocked, k).select("id", "nn_id", "distance"), "own-block")
    first, until = 1, 2
    ranked = Window.partitionBy("id").orderBy("distance", "nn_id")
    while True:
        # bundles are visited by rising gap, so a falling bound cuts the end of a row's list and no turn changes
        visits = stage(_visits(blocked.join(_bounds(best, k), "id", "left"), shells, pivots, first, until, block_rows), "visits")
        if visits.isEmpty():
            break
        found = _across_blocks(visits, blocked, k, block_rows)
        merged = best.unionByName(found).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k)
        best = stage(merged.drop("_r"), "nearest")
        first, until = until + 1, 2 * until + 1
    return best.withColumn("nn_rank", F.row_number().over(ranked)).select(F.col("id").alias(row_id), "nn_rank", "nn_id", "distance")


def _bounds(best: DataFrame, k: int) -> DataFrame:
    """The distance of the k-th candidate of every row that has k."""
    return best.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("bound")).where(F.col("_n") >= k).drop("_n")


def _blocks(placed: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block and bundle, and (cls, cell, shell, lo, hi, n, parts, before, block, size) of every shell.

    A cell has at most MOST_SHELLS of them, so this table and its broadcasts are bounded by the pivots.
    """
    steps = F.least(F.lit(MOST_SHELLS), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int")
    every = F.array(*[F.lit(i / MOST_SHELLS) for i in range(1, MOST_SHELLS)])
    cells = placed.groupBy("cls", "cell").agg(steps.alias("steps"), F.percentile_approx("reach", every, 10_000).alias("marks"))
    cells = stage(cells.select("cls", "cell", F.expr(
        f"transform(sequence(1, greatest(steps - 1, 1)), i -> if(steps > 1, marks[int(i * {MOST_SHELLS} / steps) - 1], double('inf')))").alias("cuts")), "cell-cuts")
    shelled = placed.join(cells, ["cls", "cell"]).withColumn(
        "shell", F.size(F.filter("cuts", lambda c: c < F.col("reach"))).cast("int")).drop("cuts")
    shells = shelled.groupBy("cls", "cell", "shell").agg(
        F.min("reach").alias("lo"), F.max("reach").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    # at most MOST_PIVOTS * MOST_SHELLS rows per class
    earlier = Window.partitionBy("cls").orderBy("cell", "shell").rowsBetween(Window.unboundedPreceding, -1)
    share = F.ceil(F.sum("n").over(Window.partitionBy("cls")) / LEAST_BUNDLES)
    shells = stage(shells.withColumns({
        "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "block": F.coalesce(F.sum("parts").over(earlier), F.lit(0)).cast("int"),
        "size": F.greatest(F.lit(block_rows), F.least(F.lit(2 * BLOCK_ROWS), share)).cast("long")}), "shells")
    blocked = shelled.join(shells, ["cls", "cell", "shell"]).withColumn("part", _block_of("id", F.col("parts")))
    blocked = blocked.withColumns({"block": F.col("block") + F.col("part"), "bundle": _bundle(F.col("before"), F.col("part"), block_rows, F.col("size")).cast("int")})
    # the rounds compute much on few bytes, so rows are spread by number and not by size
    blocked = blocked.select("cls", "block", "bundle", "id", "x").repartition(_tasks(placed), "id")
    return stage(blocked, "blocks"), shells


def _tasks(df: DataFrame) -> int:
    """Tasks of a step that computes much on few bytes: adaptive execution would merge them by size."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bundle(before, part, block_rows: int, size: int):
    """The bundle of a block: about ``size`` consecutive rows of a class, at least one block."""
    at = before + part * block_rows
    return (at - at % size) / size


def _pivots(base: DataFrame, block_rows: int) -> dict:
    """Random rows of each class, one per expected block and at most MOST_PIVOTS; a fitted
    parameter of bounded size, like cluster centres."""
    sizes = base.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()
    ranked = base.withColumn("_h", digest(F.col("id"))).withColumn(
        "_r", F.row_number().over(Window.partitionBy("cls").orderBy("_h", "id"))).where(F.col("_r") <= MOST_PIVOTS)
    wanted = {r["cls"]: min(-(-r["n"] // block_rows), MOST_PIVOTS) for r in sizes}
    chosen: dict = {}
    for r in ranked.orderBy("cls", "_r").select("cls", "_r", "x").collect():
        if r["_r"] <= wanted[r["cls"]]:
            chosen.setdefault(r["cls"], []).append(r["x"])
    return chosen


def _closest_pivot(df: DataFrame, pivots: dict) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        import numpy as np

        for pdf in batches:
            cell = np.zeros(len(pdf), dtype="int32")
            reach = np.full(len(pdf), np.inf)
            for name in pdf["cls"].unique():
                at = np.flatnonzero((pdf["cls"] == name).to_numpy())
                points = np.stack(pdf["x"].to_numpy()[at])
                for j, pivot in enumerate(shared.value[name]):
                    distance = np.sqrt(((points - np.asarray(pivot)) ** 2).sum(axis=1))
                    closer = distance < reach[at]
                    cell[at[closer]], reach[at[closer]] = j, distance[closer]
            yield pdf.assign(cell=cell, reach=reach)

    kind = df.schema["cls"].dataType.simpleString()
    return df.mapInPandas(place, f"cls {kind}, id long, x array<double>, cell int, reach double")


def _vectors(column):
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top(k: int):
    """Best ``k`` of a set of points for each query, by distance and then id: (query id, rank, point id, distance) as arrays.

    ``seen`` tells of some queries which blocks are theirs to compare, ``block`` in which a point is, and ``bound`` what distance
    is of no use.
    """

    def close(part, points, block, left, bound):
        """(query, point) of all pairs that may be among the best; the last entry of ``points`` is the squared length."""
        import numpy as np

        if left is not None:
            mine = left.sum(axis=0) @ np.bincount(block, minlength=left.shape[1])
            if mine < 0.05 * len(part) * len(points):
                return np.nonzero(left[:, block])
        own = (part**2).sum(axis=1)
        slack = 1e-9 * (own + points[:, -1].max())
        # one product makes the squared distances less ``own``, which the limit is lessened by instead
        rough = np.c_[-2 * part, np.ones(len(part))] @ points.T
        limit = np.full(len(part), np.inf) if bound is None else (bound + SLACK) ** 2
        near = rough <= (limit + slack - own)[:, None]
        crowded = np.flatnonzero([np.count_nonzero(r) > MANY + k for r in near])
        if len(crowded):
            some = rough[crowded]
            if left is not None:
                some[~left[crowded][:, block]] = np.inf
            most = min(k, len(points) - 1)  # the k-th neighbour lies here, as the query may be a point
            limit = np.minimum(limit[crowded] - own[crowded], np.partition(some, most, axis=1)[:, most])
            near[crowded] = (some <= (limit + slack[crowded])[:, None]) & np.isfinite(some)
        who, where = np.divmod(np.flatnonzero(near), len(points))
        if left is None:
            return who, where
        keep = left[who, block[where]]
        return who[keep], where[keep]

    def top(queries, query_ids, points, point_ids, seen=None, block=None, bound=None):
        import numpy as np

        made = [(np.zeros(0, dtype="int64"), np.zeros(0, dtype="int32"), np.zeros(0, dtype="int64"), np.zeros(0))]
        points = np.c_[points, (points**2).sum(axis=1)]
        step = max(16, min(256, PAIRS // len(points)))
        for start in range(0, len(queries), step):
            part, ids = queries[start : start + step], query_ids[start : start + step]
            left, some, some_ids, blocks = None, points, point_ids, block
            if seen is not None:
                left = seen(start, start + step)
                used = np.flatnonzero(left.any(axis=0)[block])
                if not len(used):
                    continue
                if len(used) < 0.8 * len(points):
                    some, some_ids, blocks = points[used], point_ids[used], block[used]
            who, where = close(part, some, blocks, left, None if bound is None else bound[start : start + step])
            distance = np.sqrt(((some[where, :-1] - part[who]) ** 2).sum(axis=1))
            if bound is not None:
                keep = distance <= bound[start + who] + SLACK
                who, where, distance = who[keep], where[keep], distance[keep]
            order = np.lexsort((some_ids[where], distance, who))
            who, where, distance = who[order], where[order], distance[order]
            # the first k + 1, without the query itself
            keep = (np.arange(len(who)) - np.searchsorted(who, who) <= k) & (some_ids[where] != ids[who])
            who, where, distance = who[keep], where[keep], distance[keep]
            rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
            keep = rank <= k
            made.append((ids[who[keep]], rank[keep].astype("int32"), some_ids[where[keep]], distance[keep]))
        return [np.concatenate(c) for c in zip(*made)]

    return top


def _within_blocks(blocked: DataFrame, k: int) -> DataFrame:
    """The best of a row's own block; blocks of a bundle share a task."""
    top = _top(k)

    def search(table):
        import numpy as np
        import pyarrow as pa

        points, ids, block = _vectors(table["x"]), table["id"].to_numpy(), table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
        found = [np.concatenate(c) for c in zip(*(top(points[at], ids[at], points[at], ids[at]) for at in parts))]
        return pa.table(dict(zip(["id", "nn_rank", "nn_id", "distance"], found)))

    slot = ["cls", "bundle"]
    return blocked.repartition(_tasks(blocked), *slot).groupBy(*slot).applyInArrow(
        search, "id long, nn_rank int, nn_id long, distance double")


def _visits(rows: DataFrame, shells: DataFrame, pivots: dict, first: int, until: int, block_rows: int) -> DataFrame:
    """(cls, bundle, base, id, bound, open) of the turns ``first`` to ``until`` of every row.

    A row's turns are the bundles with other blocks that may hold a closer neighbour, by the nearest of these. ``open`` has a
    bit for each block of the bundle, of which ``base`` is the first.
    """
    # at most MOST_PIVOTS * MOST_SHELLS entries per class
    shape: dict = {}
    for r in shells.select("cls", "cell", "shell", "lo", "hi", "parts", "before", "size").orderBy("cell", "shell").collect():
        shape.setdefault(r["cls"], []).append(tuple(r)[1:])
    shared = rows.sparkSession.sparkContext.broadcast((pivots, shape))

    def choose(batches):
        import numpy as np
        import pyarrow as pa

        pivot_of, shape_of = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            kinds, x, own, ids = table["cls"].to_pandas(), _vectors(table["x"]), table["block"].to_numpy(), table["id"].to_numpy()
            bound = table["bound"].to_numpy()
            bound = np.where(np.isnan(bound), np.inf, bound)
            for name in kinds.unique():
                every = np.flatnonzero((kinds == name).to_numpy())
                cell, shell, lo, hi, parts, before, size = (np.array(c) for c in zip(*shape_of[name]))
                of_block = np.repeat(np.arange(len(parts)), parts)
                bundle = _bundle(before[of_block], np.arange(len(of_block)) - np.repeat(np.cumsum(parts) - parts, parts), block_rows, size[0]).astype("int32")
                base = np.flatnonzero(np.diff(bundle, prepend=-1)).astype("int32")  # bundles rise with their blocks
                width = np.diff(base, append=len(bundle))
                # the blocks of each bundle; the last one stands for none
                member = np.where(np.arange(width.max()) < width[:, None], base[:, None] + np.arange(width.max()), len(bundle))
                if first > len(base):
                    continue
                centres = np.stack([np.asarray(p) for p in pivot_of[name]])
                cell, lo, hi = cell[of_block], lo[of_block], hi[of_block]
                points = x[every]
                far = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in centres], axis=1)
                for these in np.array_split(np.arange(len(every)), -(-len(every) // 64)):
                    at = every[these]
                    gap = np.take(far[these], cell, axis=1)
                    short = lo - gap
                    gap -= hi
                    np.maximum(np.maximum(gap, short, out=gap), 0.0, out=gap)
                    gap[np.arange(len(at)), own[at]] = np.inf
                    nearest = np.minimum.reduceat(gap, base, axis=1)
                    order = np.argsort(nearest, axis=1, kind="stable")[:, first - 1 : until]
                    limit = bound[at][:, None] + SLACK
                    reached = np.take_along_axis(nearest, order, axis=1)
                    who, turn = np.nonzero((reached <= limit) & np.isfinite(reached))
                    if not len(who):
                        continue
                    which = order[who, turn]
                    left = np.zeros((len(at), len(bundle) + 1), dtype=bool)
                    np.less_equal(gap, limit, out=left[:, :-1])
                    left[np.arange(len(at)), own[at]] = False
                    bits = np.packbits(left[who[:, None], member[which]], axis=1)
                    ends = np.arange(len(who) + 1, dtype="int32") * bits.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        batch.column("cls").take(pa.array(at[who])), pa.array(bundle[base[which]]), pa.array(base[which]),
                        pa.array(ids[at[who]]), pa.array(bound[at[who]]),
                        pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(ends), pa.py_buffer(bits.tobytes())]),
                    ], names=["cls", "bundle", "base", "id", "bound", "open"])

    kind = rows.schema["cls"].dataType.simpleString()
    return rows.repartition(_tasks(rows), "id").mapInArrow(
        choose, f"cls {kind}, bundle int, base int, id long, bound double, open binary")


def _across_blocks(visits: DataFrame, blocked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Compare visitors with the rows of the blocks they visit in a bundle; a bundle with many visitors is copied so that
    each task gets about twice ``BLOCK_ROWS`` of them."""
    slot = ["cls", "bundle"]
    crowds = visits.groupBy(*slot).agg(F.ceil(F.count(F.lit(1)) / max(2 * BLOCK_ROWS, block_rows)).cast("int").alias("parties"))
    # one row per bundle, i.e. rows / BLOCK_ROWS: left to the size seen at run time
    guests = visits.join(crowds, slot).withColumn("party", _block_of("id", F.col("parties")))
    guests = guests.join(blocked.select("id", "x"), "id").select(*slot, "party", "base", "id", "x", "bound", "open")
    copies = crowds.select(*[F.col(c).alias(c) for c in slot], F.col("parties").alias("copies"))
    hosts = blocked.select(*[F.col(c).alias(c) for c in (*slot, "block", "id", "x")]).join(
        copies, slot).withColumn("party", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    top = _top(k)

    def search(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["id", "nn_id", "distance"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: np.zeros(0, dtype="float64" if n == "distance" else "int64") for n in names})
        # rows that visit the same blocks lie together, so that a part of them needs few blocks
        bits = left["open"].combine_chunks()
        bits = np.frombuffer(b"".join(bits.to_pylist()), dtype="uint8").reshape(left.num_rows, -1)
        order = np.lexsort(bits.T[::-1])
        bits, visitors, ids = bits[order], _vectors(left["x"])[order], left["id"].to_numpy()[order]
        block = right["block"].to_numpy() - left["base"][0].as_py()

        def seen(start, stop):
            return np.unpackbits(bits[start:stop], axis=1).astype(bool)

        found = top(visitors, ids, _vectors(right["x"]), right["id"].to_numpy(), seen, block, left["bound"].to_numpy()[order])
        return pa.table(dict(zip(names, (found[0], found[2], found[3]))))

    tasks, group = max(_tasks(blocked), -(-visits.count() // TASK_VISITS)), [*slot, "party"]
    guests, hosts = guests.repartition(tasks, *group), hosts.repartition(tasks, *group)
    return guests.groupBy(*group).cogroup(hosts.groupBy(*group)).applyInArrow(
        search, "id long, nn_id long, distance double")
