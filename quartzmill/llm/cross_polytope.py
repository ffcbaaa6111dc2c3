"""Approximate nearest neighbours by cross-polytope hashing (operator 8).

Each of ``TABLES`` tables turns a vector by three rounds of random signs and the
fast Hadamard transform and hashes it to the nearest signed axis, or by two such rotations to a pair of axes, so
that a table has the square of the buckets.  A query probes, in each table, the buckets nearest to it (of pairs, those of the largest sum of its two
components); what it meets there is ranked by the inner product of the original vectors in double precision.

How many axes and probes are needed depends on how near neighbours are.  ``SAMPLE`` queries are searched exactly in one pass; the ranks at
which their neighbours' buckets are probed give the recall of every choice, and the hashes of as many vectors as ``WEIGHED`` the share of
vectors each would meet.  Of those with a recall of ``RECALL`` the one that meets least is taken.  Where neighbours are near, that is a few of many
buckets; where vectors are close to random, most of few.

Equal vectors have equal products with every query, so they are stored once
with their ``neighbours + 1`` smallest ids (no more of them can enter a list)
and searched once.  Each bucket is dealt out in blocks of at most about ``BLOCK``
vectors; a block is held as one matrix, and the queries that probe the bucket
stream past it, leaving their best ``neighbours + 1``.  Queries that met fewer
vectors than they need are searched again through all buckets of one table, so
every query gets its full list.

The hash sees directions only.  Among vectors of about equal norms the largest
products are the smallest angles, and what is among the best of all is among the
best of its own range of norms, so vectors are hashed where a range (a factor of
``RANGE``) holds ``CROWD`` of them or more.  All others, such as outliers or norms
spread thinly, are dealt out by one table, of which every query probes all buckets:
none of them can be missed.

Defined cases: null and zero vectors, vectors with a null or non-finite
component, with a null id, or of another length than most (the larger of two
equally frequent) take no part; ties go to the smaller id; rows that repeat an
id are separate candidates, except that no row of the query's own id is one; an
empty table gives no rows; texts are not read, nor are other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import ready, saved, table

TABLES = 8
#: Queries that are searched exactly to choose axes and probes, vectors that weigh the choices, the recall aimed at, and the probes of one and of two axes that are tried.
SAMPLE, WEIGHED, RECALL = 256, 8192, 0.98
TRIED = {1: (1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 48), 2: (1, 2, 4, 8, 16, 32, 64)}
NEIGHBOURS = 20
BLOCK = 8192
RANGE = 1.1
CROWD = 1024
SEED = 7
#: The second rotations' tables; what a probe costs, as a share of vectors met.
SECOND, PROBE_COST = 1000, 1e-4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """The pseudo-rotation of table ``t``."""
    signs = np.random.default_rng([SEED, t]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    """Unit vectors of a length that is a power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    most = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(most > 0, most, 1.0)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: 2 * axis, plus 1 if negative."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def buckets(x: np.ndarray, t: int, probes: int, depth: int) -> np.ndarray:
    """The ``probes`` buckets of table ``t`` nearest to each unit vector, nearest first, by ``depth`` axes."""
    y = rotated(x, t)
    if depth == 1:
        return axes(y, probes)
    other, width = rotated(x, t + SECOND), 2 * x.shape[1]
    if probes == 1:
        return axes(y, 1) * width + axes(other, 1)
    # the nearest pairs are among the nearest probes of either
    n = min(probes, width)
    a, b = axes(y, n), axes(other, n)
    value = lambda v, c: np.take_along_axis(v, c // 2, axis=1) * np.where(c % 2, -1.0, 1.0)
    sums = (value(y, a)[:, :, None] + value(other, b)[:, None, :]).reshape(len(x), -1)
    best = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis((a[:, :, None] * width + b[:, None, :]).reshape(len(x), -1), best, axis=1)


def choice(queries: np.ndarray, near: list[np.ndarray], weighed: np.ndarray, tables: int, recall: float = RECALL) -> tuple[int, int]:
    """(axes, probes) that meet least of ``weighed`` among those that find the share ``recall`` of the true neighbours ``near``
    of the sampled queries; the most thorough if none does."""
    q, w, n = padded(queries), padded(weighed), [padded(v) for v in near]
    sizes, options = np.array([len(v) for v in n]), []
    every = np.concatenate(n)
    owner = np.repeat(np.arange(len(q)), sizes)
    width = 2 * q.shape[1]
    for depth, tried in TRIED.items():
        tried = [p for p in tried if p < width]
        if not tried:
            continue
        never = tried[-1]
        found, met = np.full(len(every), never), np.full((len(q), len(w)), never, np.int16)  # the rank of the first probe that meets it, in any table
        for t in range(tables):
            probed = buckets(q, t, never, depth)
            rank = np.where(probed[owner] == buckets(every, t, 1, depth), np.arange(never), never).min(axis=1)
            found = np.minimum(found, rank)
            own, places = buckets(w, t, 1, depth)[:, 0], np.full(width**depth, never, np.int16)
            for i in range(len(q)):
                places[probed[i]] = np.arange(never)
                np.minimum(met[i], places[own], out=met[i])
                places[probed[i]] = never
        options += [((found < p).mean(), (met < p).mean() + p * PROBE_COST, depth, p) for p in tried]
    good = [o for o in options if o[0] >= recall]
    best = min(good, key=lambda o: (o[1], o[2:])) if good else max(options, key=lambda o: (o[0], -o[1]))
    return best[2], best[3]


def _exact(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """(rep, vec) -> (query, rep, score, vec): the task's k best of each sampled query, itself left out."""
    names, queries = sent.value
    best = [[] for _ in names]
    for batch in batches:
        if not batch.num_rows:
            continue
        reps, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
        scores = queries @ x.T
        for i, name in enumerate(names):
            own = np.where(reps == name, -np.inf, scores[i])
            top = np.argpartition(-own, min(k, len(own)) - 1)[:k]
            best[i] = sorted(best[i] + [(own[j], reps[j], x[j]) for j in top if own[j] > -np.inf], key=lambda r: (-r[0], r[1]))[:k]
    rows = [(i, r[1], r[0], r[2]) for i, own in enumerate(best) for r in own]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.list_(pa.float64()))], ["query", "rep", "score", "vec"])


def calibrated(dense: DataFrame, searched: DataFrame, k: int, tables: int) -> tuple[int, int]:
    """(axes, probes) for ``dense(rep, vec)`` and the queries ``searched(rep, vec)``, from bounded samples in the order of a hash."""
    spark, order = dense.sparkSession, F.xxhash64("rep", F.lit(SEED))
    some = searched.orderBy(order).limit(SAMPLE).collect()
    if not some:
        return 1, 1
    names, queries = np.array([r.rep for r in some]), np.array([r.vec for r in some], float)
    sent = spark.sparkContext.broadcast((names, queries))
    found = dense.select("rep", "vec").mapInArrow(lambda it: _exact(it, sent, k), "query long, rep long, score double, vec array<double>")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("nth") <= k)
    near: list[list] = [[] for _ in some]
    for r in best.select("query", "vec").collect():  # k rows a sampled query
        near[r.query].append(r.vec)
    weighed = np.array([r.vec for r in dense.orderBy(order).limit(WEIGHED).collect()], float)
    kept = [i for i, v in enumerate(near) if v]
    return choice(queries[kept], [np.array(near[i]) for i in kept], weighed, tables) if kept else (1, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _hashed(batches: Iterator[pa.RecordBatch], tables: list[int], probes: int, depth: int = 1) -> Iterator[pa.RecordBatch]:
    """(rep, vec) -> (bucket, rep, vec), a row for each table and probe."""
    for batch in batches:
        x = padded(_matrix(batch.column(1)))
        for t in tables:
            codes = buckets(x, t, probes, depth) + t * (2 * x.shape[1]) ** depth
            for p in range(codes.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(codes[:, p].astype(np.int64)), batch.column(0), batch.column(1)], ["bucket", "rep", "vec"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, query, rep, vec) in this order, vectors before queries -> (query, rep, score), the k best."""
    block, ids, parts, matrix = None, [], [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        if not len(keys):
            continue
        reps, vecs = batch.column(3).to_numpy(zero_copy_only=False), _matrix(batch.column(4))
        cuts = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(axis=1)])
        for s, e in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
            here = tuple(keys[s, :2])
            if here != block:
                block, ids, parts, matrix = here, [], [], None
            if not keys[s, 2]:
                ids.append(reps[s:e])
                parts.append(vecs[s:e])
                continue
            if not parts:
                continue
            if matrix is None:
                matrix, names = np.concatenate(parts), np.concatenate(ids)
            for at in range(s, e, 256):
                q = vecs[at : min(e, at + 256)]
                scores = q @ matrix.T
                n = min(k, scores.shape[1])
                # what ties with the k-th stays until the exact scores decide
                least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
                row, col = np.nonzero(scores >= (least - 1e-9 * np.abs(least) - 1e-300)[:, None])
                exact = (q[row] * matrix[col]).sum(axis=1)
                order = np.lexsort((names[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < n
                yield pa.RecordBatch.from_arrays([pa.array(reps[at + row[keep]]), pa.array(names[col[keep]]), pa.array(exact[keep])], ["query", "rep", "score"])


def _meet(vectors: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """Hashed vectors and queries -> (query, rep, score), without repeats."""
    sizes = vectors.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    # one row a bucket: twice the padded length for each table, or the square of that
    sizes = F.broadcast(sizes)
    dealt = vectors.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("query"), "rep", "vec")
    asked = queries.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "rep", "vec")
    both = dealt.union(asked).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "query")
    found = both.mapInArrow(lambda it: _search(it, k), "query long, rep long, score double")
    return found.groupBy("query", "rep").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = NEIGHBOURS, tables: int = TABLES, probes: int | None = None, depth: int = 1, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on ``vec_id``. Without ``probes``, they and the axes are chosen by ``calibrated``."""
    spark = vectors.sparkSession
    ready(spark)
    k = neighbours + 1
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == common.n)
    smallest = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("nth") <= k)
    groups = smallest.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # a repeated id may stand for several vectors, so vectors get a number of their own
    groups = groups.withColumn("least", F.element_at("ids", 1)).withColumn("rep", F.xxhash64("least", "vec"))
    groups = saved(groups.withColumn("most", F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))), "vectors")
    scaled = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.col("most")) * (x.cast("double") / F.col("most")))
    log = (F.log("most") + F.log(scaled) / 2) / F.lit(float(np.log(RANGE)))
    top, n = groups.agg(F.max(log), F.count("*")).first()
    # one row a range of norms; rounding keeps norms that differ by rounding only in one range
    ranged = groups.withColumn("range", F.round(log - F.lit(top)).cast("int"))
    crowded = ranged.groupBy("range").agg((F.count("*") >= CROWD).alias("crowded"))
    groups = saved(ranged.join(F.broadcast(crowded), "range").drop("range", "most"), "ranges")
    asked = rows.where(is_query).join(groups.select("vec", "rep"), "vec").select(F.col("vec_id").alias("query_id"), "rep")
    asked = saved(asked, "queries")
    searched = groups.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vec")

    kind = f"bucket long, rep long, vec {groups.schema['vec'].dataType.simpleString()}"
    width = 1 << max(0, (common.n - 1).bit_length())

    def hashed(df: DataFrame, which: list[int], many: int, deep: int = 1) -> DataFrame:
        return df.select("rep", "vec").mapInArrow(lambda it: _hashed(it, which, many, deep), kind)

    def through(df: DataFrame, queries: DataFrame) -> DataFrame:
        """All vectors of ``df``, by all buckets of one table."""
        return _meet(hashed(df, [0], 1), hashed(queries, [0], 2 * width), k, block)

    dense = groups.where("crowded")
    near = dense.count()
    if near > 4 * k and (probes is None or probes < 2 * width):
        which = list(range(tables))
        if probes is None:
            depth, probes = calibrated(dense, searched, k, tables)
        pairs = saved(_meet(hashed(dense, which, 1, depth), hashed(searched, which, probes, depth), k, block), "pairs")
        enough = pairs.groupBy("query").count().where(F.col("count") >= min(k, near))
        few = searched.join(enough, searched.rep == enough["query"], "left_anti")
        if not few.isEmpty():
            pairs = pairs.union(through(dense, few))
        if near < n:
            pairs = pairs.union(through(groups.where("not crowded"), searched))
        pairs = pairs.groupBy("query", "rep").agg(F.max("score").alias("score"))
    else:
        pairs = saved(through(groups, searched), "pairs")
    ids = groups.select("rep", "least", "ids")
    named = pairs.join(ids.select("rep", "least"), "rep")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "least", "rep")
    best = named.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).select("query", "rep", "score")
    lists = best.join(ids, "rep").select(F.col("query").alias("rep"), "score", F.explode("ids").alias("vec_id"))
    # the best ids and as many in reserve, should the query's own id stand for several vectors
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    lists = lists.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * k).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    mine = asked.join(lists, "rep").select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, neighbours).alias("found"))
    out = mine.select("query_id", F.posexplode("found").alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.minus")).alias("score"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
