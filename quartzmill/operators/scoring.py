"""Feature scores: ANOVA F, nearest-neighbour mutual information, elimination and forest importance."""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import delete, folder, stored
from . import elimination, ranges

EULER = 0.5772156649015329
#: Cells of a matrix that the driver may hold: 64 MB of doubles.
LOCAL_CELLS = 8_000_000


def anova_f(long: DataFrame) -> DataFrame:
    """``(feature, fidx, score)``: infinite where the classes differ and nothing varies within them, null for a constant or a single class.

    One pass: counts, means and variances of the classes, which do not cancel on large offsets.
    """
    rows = long.where("value is not null and y is not null")
    classes = rows.groupBy("feature", "fidx", "y").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    # a row a class from here on
    parts = classes.groupBy("feature", "fidx").agg(F.collect_list(F.struct("n", "m", "v")).alias("c"), F.bool_and(F.col("lo") == F.col("hi")).alias("still"), (F.min("lo") < F.max("hi")).alias("varied"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("inside"))
    mean = F.aggregate("c", F.lit(0.0), lambda s, c: s + c["n"] * c["m"]) / F.col("n")
    centred = parts.withColumn("mean", mean).withColumn("between", F.aggregate("c", F.lit(0.0), lambda s, c: s + c["n"] * (c["m"] - F.col("mean")) * (c["m"] - F.col("mean"))))
    k = F.size("c")
    score = F.try_divide(F.try_divide("between", (k - 1).cast("double")), F.try_divide("inside", (F.col("n") - k).cast("double")))
    sure = F.when(F.col("still") & F.col("varied"), F.lit(float("inf"))).when(~F.col("still"), score)
    return centred.select("feature", "fidx", sure.alias("score"))


def knn_mutual_info(long: DataFrame, k: int = 3) -> DataFrame:
    """``(feature, fidx, raw, score)``: mutual information of a value and the class (Ross 2014), score clipped at 0.

    A class of n rows uses min(k, n - 1) neighbours; single rows are left out. Equal values of a
    class are counted first. The k-th distance comes from k places before and after in the class's
    order; the points strictly within it are counted by one sweep over points and bounds. Windows
    run in ranges of values: distances that may pass a range's ends are found among the rows at all ends,
    and the counts before a range come from a table of a row a range. Tables that several steps read are written
    once and go at the end; the result, a row a feature, stays.
    """
    spark, work = long.sparkSession, f"neighbours-{uuid.uuid4().hex}"
    try:
        return stored(_mutual_info(long, k, work), "mutual_info")
    finally:
        delete(spark, f"{folder(spark)}/{work}")


def _mutual_info(long: DataFrame, k: int, work: str) -> DataFrame:
    rows = long.where("value is not null and y is not null")
    values = stored(rows.groupBy("feature", "fidx", "y", "value").agg(F.count("*").alias("n")), f"{work}/values")
    sizes = values.groupBy("feature", "y").agg(F.sum("n").alias("nc")).where("nc > 1")
    cuts = stored(ranges.cut_points(values, ["feature"], "value"), f"{work}/cuts")
    known = values.join(F.broadcast(sizes), ["feature", "y"]).join(F.broadcast(cuts), "feature")  # a row a class, a row a feature
    known = ranges.with_range(known, "cuts", "value", "b").drop("cuts")
    reach = _reach(known, k, work)
    low, high = F.col("value") - F.col("r"), F.col("value") + F.col("r")
    # the sweep: a lower bound counts values <= x - r, an upper one values < x + r
    kinds = F.array(*[
        F.struct(at.alias("at"), F.lit(kind).alias("kind"), one.cast("long").alias("one"))
        for at, kind, one in ((F.col("value"), 1, F.col("n")), (low, 2, F.lit(0)), (high, 0, F.lit(0)))
    ])
    events = reach.select("feature", "fidx", "y", "value", "n", "nc", F.least(F.lit(k), F.col("nc") - 1).alias("kc"), F.inline(kinds))
    events = ranges.with_range(events.join(F.broadcast(cuts), "feature"), "cuts", "at", "b").drop("cuts")
    every = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.lit(ranges.RANGES - 1))).alias("b"))
    counts = every.join(known.groupBy("feature", "b").agg(F.sum("n").alias("c")), ["feature", "b"], "left")
    before = Window.partitionBy("feature").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("feature", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    swept = events.join(offsets, ["feature", "b"])
    upto = F.col("o") + F.sum("one").over(Window.partitionBy("feature", "b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    bounds = swept.withColumn("upto", upto).where("kind <> 1")
    inside = bounds.groupBy("feature", "fidx", "y", "value", "n", "nc", "kc").agg((F.max(F.when(F.col("kind") == 0, F.col("upto"))) - F.max(F.when(F.col("kind") == 2, F.col("upto")))).alias("m"))
    # a radius of zero has nothing strictly within but the point itself
    counted = inside.withColumn("m", F.greatest(F.col("m"), F.lit(1)))
    mean = lambda c: F.sum(F.col("n") * _psi(F.col(c))) / F.sum("n")
    out = counted.groupBy("feature", "fidx").agg(F.sum("n").alias("total"), mean("kc").alias("k_"), mean("nc").alias("c_"), mean("m").alias("m_"))
    raw = out.select("feature", "fidx", (_psi(F.col("total")) + F.col("k_") - F.col("c_") - F.col("m_")).alias("raw"))
    return raw.withColumn("score", F.greatest(F.lit(0.0), F.col("raw")))


def _reach(known: DataFrame, k: int, work: str) -> DataFrame:
    """``known(feature, fidx, y, value, n, nc, b)`` with ``r``, the distance to the min(k, nc - 1)-th nearest row of the class.

    One sort in ranges settles all but the k first and last values of a class in a range. Those are
    found again among the 2k first and last of each range, which hold their k neighbours on both sides.
    """
    own = Window.partitionBy("feature", "y", "b").orderBy("value")
    up, size = F.row_number().over(own), F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = stored(_near(known, own, k, edge=F.least(up, size - up + 1)), f"{work}/reach")
    ends = _near(marked.where(F.col("edge") <= 2 * k).drop("r"), Window.partitionBy("feature", "y").orderBy("value"), k)
    return marked.where(F.col("edge") > k).unionByName(ends.where(F.col("edge") <= k))


def _near(rows: DataFrame, order, k: int, **more) -> DataFrame:
    """``rows`` with ``more`` and ``r`` as in ``_reach``, from k rows before and after in ``order``.

    A distance takes i values before and j after; the least that holds enough rows has i + j <= k, as each value holds a row.
    """
    item = F.struct("value", "n")
    near = {f"{side}{i}": f(item, i).over(order) for i in range(1, k + 1) for side, f in (("before", F.lag), ("after", F.lead))}
    held = lambda side, i: sum((F.col(f"{side}{x}.n") for x in range(1, i + 1)), F.lit(0))
    away = lambda side, i: F.abs(F.col(f"{side}{i}.value") - F.col("value")) if i else F.lit(0.0)
    needed = F.least(F.lit(k), F.col("nc") - 1) - (F.col("n") - 1)
    found = [F.when(held("before", i) + held("after", j) >= needed, F.greatest(away("before", i), away("after", j))) for i in range(k + 1) for j in range(k + 1 - i) if i + j]
    return rows.withColumns(near | more).withColumn("r", F.when(needed <= 0, 0.0).otherwise(F.least(*found))).drop(*near)


def _psi(n):
    """Digamma of a positive whole number: an exact sum below 64, the asymptotic series from there."""
    x = n.cast("double")
    exact = F.element_at(F.array(*[F.lit(v) for v in accumulate((1.0 / i for i in range(1, 63)), initial=-EULER)]), n.cast("int"))
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return F.when(n < 64, exact).otherwise(series)


def vectors(long: DataFrame, features: list[str]) -> DataFrame:
    """``(row_id, y, features)`` as a vector column in the given order, which the column keeps; absent cells are 0."""
    from pyspark.ml.functions import array_to_vector

    wide = long.groupBy("row_id", "y").pivot("feature", features).agg(F.first("value"))
    cells = F.array(*[F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in features])
    return wide.select("row_id", "y", array_to_vector(cells).alias("features", metadata={"names": list(features)}))


def vector_names(rows: DataFrame) -> list[str] | None:
    """The features behind a vector column in their order, where the column knows them."""
    from .explain import column_names

    return column_names(rows)


def forest_importance(rows: DataFrame, features: list[str], seed: int = 42, trees: int = 100, depth: int = 30, drawn: bool = True) -> DataFrame:
    """``(feature, fidx, score)`` of an impurity-based forest with balanced classes; ``rows`` as ``vectors`` gives."""
    from .models import forest
    from .profile import with_class_weight

    model = forest(seed, trees, depth, drawn=drawn).fit(with_class_weight(rows))
    scores = [(f, i, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(scores, "feature string, fidx int, score double")


def rfe_ranks(rows: DataFrame, features: list[str], keep: int, step: int = 1, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """``(feature, fidx, rank)``: recursive elimination by the squared logistic coefficient; survivors all rank 1.

    ``step`` features go a round; squares equal to a millionth are a tie, and the first feature goes. The
    intercept is not penalised, unlike in solvers that treat it as one more coefficient. One solver
    (``elimination``) runs on sums over rows, which come from an array on the driver up to ``local_cells`` cells, and from
    blocks in Spark beyond. Rows without a class are left out; with a single class all coefficients are zero.
    """
    from pyspark.ml.functions import vector_to_array

    from .profile import with_class_weight

    data = with_class_weight(rows.where("y is not null")).select(vector_to_array("features").alias("x"), "y", "weight")
    n, classes = data.agg(F.count("*"), F.count_distinct("y")).first()
    m = len(features)
    if classes < 2:
        order = list(range(m - min(keep, m)))
        rounds = [order[i : i + step] for i in range(0, len(order), step)] + [list(range(len(order), m))]
    elif n * m <= local_cells:
        got = data.toPandas()
        rounds = elimination.eliminate(elimination.LocalRows(np.stack(got.x.to_numpy()), got.y.to_numpy(float), got.weight.to_numpy(float)), m, keep, step)
    else:
        rounds = elimination.eliminate(elimination.SparkRows(data, m), m, keep, step)
    ranks = [(f, r) for r, group in enumerate(reversed(rounds), 1) for f in group]
    return rows.sparkSession.createDataFrame([(features[i], i, float(r)) for i, r in sorted(ranks)], "feature string, fidx int, rank double")
