"""Registered queries over the supplied tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .functions import expr
from .operators import explain as X
from .operators import metrics, models, preprocess, profile, ranking, scoring, sinks, split
from .plans import run as plan
from .plans.storage import folder, stored, stored_text
from .sources import sensor_files as S

SEED = 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


r = expr.rounded


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r(F.col(c)) for c in cols})


# -- sources -------------------------------------------------------------------


@query("""
SELECT event_id AS row_id, CASE WHEN event_id % 10 < 3 THEN NULL ELSE floor(value)::DOUBLE END AS value,
  CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS y FROM events""")
def s1_token_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V._read(spark, sf_dir, "events")
    token = F.when(F.col("event_id") % 10 == 0, "NaN").when(F.col("event_id") % 10 == 1, "nan").when(F.col("event_id") % 10 == 2, "NA")
    raw = F.coalesce(token, F.floor("value").cast("string"))
    label = F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 7 == 1, 0).otherwise(-1)
    return e.select(F.col("event_id").alias("row_id"), expr.token_to_double(raw).alias("value"), expr.label_to_class(label).alias("y"))


@query("""
WITH raw AS (
  SELECT event_id AS row_id, CASE WHEN event_id % 11 = 0 THEN 'x' || strftime(ts, '%d/%m/%Y %H:%M:%S')
    WHEN event_id % 13 = 0 THEN '31/02/2008 00:00:00' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS s FROM events)
SELECT row_id, strftime(try_strptime(s, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts FROM raw""")
def s3_parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V._read(spark, sf_dir, "events")
    text = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    raw = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), text)).when(F.col("event_id") % 13 == 0, "31/02/2008 00:00:00").otherwise(text)
    return e.select(F.col("event_id").alias("row_id"), F.date_format(expr.parse_time(raw), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""
WITH l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, CASE WHEN event_id % 7 = 0 THEN 'no name' WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'F12'
  ELSE event_id || '. F' || lpad((event_id % 591 + 1)::VARCHAR, 3, '0') || CASE WHEN event_id % 5 = 0 THEN ' and F003' ELSE '' END END AS value FROM events)
SELECT line_no, regexp_extract(value, '(F[0-9]{3})', 1) AS feature FROM l WHERE regexp_extract(value, '(F[0-9]{3})', 1) <> ''""")
def s6_feature_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature list with a line an event, written as text, read again and parsed."""
    i = F.col("event_id")
    name = F.concat(i.cast("string"), F.lit(". "), expr.feature_name(i % S.N_FEATURES + 1), F.when(i % 5 == 0, " and F003").otherwise(""))
    line = F.when(i % 7 == 0, "no name").when(i % 11 == 0, "").when(i % 13 == 0, "F12").otherwise(name)
    path = stored_text(V._read(spark, sf_dir, "events").orderBy("event_id").select(line.alias("value")), "list")
    return S.parse_feature_lines(S.numbered(spark.read.text(path)), "row_id").withColumnRenamed("row_id", "line_no")


@query(f"""
WITH {V.SENSOR}, placed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)
SELECT pos AS row_id, y, strftime(DATE '2008-07-19' + (row_id % 300)::INTEGER, '%Y-%m-%d') || ' 11:55:00' AS ts, fidx, feature, value
FROM sensor JOIN placed ON row_id = vec_id""")
def j1_sensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor and label files, written in order of ids, read again and paired by position."""
    e = V._read(spark, sf_dir, "embeddings").orderBy("vec_id")
    gone = lambda i: ((F.col("vec_id") * 7 + i * 13) % 97 < 5) | (i == 63)
    missing = F.element_at(F.array(*[F.lit(t) for t in expr.MISSING_TOKENS]), (F.col("vec_id") % len(expr.MISSING_TOKENS) + 1).cast("int"))
    cells = F.transform("embedding", lambda v, i: F.when(gone(i), missing).otherwise(v.cast("double").cast("string")))
    day = F.date_format(F.date_add(F.lit("2008-07-19").cast("date"), (F.col("vec_id") % 300).cast("int")), "dd/MM/yyyy")
    label = F.format_string('%d "%s 11:55:00"', F.when(F.col("label") == 0, 1).otherwise(-1), day)
    features = stored_text(e.select(F.concat_ws(" ", cells).alias("value")), "features")
    labels = stored_text(e.select(label.alias("value")), "labels")
    rows = S.read_sensors(spark, features, labels, 64)
    cells = S.to_long(rows).join(rows.select("row_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")), "row_id")
    return cells.select("row_id", "y", "ts", "fidx", "feature", "value")


@query(f"WITH {V.SENSOR} SELECT DISTINCT fidx + 1 AS i, feature FROM sensor")
def p1_feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from the places of all cells."""
    cells = V._read(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("fidx", "value"))
    return cells.select((F.col("fidx") + 1).alias("i")).distinct().select("i", expr.feature_name(F.col("i")).alias("feature"))


@query(f"""
WITH {V.SENSOR}, m AS (SELECT printf('F%03d', p_partkey) AS feature, p_name AS meaning FROM part WHERE p_partkey % 2 = 0 AND p_partkey < 1000)
SELECT f.feature, coalesce(m.meaning, 'unknown(匿名)') AS description FROM (SELECT DISTINCT feature FROM sensor) f LEFT JOIN m USING (feature)""")
def p16_feature_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor features, described by a map of every second part's name, which is written as a YAML file and read again."""
    names = V.sensor_long(spark, sf_dir).select("feature").distinct()
    parts = V._read(spark, sf_dir, "part").where("p_partkey % 2 = 0 and p_partkey < 1000")
    lines = parts.select(F.concat(expr.feature_name(F.col("p_partkey")), F.lit(": '"), F.replace("p_name", F.lit("'"), F.lit("''")), F.lit("'")).alias("line"))
    path = sinks.write_text("\n".join(r.line for r in lines.collect()), f"{folder(spark)}/map-{uuid.uuid4().hex}.yaml")  # names of features, so below 1000
    meanings = spark.createDataFrame(list(S.read_feature_map(path).items()), "feature string, meaning string")
    return names.join(meanings, "feature", "left").select("feature", expr.described(F.col("feature"), F.col("meaning")).alias("description"))


# -- profile and preprocessing ----------------------------------------------------


@query(f"WITH {V.SENSOR} SELECT feature, fidx FROM sensor GROUP BY ALL HAVING count(value) = 0")
def g1_all_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.all_null_features(V.sensor_long(spark, sf_dir))


@query(f"WITH {V.SENSOR} SELECT DISTINCT feature, fidx FROM sensor WHERE feature IN (SELECT feature FROM sensor GROUP BY 1 HAVING count(value) > 0)")
def p3_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = V.sensor_long(spark, sf_dir)
    return profile.drop_features(long, profile.all_null_features(long)).select("feature", "fidx").distinct()


@query(f"""
WITH {V.SENSOR}, p AS (SELECT feature, count(*) AS n, count(*) - count(value) AS m FROM sensor GROUP BY 1)
SELECT count(*) AS n_features, count(*) FILTER (m > 0) AS n_with_null, count(*) FILTER (m = n) AS n_all_null, round(sum(m)::DOUBLE / sum(n)::DOUBLE, 6) AS null_rate FROM p""")
def g2_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.null_summary(V.sensor_long(spark, sf_dir)), "null_rate")


def _imputed(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        long = V.sensor_long(spark, sf_dir)
        out = preprocess.impute(long, preprocess.impute_statistics(long, strategy))
        return out.select("row_id", "feature", r(F.col("value")).alias("value"))

    return run


for _name, _strategy in (("g3_median_impute", "median"), ("g4_mean_impute", "avg")):
    _f = _imputed("mean" if _strategy == "avg" else "median")
    _f.__name__ = _name
    query(f"""
WITH {V.SENSOR}, s AS (SELECT feature, {_strategy}(value) AS m FROM sensor GROUP BY 1)
SELECT row_id, feature, round(coalesce(value, m, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS value FROM sensor JOIN s USING (feature)""")(_f)

_SCALED = """
known AS (SELECT feature FROM {fit} GROUP BY 1 HAVING count(value) > 0),
med AS (SELECT feature, median(value) AS m FROM {fit} GROUP BY 1),
filled AS (SELECT x.row_id, x.y, x.fidx, x.feature, coalesce(value, m, 0.0::DOUBLE) AS value FROM {all} x JOIN med USING (feature) JOIN known USING (feature)),
st AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std FROM {which} GROUP BY 1),
scaled AS (SELECT row_id, y, fidx, feature, (value - mean) / CASE WHEN std = 0 THEN 1.0::DOUBLE ELSE std END AS value FROM filled JOIN st USING (feature))"""


@query(f"WITH {V.SENSOR}, {_SCALED.format(fit='sensor', all='sensor', which='filled')} SELECT row_id, feature, round(value, 6) + 0.0::DOUBLE AS value FROM scaled")
def p10_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.preprocess(V.sensor_long(spark, sf_dir)).select("row_id", "feature", r(F.col("value")).alias("value"))


@query(f"""
WITH {V.ORDERS}, {_SCALED.format(fit='order_long', all='order_long', which='filled')}
SELECT feature, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(sum(abs(value)) / count(*), 6) AS mean_abs FROM scaled GROUP BY 1""")
def p10_standardize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.preprocess(V.order_long(spark, sf_dir)).groupBy("feature").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg(F.abs("value")).alias("mean_abs"))
    return _rounded(out, "lo", "hi", "mean_abs")


def _quota_sql(rows: str, size: str) -> str:
    """Class quotas by largest remainder, ranks by MD5, over a CTE of (row_id, y)."""
    return f"""
tot AS (SELECT count(*) AS total FROM {rows}),
cls AS (SELECT y, count(*) AS n, any_value(total) AS total, any_value({size})::BIGINT AS size FROM {rows}, tot GROUP BY y),
fl AS (SELECT y, n, total, size, size * n // total AS whole, size * n % total AS rest FROM cls),
quota AS (SELECT y, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= size - sum(whole) OVER () THEN 1 ELSE 0 END AS q FROM fl),
ranked AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}|' || row_id), row_id) AS nth FROM {rows})"""


_TRAIN = "total - ceil(0.2::DOUBLE * total)"
_SPLIT = "CASE WHEN nth <= q THEN 'train' ELSE 'test' END AS part FROM ranked JOIN quota USING (y)"


@query(f"""
WITH {V.SENSOR}, {V.SENSOR_ROWS}, {_quota_sql('sensor_rows', _TRAIN)}, parts AS (SELECT row_id, {_SPLIT}),
fit AS (SELECT s.* FROM sensor s JOIN parts USING (row_id) WHERE part = 'train'),
{_SCALED.format(fit='fit', all='sensor', which="(SELECT f.* FROM filled f JOIN parts USING (row_id) WHERE part = 'train')")}
SELECT row_id, feature, round(value, 6) + 0.0::DOUBLE AS value FROM scaled""")
def p10_standardize_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = V.sensor_long(spark, sf_dir)
    train = split.stratified_split(V.sensor_rows(spark, sf_dir), 0.2, SEED).where("part = 'train'").select("row_id")
    out = preprocess.preprocess(long, long.join(train, "row_id", "left_semi"))
    return out.select("row_id", "feature", r(F.col("value")).alias("value"))


@query(f"WITH {V.EVENTS} SELECT y, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM event_rows), 6) AS share FROM event_rows GROUP BY y")
def g6_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.class_balance(V.event_rows(spark, sf_dir)), "share")


@query("""
WITH d AS (SELECT toxic AS y, n_chars FROM labels JOIN documents USING (doc_id))
SELECT y, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM d GROUP BY y""")
def g6_document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V._read(spark, sf_dir, "labels").join(V._read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(F.col("toxic").alias("y")).agg(F.count("*").alias("n"), r(F.avg("n_chars")).alias("mean_chars"))


@query(f"""
WITH {V.EVENTS}, c AS (SELECT y, count(*) AS n FROM event_rows GROUP BY y)
SELECT y, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def p22_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.class_weights(V.event_rows(spark, sf_dir)), "weight")


# -- sampling ------------------------------------------------------------------


@query(f"WITH {V.SENSOR_ROWS}, {_quota_sql('sensor_rows', _TRAIN)} SELECT row_id, y, {_SPLIT}")
def m1_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(V.sensor_rows(spark, sf_dir), 0.2, SEED).select("row_id", "y", "part")


@query(f"WITH {V.EVENTS}, {_quota_sql('event_rows', 'least(200, total)')} SELECT row_id, y FROM ranked JOIN quota USING (y) WHERE nth <= q")
def m2_quick_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_sample(V.event_rows(spark, sf_dir), 200, SEED).select("row_id", "y")


@query(f"WITH {V.SENSOR_ROWS} SELECT row_id, y FROM sensor_rows ORDER BY md5('{SEED}|' || row_id), row_id LIMIT 100")
def m3_background_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.background_sample(V.sensor_rows(spark, sf_dir), 100, SEED)


@query(f"WITH {V.EVENTS}, ranked AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}|' || row_id), row_id) AS nth FROM event_rows) SELECT row_id, y, CAST((nth - 1) % 10 AS INTEGER) AS fold FROM ranked")
def m5_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_folds(V.event_rows(spark, sf_dir), 10, SEED).select("row_id", "y", "fold")


@query(f"WITH {V.SENSOR_ROWS} SELECT row_id, y FROM sensor_rows")
def u1_concat_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.stratified_split(V.sensor_rows(spark, sf_dir), 0.2, SEED)
    both = parts.where("part = 'train'").unionByName(parts.where("part = 'test'"))
    return both.select("row_id", "y").orderBy("row_id")


# -- feature scores and ranks ---------------------------------------------------------


def _anova_sql(rows: str) -> str:
    return f"""
av_c AS (SELECT feature, avg(value) AS m FROM {rows} WHERE value IS NOT NULL GROUP BY 1),
av_g AS (SELECT feature, fidx, y, count(*) AS n, sum(value - m) AS s, sum((value - m) * (value - m)) AS q, min(value) AS lo, max(value) AS hi FROM {rows} JOIN av_c USING (feature) WHERE value IS NOT NULL GROUP BY ALL),
av_t AS (SELECT feature, fidx, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, bool_and(lo = hi) AS still, min(lo) < max(hi) AS varied FROM av_g GROUP BY ALL),
anova AS (SELECT feature, fidx, CASE WHEN still AND varied THEN 'inf'::DOUBLE WHEN still THEN NULL
  ELSE ((b - s * s / n) / nullif(k - 1.0::DOUBLE, 0)) / nullif((q - b) / nullif((n - k)::DOUBLE, 0), 0) END AS score FROM av_t)"""


_ANOVA = _anova_sql("sensor")


def _sensor_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.anova_f(V.sensor_long(spark, sf_dir))


@query(f"WITH {V.SENSOR}, {V.EXTREMES}, {_anova_sql('extremes')} SELECT feature, fidx, CASE WHEN score IS NOT NULL THEN round(least(score, 1e9::DOUBLE), 6) END AS score, coalesce(isinf(score), false) AS separates FROM anova")
def g7_anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.anova_f(V.sensor_extremes(spark, sf_dir))
    infinite = F.coalesce(F.col("score") == float("inf"), F.lit(False))
    return found.select("feature", "fidx", r(F.when(F.col("score").isNotNull(), F.least("score", F.lit(1e9)))).alias("score"), infinite.alias("separates"))


@query(f"WITH {V.ORDERS}, {_anova_sql('order_long')} SELECT feature, fidx, round(score, 5) AS score FROM anova")
def g7_anova_f_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.anova_f(V.order_long(spark, sf_dir)).select("feature", "fidx", r(F.col("score"), 5).alias("score"))


_MI = """
few AS (SELECT * FROM sensor WHERE value IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS nc FROM few),
own AS (SELECT *, least(3, nc - 1) AS kc FROM sized WHERE nc > 1),
near AS (SELECT a.feature, a.fidx, a.row_id, a.value, a.nc, a.kc, abs(a.value - b.value) AS d,
    row_number() OVER (PARTITION BY a.feature, a.row_id ORDER BY abs(a.value - b.value), b.row_id) AS nth
  FROM own a JOIN own b ON a.feature = b.feature AND a.y = b.y AND a.row_id <> b.row_id),
reach AS (SELECT feature, fidx, row_id, value, nc, kc, d AS r FROM near WHERE nth = kc),
inside AS (SELECT a.feature, a.fidx, a.row_id, any_value(a.nc) AS nc, any_value(a.kc) AS kc, greatest(1, count(*) FILTER (b.value > a.value - a.r AND b.value < a.value + a.r)) AS m
  FROM reach a JOIN own b ON a.feature = b.feature GROUP BY ALL),
h AS (SELECT i AS n, -0.5772156649015329::DOUBLE + coalesce(sum(1.0::DOUBLE / nullif(i - 1, 0)) OVER (ORDER BY i), 0) AS psi FROM (SELECT row_number() OVER () AS i FROM embeddings)),
total AS (SELECT feature, count(*) AS n FROM inside GROUP BY 1),
mi AS (SELECT i.feature, i.fidx, any_value(hn.psi) + avg(hk.psi) - avg(hc.psi) - avg(hm.psi) AS raw
  FROM inside i JOIN total USING (feature) JOIN h hn ON hn.n = total.n JOIN h hk ON hk.n = i.kc JOIN h hc ON hc.n = i.nc JOIN h hm ON hm.n = i.m GROUP BY ALL)"""


@query(f"WITH {V.SENSOR}, {_MI} SELECT feature, fidx, round(raw, 6) + 0.0::DOUBLE AS raw, round(greatest(raw, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS score FROM mi")
def g8_knn_mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.knn_mutual_info(V.sensor_long(spark, sf_dir)), "raw", "score")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """All features with a value, imputed and standardised, as vectors; written once, as models pass over them often."""
    long = V.sensor_long(spark, sf_dir)
    names = [x.feature for x in long.groupBy("feature", "fidx").agg(F.count("value").alias("n")).where("n > 0").orderBy("fidx").collect()]
    return stored(scoring.vectors(preprocess.preprocess(long), names), "vectors"), names


@query()
def l10_forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.forest_importance(*_vectors(spark, sf_dir), SEED)


@query()
def l9_rfe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rfe_ranks(*_vectors(spark, sf_dir), keep=40)


_RANK = "row_number() OVER (ORDER BY {s} DESC NULLS LAST, fidx)::DOUBLE"


@query(f"WITH {V.SENSOR}, {_ANOVA}, a AS (SELECT feature, fidx, CASE WHEN fidx % 9 = 0 THEN NULL ELSE score END AS s FROM anova) SELECT feature, fidx, CASE WHEN s IS NULL THEN (SELECT count(*) FROM a)::DOUBLE ELSE {_RANK.format(s='s')} END AS rank FROM a")
def w1_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _sensor_anova(spark, sf_dir).withColumn("score", F.when(F.col("fidx") % 9 != 0, F.col("score")))
    return ranking.rank_descending(scores)


def _ranks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """By F, and by the coefficient of variation, coarsely rounded."""
    long = V.sensor_long(spark, sf_dir).where("value is not null")
    spread = long.groupBy("feature", "fidx").agg(F.round(F.stddev_pop("value"), 2).alias("score"))
    return {"f": ranking.rank_descending(_sensor_anova(spark, sf_dir)), "spread": ranking.rank_descending(spread)}


_FUSED = f"""
rf AS (SELECT feature, fidx, {_RANK.format(s='score')} AS rank_f FROM anova),
sp AS (SELECT feature, fidx, round(stddev_pop(value), 2) AS s FROM sensor WHERE value IS NOT NULL GROUP BY ALL),
rs AS (SELECT feature, fidx, {_RANK.format(s='s')} AS rank_spread FROM sp),
mean AS (SELECT feature, fidx, rank_f, rank_spread, (rank_f + rank_spread) / 2 AS mean_rank FROM rf JOIN rs USING (feature, fidx)),
fused AS (SELECT *, rank() OVER (ORDER BY mean_rank) + (count(*) OVER (PARTITION BY mean_rank) - 1) / 2.0::DOUBLE AS overall_rank FROM mean)"""


@query(f"WITH {V.SENSOR}, {_ANOVA}, {_FUSED} SELECT * FROM fused")
def w2_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse(_ranks(spark, sf_dir))


@query(f"""WITH {V.SENSOR}, {_ANOVA}, {_FUSED} SELECT corr(rank_f, rank_spread).round(6) AS spearman,
  round(count(*) FILTER (rank_f <= 20 AND rank_spread <= 20)::DOUBLE / count(*) FILTER (rank_f <= 20 OR rank_spread <= 20), 6) AS jaccard FROM fused""")
def w2_rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.agreement(_ranks(spark, sf_dir), 20), "spearman", "jaccard").select("spearman", "jaccard")


_TOP = "top AS (SELECT feature, fidx FROM fused ORDER BY mean_rank, fidx LIMIT 10)"


@query(f"WITH {V.SENSOR}, {_ANOVA}, {_FUSED}, {_TOP} SELECT row_id, feature, value FROM sensor SEMI JOIN top USING (feature)")
def p4_select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.select_top(ranking.fuse(_ranks(spark, sf_dir)), 10)
    return ranking.keep_features(V.sensor_long(spark, sf_dir), top).select("row_id", "feature", "value")


@query(f"WITH {V.SENSOR}, {_ANOVA}, {_FUSED}, {_TOP} , p AS (SELECT row_number() OVER (ORDER BY mean_rank, fidx) AS pos, feature FROM fused) SELECT pos::INTEGER AS pos, pos || '. ' || feature AS line FROM p WHERE pos <= 10")
def k2_feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.feature_lines(ranking.select_top(ranking.fuse(_ranks(spark, sf_dir)), 10))


@query(f"""
WITH {V.SENSOR}, {_ANOVA}, {_MI}, n AS (SELECT count(*) AS n FROM anova),
f AS (SELECT feature, fidx, {_RANK.format(s='score')} AS rank_f_test FROM anova),
k AS (SELECT feature, fidx, {_RANK.format(s='greatest(raw, 0.0::DOUBLE)')} AS rank_mutual_info FROM mi)
SELECT feature, fidx, rank_f_test, rank_mutual_info, true AS fused, (n * (n + 1) // 2)::BIGINT AS forest_ranks, least(40, n)::BIGINT AS kept_by_elimination, least(40, n)::BIGINT AS n_selected
FROM f JOIN k USING (feature, fidx), n""")
def l11_select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection by all four methods: ranks by F and by mutual information as they are; elimination and the forest's importance by what must hold of
    their ranks; and whether the fusion is right, by windows over the stored ranks."""
    long = V.sensor_long(spark, sf_dir)
    long = stored(profile.drop_features(long, profile.all_null_features(long)), "cells")
    chosen, fused = plan.select_features(long, plan.configured({"random_state": SEED}), quick=False)
    fused.createOrReplaceTempView("l11_ranks")
    checked = spark.sql("""
      WITH m AS (SELECT *, (rank_f_test + rank_mutual_info + rank_rfe + rank_random_forest) / 4 AS mean FROM l11_ranks),
      r AS (SELECT *, avg(place) OVER (PARTITION BY mean) AS overall FROM (SELECT *, row_number() OVER (ORDER BY mean, fidx) AS place FROM m))
      SELECT feature, fidx, rank_f_test, rank_mutual_info, abs(mean - mean_rank) < 1e-9 AND abs(overall - overall_rank) < 1e-9 AS fused, place,
        CAST(sum(rank_random_forest) OVER (PARTITION BY 1) AS BIGINT) AS forest_ranks, count_if(rank_rfe = 1) OVER (PARTITION BY 1) AS kept_by_elimination FROM r""")
    place = F.array_position(F.array(*[F.lit(f) for f in chosen]), F.col("feature"))
    right = F.col("fused") & (F.when(F.col("place") <= len(chosen), place == F.col("place")).otherwise(place == 0))
    return checked.withColumn("fused", right).drop("place").withColumn("n_selected", F.lit(len(chosen)).cast("long"))


_QUICK = f"""{V.SENSOR}, {_ANOVA}, {_MI},
f AS (SELECT feature, fidx, {_RANK.format(s='score')} AS rank_f_test FROM anova), k AS (SELECT feature, fidx, {_RANK.format(s='greatest(raw, 0.0::DOUBLE)')} AS rank_mutual_info FROM mi),
quick AS (SELECT *, (rank_f_test + rank_mutual_info) / 2 AS mean_rank FROM f JOIN k USING (feature, fidx))"""


@query(f"WITH {_QUICK} SELECT row_number() OVER (ORDER BY mean_rank, fidx)::INTEGER AS pos, feature, mean_rank FROM quick ORDER BY mean_rank, fidx LIMIT 40")
def l11_quick_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of a quick run, in order: elimination is left out of the methods."""
    long = V.sensor_long(spark, sf_dir)
    long = stored(profile.drop_features(long, profile.all_null_features(long)), "cells")
    cfg = plan.configured({"random_state": SEED, "feature_selection": {"methods": ["f_test", "mutual_info", "rfe"]}})
    chosen, fused = plan.select_features(long, cfg, quick=True)
    places = spark.createDataFrame(list(enumerate(chosen, 1)), "pos int, feature string")
    return places.join(fused.select("feature", "mean_rank"), "feature").select("pos", "feature", "mean_rank")


@query(f"WITH {V.SENSOR}, {_ANOVA}, {_FUSED} SELECT row_number() OVER (ORDER BY mean_rank, fidx)::INTEGER AS pos, feature, fidx FROM fused")
def p14_select_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More features asked for than there are: all, in order."""
    return ranking.select_top(ranking.fuse(_ranks(spark, sf_dir)), 1000)


# -- metrics -------------------------------------------------------------------

_CELLS = """count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp"""
_BER = """CASE WHEN tn + fp + fn = 0 OR tp + fp + fn = 0 THEN 1.0::DOUBLE
  ELSE (coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) + coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0)) / 2 END"""
_RATES = f"""round({_BER}, 6) AS ber, round((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 6) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


@query(f"WITH {V.SCORES} SELECT row_id, CAST(score > 0.5::DOUBLE AS INTEGER) AS by_probability, CAST(score - 0.9::DOUBLE > 0 AS INTEGER) AS by_margin FROM score_rows")
def p19_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.score_rows(spark, sf_dir)
    return rows.select("row_id", expr.predicted(F.col("score"), 0.5).alias("by_probability"), expr.predicted(F.col("score") - 0.9, 0.0).alias("by_margin"))


@query("SELECT vec_id AS row_id, embedding[64]::DOUBLE AS positive FROM embeddings")
def p23_positive_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V._read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), expr.positive_class(F.col("embedding")).cast("double").alias("positive"))


@query(f"WITH {V.SCORES} SELECT {_CELLS} FROM score_rows")
def g9_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(V.score_rows(spark, sf_dir))


@query(f"WITH {V.SCORES}, c AS (SELECT row_id % 7 AS g, {_CELLS} FROM score_rows GROUP BY 1) SELECT g, round({_BER}, 6) AS ber FROM c")
def g10_ber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.score_rows(spark, sf_dir).withColumn("g", F.col("row_id") % 7)
    return metrics.confusion(rows, ["g"]).select("g", r(metrics.balanced_error_rate()).alias("ber"))


@query(f"WITH {V.SCORES}, c AS (SELECT floor(score * 10)::BIGINT AS g, {_CELLS} FROM score_rows GROUP BY 1) SELECT g, tn, fp, fn, tp, {_RATES} FROM c")
def g11_precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.score_rows(spark, sf_dir).withColumn("g", F.floor(F.col("score") * 10))
    return _rounded(metrics.rates(metrics.confusion(rows, ["g"])), "ber", "accuracy", "precision", "recall", "f1")


def _auc_sql(rows: str, by: str) -> str:
    return f"""
pts AS (SELECT {by}, score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {rows} GROUP BY ALL),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pts),
area AS (SELECT {by}, sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * sum(n)::DOUBLE, 0) AS auc FROM run GROUP BY {by})"""


@query(f"WITH {V.SCORES}, g AS (SELECT *, row_id % 3 AS g FROM score_rows), {_auc_sql('g', 'g')} SELECT g, round(auc, 6) AS auc FROM area")
def g12_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auc(V.score_rows(spark, sf_dir).withColumn("g", F.col("row_id") % 3), ["g"]), "auc")


_PARTED = f"{_quota_sql('event_rows', _TRAIN)}, parted AS (SELECT s.*, part FROM score_rows s JOIN (SELECT row_id, {_SPLIT}) USING (row_id))"


def _record_sql(rows: str, to: str) -> str:
    """The metrics record of a CTE of (model, part, y, pred, score), names prefixed by ``to``."""
    cell = lambda name, c, part: f"SELECT model, '{name}' AS metric, {c} AS value FROM {to}_w WHERE part = '{part}'"
    cells = [cell("train_ber", "ber", "train"), cell("test_ber", "ber", "test"), *(cell(c, c, "test") for c in ("accuracy", "precision", "recall", "f1", "auc"))]
    return f"""
{to}_c AS (SELECT model, part, {_CELLS} FROM {rows} GROUP BY ALL),
{to}_p AS (SELECT model, part, score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {rows} GROUP BY ALL),
{to}_r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model, part ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {to}_p),
{to}_a AS (SELECT model, part, sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * sum(n)::DOUBLE, 0) AS auc FROM {to}_r GROUP BY ALL),
{to}_w AS (SELECT model, part, {_RATES}, round(auc, 6) AS auc FROM {to}_c JOIN {to}_a USING (model, part)),
{to} AS ({" UNION ALL ".join(cells)})"""


@query(f"WITH {V.SCORES}, {_PARTED}, m AS (SELECT *, 'fixed' AS model FROM parted), {_record_sql('m', 'record')} SELECT * FROM record")
def l7_train_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.stratified_split(V.event_rows(spark, sf_dir), 0.2, SEED).select("row_id", "part")
    rows = V.score_rows(spark, sf_dir).join(parts, "row_id").withColumn("model", F.lit("fixed"))
    return _rounded(metrics.train_test_record(rows), "value")


@query(f"""
WITH {V.SCORES}, f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}|' || row_id), row_id) - 1) % 10 AS fold FROM score_rows),
c AS (SELECT fold, {_CELLS} FROM f GROUP BY 1), b AS (SELECT {_BER} AS ber FROM c)
SELECT round(avg(ber), 6) AS mean_ber, round(stddev_pop(ber), 6) AS std_ber FROM b""")
def g13_cv_ber(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = split.stratified_folds(V.score_rows(spark, sf_dir), 10, SEED)
    return _rounded(metrics.cross_validated(folds), "mean_ber", "std_ber")


@query(f"""
WITH {V.SCORES}, c AS (SELECT CASE WHEN pred = 1 THEN 'TP' ELSE 'FN' END AS "case", row_id, score,
  row_number() OVER (PARTITION BY pred ORDER BY score DESC, row_id) AS nth FROM score_rows WHERE y = 1)
SELECT k."case", c.row_id, c.score, CASE k."case" WHEN 'TP' THEN 'true positive' ELSE 'false negative' END AS caption
FROM (VALUES ('TP'), ('FN')) k("case") LEFT JOIN c ON c."case" = k."case" AND nth = 1""")
def w5_case_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pick_cases(V.score_rows(spark, sf_dir)).withColumn("caption", expr.case_caption(F.col("case")))


_CUTS = {"logistic": 0.9, "random_forest": 0.8, "ridge": 0.9}


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of three predictions of all events, two of them alike; and as a baseline those of every second event,
    with a model that is not there and a null."""
    parts = split.stratified_split(V.event_rows(spark, sf_dir), 0.2, SEED).select("row_id", "part")
    cells = F.array(*[F.struct(F.lit(m).alias("model"), expr.predicted(F.col("score"), t).alias("pred")) for m, t in _CUTS.items()])
    rows = V.score_rows(spark, sf_dir).drop("pred").join(parts, "row_id").select("row_id", "part", "y", "score", F.inline(cells))
    rows = stored(rows, "predictions")
    before = _rounded(metrics.train_test_record(rows.where("row_id % 2 = 0")), "value")
    known = before.withColumn("value", F.when(~((F.col("model") == "ridge") & (F.col("metric") == "auc")), F.col("value")))
    return _rounded(metrics.train_test_record(rows), "value"), known.unionByName(before.where("model = 'ridge'").withColumn("model", F.lit("svm")))


_MODELS = "m AS (" + " UNION ALL ".join(f"SELECT row_id, part, y, score, '{m}' AS model, CAST(score > {t}::DOUBLE AS INTEGER) AS pred FROM parted" for m, t in _CUTS.items()) + ")"
_CURRENT = f"WITH {V.SCORES}, {_PARTED}, {_MODELS}, {_record_sql('m', 'record')}"
_COMPARE = f"""{_CURRENT}, h AS (SELECT * FROM m WHERE row_id % 2 = 0), {_record_sql('h', 'older')},
b AS (SELECT model, metric, CASE WHEN model = 'ridge' AND metric = 'auc' THEN NULL ELSE value END AS expected FROM older UNION ALL SELECT 'svm', metric, value FROM older WHERE model = 'ridge'),
j AS (SELECT model, metric, expected, value AS actual, round(abs(value - expected), 6) AS diff, coalesce(abs(value - expected) < 0.01::DOUBLE, false) AS ok
  FROM b LEFT JOIN record USING (model, metric) WHERE expected IS NOT NULL)"""


@query(f"{_CURRENT} SELECT model, value FROM record WHERE metric = 'test_ber' ORDER BY value, CASE model WHEN 'logistic' THEN 1 WHEN 'random_forest' THEN 2 ELSE 3 END LIMIT 1")
def g18_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least test error; two models tie, and the first in the registry's order wins."""
    return metrics.best_model(_records(spark, sf_dir)[0], list(models.REGISTRY))


@query(f"{_COMPARE} SELECT * FROM j")
def j3_baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.compare_baseline(*_records(spark, sf_dir)), "expected", "actual", "diff")


@query(f"{_COMPARE} SELECT coalesce(bool_and(ok), true) AS ok, (SELECT bool_and(abs(value - value) < 0.01) FROM record WHERE value IS NOT NULL) AS same FROM j")
def g19_all_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the older record, and against itself."""
    current, older = _records(spark, sf_dir)
    current = stored(current, "records")
    same = metrics.all_pass(metrics.compare_baseline(current, current)).withColumnRenamed("ok", "same")
    return metrics.all_pass(metrics.compare_baseline(current, older)).crossJoin(same)  # a row each


_NAMED = "names(model, shown) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in models.DISPLAY_NAMES.items()) + "), labels(metric, label) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in models.METRIC_NAMES.items()) + ")"


@query(f"{_CURRENT}, {_NAMED} SELECT shown AS model, label AS metric, value FROM record JOIN names USING (model) JOIN labels USING (metric)")
def k1_metrics_json_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics file of three models under their display names, written and read as a baseline."""
    record = sinks.metrics_record(_records(spark, sf_dir)[0])
    path = sinks.write_json(plan.displayed(record), f"{folder(spark)}/metrics-{uuid.uuid4().hex}.json")
    return stored(S.read_baseline(spark, path), "read")


@query(f"""{_CURRENT}, o AS (SELECT *, list_position(['train_ber', 'test_ber', 'accuracy', 'precision', 'recall', 'f1', 'auc'], metric) AS place FROM record)
SELECT model || ': ' || string_agg(metric || '=' || CASE WHEN value IS NULL THEN 'N/A' ELSE printf('%.3f', value) END, ', ' ORDER BY place) AS line, 0 AS code FROM o GROUP BY model""")
def k9_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's lines, and the exit code of a run that is its own baseline."""
    current = stored(_records(spark, sf_dir)[0], "records")
    code = sinks.exit_code(metrics.all_pass(metrics.compare_baseline(current, current)).first().ok)
    record = {m: {k: v[k] for k in models.METRIC_NAMES} for m, v in sinks.metrics_record(current).items()}
    return spark.createDataFrame([(line, code) for line in sinks.summary(record)], "line string, code int")


# -- models --------------------------------------------------------------------


def _two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items with two features."""
    from pyspark.ml.feature import VectorAssembler

    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    rows = V._read(spark, sf_dir, "lineitem").select(key, (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)


_POINTS = "pts AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity / 50.0::DOUBLE AS a, l_discount * 10.0::DOUBLE AS b FROM lineitem)"
_RIDGE = """d AS (SELECT 2.0::DOUBLE * CAST(l_returnflag = 'R' AS INTEGER) - 1 AS t, l_quantity / 50.0::DOUBLE AS a, l_discount * 10.0::DOUBLE AS b,
    (SELECT count(*) FROM lineitem)::DOUBLE / (2 * count(*) OVER (PARTITION BY l_returnflag = 'R')) AS w FROM lineitem),
m AS (SELECT sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * t) / sum(w) AS mt FROM d),
s AS (SELECT sum(w * (a - ma) * (a - ma)) + 1 AS aa, sum(w * (b - mb) * (b - mb)) + 1 AS bb, sum(w * (a - ma) * (b - mb)) AS ab,
    sum(w * (a - ma) * (t - mt)) AS s_at, sum(w * (b - mb) * (t - mt)) AS s_bt, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mt) AS mt FROM d, m),
c AS (SELECT (s_at * bb - s_bt * ab) / (aa * bb - ab * ab) AS ca, (s_bt * aa - s_at * ab) / (aa * bb - ab * ab) AS cb, ma, mb, mt FROM s)"""


@query(f"WITH {_RIDGE} SELECT round(ca, 6) AS coef_a, round(cb, 6) AS coef_b, round(mt - ca * ma - cb * mb, 6) AS intercept FROM c")
def l3_ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models.fit("ridge", _two_features(spark, sf_dir))
    row = (float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept))
    return _rounded(spark.createDataFrame([row], "coef_a double, coef_b double, intercept double"), "coef_a", "coef_b", "intercept")


@query(f"""
WITH {_RIDGE}, {_POINTS}, o AS (SELECT row_id, y, mt + ca * (a - ma) + cb * (b - mb) AS score FROM pts, c)
SELECT row_id, y, round(score, 6) + 0.0::DOUBLE AS score, CAST(score > 0 AS INTEGER) AS pred, '{models.SCORE_LABELS["margin"]}' AS score_label FROM o""")
def l3_ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model without probabilities: the margin, cut at 0."""
    rows = _two_features(spark, sf_dir)
    m = models.fit("ridge", rows)
    return _rounded(models.score(m, rows).select("row_id", "y", "score", "pred"), "score").withColumn("score_label", F.lit(models.score_label(m)))


@query(f"""
WITH {_RIDGE}, {_POINTS}, o AS (SELECT row_id, mt + ca * (a - ma) + cb * (b - mb) AS score FROM pts, c)
SELECT row_id, round(score, 6) + 0.0::DOUBLE AS score FROM o""")
def k3_model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that was saved and loaded."""
    from pyspark.ml.regression import LinearRegressionModel

    rows = _two_features(spark, sf_dir)
    path = sinks.write_model(models.fit("ridge", rows), f"{folder(spark)}/model-{uuid.uuid4().hex}")
    return _rounded(models.score(LinearRegressionModel.load(path), rows).select("row_id", "score"), "score")


_NEWTON = ", ".join(f"""
h{i} AS MATERIALIZED (SELECT any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, sum(w * (p - y)) AS g0, sum(w * (p - y) * a) + any_value(c1) AS g1,
    sum(w * (p - y) * b) + any_value(c2) AS g2, sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * a) AS h01, sum(w * p * (1 - p) * b) AS h02,
    sum(w * p * (1 - p) * a * a) + 1 AS h11, sum(w * p * (1 - p) * a * b) AS h12, sum(w * p * (1 - p) * b * b) + 1 AS h22
  FROM (SELECT g.*, n{i}.*, 1 / (1 + exp(-(c0 + c1 * a + c2 * b))) AS p FROM g, n{i})),
n{i + 1} AS MATERIALIZED (SELECT
    c0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS c0,
    c1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS c1,
    c2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS c2
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM h{i}))""" for i in range(8))


@query(f"""
WITH {_POINTS}, t AS (SELECT y, a, b, count(*)::DOUBLE AS n FROM pts GROUP BY ALL),
g AS MATERIALIZED (SELECT y, a, b, n * sum(n) OVER () / (2 * sum(n) OVER (PARTITION BY y)) AS w FROM t),
n0 AS (SELECT 0::DOUBLE AS c0, 0::DOUBLE AS c1, 0::DOUBLE AS c2), {_NEWTON}
SELECT round(c1, 4) AS coef_a, round(c2, 4) AS coef_b, round(c0, 4) AS intercept FROM n8""")
def l1_logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit on all line items; the SQL takes eight Newton steps to the same optimum."""
    m = models.fit("logistic", _two_features(spark, sf_dir))
    row = (float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept))
    found = spark.createDataFrame([row], "coef_a double, coef_b double, intercept double")
    return found.withColumns({c: r(F.col(c), 4) for c in found.columns})


def _order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, whose keys are unique, with two features."""
    from pyspark.ml.feature import VectorAssembler

    rows = V._read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 100000).alias("a"), (F.col("o_custkey") % 10 / 10).alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("row_id", "y", "features")


_ORDER_POINTS = "pts AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice / 100000.0::DOUBLE AS a, o_custkey % 10 / 10.0::DOUBLE AS b FROM orders)"


@query(f"""
WITH {_ORDER_POINTS}, f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}|' || row_id), row_id) - 1) % 10 AS fold FROM pts),
k AS (SELECT k FROM range(10) x(k)), tr AS (SELECT k, y, a, b, 1.0::DOUBLE AS n FROM f, k WHERE fold <> k),
d AS (SELECT *, 2.0::DOUBLE * y - 1 AS t, n * sum(n) OVER (PARTITION BY k) / (2 * sum(n) OVER (PARTITION BY k, y)) AS w FROM tr),
m AS (SELECT k, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * t) / sum(w) AS mt FROM d GROUP BY k),
s AS (SELECT k, sum(w * (a - ma) * (a - ma)) + 1 AS aa, sum(w * (b - mb) * (b - mb)) + 1 AS bb, sum(w * (a - ma) * (b - mb)) AS ab,
    sum(w * (a - ma) * (t - mt)) AS s_at, sum(w * (b - mb) * (t - mt)) AS s_bt, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mt) AS mt FROM d JOIN m USING (k) GROUP BY k),
c AS (SELECT k, (s_at * bb - s_bt * ab) / (aa * bb - ab * ab) AS ca, (s_bt * aa - s_at * ab) / (aa * bb - ab * ab) AS cb, ma, mb, mt FROM s),
o AS (SELECT fold, y, CAST(mt + ca * (a - ma) + cb * (b - mb) > 0 AS INTEGER) AS pred FROM f JOIN c ON fold = k),
v AS (SELECT fold, {_CELLS} FROM o GROUP BY 1), e AS (SELECT {_BER} AS ber FROM v)
SELECT round(avg(ber), 6) AS mean_ber, round(stddev_pop(ber), 6) AS std_ber FROM e""")
def l8_ridge_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds of all orders, a fit each."""
    found = plan.cross_validate("ridge", _order_features(spark, sf_dir), plan.configured({"random_state": SEED}))
    return _rounded(spark.createDataFrame([(found["mean_ber"], found["std_ber"])], "mean_ber double, std_ber double"), "mean_ber", "std_ber")


def _scored(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = _vectors(spark, sf_dir)
        return models.score(models.fit(name, rows, seed=SEED), rows).select("row_id", "y", "score", "margin", "pred")

    return run


for _name, _model in (("l1_logistic_fit", "logistic"), ("l2_forest_fit", "random_forest")):
    _f = _scored(_model)
    _f.__name__ = _name
    query()(_f)


# -- attributions ----------------------------------------------------------------

_LINEAR = f"""{V.SENSOR}, {V.SENSOR_ROWS}, {V.COEF},
med AS (SELECT feature, median(value) AS m FROM sensor GROUP BY 1),
cells AS (SELECT row_id, y, fidx, feature, coalesce(value, m, 0.0::DOUBLE) AS value FROM sensor JOIN med USING (feature) SEMI JOIN coef USING (feature)),
bgr AS (SELECT row_id FROM sensor_rows ORDER BY md5('{SEED}|' || row_id), row_id LIMIT 100),
bg AS (SELECT feature, avg(value) AS bg FROM cells SEMI JOIN bgr USING (row_id) GROUP BY 1),
phi AS (SELECT row_id, feature, fidx, value, beta * (value - bg) AS phi FROM cells JOIN coef USING (feature) JOIN bg USING (feature))"""


def _linear(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filled cells, coefficients and background."""
    long = V.sensor_long(spark, sf_dir)
    coef = V.coefficients(spark)
    cells = preprocess.impute(long, preprocess.impute_statistics(long)).join(F.broadcast(coef.select("feature")), "feature", "left_semi")
    cells = stored(cells, "filled")
    chosen = split.background_sample(V.sensor_rows(spark, sf_dir), 100, SEED).select("row_id")
    return cells, coef, cells.join(chosen, "row_id", "left_semi")


def _phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.linear_shap(*_linear(spark, sf_dir))


@query(f"WITH {_LINEAR} SELECT row_id, feature, round(phi, 6) + 0.0::DOUBLE AS phi FROM phi")
def a4_linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_phi(spark, sf_dir), "phi").select("row_id", "feature", "phi")


@query(f"""
WITH {_LINEAR}, b AS (SELECT sum(beta * bg) + 0.5::DOUBLE AS base FROM coef JOIN bg USING (feature)),
o AS (SELECT row_id, sum(beta * value) + 0.5::DOUBLE AS output FROM cells JOIN coef USING (feature) GROUP BY 1), s AS (SELECT row_id, sum(phi) AS phi_sum FROM phi GROUP BY 1)
SELECT row_id, round(phi_sum, 6) + 0.0::DOUBLE AS phi_sum, round(base, 6) AS base, round(output, 6) + 0.0::DOUBLE AS output,
  abs(base + phi_sum - output) <= 0.000001::DOUBLE * greatest(1.0::DOUBLE, abs(output)) AS consistency_ok FROM s JOIN o USING (row_id), b""")
def a9_self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, coef, bg = _linear(spark, sf_dir)
    return _rounded(X.linear_consistency(cells, coef, bg, 0.5), "phi_sum", "base", "output").drop("deviation")


_IMPORTANCE = "imp AS (SELECT feature, fidx, avg(abs(phi)) AS mean_abs, stddev_pop(abs(phi)) AS std_abs FROM phi GROUP BY ALL)"


@query(f"WITH {_LINEAR}, {_IMPORTANCE} SELECT feature, fidx, round(mean_abs, 6) AS mean_abs, round(std_abs, 6) AS std_abs, row_number() OVER (ORDER BY mean_abs DESC, fidx)::INTEGER AS rank FROM imp")
def g14_global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.global_importance(_phi(spark, sf_dir)), "mean_abs", "std_abs")


_SIDES = """placed AS (SELECT row_id, CASE WHEN phi > 0 THEN 'push' ELSE 'protect' END AS side, feature, fidx, value, phi,
  row_number() OVER (PARTITION BY row_id, phi > 0 ORDER BY abs(phi) DESC, fidx)::INTEGER AS pos FROM phi WHERE phi <> 0)"""


@query(f"WITH {_LINEAR}, {_SIDES} SELECT row_id, side, pos, feature, round(phi, 6) AS phi FROM placed WHERE pos <= 5")
def w7_push_protect_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.ranked_contributions(_phi(spark, sf_dir)), "phi").select("row_id", "side", "pos", "feature", "phi")


@query(f"WITH {_LINEAR}, p AS (SELECT row_id, feature, phi, row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, fidx)::INTEGER AS pos FROM phi) SELECT row_id, pos, feature, round(phi, 6) + 0.0::DOUBLE AS phi, CASE WHEN phi > 0 THEN 'red' ELSE 'blue' END AS colour FROM p WHERE pos <= 10")
def k7_contribution_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.plot_bars(_phi(spark, sf_dir)), "phi")


@query(f"WITH {_LINEAR}, {_IMPORTANCE} SELECT feature, round(mean_abs, 6) AS mean_abs FROM imp ORDER BY mean_abs DESC, fidx LIMIT 15")
def k5_summary_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.global_importance(_phi(spark, sf_dir)).orderBy("rank").limit(15), "mean_abs").select("feature", "mean_abs")


@query(f"WITH {_LINEAR}, {_SIDES} SELECT row_id, side, pos, printf('  %d. %s: %+.4f (value=%.3f)', pos, feature, phi, value) AS line FROM placed WHERE pos <= 5")
def k6_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.report_lines(X.ranked_contributions(_phi(spark, sf_dir)))


@query()
def k4_importance_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.importance_json(X.global_importance(_phi(spark, sf_dir)), model="fixed", shap_method="linear", output_space="decision margin", random_seed=SEED)


@query(f"""WITH {_LINEAR}, {_IMPORTANCE} SELECT 'fixed' AS model, 'linear' AS shap_method, feature, round(mean_abs, 6) AS mean_abs_shap, round(std_abs, 6) AS std_abs_shap,
  row_number() OVER (ORDER BY mean_abs DESC, fidx)::INTEGER AS rank FROM imp""")
def k4_importance_json_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of ``k4_importance_json``, read back by its field names."""
    form = "model string, shap_method string, features map<string, struct<mean_abs_shap: double, std_abs_shap: double, rank: int>>"
    record = k4_importance_json(spark, sf_dir).select(F.from_json("json", form).alias("j")).select("j.*")
    rows = record.select("model", "shap_method", F.explode("features").alias("feature", "v"))
    return _rounded(rows.select("model", "shap_method", "feature", "v.*"), "mean_abs_shap", "std_abs_shap")


@query()
def a5_tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _vectors(spark, sf_dir)
    base, phi = X.tree_shap(models.fit("random_forest", rows, seed=SEED), rows, names)
    return phi.withColumn("base", F.lit(base))


@query()
def a6_kernel_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    rows, names = _vectors(spark, sf_dir)
    model = models.fit("logistic", rows)
    beta, b = model.coefficients.toArray(), float(model.intercept)
    background = np.array([x.features.toArray() for x in split.background_sample(rows, X.KERNEL_BACKGROUND, SEED).collect()])
    explained = split.background_sample(rows, X.KERNEL_ROWS, SEED + 1)
    base, phi = X.kernel_shap(lambda x: 1 / (1 + np.exp(-(x @ beta + b))), background, explained.repartition(16), names)
    return phi.withColumn("base", F.lit(base))


_LINE_SHAP = f"""{_RIDGE}, {_POINTS}, bgr AS (SELECT row_id FROM pts ORDER BY md5('{SEED}|' || row_id), row_id LIMIT 100),
bg AS (SELECT avg(a) AS ba, avg(b) AS bb FROM pts SEMI JOIN bgr USING (row_id)),
o AS (SELECT row_id, a, b, ca * (a - ba) AS phi_a, cb * (b - bg.bb) AS phi_b, mt + ca * (a - ma) + cb * (b - mb) AS output, mt + ca * (ba - ma) + cb * (bg.bb - mb) AS base FROM pts, c, bg)"""


@query(f"""
WITH {_LINE_SHAP} SELECT row_id, 'a' AS feature, 0 AS fidx, round(a, 6) AS value, round(phi_a, 6) + 0.0::DOUBLE AS phi, round(base, 6) + 0.0::DOUBLE AS base, 'linear' AS method FROM o
UNION ALL SELECT row_id, 'b', 1, round(b, 6), round(phi_b, 6) + 0.0::DOUBLE, round(base, 6) + 0.0::DOUBLE, 'linear' FROM o""")
def a10_ridge_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole explanation of a ridge model fitted on all line items."""
    rows = _two_features(spark, sf_dir).select("row_id", "y", "features")
    background = split.background_sample(rows.select("row_id", "y"), 100, SEED).select("row_id")
    phi, base, method = X.explain(models.fit("ridge", rows), rows, rows.join(background, "row_id", "left_semi"), ["a", "b"])
    return _rounded(phi.crossJoin(F.broadcast(base)).withColumn("method", F.lit(method)), "value", "phi", "base")  # one row


def _orders_ridge(rows: str) -> str:
    """Ridge on two features of a CTE of (row_id, y, a, b): coefficients ``c``."""
    return f"""
d AS (SELECT 2.0::DOUBLE * y - 1 AS t, a, b, (SELECT count(*) FROM {rows})::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS w FROM {rows}),
m AS (SELECT sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * t) / sum(w) AS mt FROM d),
s AS (SELECT sum(w * (a - ma) * (a - ma)) + 1 AS aa, sum(w * (b - mb) * (b - mb)) + 1 AS bb, sum(w * (a - ma) * (b - mb)) AS ab,
    sum(w * (a - ma) * (t - mt)) AS s_at, sum(w * (b - mb) * (t - mt)) AS s_bt, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mt) AS mt FROM d, m),
c AS (SELECT (s_at * bb - s_bt * ab) / (aa * bb - ab * ab) AS ca, (s_bt * aa - s_at * ab) / (aa * bb - ab * ab) AS cb, ma, mb, mt FROM s)"""


@query(f"""
WITH {_ORDER_POINTS}, {_quota_sql('pts', _TRAIN)}, parts AS (SELECT row_id, {_SPLIT}), train AS (SELECT pts.* FROM pts JOIN parts USING (row_id) WHERE part = 'train'), {_orders_ridge('train')},
scored AS (SELECT row_id, mt + ca * (a - ma) + cb * (b - mb) AS score FROM pts JOIN parts USING (row_id), c WHERE part = 'test' AND y = 1),
best AS (SELECT CASE WHEN score > 0 THEN 'TP' ELSE 'FN' END AS "case", row_id, row_number() OVER (PARTITION BY score > 0 ORDER BY score DESC, row_id) AS nth FROM scored),
k AS (SELECT * FROM (VALUES ('TP'), ('FN')) v("case")), e AS (SELECT k."case", row_id FROM k LEFT JOIN best ON best."case" = k."case" AND nth = 1)
SELECT 'all' AS scenario, 'ok' AS status, "case", CASE WHEN row_id IS NULL THEN 'skipped' ELSE 'generated' END AS case_status, row_id AS wafer_id, CASE WHEN row_id IS NOT NULL THEN true END AS consistency_ok FROM e
UNION ALL SELECT 'no failures', 'ok', "case", 'skipped', NULL, NULL FROM k UNION ALL SELECT 'broken', 'failed', CASE WHEN (SELECT row_id FROM e WHERE "case" = 'TP') IS NOT NULL THEN 'TP' ELSE 'FN' END, 'failed', NULL, NULL
UNION ALL SELECT 'broken', 'failed', 'TP', 'skipped', NULL, NULL FROM e WHERE "case" = 'TP' AND row_id IS NULL
UNION ALL SELECT 'no background', 'failed', NULL, NULL, NULL, NULL UNION ALL SELECT 'off', 'disabled', NULL, NULL, NULL, NULL""")
def k8_manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation stage on all orders: with both kinds of cases, without failures in the test rows, with a record that cannot be made, without a background, and off."""
    rows = _order_features(spark, sf_dir)
    rows = stored(rows.join(split.stratified_split(rows.select("row_id", "y"), 0.2, SEED).select("row_id", "part"), "row_id"), "parted")
    train, test = rows.where("part = 'train'").drop("part"), rows.where("part = 'test'").drop("part")
    fitted = {"ridge": models.fit("ridge", train)}
    stage = lambda case_of=plan.explain_case, rows=test, **how: plan.explain_stage(fitted, "ridge", train, rows, ["a", "b"], plan.configured({"random_state": SEED, "explain": {"required": False} | how}), None, "t", case_of)

    def broken(*_):
        raise ValueError("no record")

    found = {"all": stage(), "no failures": stage(rows=test.where("y = 0")), "broken": stage(broken), "no background": stage(background_size=0), "off": stage(enabled=False)}
    states = plan.manifest_frame(spark, [m | {"run_tag": name} for name, m in found.items()])
    cases = states.select(F.col("run_tag").alias("scenario"), "status", F.explode_outer("cases").alias("case", "c"))
    return cases.select("scenario", "status", "case", F.col("c.status").alias("case_status"), F.col("c.wafer_id").alias("wafer_id"), F.col("c.consistency_ok").alias("consistency_ok"))


_MODEL_ROWS = ", ".join(f"('{m}', '{k}', '{o}', '{models.SCORE_LABELS[sc]}')" for m, k, o, sc in (
    ("logistic", "linear", "log-odds (decision margin)", "probability"), ("random_forest", "tree", "positive-class probability", "probability"), ("ridge", "linear", "decision margin", "margin")))


@query(f"WITH n AS (SELECT count(*) AS n_rows FROM embeddings) SELECT m.*, n_rows, n_rows AS n_consistent FROM n, (VALUES {_MODEL_ROWS}) m(model, method, output_space, score_label)")
def a2_all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each registered model on all rows: how it is explained, in which space, what its score is, and how many rows add up."""
    rows, names = _vectors(spark, sf_dir)
    background = stored(split.background_sample(rows, 100, SEED), "background")
    found = []
    for name in models.active_models("all"):
        model = models.fit(name, rows, seed=SEED)
        phi, base, method = X.explain(model, rows, background, names, SEED)
        check = X.self_consistency(phi, base, models.score(model, rows).select("row_id", F.col("margin").alias("output")), method)
        counts = check.agg(F.count("*").alias("n_rows"), F.count_if("consistency_ok").alias("n_consistent"))
        found.append(counts.select(F.lit(name).alias("model"), F.lit(method).alias("method"), F.lit(models.output_space(model)).alias("output_space"), F.lit(models.score_label(model)).alias("score_label"), "n_rows", "n_consistent"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {V.SENSOR} SELECT least(100, count(DISTINCT row_id)) AS n_rows, count(DISTINCT feature) AS n_features, true AS within_error FROM sensor WHERE value IS NOT NULL")
def m4_kernel_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the kernel method explains, and whether all values are within the standard error aimed at."""
    found = a6_kernel_shap(spark, sf_dir).groupBy("row_id").agg(F.count("*").alias("n"), F.max("error").alias("error"), (F.sum("phi") + F.first("base")).alias("output"))
    within = F.bool_and(F.col("error") <= X.kernel.ERROR * F.greatest(F.lit(1.0), F.abs("output")))
    return found.agg(F.count("*").alias("n_rows"), F.max("n").alias("n_features"), within.alias("within_error"))


@query(f"WITH {_LINEAR}, {_IMPORTANCE}, t AS (SELECT *, row_number() OVER (ORDER BY mean_abs DESC, fidx)::INTEGER AS rank FROM imp) SELECT rank, printf('feature %d: %s, mean contribution %.4f', rank, feature, mean_abs) AS line FROM t WHERE rank <= 5")
def p26_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines of the five most important features."""
    top = X.global_importance(_phi(spark, sf_dir)).where("rank <= 5")
    return top.select("rank", F.format_string(plan.TOP_LINE, "rank", "feature", "mean_abs").alias("line"))


@query(f"""
WITH {_ORDER_POINTS}, {_quota_sql('pts', _TRAIN)}, parts AS (SELECT row_id, {_SPLIT}), train AS (SELECT pts.* FROM pts JOIN parts USING (row_id) WHERE part = 'train'), {_orders_ridge('train')},
scored AS (SELECT row_id, a, b, mt + ca * (a - ma) + cb * (b - mb) AS score FROM pts JOIN parts USING (row_id), c WHERE part = 'test' AND y = 1),
best AS (SELECT *, CASE WHEN score > 0 THEN 'TP' ELSE 'FN' END AS "case", row_number() OVER (PARTITION BY score > 0 ORDER BY score DESC, row_id) AS nth FROM scored),
bgr AS (SELECT row_id FROM train ORDER BY md5('{SEED}|' || row_id), row_id LIMIT 100), bg AS (SELECT avg(a) AS ba, avg(b) AS bb FROM train SEMI JOIN bgr USING (row_id))
SELECT row_id AS wafer_id, "case", 1 AS y_true, CAST(score > 0 AS INTEGER) AS y_pred, round(score, 6) AS score, round(mt + ca * (ba - ma) + cb * (bb - mb), 6) AS baseline, round(score, 6) AS explained_output,
  round(score, 6) AS reconstruction, true AS consistency_ok, round(ca * (a - ba), 6) AS phi_a, round(cb * (b - bb), 6) AS phi_b FROM best, c, bg WHERE nth = 1""")
def a11_case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the hit and the miss with the highest score among the test orders."""
    rows = _order_features(spark, sf_dir)
    rows = stored(rows.join(split.stratified_split(rows.select("row_id", "y"), 0.2, SEED).select("row_id", "part"), "row_id"), "parted")
    train, test = rows.where("part = 'train'").drop("part"), rows.where("part = 'test'").drop("part")
    cfg = plan.configured({"random_state": SEED})
    found = plan.explain_stage({"ridge": models.fit("ridge", train)}, "ridge", train, test, ["a", "b"], cfg, None, "t")
    records = [c["record"] for c in found["cases"].values() if c["status"] == "generated"]
    fields = ("wafer_id", "case", "y_true", "y_pred", "score", "baseline", "explained_output", "reconstruction", "consistency_ok")
    cells = [(*(r[f] for f in fields), r["shap_values"]["a"], r["shap_values"]["b"]) for r in records]
    out = spark.createDataFrame(cells, "wafer_id long, `case` string, y_true int, y_pred int, score double, baseline double, explained_output double, reconstruction double, consistency_ok boolean, phi_a double, phi_b double")
    return _rounded(out, "score", "baseline", "explained_output", "reconstruction", "phi_a", "phi_b")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null injection -> median imputation -> standardisation -> ANOVA F -> the ten best features."""
    scores = scoring.anova_f(preprocess.preprocess(V.sensor_long(spark, sf_dir)))
    return ranking.rank_descending(scores, ("score",)).where("rank <= 10").select("rank", "feature", r(F.col("score")).alias("score"))


@query(f"""
WITH {V.SENSOR}, {_SCALED.format(fit='sensor', all='sensor', which='filled')}, {_anova_sql('scaled')}
SELECT row_number() OVER (ORDER BY score DESC, fidx)::DOUBLE AS rank, feature, round(score, 6) AS score FROM anova ORDER BY score DESC, fidx LIMIT 10""")
def flagship_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)
