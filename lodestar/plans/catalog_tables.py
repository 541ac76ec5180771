"""Queries over labelled tables: labels, schemas, splits and preprocessing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import labels
from lodestar.functions.session import shared_dir
from lodestar.operators import metrics, preprocess, splits
from lodestar.plans.registry import query, table
from lodestar.sources import tables

NORMALIZED = "coalesce(nullif(trim(regexp_replace(lower(trim({})), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'unknown')"


@query(f"SELECT p_type AS label, {NORMALIZED.format('p_type')} AS normalized, count(*) AS n FROM part GROUP BY p_type")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("normalized", labels.normalized(F.col("label")))


@query("SELECT p_name AS label, translate(lower(trim(p_name)), ' -', '__') AS prepared, count(*) AS n FROM part GROUP BY p_name")
def label_normalize_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("prepared", labels.prepared(F.col("label")))


@query("SELECT o_orderpriority AS label, count(*) AS rows FROM orders GROUP BY o_orderpriority")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profile(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(f"""SELECT o_orderkey, {NORMALIZED.format('o_orderpriority')} AS label, o_totalprice FROM orders""")
def labeled_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "Type")
    return tables.labelled(given, drop=("o_custkey", "o_orderstatus", "o_orderdate", "absent"))


@query("""SELECT l_orderkey, l_linenumber, l_tax, CAST(NULL AS DOUBLE) AS l_weight, l_quantity, l_linestatus FROM lineitem""")
def schema_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = preprocess.Schema("l_returnflag", ("l_tax", "l_weight", "l_quantity"), ("l_linestatus",), ("l_tax", "l_weight", "l_quantity", "l_linestatus"))
    return preprocess.align(table(spark, sf_dir, "lineitem"), frozen, ("l_orderkey", "l_linenumber"))[0]


@query("""SELECT event_type AS original, CASE WHEN event_type IN ('view', 'click') THEN 'benign' ELSE 'attack' END AS label, count(*) AS n, round(avg(value), 6) AS mean_value
          FROM events GROUP BY event_type""")
def binary_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    collapsed = events.withColumn("label", F.when(F.col("event_type").isin("view", "click"), "benign").otherwise("attack"))
    return collapsed.groupBy(F.col("event_type").alias("original"), "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""SELECT vec_id, label FROM embeddings WHERE label IN (0, 1, 2, 3, 4, 5)""")
def base_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    base = e.select("label").distinct().where("label < 6")
    return e.join(F.broadcast(base), "label", "left_semi").select("vec_id", "label")


@query("""SELECT vec_id, label, CASE WHEN label <> 3 AND vec_id % 2 = 0 THEN 'train' WHEN label <> 3 THEN 'calibration' ELSE 'support' END AS role FROM embeddings""")
def holdout_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    held = e.where("label <> 3")
    parts = (held.where("vec_id % 2 = 0").withColumn("role", F.lit("train")), held.where("vec_id % 2 <> 0").withColumn("role", F.lit("calibration")), e.where("label = 3").withColumn("role", F.lit("support")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT DISTINCT o_orderstatus AS label FROM orders WHERE o_orderstatus NOT IN (SELECT l_linestatus FROM lineitem)""")
def label_validation_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"))
    return splits.missing_labels(wanted, table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("label")))


@query("""WITH a AS (SELECT DISTINCT o_orderstatus AS label FROM orders), b AS (SELECT DISTINCT l_linestatus AS label FROM lineitem), c AS (SELECT DISTINCT l_returnflag AS label FROM lineitem)
          SELECT 'union' AS op, label FROM (SELECT label FROM a UNION SELECT label FROM b UNION SELECT label FROM c)
          UNION ALL SELECT 'minus', label FROM (SELECT label FROM a EXCEPT SELECT label FROM b)
          UNION ALL SELECT 'both', label FROM (SELECT label FROM a INTERSECT SELECT label FROM b)""")
def label_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label")).distinct()
    b, c = item.select(F.col("l_linestatus").alias("label")).distinct(), item.select(F.col("l_returnflag").alias("label")).distinct()
    named = lambda df, op: df.select(F.lit(op).alias("op"), "label")
    return named(a.unionByName(b).unionByName(c).distinct(), "union").unionByName(named(a.subtract(b), "minus")).unionByName(named(a.intersect(b), "both"))


SPLIT_SQL = """WITH r AS (SELECT o_orderkey, o_orderpriority, least(count(*) OVER (PARTITION BY o_orderpriority), 2000) AS n,
                          row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3:' || o_orderkey), o_orderkey) AS r FROM orders),
               s AS (SELECT *, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 'calibration' WHEN r <= n THEN 'test' END AS split FROM r)"""


@query(SPLIT_SQL + " SELECT o_orderkey, split FROM s")
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balanced_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 2000, 3).select("o_orderkey", "split")


@query(SPLIT_SQL + " SELECT o_orderpriority, split, count(*) AS n FROM s GROUP BY ALL")
def balanced_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.balanced_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 2000, 3)
    return rows.groupBy("o_orderpriority", "split").agg(F.count(F.lit(1)).alias("n"))


RANKED_SQL = "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || vec_id), vec_id) AS rank FROM embeddings"


@query(f"SELECT vec_id, label, rank, CAST(floor((rank - 1) / 4) AS INTEGER) AS chunk FROM ({RANKED_SQL}) WHERE rank <= 10")
def kshot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chunks(splits.support(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 10, 5), 4)


@query(f"SELECT vec_id, label, CASE WHEN rank <= 2 THEN 0 WHEN rank <= 5 THEN 1 WHEN rank <= 12 THEN 2 END AS burst FROM ({RANKED_SQL})")
def support_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.bursts(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", [2, 3, 7], 5).drop("rank")


@query("""WITH c AS (SELECT label, count(*) FILTER (vec_id % 5 < 3) AS tr, count(*) FILTER (vec_id % 5 = 3) AS ca, count(*) FILTER (vec_id % 5 = 4) AS te, count(*) FILTER (vec_id % 13 = 0) AS su FROM embeddings GROUP BY label)
          SELECT label, CASE WHEN tr < 1 THEN 'no_training_rows' WHEN ca < 1 THEN 'no_calibration_rows' WHEN te < 1 THEN 'no_test_rows' WHEN su < 4 THEN 'too_little_support' END AS reason FROM c""")
def episode_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.operators.admission import skip_reason

    part = lambda cond: F.sum(F.expr(cond).cast("int"))
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(part("vec_id % 5 < 3").alias("tr"), part("vec_id % 5 = 3").alias("ca"), part("vec_id % 5 = 4").alias("te"), part("vec_id % 13 = 0").alias("su"))
    return c.select("label", skip_reason(F.col("tr"), F.col("ca"), F.col("te"), F.col("su"), 4).alias("reason"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT median(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END) AS l_quantity, median(l_extendedprice) AS l_extendedprice FROM lineitem")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    found = preprocess.medians(item, ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([tuple(found.values())], "l_quantity double, l_extendedprice double")


@query("SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1")
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.modes(table(spark, sf_dir, "part"), "p_brand")


def _scale(spark: SparkSession, sf_dir: str, scaler: str, digits: int = 6) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS)
    fitted = preprocess.fit(item, preprocess.Schema("", NUMBERS, (), NUMBERS), scaler)
    rows = preprocess.transform(item, fitted, ("l_orderkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(F.col("x")[i], digits).alias(c) for i, c in enumerate(NUMBERS)))


def _scale_sql(shift: str, spread: str) -> str:
    one = lambda c: f"round(({c} - {shift.format(c)}) / coalesce(nullif({spread.format(c)}, 0), 1), 6) AS {c}"
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_b, avg({c}) AS {c}_avg, stddev_pop({c}) AS {c}_sd, min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in NUMBERS)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(map(one, NUMBERS))} FROM lineitem, s"


@query(_scale_sql("{0}_m", "({0}_b - {0}_a)"))
def scale_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir, "robust")


@query(_scale_sql("{0}_avg", "{0}_sd"))
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir, "standard")


@query(_scale_sql("{0}_lo", "({0}_hi - {0}_lo)"))
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir, "minmax")


@query()
def scale_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir, "power", 4)


@query()
def scale_quantile_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir, "quantile", 4)


@query("""WITH v AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS v FROM orders)
          SELECT o_orderkey, list_position(v, o_orderpriority) AS hot_at, CAST(1 AS DOUBLE) AS hot_sum FROM orders, v""")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    fitted = preprocess.fit(rows.drop("o_orderkey"), preprocess.Schema("", (), ("o_orderpriority",), ("o_orderpriority",)))
    x = preprocess.transform(rows, fitted, ("o_orderkey",))
    return x.select("o_orderkey", F.array_position("x", 1.0).cast("int").alias("hot_at"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("hot_sum"))


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), k AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 9),
          v AS (SELECT list(p_brand ORDER BY p_brand) AS v FROM k)
          SELECT p_partkey, coalesce(list_position(v, p_brand), 10) AS hot_at FROM part, v""")
def onehot_infrequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    fitted = preprocess.fit(rows.drop("p_partkey"), preprocess.Schema("", (), ("p_brand",), ("p_brand",)), max_categories=10)
    x = preprocess.transform(rows, fitted, ("p_partkey",))
    return x.select("p_partkey", F.array_position("x", 1.0).cast("int").alias("hot_at"))


@query("""SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS good, try_cast(event_type AS DOUBLE) AS bad FROM events""")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", labels.number(F.regexp_extract("props", "([0-9]+)", 1)).alias("good"), labels.number(F.col("event_type")).alias("bad"))


@query("""WITH e AS (SELECT 'u' || (user_id % 50) AS tag, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, event_id AS seq, value FROM events)
          SELECT tag, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq DESC) AS r FROM e WHERE status = 'ok') WHERE r = 1""")
def resumable_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("tag"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("event_id").alias("seq"), "value")
    return tables.finished(log).select("tag", "seq", "value")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def drop_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


@query("""WITH e AS (SELECT user_id % 20 AS episode, (event_id % 5) AS ok, value FROM events),
          t AS (SELECT episode, CAST(value AS VARCHAR) AS a, CASE WHEN ok = 0 THEN 'n/a' ELSE CAST(ok AS VARCHAR) END AS b FROM e)
          SELECT count(*) AS episode_count, round(avg(try_cast(a AS DOUBLE)), 4) AS mean_a, round(avg(try_cast(b AS DOUBLE)), 4) AS mean_b, round(sum(coalesce(try_cast(b AS DOUBLE), 0)), 2) AS sum_b FROM t""")
def static_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("value").cast("string").alias("a"), F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("event_id") % 5).cast("string")).alias("b"))
    r = metrics.static_aggregate(e, ["a", "b"], ["b"])
    return r.select("episode_count", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.round("sum_b", 2).alias("sum_b"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def csv_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV files in order and read back, numbered by file and place."""
    path = f"{shared_dir(spark).rstrip('/')}/orders-{uuid.uuid4().hex}.csv"
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")).orderBy("o_orderkey").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "o_orderkey long, o_totalprice double", row_id="row_id")
