"""Queries for gates and budgets, metrics and whole runs; the flagship query."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.exact import rounded
from lodestar.functions.session import cut, shared_dir
from lodestar.functions.vectors import squared_distance
from lodestar.operators import admission, metrics, prototypes
from lodestar.plans.catalog_vectors import BANK, CENTER, V, bank, bank_table, vectors
from lodestar.plans.registry import query, table
from lodestar.streaming import buffer, keyed

# --- gates and budgets ----------------------------------------------------

NOVEL = f"""{BANK}, nt AS (SELECT * FROM v WHERE label >= '7'), nc AS (SELECT label, {CENTER.format(x='x', t='nt')}), nd AS (SELECT nt.label, list_distance(x, center) AS d FROM nt JOIN nc USING (label)),
nk AS (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) AS r, count(*) OVER (PARTITION BY label) AS n FROM nd), nr AS (SELECT label, greatest(min(d) FILTER (r >= 0.9 * n), 1e-6) AS rho FROM nk GROUP BY label),
np AS (SELECT label, center, rho FROM nc JOIN nr USING (label))"""


def novel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.build(vectors(spark, sf_dir).where("label >= '7'"), unit="label")


def small(df: DataFrame) -> DataFrame:
    """A prototype table as a broadcast side, its size checked."""
    held = cut(df)
    if held.count() > prototypes.MAX_PROTOTYPES:
        raise ValueError("the bank is over its cap")
    return F.broadcast(held)


@query(f"""WITH {NOVEL} SELECT np.label, pr.label AS other, round(list_distance(np.center, pr.center), 6) AS distance, list_distance(np.center, pr.center) <= 0.2 * (np.rho + pr.rho) + 0.02 AS conflict FROM np, pr""")
def margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = novel_table(spark, sf_dir).select("label", "center", "rho")
    b = small(bank_table(spark, sf_dir).select(F.col("label").alias("other"), F.col("center").alias("oc"), F.col("rho").alias("orho")))
    both = a.join(b, F.col("label") != F.col("other"))
    clash = admission.margin_conflict((F.col("label"), F.col("center"), F.col("rho")), (F.col("other"), F.col("oc"), F.col("orho")), 0.2, 0.02)
    return both.select("label", "other", F.round(F.sqrt(squared_distance(F.col("center"), F.col("oc"))), 6).alias("distance"), clash.alias("conflict"))


@query(f"""WITH {BANK}, p AS (SELECT a.label, b.label AS other, list_distance(a.center, b.center) AS d FROM pr a JOIN pr b ON a.label <> b.label)
SELECT label, other, round(d, 6) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, other) AS r FROM p) WHERE r <= 3""")
def affine_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cut(bank_table(spark, sf_dir).select("label", "center"))
    b = small(a.select(F.col("label").alias("other"), F.col("center").alias("oc")))
    d = a.join(b, F.col("label") != F.col("other")).select("label", "other", F.sqrt(squared_distance(F.col("center"), F.col("oc"))).alias("d"))
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("d", "other"))).where("rank <= 3")
    return ranked.select("label", "other", F.round("d", 6).alias("distance"), "rank")


@query("""WITH w AS (SELECT l_returnflag || l_linestatus AS label, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL) SELECT label, weight FROM w WHERE label NOT IN ('NF', 'AF') ORDER BY weight, label LIMIT 1""")
def archive_victim(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("label")).agg(F.sum("l_quantity").alias("weight"))
    return admission.archive_victim(weights, ["NF", "AF"])


PENDING = """p AS (SELECT 'b' || (user_id % 40) || ':' || event_type AS item_id, event_type AS label, CASE WHEN sum(value) > 2000 THEN 'blocked' ELSE 'pending' END AS status, CAST(min(event_id) AS DOUBLE) AS created_at FROM events GROUP BY user_id % 40, event_type)"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    made = e.groupBy((F.col("user_id") % 40).alias("u"), F.col("event_type").alias("label")).agg(F.sum("value").alias("v"), F.min("event_id").cast("double").alias("created_at"))
    return made.select(F.concat(F.lit("b"), "u", F.lit(":"), "label").alias("item_id"), "label", F.when(F.col("v") > 2000, "blocked").otherwise("pending").alias("status"), F.lit("hot").alias("location"), "created_at")


@query(f"""WITH {PENDING} SELECT item_id, status, CASE WHEN r > 60 THEN 'archived' ELSE 'hot' END AS location, r > 60 AS refresh_requested FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN status = 'blocked' THEN 1 ELSE 0 END, created_at DESC, item_id DESC) AS r FROM p)""")
def pending_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.evict(pending(spark, sf_dir), 60).select("item_id", "status", "location", "refresh_requested")


@query("""WITH old AS (SELECT 'b1:' || event_type AS item_id FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type),
fresh AS (SELECT 'b1:' || event_type AS item_id, count(*) AS n FROM events GROUP BY event_type) SELECT item_id, 0 AS rows FROM old UNION ALL SELECT item_id, n FROM fresh WHERE item_id NOT IN (SELECT item_id FROM old)""")
def cache_labeled_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    have = e.where("event_type IN ('view', 'click')").select(F.concat(F.lit("b1:"), "event_type").alias("item_id"), F.col("event_type").alias("label"), F.lit(0).cast("long").alias("rows"), F.lit("pending").alias("status"), F.lit("hot").alias("location"), F.lit(0.0).alias("created_at")).distinct()
    return admission.cache_items(have, e, "b1", 1.0, "event_type").select("item_id", "rows")


@query(f"""WITH {V}, un AS (SELECT label || ':' || (row_id % 3) AS unit, label, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM v), ce AS (SELECT unit, label, list(m ORDER BY j) AS center FROM (SELECT unit, label, j, avg(c) AS m FROM un GROUP BY ALL) GROUP BY unit, label),
p AS (SELECT a.unit AS a, b.unit AS b, list_distance(a.center, b.center) AS d FROM ce a JOIN ce b ON a.label = b.label AND a.unit < b.unit) SELECT a, b, round(d, 6) AS distance FROM p ORDER BY d, a, b LIMIT 1""")
def closest_merge_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("unit_id", F.concat("label", F.lit(":"), F.col("row_id") % 3))
    b = prototypes.Bank.of(prototypes.build(rows))
    d, i, j = prototypes.closest_pair(b)
    return spark.createDataFrame([(b.ids[i], b.ids[j], round(d, 6))], "a string, b string, distance double")


@query(f"""WITH {NOVEL}, s AS (SELECT np.label, np.center AS own, pr.center AS theirs, pr.label AS other, list_cosine_similarity(np.center, pr.center) AS s FROM np, pr), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, other) AS r FROM s),
w AS (SELECT label, own, theirs, exp(s) / sum(exp(s)) OVER (PARTITION BY label) AS w FROM k WHERE r <= 3), n AS (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM nt GROUP BY label),
l AS (SELECT label, own, w, unnest(theirs) AS c, generate_subscripts(theirs, 1) AS j FROM w), m AS (SELECT label, any_value(own) AS own, j, sum(w * c) AS b FROM l GROUP BY label, j)
SELECT label, CAST(j - 1 AS INTEGER) AS j, round((1 - 0.4 / (1 + n / 5)) * own[j] + 0.4 / (1 + n / 5) * b, 6) AS x FROM m JOIN n USING (label)""")
def teen_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, few = bank(spark, sf_dir), prototypes.Bank.of(novel_table(spark, sf_dir))
    rows = [(label, j, round(float(x), 6)) for label, c, w in zip(few.labels, few.centers, few.weight, strict=True) for j, x in enumerate(prototypes.blended_center(c, w, label, base, 3, 0.4, 5.0))]
    return spark.createDataFrame(rows, "label string, j int, x double")


@query("""WITH s AS (SELECT event_id, value * exp(-0.001 * (10000 - event_id)) AS w FROM events) SELECT event_id, round(w, 6) AS w FROM s WHERE w >= 0.5""")
def decay_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("w"), F.col("event_id").alias("t"))
    return admission.decayed(s, 10000.0, 0.001, 0.5).select("event_id", rounded(F.col("w"), 6).alias("w"))


TRIM = "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events"


@query(f"SELECT event_type, event_id FROM ({TRIM}) WHERE i >= n - 25")
def trim_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.trim(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 25, "latest", "event_id")


@query(f"SELECT event_type, event_id FROM ({TRIM}) WHERE i IN (SELECT CAST(floor(k * (n - 1) / 24.0) AS BIGINT) FROM range(0, 25) t(k))")
def trim_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.trim(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 25, "uniform", "event_id")


@query()
def leverage_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("label", F.col("row_id").alias("seq"), F.col("x").alias("phi"))
    return admission.trim(rows, ["label"], 10, "leverage").select("label", "seq")


@query()
def affine_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the rows of each class from the hull of class 0's."""
    rows = vectors(spark, sf_dir)
    far = admission.hull_distances(rows, admission.hull_of(rows.where("label = '0'")))
    return far.groupBy("label").agg(F.avg("residual").alias("residual"))


@query(f"""WITH {V}, c AS (SELECT label, count(*) AS n FROM v GROUP BY label), l AS (SELECT max(n) AS l FROM c) SELECT label, l - n AS drawn FROM c, l WHERE n < l""")
def pa_inn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.plans.model import _augmented

    rows = vectors(spark, sf_dir).select("row_id", "label", F.col("x").alias("phi"))
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0  # every smaller class is filled up to it
    return _augmented(rows, largest, 7).groupBy("label").agg(F.count(F.lit(1)).alias("drawn"))


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 200")
def unknown_buffer_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.bounded(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), 200, "fifo", "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def unknown_buffer_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.bounded_by(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], 3, "event_id")


@query("SELECT event_id, value FROM events ORDER BY md5('0:' || event_id), event_id LIMIT 200")
def unknown_buffer_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.bounded(table(spark, sf_dir, "events").select("event_id", "value"), 200, "reservoir", "event_id")


@query("SELECT event_id, value, FALSE AS accepted FROM events WHERE value > 25 ORDER BY event_id DESC LIMIT 200")
def unknown_buffer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: micro-batches are scored and rejects buffered."""
    path = f"{shared_dir(spark).rstrip('/')}/buffer-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    held = buffer.Buffer(spark, f"{path}/versions", "event_id long, value double, accepted boolean", 200, seq="event_id")
    scored = lambda df: df.select("event_id", "value", (F.col("value") <= 25).alias("accepted"))
    buffer.start(stream, scored, held, f"{path}/progress").awaitTermination()
    return held.read()


@query("""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(avg(CASE WHEN value > 25 THEN 1.0 ELSE 0 END), 6) AS reject_rate FROM events GROUP BY 1""")
def windowed_reject_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") <= 25).alias("accepted"))
    return buffer.windowed_rejects(events).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("reject_rate", 6).alias("reject_rate"))


KEYED = """e AS (SELECT *, epoch_ms(ts) AS ms FROM events WHERE value > 25), m AS (SELECT max(ms) AS newest FROM e),
b AS (SELECT event_type, event_id, ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place FROM e)"""


def _twice(spark: SparkSession, name: str, rows: DataFrame, seq: str, start) -> str:
    """Run a keyed query over the earlier half of the rows, stop it, and start it
    again from its checkpoint when the later half has come. Its checkpoint."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    middle = rows.agg(F.percentile_approx(seq, 0.5)).first()[0] or 0
    for half in (F.col(seq) <= middle, F.col(seq) > middle):
        rows.where(half).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        start(stream, f"{path}/checkpoint").awaitTermination()
    return f"{path}/checkpoint"


@query(f"""WITH {KEYED} SELECT event_type AS key, event_id AS seq FROM b, m WHERE place <= 50 AND ms + 1728000000 > newest""")
def unknown_buffer_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type the last 50 rejects whose weight, halved every 10 days, is
    over a quarter: keyed state, with a restart in the middle."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.col("value").cast("string").alias("body"), (F.col("value") <= 25).alias("accepted"))
    rate = math.log(2) / (86400 * 10)
    return keyed.buffered(spark, _twice(spark, "keyed", rows, "seq", lambda stream, at: keyed.buffer_rejects(stream, at, 50, rate, 0.25))).select("key", "seq")


@query("""WITH i AS (SELECT event_type AS key, 'u' || user_id AS item_id, count(*) AS rows, min(event_id) AS seq, sum(value) > 1500 AS blocked FROM events GROUP BY event_type, user_id)
SELECT key, item_id, rows, CASE WHEN blocked THEN 'blocked' ELSE 'pending' END AS status, CASE WHEN r <= 20 THEN 'hot' ELSE 'archived' END AS location
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY blocked, seq DESC) AS r FROM i)""")
def pending_items_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending items of each type as keyed state under a budget of 20 hot ones,
    with a restart in the middle."""
    e = table(spark, sf_dir, "events")
    made = e.groupBy(F.col("event_type").alias("key"), "user_id").agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("seq"), F.min("ts").cast("timestamp").alias("at"), (F.sum("value") > 1500).alias("blocked"))
    rows = made.select("key", "seq", F.when(F.col("blocked"), "blocked").otherwise("cached").alias("event"), F.concat(F.lit("u"), "user_id").alias("item_id"), F.col("key").alias("label"), "rows", "at")
    found = keyed.items(spark, _twice(spark, "pending", rows, "seq", lambda stream, at: keyed.pending_items(stream, at, 20)))
    return found.select("key", "item_id", "rows", "status", "location")


# --- metrics --------------------------------------------------------------

PRED = """p AS (SELECT l_linenumber - 1 AS session_id, l_orderkey AS k, lower(l_returnflag || l_linestatus) AS t, (l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 10 AS m, l_discount * 10 + l_tax AS score, 0.55 AS threshold FROM lineitem),
pred AS (SELECT session_id, k, t AS true_label, CASE WHEN m < 6 THEN t WHEN m < 8 THEN 'unknown' WHEN m = 8 THEN 'nf' ELSE 'rf' END AS predicted_label, NOT (m = 6 OR m = 7) AS accepted, score, threshold, CASE WHEN m = 0 THEN 'provisional' WHEN m = 1 THEN 'fragile_stable' ELSE 'stable' END AS status FROM p),
ad AS (SELECT * FROM (VALUES (1, 'ro'), (2, 'ro'), (2, 'rf'), (3, 'ro'), (3, 'rf'), (4, 'ro'), (4, 'rf'), (5, 'ro'), (5, 'rf'), (6, 'ro'), (6, 'rf'), (6, 'ao')) a(session_id, label)),
fl AS (SELECT pred.*, true_label IN ('af', 'nf', 'no') OR ad.label IS NOT NULL AS known FROM pred LEFT JOIN ad ON pred.session_id = ad.session_id AND true_label = ad.label),
one AS (SELECT *, CASE WHEN known THEN true_label ELSE 'unknown' END AS c FROM fl)"""
SESSIONS = PRED + """, base AS (SELECT session_id, count(*) AS n_samples, count(*) FILTER (known) AS n_true_known, count(*) FILTER (NOT known) AS n_true_unknown,
 coalesce(avg(CASE WHEN predicted_label = true_label THEN 1.0 ELSE 0 END) FILTER (known), 0) AS ccr, coalesce(avg(CASE WHEN predicted_label = 'unknown' THEN 1.0 ELSE 0 END) FILTER (NOT known), 0) AS tur,
 count(*) FILTER (predicted_label = 'unknown' AND NOT known) AS tp, count(*) FILTER (predicted_label = 'unknown' AND known) AS fp, count(*) FILTER (predicted_label <> 'unknown' AND NOT known) AS fn FROM one GROUP BY session_id),
cl AS (SELECT session_id, c FROM base, (VALUES ('af'), ('nf'), ('no'), ('unknown')) x(c) UNION SELECT session_id, label FROM ad),
f1 AS (SELECT cl.session_id, cl.c, count(*) FILTER (one.c = cl.c AND predicted_label = cl.c) AS h, count(*) FILTER (one.c = cl.c) AS a, count(*) FILTER (predicted_label = cl.c) AS b FROM cl JOIN one USING (session_id) GROUP BY cl.session_id, cl.c),
mf AS (SELECT session_id, avg(CASE WHEN a + b > 0 THEN 2.0 * h / (a + b) ELSE 0 END) AS macro FROM f1 GROUP BY session_id),
se AS (SELECT session_id, n_samples, n_true_known, n_true_unknown, round(ccr, 4) AS ccr, round(tur, 4) AS tur, round(CASE WHEN ccr + tur > 0 THEN 2 * ccr * tur / (ccr + tur) ELSE 0 END, 4) AS os_hm,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1_unknown, round(macro, 4) AS macro_f1_with_unknown FROM base JOIN mf USING (session_id))"""
BASE = ["af", "nf", "no"]
ADMITTED = [(1, "ro"), (2, "ro"), (2, "rf"), (3, "ro"), (3, "rf"), (4, "ro"), (4, "rf"), (5, "ro"), (5, "rf"), (6, "ro"), (6, "rf"), (6, "ao")]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    t, m = F.lower(F.concat("l_returnflag", "l_linestatus")), (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")) % 10
    said = F.when(m < 6, t).when(m < 8, "unknown").when(m == 8, "nf").otherwise("rf")
    status = F.when(m == 0, "provisional").when(m == 1, "fragile_stable").otherwise("stable")
    return item.select((F.col("l_linenumber") - 1).alias("session_id"), F.col("l_orderkey").alias("k"), t.alias("true_label"), said.alias("predicted_label"), (~((m == 6) | (m == 7))).alias("accepted"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("score"), F.lit(0.55).alias("threshold"), status.alias("best_prototype_status"))


def admitted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADMITTED, "session_id int, label string")


@query(f"WITH {SESSIONS} SELECT * FROM se")
def openset_session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.session_metrics(predictions(spark, sf_dir), BASE, admitted(spark))


@query(f"WITH {SESSIONS} SELECT round(avg(os_hm), 6) AS os_hm, round(avg(ccr), 6) AS ccr, round(avg(tur), 6) AS tur, round(avg(f1_unknown), 6) AS f1_unknown, round(avg(macro_f1_with_unknown), 6) AS macro_f1_with_unknown FROM se WHERE n_true_unknown > 0")
def openset_run_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_metrics(openset_session_metrics(spark, sf_dir), 6)


@query(f"""WITH {PRED}, r AS (SELECT *, true_label IN ('af', 'nf', 'no') AS kn, round(score / threshold, 9) AS s FROM pred),
kc AS (SELECT unnest(['af', 'nf', 'no']) AS c), kf AS (SELECT c, count(*) FILTER (true_label = c AND predicted_label = c) AS h, count(*) FILTER (true_label = c) AS a, count(*) FILTER (predicted_label = c) AS b FROM r, kc WHERE kn GROUP BY c),
kt AS (SELECT sum(a * a) AS aa FROM (SELECT count(*) AS a FROM r WHERE kn GROUP BY true_label)), kp AS (SELECT sum(b * b) AS bb FROM (SELECT count(*) AS b FROM r WHERE kn GROUP BY predicted_label)),
kx AS (SELECT sum(a * b) AS ab FROM (SELECT true_label AS c, count(*) AS a FROM r WHERE kn GROUP BY 1) JOIN (SELECT predicted_label AS c, count(*) AS b FROM r WHERE kn GROUP BY 1) USING (c)),
ks AS (SELECT CAST(count(*) AS DOUBLE) AS s, count(*) FILTER (true_label = predicted_label) AS c FROM r WHERE kn),
g AS (SELECT s, count(*) FILTER (NOT kn) AS p, count(*) FILTER (kn) AS n FROM r GROUP BY s), o AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS b, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p + n) OVER (ORDER BY s DESC) AS k FROM g)
SELECT count(*) FILTER (accepted) AS accepted_count, count(*) FILTER (NOT accepted) AS rejected_count, count(*) AS total_rows,
 round(avg(CASE WHEN (kn AND accepted AND true_label = predicted_label) OR (NOT kn AND NOT accepted) THEN 1.0 ELSE 0 END), 6) AS overall_open_set_accuracy, round(avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0 END) FILTER (accepted), 6) AS accepted_accuracy,
 round(avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0 END) FILTER (kn), 6) AS known_class_accuracy, round(avg(CASE WHEN NOT accepted THEN 1.0 ELSE 0 END) FILTER (NOT kn), 6) AS unknown_rejection_rate, round(avg(CASE WHEN accepted THEN 1.0 ELSE 0 END) FILTER (NOT kn), 6) AS false_known_rate,
 (SELECT round(sum(CASE WHEN a + b > 0 THEN 2.0 * h / (a + b) ELSE 0 END) / 3, 6) FROM kf) AS known_macro_f1, (SELECT round((c * s - ab) / (sqrt(s * s - bb) * sqrt(s * s - aa)), 6) FROM ks, kt, kp, kx) AS known_mcc,
 (SELECT round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6) FROM o) AS unknown_rejection_auroc, (SELECT round(sum(p * tp / k) / sum(p), 6) FROM o) AS unknown_rejection_aupr FROM r""")
def open_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.summary(predictions(spark, sf_dir), BASE)
    shares = ("overall_open_set_accuracy", "accepted_accuracy", "known_class_accuracy", "unknown_rejection_rate", "false_known_rate", "known_macro_f1", "known_mcc", "unknown_rejection_auroc", "unknown_rejection_aupr")
    return found.select("accepted_count", "rejected_count", "total_rows", *(F.round(c, 6).alias(c) for c in shares))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = predictions(spark, sf_dir)
    return pred.select("session_id", (~F.col("true_label").isin(BASE)).alias("unknown"), F.round(metrics.rejection_score(pred), 6).alias("r"))


RANKED = f"WITH {PRED}, x AS (SELECT session_id, true_label NOT IN ('af', 'nf', 'no') AS u, round(score / threshold, 6) AS r FROM pred)"


@query(RANKED + """, g AS (SELECT session_id, r, count(*) FILTER (u) AS p, count(*) FILTER (NOT u) AS n FROM x GROUP BY session_id, r), c AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY r) - n AS b FROM g)
SELECT session_id, round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6) AS auroc FROM c GROUP BY session_id""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(_ranked(spark, sf_dir), ["session_id"], "unknown", "r").withColumn("auroc", F.round("auroc", 6))


@query(RANKED + """, g AS (SELECT session_id, r, count(*) FILTER (u) AS p, count(*) AS m FROM x GROUP BY session_id, r), c AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS k FROM g WINDOW w AS (PARTITION BY session_id ORDER BY r DESC))
SELECT session_id, round(sum(p * tp / k) / sum(p), 6) AS aupr FROM c GROUP BY session_id""")
def aupr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aupr(_ranked(spark, sf_dir), ["session_id"], "unknown", "r").withColumn("aupr", F.round("aupr", 6))


@query("""WITH x AS (SELECT quality AS t, toxic AS p, CAST(doc_id % 4 AS INTEGER) AS g FROM labels), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS s, sum(CASE WHEN t = p THEN 1.0 ELSE 0 END) AS c, sum(t) AS t1, sum(p) AS p1 FROM x GROUP BY g)
SELECT g, round(coalesce((c * s - (t1 * p1 + (s - t1) * (s - p1))) / nullif(sqrt(s * s - (p1 * p1 + (s - p1) * (s - p1))) * sqrt(s * s - (t1 * t1 + (s - t1) * (s - t1))), 0), 0), 6) AS mcc FROM s""")
def mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("true_label"), F.col("toxic").alias("predicted_label"), (F.col("doc_id") % 4).cast("int").alias("g"))
    return metrics.mcc(rows, ["g"]).withColumn("mcc", F.round("mcc", 6))


@query(f"""WITH {PRED}, c AS (SELECT unnest(['af', 'nf', 'no', 'rf', 'zz']) AS c), f AS (SELECT session_id, c, count(*) FILTER (true_label = c AND predicted_label = c) AS h, count(*) FILTER (true_label = c) AS a, count(*) FILTER (predicted_label = c) AS b FROM pred, c GROUP BY session_id, c)
SELECT session_id, round(sum(CASE WHEN a + b > 0 THEN 2.0 * h / (a + b) ELSE 0 END) / 5, 6) AS macro_f1 FROM f GROUP BY session_id""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(c,) for c in ("af", "nf", "no", "rf", "zz")], "c string")
    return metrics.macro_f1(predictions(spark, sf_dir), ["session_id"], classes).withColumn("macro_f1", F.round("macro_f1", 6))


RECORD = PRED + """, rec AS (SELECT session_id, avg(CASE WHEN predicted_label = true_label THEN 1.0 ELSE 0 END) FILTER (known) AS o, coalesce(avg(CASE WHEN predicted_label = true_label THEN 1.0 ELSE 0 END) FILTER (true_label IN ('af', 'nf', 'no')), 0) AS b,
 coalesce(avg(CASE WHEN predicted_label = true_label THEN 1.0 ELSE 0 END) FILTER (known AND true_label NOT IN ('af', 'nf', 'no')), 0) AS n, coalesce(avg(CASE WHEN predicted_label = 'unknown' THEN 1.0 ELSE 0 END) FILTER (NOT known), 0) AS u FROM fl GROUP BY session_id)"""


@query(f"WITH {RECORD} SELECT session_id, round(o, 6) AS overall_accuracy, round(b, 6) AS base_accuracy, round(n, 6) AS novel_accuracy, round(u, 6) AS unknown_rejection_rate, round(CASE WHEN b + n > 0 THEN 2 * b * n / (b + n) ELSE 0 END, 6) AS harmonic_mean FROM rec")
def fscil_session_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.session_record(predictions(spark, sf_dir), BASE, admitted(spark))
    return found.select("session_id", *(F.round(c, 6).alias(c) for c in ("overall_accuracy", "base_accuracy", "novel_accuracy", "unknown_rejection_rate", "harmonic_mean")))


@query(f"""WITH {RECORD} SELECT round(arg_min(o, session_id), 6) AS first, round(arg_max(o, session_id), 6) AS last, round(avg(o) FILTER (session_id > 0), 6) AS mean_novel, count(*) AS sessions, round((arg_min(o, session_id) - arg_max(o, session_id)) / arg_min(o, session_id), 6) AS dropping_rate FROM rec""")
def fscil_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.run_summary(metrics.session_record(predictions(spark, sf_dir), BASE, admitted(spark)))
    return found.select("sessions", *(F.round(c, 6).alias(c) for c in ("first", "last", "mean_novel", "dropping_rate")))


@query(f"""WITH {PRED} SELECT session_id, count(*) AS n, round(avg(CASE WHEN accepted AND status = 'provisional' THEN 1.0 ELSE 0 END), 6) AS provisional_rate, round(avg(CASE WHEN accepted AND status = 'fragile_stable' THEN 1.0 ELSE 0 END), 6) AS fragile_rate,
 round(count(*) FILTER (true_label = 'rf' AND predicted_label = 'rf') / CAST(count(*) FILTER (predicted_label = 'rf') AS DOUBLE), 6) AS new_precision, round(count(*) FILTER (true_label = 'rf' AND predicted_label = 'rf') / CAST(count(*) FILTER (true_label = 'rf') AS DOUBLE), 6) AS new_recall,
 round(2.0 * count(*) FILTER (true_label = 'rf' AND predicted_label = 'rf') / (count(*) FILTER (true_label = 'rf') + count(*) FILTER (predicted_label = 'rf')), 6) AS new_f1 FROM pred GROUP BY session_id""")
def stage_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.stage_record(predictions(spark, sf_dir), ["session_id"], F.lit("rf"))
    return found.select("session_id", "n", *(F.round(c, 6).alias(c) for c in ("provisional_rate", "fragile_rate", "new_precision", "new_recall", "new_f1")))


@query("""WITH s AS (SELECT l_suppkey AS episode, l_linenumber AS stage, avg(l_discount) AS v, l_linenumber % 2 = 0 AS f FROM lineitem GROUP BY ALL)
SELECT episode, round(arg_min(v, stage), 6) AS pre, round(arg_max(v, stage), 6) AS final, round(arg_max(v, stage) FILTER (f), 6) AS after_refresh, count(*) AS stages, round(arg_max(v, stage) - arg_min(v, stage), 6) AS damage FROM s GROUP BY episode""")
def episode_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("episode"), F.col("l_linenumber").alias("stage")).agg(F.avg("l_discount").alias("v")).withColumn("is_refresh", F.col("stage") % 2 == 0)
    found = metrics.episode_record(stages, "episode", "stage", "v")
    return found.select("episode", "stages", *(F.round(c, 6).alias(c) for c in ("pre", "final", "after_refresh", "damage")))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, arg_min(l_returnflag, (-n, l_returnflag)) AS l_returnflag, max(n) AS votes FROM c GROUP BY l_orderkey""")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vote(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_shipmode_like AS dataset, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd_pop, round(stddev_samp(v), 6) AS sd_samp, count(*) AS seeds FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like, l_linenumber, avg(l_tax) AS v FROM lineitem GROUP BY ALL) GROUP BY l_shipmode_like")
def seed_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("dataset"), "l_linenumber").agg(F.avg("l_tax").alias("v"))
    found = metrics.seeds(runs, "dataset", "v")
    return found.select("dataset", "seeds", *(F.round(c, 6).alias(c) for c in ("mean", "sd_pop", "sd_samp")))


@query("WITH m AS (SELECT p_type AS arm, avg(p_retailprice) AS mean FROM part GROUP BY p_type) SELECT arm, round(mean, 6) AS mean, round(mean - (SELECT mean FROM m WHERE arm = 'ECONOMY'), 6) AS delta FROM m")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.ablation(table(spark, sf_dir, "part").withColumnRenamed("p_type", "arm"), "arm", "p_retailprice", "ECONOMY")
    return found.select("arm", F.round("mean", 6).alias("mean"), F.round("delta", 6).alias("delta"))


@query("""WITH p AS (SELECT user_id AS k, round(avg(value) / 10000, 9) AS p FROM events GROUP BY user_id), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, k) AS rank FROM p), h AS (SELECT *, max(least(1.0, p * (m - rank + 1))) OVER (ORDER BY p, k) AS h FROM r)
SELECT k, p, rank, round(h, 6) AS holm_p, h < 0.05 AS significant FROM h""")
def holm_stepdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", "value")
    # A sum of doubles depends on its order: each user's values are added by event, however the table is split.
    placed = events.repartition("k").sortWithinPartitions("k", "event_id", "value")
    p = placed.groupBy("k").agg(rounded(F.avg("value") / 10000, 9).alias("p"))
    return metrics.holm(p, "k", "p").withColumn("holm_p", rounded(F.col("holm_p"), 6))


@query("""WITH r AS (SELECT l_returnflag AS dataset, l_linestatus AS method, l_linenumber AS seed, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY ALL)
SELECT a.dataset, b.method, round(avg(a.v), 6) AS ours, round(avg(b.v), 6) AS theirs, CAST(sum(CASE WHEN a.v > b.v THEN 1 ELSE 0 END) AS BIGINT) AS seeds_won, round(avg(a.v - b.v) / (stddev_samp(a.v - b.v) / sqrt(count(*))), 4) AS t
FROM r a JOIN r b ON a.dataset = b.dataset AND a.seed = b.seed AND a.method = 'F' AND b.method <> 'F' GROUP BY a.dataset, b.method""")
def paired_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_discount"), 6).alias("v"))
    mine = runs.where("method = 'F'").select("dataset", "seed", F.col("v").alias("a"))
    pairs = runs.where("method <> 'F'").join(mine, ["dataset", "seed"]).withColumn("d", F.col("a") - F.col("v"))
    t = F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))))
    return pairs.groupBy("dataset", "method").agg(F.round(F.avg("a"), 6).alias("ours"), F.round(F.avg("v"), 6).alias("theirs"), F.sum((F.col("a") > F.col("v")).cast("long")).alias("seeds_won"), F.round(t, 4).alias("t"))


@query()
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("v"))
    return metrics.significance(runs, ["dataset"], "method", "seed", "v", "F")


@query(f"WITH {SESSIONS} SELECT session_id, round(ccr - lag(ccr) OVER (ORDER BY session_id), 6) AS delta, round(ccr - first_value(ccr) OVER (ORDER BY session_id), 6) AS since_first FROM se")
def session_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.session_deltas(openset_session_metrics(spark, sf_dir).withColumn("run", F.lit(0)), ["run"], "session_id", "ccr")
    return found.select("session_id", F.round("delta", 6).alias("delta"), F.round("since_first", 6).alias("since_first"))


# --- whole runs -----------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text counted at a time.
COUNTED = 1 << 20
UNSEEN = "es"


def letter_features(docs: DataFrame) -> DataFrame:
    """row_id, label, split, x: frequencies of 26 letters in a whole text.

    The bytes of each text are counted once in Arrow batches; 26 replacements
    in the JVM read them 26 times (2 s against 4.5 s for the flagship at sf0.1)."""

    def letters(text: pa.Scalar) -> np.ndarray:
        data, first = np.frombuffer(text.as_buffer(), np.uint8), ord(LETTERS[0])
        found = np.zeros(256, np.int64)
        for at in range(0, len(data), COUNTED):
            found += np.bincount(data[at : at + COUNTED], minlength=256)
        return found[first : first + 26]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.maximum(batch.column(4).to_numpy(), 1)
            counts = np.array([letters(t) for t in batch.column(3)]).reshape(-1, 26)
            x = pa.FixedSizeListArray.from_arrays(pa.array((counts / n[:, None]).ravel()), 26).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], names=["row_id", "label", "split", "x"])

    low = F.lower("text")
    split = F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "calibration").otherwise("test")
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), split.alias("split"), low.cast("binary").alias("t"), F.char_length(low).alias("n"))
    return rows.mapInArrow(count, "row_id long, label string, split string, x array<double>")


FEATURES_SQL = f"""d AS (SELECT doc_id, lang AS label, doc_id % 5 AS s, lower(text) AS t FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
f AS (SELECT doc_id, label, s, [(length(t) - length(replace(t, c, ''))) / CAST(greatest(length(t), 1) AS DOUBLE) FOR c IN [{', '.join(f"'{c}'" for c in LETTERS)}]] AS x FROM d),
tr AS (SELECT * FROM f WHERE s < 3 AND label <> '{UNSEEN}'), st AS (SELECT list(m ORDER BY j) AS m, list(sd ORDER BY j) AS sd FROM (SELECT j, avg(c) AS m, coalesce(nullif(stddev_pop(c), 0), 1) AS sd FROM (SELECT unnest(x) AS c, generate_subscripts(x, 1) AS j FROM tr) GROUP BY j)),
z AS (SELECT doc_id, label, s, list_transform(x, lambda e, i: (e - m[i]) / sd[i]) AS x FROM f, st), zt AS (SELECT * FROM z WHERE s < 3 AND label <> '{UNSEEN}'), ce AS (SELECT label, {CENTER.format(x='x', t='zt')}),
di AS (SELECT zt.label, center, list_distance(x, center) AS d FROM zt JOIN ce USING (label)), rk AS (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) AS r, count(*) OVER (PARTITION BY label) AS n FROM di),
pr AS (SELECT label, center, rho FROM ce JOIN (SELECT label, greatest(min(d) FILTER (r >= 0.9 * n), 1e-6) AS rho FROM rk GROUP BY label) USING (label)),
ta AS (SELECT quantile_cont(list_distance(x, center) / rho, 0.85) AS tau FROM z JOIN pr USING (label) WHERE s = 3),
pd AS (SELECT doc_id, z.label AS t, min(list_distance(x, center) / rho) AS v, arg_min(pr.label, (list_distance(x, center) / rho, pr.label)) AS p FROM z, pr WHERE s = 4 GROUP BY doc_id, z.label),
q AS (SELECT count(*) AS n_rows, count(*) FILTER (t = '{UNSEEN}') AS n_unknown, avg(CASE WHEN p = t AND NOT v > tau THEN 1.0 ELSE 0 END) FILTER (t <> '{UNSEEN}') AS ccr, avg(CASE WHEN v > tau THEN 1.0 ELSE 0 END) FILTER (t = '{UNSEEN}') AS tur, any_value(tau) AS tau FROM pd, ta)"""


@query(f"WITH {FEATURES_SQL} SELECT n_rows, n_unknown, round(ccr, 6) AS ccr, round(tur, 6) AS tur, round(CASE WHEN ccr + tur > 0 THEN 2 * ccr * tur / (ccr + tur) ELSE 0 END, 6) AS os_hm, round(tau, 6) AS tau FROM q")
def flagship_open_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter frequencies, one prototype for each seen language, a calibrated
    threshold, and the open-set score on a language never seen."""
    from lodestar.functions.labels import harmonic
    from lodestar.operators import calibration, scoring
    from lodestar.plans.model import calibration_scores

    rows = cut(letter_features(table(spark, sf_dir, "documents")))
    seen = F.col("label") != UNSEEN
    train = rows.where((F.col("split") == "train") & seen)
    stats = train.select(F.posexplode("x").alias("j", "c")).groupBy("j").agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s")).orderBy("j").collect()
    mean, spread = F.array(*(F.lit(r["m"]) for r in stats)), F.array(*(F.lit(r["s"] or 1.0) for r in stats))
    z = cut(rows.withColumn("x", F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), spread, lambda a, b: a / b)))
    bank_ = prototypes.Bank.of(prototypes.build(z.where((F.col("split") == "train") & seen), unit="label"))
    tau = calibration.quantile(calibration_scores(z.where((F.col("split") == "calibration") & seen), bank_, vector="x").where("kind = 'pos'"), 0.85, 1.0)
    test = z.where(F.col("split") == "test")
    found = scoring.predict(test, bank_, scoring.Rule(), tau, keep=("label",))
    known, hit = F.col("label") != UNSEEN, F.col("predicted_label") == F.col("label")
    share = lambda x, of: F.avg(F.when(of, F.coalesce(x.cast("double"), F.lit(0.0))))
    out = found.agg(F.count(F.lit(1)).alias("n_rows"), F.sum((~known).cast("long")).alias("n_unknown"), share(hit, known).alias("ccr"), share(~F.col("accepted"), ~known).alias("tur"))
    return out.select("n_rows", "n_unknown", F.round("ccr", 6).alias("ccr"), F.round("tur", 6).alias("tur"), F.round(harmonic(F.col("ccr"), F.col("tur")), 6).alias("os_hm"), F.lit(round(tau, 6)).alias("tau"))


@query()
def fit_predict_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole model on letter frequencies: map, graph, projection, bank,
    calibration and prediction, with one language never seen."""
    from lodestar.plans import model as models
    from lodestar.plans.config import ModelConfig

    rows = letter_features(table(spark, sf_dir, "documents"))
    wide = cut(rows.select("row_id", "label", "split", *(F.col("x")[i].alias(c) for i, c in enumerate(LETTERS))))
    part = lambda name: wide.where(F.col("split") == name).drop("split")
    seen = F.col("label") != UNSEEN
    model = models.fit(part("train").where(seen), part("calibration").where(seen), ModelConfig(scaler="standard", map_width=128, projection_width=8))
    test = part("test")
    found = models.predict(model, test, keep=("label",)).withColumnRenamed("label", "true_label").withColumn("session_id", F.lit(0))
    return metrics.session_metrics(cut(found), model.classes)


