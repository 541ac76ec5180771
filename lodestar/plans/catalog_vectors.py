"""Queries over feature vectors: graphs, moments, prototypes, scores, thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.session import cut
from lodestar.functions.vectors import mean_vectors, total, vector_sums
from lodestar.operators import calibration, graph, maps, prototypes, scoring
from lodestar.operators.ledger import Ledger
from lodestar.operators.maps import Map
from lodestar.operators.prototypes import Bank
from lodestar.plans.registry import query, table

V = """v AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""
EDGES = f"""{V}, pairs AS (SELECT a.row_id AS src, b.row_id AS dst, a.label, pow(list_distance(a.x, b.x), 2) AS d2 FROM v a JOIN v b ON a.label = b.label AND a.row_id <> b.row_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM pairs), near AS (SELECT * FROM ranked WHERE rank <= {{r}})"""
CENTER = """list(m ORDER BY j) AS center FROM (SELECT label, j, avg(c) AS m FROM (SELECT label, unnest({x}) AS c, generate_subscripts({x}, 1) AS j FROM {t}) GROUP BY label, j) GROUP BY label"""
PROTOTYPES = f"""ce AS (SELECT label, {CENTER.format(x='x', t='tr')}),
di AS (SELECT tr.row_id, tr.label, center, list_distance(x, center) AS d FROM tr JOIN ce USING (label)),
rk AS (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) AS r, count(*) OVER (PARTITION BY label) AS n FROM di),
rh AS (SELECT label, greatest(min(d) FILTER (r >= 0.9 * n), 1e-6) AS rho, CAST(count(*) AS DOUBLE) AS weight FROM rk GROUP BY label),
pr AS (SELECT label, center, rho, weight FROM ce JOIN rh USING (label))"""
EVERY = f"{V}, tr AS (SELECT * FROM v), {PROTOTYPES}"
# Base classes have prototypes; all rows are scored, those of the other classes as unknown ones.
BANK = f"{V}, tr AS (SELECT * FROM v WHERE label < '7'), {PROTOTYPES}, te AS (SELECT * FROM v), ca AS (SELECT * FROM tr)"
SCORED = BANK + """, sc AS (SELECT te.row_id, te.label AS true_label, te.x, pr.label AS p, center, weight, list_distance(te.x, center) AS d, list_distance(te.x, center) / greatest(rho, 1e-12) AS s FROM te, pr)"""
CAL = BANK + """, cs AS (SELECT ca.row_id AS seq, ca.label, pr.label AS p, list_distance(ca.x, center) / greatest(rho, 1e-12) AS s FROM ca, pr),
pos AS (SELECT seq, label, s AS score FROM cs WHERE label = p), neg AS (SELECT seq, label, min(s) AS score FROM cs WHERE label <> p GROUP BY seq, label)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the base classes."""
    return vectors(spark, sf_dir).where("label < '7'")


def bank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.build(base_rows(spark, sf_dir), unit="label")


def bank(spark: SparkSession, sf_dir: str) -> Bank:
    return Bank.of(bank_table(spark, sf_dir))


# --- graphs ---------------------------------------------------------------


@query(f"WITH {EDGES.format(r=5)} SELECT src, dst, label, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM near")
def rnn_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(vectors(spark, sf_dir), 5).withColumn("d2", F.round("d2", 6))


@query(f"""WITH {V}, n AS (SELECT row_id, label, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) AS x FROM v),
pairs AS (SELECT a.row_id AS src, b.row_id AS dst, pow(list_distance(a.x, b.x), 2) / 2 AS d2 FROM n a JOIN n b ON a.label = b.label AND a.row_id <> b.row_id)
SELECT src, dst, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM pairs) WHERE rank <= 3""")
def rnn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(vectors(spark, sf_dir), 3, metric="cosine").select("src", "dst", F.round("d2", 6).alias("d2"))


ROUNDED = EDGES.replace("CAST(embedding AS DOUBLE[]) AS x", "list_transform(range(0, 4), lambda i: round(list_sum(CAST(embedding AS DOUBLE[])[16 * i + 1:16 * i + 16]))) AS x")


@query(f"WITH {ROUNDED.format(r=4)} SELECT src, dst, label, d2, CAST(rank AS INTEGER) AS rank FROM near")
def rnn_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by four rounded sums of all coordinates, where many rows are equal
    and most distances tie."""
    coarse = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.round(total(F.slice("x", 16 * i + 1, 16))))
    return graph.nearest(vectors(spark, sf_dir).withColumn("x", coarse), 4)


@query(f"WITH {EDGES.format(r=5)} SELECT a.src, a.dst FROM near a JOIN near b ON a.src = b.dst AND a.dst = b.src")
def rnn_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mutual(cut(graph.nearest(vectors(spark, sf_dir), 5))).select("src", "dst")


COMPONENTS = f"""WITH RECURSIVE {EDGES.format(r=3)}, mu AS (SELECT a.src, a.dst FROM near a JOIN near b ON a.src = b.dst AND a.dst = b.src),
walk AS (SELECT row_id, row_id AS seen FROM v UNION SELECT walk.row_id, mu.dst FROM walk JOIN mu ON walk.seen = mu.src),
co AS (SELECT row_id, min(seen) AS component FROM walk GROUP BY row_id)"""


@query(f"{COMPONENTS} SELECT row_id, component FROM co")
def rnn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return graph.components(rows, graph.mutual(cut(graph.nearest(rows, 3))))


@query(f"""{COMPONENTS}, sz AS (SELECT component, count(*) AS size, min(label) AS label FROM co JOIN v USING (row_id) GROUP BY component),
nu AS (SELECT component, 'unit:' || label || ':' || (row_number() OVER (PARTITION BY label ORDER BY component) - 1) AS unit_id FROM sz WHERE size >= 3)
SELECT row_id, label, co.component, size, unit_id FROM co JOIN v USING (row_id) JOIN (SELECT component, size FROM sz) USING (component) LEFT JOIN nu USING (component)""")
def units_and_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.localise(vectors(spark, sf_dir), 3, 3)


@query(f"""{COMPONENTS}, sz AS (SELECT component, count(*) AS size, min(label) AS label FROM co JOIN v USING (row_id) GROUP BY component),
nu AS (SELECT component, 'unit:' || label || ':' || (row_number() OVER (PARTITION BY label ORDER BY component) - 1) AS unit_id, label FROM sz WHERE size >= 3)
SELECT label, string_agg(unit_id, ',' ORDER BY unit_id) AS units FROM nu GROUP BY label""")
def class_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = graph.localise(vectors(spark, sf_dir), 3, 3).where("unit_id IS NOT NULL").select("label", "unit_id").distinct()
    return units.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("unit_id")), ",").alias("units"))


@query(f"WITH {EDGES.format(r=1)} SELECT label, round(median(sqrt(d2)), 6) AS distance FROM near GROUP BY label")
def median_nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graph.nearest(vectors(spark, sf_dir), 1)
    return near.groupBy("label").agg(F.round(F.percentile(F.sqrt("d2"), 0.5), 6).alias("distance"))


# --- maps -----------------------------------------------------------------


def _weights(width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    j, k = np.arange(1, width + 1)[:, None], np.arange(1, n + 1)[None, :]
    return np.sin(j * k) * 2, np.cos(np.arange(1, n + 1)) * 3


@query(f"""WITH {V}, k AS (SELECT unnest(range(1, 9)) AS k), z AS (SELECT row_id, k, list_sum(list_transform(x, lambda e, j: e * sin(j * k) * 2)) + cos(k) * 3 AS a FROM v, k)
SELECT row_id, CAST(k AS INTEGER) AS k, round(sqrt(2.0 / 8) * cos(a), 6) AS phi FROM z""")
def rff_fixed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    omega, phase = _weights(64, 8)
    phi = maps.apply(vectors(spark, sf_dir), Map("rff", 64, omega, phase))
    return phi.select("row_id", F.posexplode("phi").alias("k", "phi")).select("row_id", (F.col("k") + 1).alias("k"), F.round("phi", 6).alias("phi"))


@query(f"""WITH {V}, s AS (SELECT * FROM v ORDER BY md5('0:' || row_id), row_id LIMIT 2000), pairs AS (SELECT a.row_id, pow(list_distance(a.x, b.x), 2) AS d2 FROM s a JOIN s b ON a.row_id <> b.row_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2) AS r FROM pairs) SELECT round(1 / avg(d2), 6) AS gamma FROM r WHERE r = 20""")
def gamma_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(maps.gamma_knn(vectors(spark, sf_dir), 20), 6),)], "gamma double")


@query(f"""WITH {V}, s AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || row_id), row_id) - 1 AS i FROM v), n AS (SELECT least(count(*), 5000) // 2 AS half FROM s),
h AS (SELECT half, least(half, 2000) AS take FROM n), a AS (SELECT x FROM s, h WHERE i < take), b AS (SELECT x FROM s, h WHERE i >= half AND i < half + take)
SELECT round(1 / median(pow(list_distance(a.x, b.x), 2)), 6) AS gamma FROM a, b""")
def gamma_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(maps.gamma_median(vectors(spark, sf_dir)), 6),)], "gamma double")


@query("""WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT sum(n) AS total, count(*) AS k FROM c),
q AS (SELECT label, (37 - k) * n / CAST(total AS DOUBLE) AS q FROM c, t), f AS (SELECT label, q - floor(q) AS rest, 1 + floor(q) AS got FROM q),
l AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS r, 37 - sum(got) OVER () AS left_ FROM f)
SELECT label, CAST(got + CASE WHEN r <= left_ THEN 1 ELSE 0 END AS BIGINT) AS landmarks FROM l""")
def landmark_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {r["o_orderpriority"]: r["count"] for r in table(spark, sf_dir, "orders").groupBy("o_orderpriority").count().collect()}
    return spark.createDataFrame(list(maps.landmark_allocation(sizes, 37).items()), "label string, landmarks long")


PLANE = f"""{V}, e AS (SELECT row_id, label, x[1] AS a, x[2] AS b FROM v), m AS (SELECT label, CAST(count(*) AS DOUBLE) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab FROM e GROUP BY label),
s AS (SELECT sum(n) AS n, sum(n * vaa) / sum(n) AS saa, sum(n * vbb) / sum(n) AS sbb, sum(n * vab) / sum(n) AS sab FROM m)"""


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with their first two coordinates, whose matrices SQL can invert."""
    return vectors(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))


@query(f"""WITH {PLANE}, q AS (SELECT *, sqrt(saa * sbb - sab * sab) AS d, sqrt(saa + sbb + 2 * sqrt(saa * sbb - sab * sab)) AS t FROM s)
SELECT row_id, round(((sbb + d) * a - sab * b) / (t * d), 6) AS u, round(((saa + d) * b - sab * a) / (t * d), 6) AS w FROM e, q""")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the symmetric inverse root of the mean within-class scatter."""
    rows = plane(spark, sf_dir)
    n, within = _within(rows)
    white = maps.apply(rows, Map("identity", 2, after=maps.whitening(within, n)))
    return white.select("row_id", F.round(F.col("phi")[0], 6).alias("u"), F.round(F.col("phi")[1], 6).alias("w"))


def _within(rows: DataFrame) -> tuple[float, np.ndarray]:
    n, s1, s2 = prototypes.moments(rows)
    units = [(r["n"], np.array(r["s1"])) for r in vector_sums(rows, ["label"], "x").collect()]
    return n, prototypes.scatters(n, s1, s2, units)[1]


@query()
def nystrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    marks = maps.supervised_landmarks(rows, 24)
    phi = maps.apply(rows, maps.fit("nystrom", 64, 24, 1.0, landmarks=marks))
    return phi.select("row_id", F.size("phi").alias("width"), F.round(F.aggregate("phi", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query(f"""WITH {V}, l AS (SELECT x FROM v ORDER BY row_id LIMIT 2), ll AS (SELECT list(x) AS l FROM l), k AS (SELECT row_id, exp(-pow(list_distance(x, l[1]), 2)) AS a, exp(-pow(list_distance(x, l[2]), 2)) AS b, exp(-pow(list_distance(l[1], l[2]), 2)) AS c FROM v, ll)
SELECT row_id, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS norm FROM k""")
def nystrom_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of kernel features on two given landmarks."""
    rows = vectors(spark, sf_dir)
    marks = np.array([r["x"] for r in rows.orderBy("row_id").limit(2).collect()])
    phi = maps.apply(rows, maps.fit("nystrom", 64, 2, 1.0, landmarks=marks))
    return phi.select("row_id", F.round(F.aggregate("phi", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query(f"""WITH {PLANE}, r AS (SELECT n, (saa + sbb) / 2 AS h, sqrt(pow((saa - sbb) / 2, 2) + sab * sab) AS g FROM s), l AS (SELECT 0 AS i, n * (h - g) AS v, n * h AS m FROM r UNION ALL SELECT 1, n * (h + g), n * h FROM r)
SELECT CAST(i AS INTEGER) AS i, round(v, 5) AS scatter, CASE WHEN (SELECT bool_or(v <= 0.9 * m) FROM l) THEN 'epsilon_null' ELSE 'min_scatter_fallback' END AS mode FROM l WHERE v <= 0.9 * m OR NOT (SELECT bool_or(v <= 0.9 * m) FROM l)""")
def soft_null_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of little scatter: those under 0.9 of the median eigenvalue."""
    rows = plane(spark, sf_dir)
    n, s1, s2 = prototypes.moments(rows)
    found = maps.soft_null(s2 - np.outer(s1, s1) / n, _within(rows)[1], 2, null_share=0.9)
    return spark.createDataFrame([(i, round(float(v), 5), found.mode) for i, v in enumerate(found.spectrum)], "i int, scatter double, mode string")


# --- moments and prototypes -----------------------------------------------


@query(f"""WITH {V}, w AS (SELECT row_id, label, x, 1.0 + row_id % 3 AS w FROM v), l AS (SELECT row_id, w, unnest(x) AS c, generate_subscripts(x, 1) - 1 AS j FROM w)
SELECT CAST(a.j AS INTEGER) AS j, CAST(b.j AS INTEGER) AS k, round(sum(a.w * a.c * b.c), 5) AS s2 FROM l a JOIN l b USING (row_id) GROUP BY a.j, b.j""")
def moment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, s2 = prototypes.moments(vectors(spark, sf_dir).withColumn("w", 1.0 + F.col("row_id") % 3), weight="w")
    return spark.createDataFrame([(j, k, round(float(v), 5)) for j, row in enumerate(s2) for k, v in enumerate(row)], "j int, k int, s2 double")


@query(f"""WITH {V}, l AS (SELECT label, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM v)
SELECT label, CAST(j - 1 AS INTEGER) AS j, CAST(count(*) AS DOUBLE) AS n, round(sum(c), 5) AS s1 FROM l GROUP BY label, j""")
def moments_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.moments_by_unit(vectors(spark, sf_dir), ["label"]).select("label", "j", "n", F.round("s1", 5).alias("s1"))


@query(f"""WITH {V}, l AS (SELECT label, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM v),
t AS (SELECT sum(q) AS total FROM (SELECT sum(c * c) - sum(c) * sum(c) / count(*) AS q FROM l GROUP BY j)), w AS (SELECT sum(q) AS within FROM (SELECT sum(c * c) - sum(c) * sum(c) / count(*) AS q FROM l GROUP BY j, label))
SELECT round(total, 4) AS total, round(within, 4) AS within FROM t, w""")
def scatter_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    n, s1, s2 = prototypes.moments(rows)
    _, within = _within(rows)
    return spark.createDataFrame([(round(float(np.trace(s2 - np.outer(s1, s1) / n)), 4), round(float(np.trace(within)), 4))], "total double, within double")


@query("""WITH w AS (SELECT label, 1.0 + vec_id % 3 AS w FROM embeddings), c AS (SELECT label, sum(w) AS c FROM w GROUP BY label), t AS (SELECT sum(c) / count(*) AS t FROM c)
SELECT CAST(label AS VARCHAR) AS label, round(sum(w * sqrt(t / c)), 6) AS weight FROM w JOIN c USING (label), t GROUP BY label""")
def class_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("label", (1.0 + F.col("row_id") % 3).alias("w"))
    return prototypes.balanced_weights(rows, power=0.5).groupBy("label").agg(F.round(F.sum("w"), 6).alias("weight"))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)
SELECT l_returnflag, min(v) AS quantile FROM r WHERE c >= 0.3 * t GROUP BY l_returnflag""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.weighted_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.3)


@query(f"""WITH {V}, w AS (SELECT label, x, 1.0 + row_id % 3 AS w FROM v), l AS (SELECT label, w, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM w),
ce AS (SELECT label, list(m ORDER BY j) AS center FROM (SELECT label, j, sum(w * c) / sum(w) AS m FROM l GROUP BY label, j) GROUP BY label),
d AS (SELECT label, w, list_distance(x, center) AS d FROM w JOIN ce USING (label)), r AS (SELECT *, sum(w) OVER (PARTITION BY label ORDER BY d) AS c, sum(w) OVER (PARTITION BY label) AS t FROM d)
SELECT label, round(min(d), 6) AS radius FROM r WHERE c >= 0.5 * t GROUP BY label""")
def support_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("w", 1.0 + F.col("row_id") % 3)
    far = prototypes.distances(rows, mean_vectors(rows, ["label"], "x", "w"), ["label"])
    return prototypes.weighted_quantile(far, ["label"], "d", "w", 0.5, "radius").withColumn("radius", F.round("radius", 6))


@query(f"WITH {EVERY} SELECT label AS prototype_id, label, round(rho, 6) AS rho, weight, CASE WHEN weight < 20 THEN 'fragile_stable' ELSE 'stable' END AS status, round(list_sum(center), 5) AS center_sum FROM pr")
def prototype_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prototypes.build(vectors(spark, sf_dir), unit="label", fragile_below=20)
    return built.select("prototype_id", "label", F.round("rho", 6).alias("rho"), "weight", "status", F.round(F.aggregate("center", F.lit(0.0), lambda s, x: s + x), 5).alias("center_sum"))


@query(f"WITH {EVERY} SELECT label, round(max(d), 6) AS radius, CAST(count(*) AS DOUBLE) AS weight FROM di GROUP BY label")
def centroid_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    far = prototypes.distances(rows, mean_vectors(rows, ["label"], "x"), ["label"])
    return far.groupBy("label").agg(F.round(F.max("d"), 6).alias("radius"), F.sum(F.lit(1.0)).alias("weight"))


# --- scores ---------------------------------------------------------------


def _scores(spark: SparkSession, sf_dir: str, rule: scoring.Rule, digits: int = 6) -> DataFrame:
    found = scoring.predict(vectors(spark, sf_dir), bank(spark, sf_dir), rule, 1.0)
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", digits).alias("score"))


@query(f"WITH {SCORED} SELECT row_id, arg_min(p, (s, p)) AS label, round(min(s), 6) AS score FROM sc GROUP BY row_id")
def score_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, scoring.Rule())


@query(f"WITH {SCORED} SELECT row_id, arg_min(p, (s, p)) AS label, round(-0.5 * ln(sum(exp(-s / 0.5))), 6) AS score FROM sc GROUP BY row_id")
def score_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, scoring.Rule("energy", temperature=0.5))


@query(f"""WITH {SCORED}, m AS (SELECT median(weight) AS m FROM pr) SELECT row_id, arg_min(p, (s, p)) AS label, round(-0.5 * ln(sum(exp(-s / (0.5 * sqrt(weight / m))))), 6) AS score FROM sc, m GROUP BY row_id""")
def score_energy_class_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir)
    return _scores(spark, sf_dir, scoring.Rule("energy", temperature=0.5, inner_temperature=scoring.class_temperatures(b, 0.5, 0.5)))


@query(f"""WITH {SCORED}, h AS (SELECT row_id, p, 1 - list_cosine_similarity(x, center) AS h FROM sc) SELECT row_id, arg_min(p, (h, p)) AS label, round(min(h), 6) AS score FROM h GROUP BY row_id""")
def score_hyperspherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, scoring.Rule("hyperspherical"))


@query(f"""WITH {SCORED}, o AS (SELECT a.label, unnest(b.center) AS c, generate_subscripts(b.center, 1) AS j FROM pr a JOIN pr b ON a.label <> b.label),
rp AS (SELECT label, list(m ORDER BY j) AS point FROM (SELECT label, j, avg(c) AS m FROM o GROUP BY label, j) GROUP BY label),
h AS (SELECT row_id, p, d - 0.5 * list_distance(x, point) AS h FROM sc JOIN rp ON p = rp.label) SELECT row_id, arg_min(p, (h, p)) AS label, round(min(h), 6) AS score FROM h GROUP BY row_id""")
def score_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, scoring.Rule("reciprocal", reciprocal_weight=0.5))


@query(f"""WITH {BANK}, nn AS (SELECT te.row_id, tr.label, list_distance(te.x, tr.x) AS d, row_number() OVER (PARTITION BY te.row_id ORDER BY list_distance(te.x, tr.x), tr.row_id) AS r FROM te, tr),
k AS (SELECT * FROM nn WHERE r <= 5), vo AS (SELECT row_id, label, count(*) AS n FROM k GROUP BY row_id, label)
SELECT row_id, arg_min(label, (-n, label)) AS label, (SELECT round(max(d), 6) FROM k WHERE k.row_id = vo.row_id) AS score FROM vo GROUP BY row_id""")
def score_knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.knn_vote(scoring.nearest_references(vectors(spark, sf_dir), base_rows(spark, sf_dir), 5))
    return found.select("row_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED}, e AS (SELECT row_id, p, exp(-pow(s / 1.2, 3)) AS e FROM sc) SELECT row_id, arg_max(p, e) AS label, round(1 - max(e), 6) AS score FROM e GROUP BY row_id")
def score_evm_fixed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, scoring.Rule("evm", weibull={str(i): (3.0, 1.2) for i in range(10)}))


SPREAD = """ls AS (SELECT label, c, j FROM (SELECT label, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM tr)), vj AS (SELECT label, j, var_pop(c) AS v, count(*) AS n FROM ls GROUP BY label, j)"""


@query(f"""WITH {SCORED}, {SPREAD}, pj AS (SELECT label, list(1 / greatest(v, 1e-10) ORDER BY j) AS q FROM vj GROUP BY label),
st AS (SELECT row_id, p, list_sum(list_transform(list_zip(x, center, q), lambda e: pow(e[1] - e[2], 2) * e[3])) AS t FROM sc JOIN pj ON p = pj.label), g AS (SELECT row_id, min(t) / 2 AS h, arg_min(p, (t, p)) AS p FROM st GROUP BY row_id)
SELECT row_id, p AS label, round(1 - list_sum(list_transform(range(0, 32), lambda i: exp(-h + i * ln(h) - lgamma(i + 1)))), 6) AS score FROM g""")
def score_ghost_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square tails under each prototype's own variances."""
    b = Bank.of(prototypes.build(base_rows(spark, sf_dir), unit="label", second=True))
    found = scoring.predict(vectors(spark, sf_dir), b, scoring.Rule("ghost", precision=prototypes.diagonal_precisions(b)), 1.0)
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", 6).alias("score"))


@query(f"""WITH {SCORED}, {SPREAD}, sj AS (SELECT list(1 / (s + 1e-10) ORDER BY j) AS q FROM (SELECT j, sum(n * v) / sum(n) AS s FROM vj GROUP BY j)),
h AS (SELECT row_id, p, sqrt(list_sum(list_transform(list_zip(x, center, q), lambda e: pow(e[1] - e[2], 2) * e[3]))) AS h FROM sc, sj) SELECT row_id, arg_min(p, (h, p)) AS label, round(min(h), 6) AS score FROM h GROUP BY row_id""")
def score_mahalanobis_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances under the variances that all prototypes share."""
    b = Bank.of(prototypes.build(base_rows(spark, sf_dir), unit="label", second=True))
    found = scoring.predict(vectors(spark, sf_dir), b, scoring.Rule("mahalanobis", precision=prototypes.precisions(b, adaptive=False)), 1.0)
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", 6).alias("score"))


BASE_PLANE = PLANE.replace("FROM e GROUP BY label", "FROM e WHERE label < '7' GROUP BY label")


def plane_bank(spark: SparkSession, sf_dir: str) -> Bank:
    return Bank.of(prototypes.build(plane(spark, sf_dir).where("label < '7'"), unit="label", second=True))


@query(f"""WITH {BASE_PLANE}, c AS (SELECT label, ma, mb, (m.n * vaa + 2 * saa) / (m.n + 2) + 1e-10 AS ca, (m.n * vbb + 2 * sbb) / (m.n + 2) + 1e-10 AS cb, m.n * vab / (m.n + 2) AS cc FROM m, s),
h AS (SELECT row_id, c.label AS p, sqrt((pow(a - ma, 2) * cb - 2 * (a - ma) * (b - mb) * cc + pow(b - mb, 2) * ca) / (ca * cb - cc * cc)) AS h FROM e, c) SELECT row_id, arg_min(p, (h, p)) AS label, round(min(h), 6) AS score FROM h GROUP BY row_id""")
def score_mahalanobis_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances under each prototype's covariance, shrunk by its support."""
    b = plane_bank(spark, sf_dir)
    found = scoring.predict(plane(spark, sf_dir), b, scoring.Rule("mahalanobis", precision=prototypes.precisions(b)), 1.0)
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", 6).alias("score"))


@query(f"""WITH {BASE_PLANE}, t AS (SELECT saa + 1e-6 AS ca, sbb + 1e-6 AS cb, sab AS cc, (SELECT avg(a) FROM e WHERE label < '7') AS ga, (SELECT avg(b) FROM e WHERE label < '7') AS gb FROM s),
h AS (SELECT row_id, m.label AS p, sqrt((pow(a - ma, 2) * cb - 2 * (a - ma) * (b - mb) * cc + pow(b - mb, 2) * ca) / (ca * cb - cc * cc)) AS h, sqrt((pow(a - ga, 2) * cb - 2 * (a - ga) * (b - gb) * cc + pow(b - gb, 2) * ca) / (ca * cb - cc * cc)) AS g FROM e, m, t)
SELECT row_id, arg_min(p, (h, p)) AS label, round(min(h) - max(g), 6) AS score FROM h GROUP BY row_id""")
def score_relative_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class distance less background distance, under the covariance that
    classes share."""
    behind = prototypes.background(plane(spark, sf_dir).where("label < '7'"))
    found = scoring.predict(plane(spark, sf_dir), plane_bank(spark, sf_dir), scoring.Rule("relative_mahalanobis", precision=behind[1], background=behind), 1.0)
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", 6).alias("score"))


@query(f"""WITH {V}, l AS (SELECT row_id, label, unnest(x) AS c, generate_subscripts(x, 1) - 1 AS j FROM v)
SELECT a.label, CAST(a.j AS INTEGER) AS j, CAST(b.j AS INTEGER) AS k, round(covar_pop(a.c, b.c), 6) + 0.0 AS cov FROM l a JOIN l b USING (row_id) GROUP BY a.label, a.j, b.j""")
def weighted_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class's covariance, all coordinates."""
    built = prototypes.build(vectors(spark, sf_dir), unit="label", second=True)
    width = F.sqrt(F.size("cov")).cast("int")
    return built.select("label", width.alias("width"), F.posexplode("cov").alias("at", "cov")).select("label", F.floor(F.col("at") / F.col("width")).cast("int").alias("j"), (F.col("at") % F.col("width")).cast("int").alias("k"), (F.round("cov", 6) + 0.0).alias("cov"))


def full_bank(spark: SparkSession, sf_dir: str) -> Bank:
    return Bank.of(prototypes.build(base_rows(spark, sf_dir), unit="label", second=True))


@query()
def whitening_all_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the inverse root of the within-class scatter of all coordinates."""
    rows = vectors(spark, sf_dir)
    n, within = _within(rows)
    white = maps.apply(rows, Map("identity", len(within), after=maps.whitening(within, n)))
    return white.select("row_id", "label", F.transform("phi", lambda x: F.round(x, 6)).alias("white"))


@query()
def soft_null_all_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight directions of all coordinates in which classes scatter least."""
    ledger = Ledger.of(vectors(spark, sf_dir).withColumn("w", F.lit(1.0)), "label", "x")
    total, within = ledger.scatters()
    found = maps.soft_null(total, within, 8, null_share=0.0)
    return spark.createDataFrame([(i, float(v), found.matrix[:, i].tolist()) for i, v in enumerate(found.spectrum)], "i int, scatter double, axis array<double>")


@query()
def score_mahalanobis_all_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances under each prototype's covariance of all coordinates, shrunk by its support."""
    b = full_bank(spark, sf_dir)
    found = scoring.predict(vectors(spark, sf_dir), b, scoring.Rule("mahalanobis", precision=prototypes.precisions(b)), 1.0)
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", 6).alias("score"))


@query()
def score_relative_mahalanobis_all_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class distance less background distance, all coordinates."""
    behind = prototypes.background(base_rows(spark, sf_dir))
    found = scoring.predict(vectors(spark, sf_dir), full_bank(spark, sf_dir), scoring.Rule("relative_mahalanobis", precision=behind[1], background=behind), 1.0)
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", 6).alias("score"))


@query(f"""WITH {SCORED}, k AS (SELECT ln(greatest(median(weight), 2)) AS k FROM pr), b AS (SELECT row_id, arg_min(p, s) AS p, arg_min(weight, s) AS w, min(s) AS s FROM sc GROUP BY row_id)
SELECT row_id, p AS label, round(s * (1 + 0.3 * (ln(greatest(w, 1)) / k - 1)), 6) AS score FROM b, k""")
def support_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, scoring.Rule(penalty=("log", 0.3)))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s, p) AS r FROM sc),
two AS (SELECT row_id, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2, max(s) FILTER (r = 1) AS s1, max(s) FILTER (r = 2) AS s2, max(weight) FILTER (r = 1) AS w1, max(weight) FILTER (r = 2) AS w2 FROM r GROUP BY row_id)
SELECT row_id, CASE WHEN s1 / greatest(s2, 1e-12) > 0.97 AND w2 < w1 THEN p2 ELSE p1 END AS label, round(s1, 6) AS score FROM two""")
def ncdr_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, scoring.Rule(tie_break=0.97))


@query(f"""WITH {SCORED}, h AS (SELECT row_id, label, x[1:16] AS x FROM tr), hc AS (SELECT label, {CENTER.format(x='x', t='h')}), hd AS (SELECT h.label, list_distance(x, center) AS d FROM h JOIN hc USING (label)),
hk AS (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) AS r, count(*) OVER (PARTITION BY label) AS n FROM hd), hr AS (SELECT label, greatest(min(d) FILTER (r >= 0.9 * n), 1e-6) AS rho FROM hk GROUP BY label),
small AS (SELECT te.row_id, min(list_distance(te.x[1:16], center) / rho) AS s FROM te, hc JOIN hr USING (label) GROUP BY te.row_id), wide AS (SELECT row_id, min(s) AS f, arg_min(p, s) AS p FROM sc GROUP BY row_id),
mx AS (SELECT (SELECT max(s) FROM small) AS ms, (SELECT max(f) FROM wide) AS mf)
SELECT row_id, p AS label, round((0.6 * s / ms + 0.4 * f / mf) * ms, 6) AS score FROM small JOIN wide USING (row_id), mx""")
def dual_space_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda df: df.withColumn("z", F.slice("x", 1, 16))
    small = Bank.of(prototypes.build(part(base_rows(spark, sf_dir)), unit="label", vector="z"))
    found = scoring.predict(part(vectors(spark, sf_dir)), small, scoring.Rule(dual=0.6, full=bank(spark, sf_dir)), 1.0, vector="z", full_vector="x")
    return found.select("row_id", F.col("best_class_label").alias("label"), F.round("score", 6).alias("score"))


@query(f"""WITH {BANK}, o AS (SELECT label, CASE WHEN label = '1' THEN 0.7 WHEN label = '2' THEN 1.9 WHEN label IN ('3', '4') THEN least(1.1, CASE label WHEN '3' THEN 0.88 ELSE 1.5 END) ELSE 1.1 END AS tau FROM pr) SELECT label, CAST(tau AS DOUBLE) AS tau FROM o""")
def tau_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir)
    b.status = ["fragile_stable" if x in ("3", "4") else s for x, s in zip(b.labels, b.status, strict=True)]
    b.override = np.array([{"3": 0.88, "4": 1.5, "5": 0.2}.get(x, np.nan) for x in b.labels])
    b.local = np.array([1.9 if x == "2" else np.nan for x in b.labels])
    taus = scoring.effective_tau(b, 1.1, {"1": 0.7})
    return spark.createDataFrame([(x, float(t)) for x, t in zip(b.labels, taus, strict=True)], "label string, tau double")


@query(f"""WITH {CAL}, tau AS (SELECT quantile_cont(score, 0.85) AS tau FROM pos), pred AS (SELECT te.row_id, te.label AS true_label, min(list_distance(te.x, center) / greatest(rho, 1e-12)) AS s, arg_min(pr.label, list_distance(te.x, center) / greatest(rho, 1e-12)) AS p FROM te, pr GROUP BY te.row_id, te.label)
SELECT row_id, true_label, CASE WHEN s > tau THEN 'unknown' ELSE p END AS predicted_label, NOT s > tau AS accepted FROM pred, tau""")
def accept_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir)
    tau = calibration.quantile(_positives(spark, sf_dir, b), 0.85, 1.0)
    found = scoring.predict(vectors(spark, sf_dir), b, scoring.Rule(), tau)
    return found.join(vectors(spark, sf_dir).select("row_id", F.col("label").alias("true_label")), "row_id").select("row_id", "true_label", F.coalesce("predicted_label", F.lit("unknown")).alias("predicted_label"), "accepted")


# --- thresholds -----------------------------------------------------------


def _calibration(spark: SparkSession, sf_dir: str, b: Bank | None = None) -> DataFrame:
    from lodestar.plans.model import calibration_scores

    return cut(calibration_scores(base_rows(spark, sf_dir), b or bank(spark, sf_dir), vector="x"))


def _positives(spark: SparkSession, sf_dir: str, b: Bank | None = None) -> DataFrame:
    return _calibration(spark, sf_dir, b).where("kind = 'pos'")


@query(f"WITH {CAL} SELECT 'pos' AS kind, label, seq, round(score, 6) AS score FROM pos UNION ALL SELECT 'imp', label, seq, round(score, 6) FROM neg")
def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibration(spark, sf_dir).select("kind", "label", "seq", F.round("score", 6).alias("score"))


@query(f"WITH {CAL} SELECT label, seq, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS r FROM pos) WHERE r <= 4")
def reservoir_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.last(_positives(spark, sf_dir), ["label"], 4).select("label", "seq", F.round("score", 6).alias("score"))


@query(f"WITH {CAL} SELECT label, seq, round(score, 6) AS score FROM neg ORDER BY seq DESC, label DESC, score DESC LIMIT 16")
def reservoir_impostor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.reservoir(_calibration(spark, sf_dir), "imp", 16).select("label", "seq", F.round("score", 6).alias("score"))


@query(f"""WITH {EVERY}, aff AS (SELECT median(r) AS r FROM (SELECT label, max(d) AS r FROM di GROUP BY label)), nn AS (SELECT median(d) AS d FROM (SELECT a.row_id, min(list_distance(a.x, b.x)) AS d FROM v a JOIN v b ON a.row_id <> b.row_id GROUP BY a.row_id)), rr AS (SELECT median(rho) AS rho FROM pr)
SELECT round(1e-8 * d * d, 9) AS range_tol, round(0.01 * d * d, 6) AS eps_null, round(r, 6) AS eps_aff_local, round(2 * r, 6) AS eps_aff_global, round(rho, 6) AS eta_margin, round(0.1 * d, 6) AS rho_floor, CAST(1.1 * 1.2 AS DOUBLE) AS tau_sep FROM aff, nn, rr""")
def scale_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative thresholds from the geometry of all rows, classes as units."""
    rows = cut(vectors(spark, sf_dir))
    b = Bank.of(prototypes.build(rows, unit="label"))
    far = prototypes.distances(rows, mean_vectors(rows, ["label"], "x"), ["label"])
    near = prototypes.median_nearest(rows)
    factors = {"range": 1e-8, "null": 1e-2, "aff_local": 1.0, "aff_global": 2.0, "margin": 1.0, "rho": 0.1, "sep": 1.1}
    found = prototypes.scales(factors, 1.2, False, prototypes.median_radius(far, ["label"]), near, float(np.median(b.rho)), near**2, near**2)
    digits = {"range_tol": 9}
    return spark.createDataFrame([tuple(round(float(v), digits.get(k, 6)) for k, v in found.__dict__.items())], ", ".join(f"{k} double" for k in found.__dict__))


@query(f"""WITH {CAL}, n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM pos GROUP BY label)) SELECT label, seq, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS r FROM pos), n WHERE r <= n""")
def class_balanced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.balanced(_positives(spark, sf_dir)).select("label", "seq", F.round("score", 6).alias("score"))


@query(f"""WITH {CAL}, b AS (SELECT score FROM pos UNION ALL SELECT score FROM neg), g AS (SELECT unnest(quantile_cont(score, [i / 63.0 FOR i IN range(0, 64)])) AS t FROM b),
f AS (SELECT t, (SELECT avg(CASE WHEN score <= t THEN 1.0 ELSE 0 END) FROM neg) AS fpr, (SELECT avg(CASE WHEN score <= t THEN 1.0 ELSE 0 END) FROM pos) AS tpr FROM g)
SELECT round(coalesce((SELECT max(t) FROM f WHERE fpr <= 0.7 AND tpr >= 0.3), (SELECT quantile_cont(score, 0.3) FROM pos)), 6) AS tau""")
def tau_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _calibration(spark, sf_dir)
    tau = calibration.grid_search(scores.where("kind = 'pos'"), scores.where("kind <> 'pos'"), 0.7, 0.3, 1.0)
    return spark.createDataFrame([(round(tau, 6),)], "tau double")


@query(f"""WITH {CAL}, q AS (SELECT min(q) AS t FROM (SELECT quantile_cont(score, 0.9) AS q FROM pos GROUP BY label)), n AS (SELECT quantile_cont(score, 0.95) AS m FROM neg) SELECT round(least(t, greatest(m, 0.8 * t)), 6) AS tau FROM q, n""")
def tau_loco(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _calibration(spark, sf_dir)
    return spark.createDataFrame([(round(calibration.leave_one_out(scores.where("kind = 'pos'"), scores.where("kind <> 'pos'"), 0.05, 0.9, 1.0), 6),)], "tau double")


@query(f"WITH {CAL} SELECT label, round(CASE WHEN count(*) < 5 THEN 0.9 ELSE greatest(0.27, least(2.7, quantile_cont(score, 0.85))) END, 6) AS tau FROM pos GROUP BY label")
def tau_per_class_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.by_class_quantile(_positives(spark, sf_dir), 0.85, 0.9).select("label", F.round("tau", 6).alias("tau"))


@query(f"""WITH {CAL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, seq) AS r FROM pos), t AS (SELECT label, score AS threshold FROM r WHERE r = 4)
SELECT label, round(score, 6) AS score, round(threshold, 6) AS threshold, round(score - threshold, 6) AS excess FROM r JOIN t USING (label) WHERE r <= 3""")
def evt_tail_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = calibration.tails(_positives(spark, sf_dir), 3)
    return tails.select("label", *(F.round(c, 6).alias(c) for c in ("score", "threshold", "excess")))


@query()
def evt_gpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pareto_by_group(_positives(spark, sf_dir), 4, 0.95)


@query()
def evm_weibull(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibration.weibull_by_class(_positives(spark, sf_dir), 5)
    return spark.createDataFrame([(k, *v) for k, v in sorted(found.items())], "label string, shape double, scale double")
