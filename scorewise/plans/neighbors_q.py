"""Registered queries: k-NN, SMOTE, folds, clustering and Gaussian naive Bayes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even, split_bucket, split_bucket_sql
from scorewise.operators import bayes, cluster, neighbors, resample
from scorewise.plans.analytics import STD_COLS
from scorewise.plans.duck import PREP_CTE, fx, with_fx
from scorewise.plans.registry import query
from scorewise.plans.relational import prepared
from scorewise.session import cut_lineage
from scorewise.sources.fixtures import fixture

SEED = 5805
KNN_K = 3
KNN_KS = list(range(2, 10))
SMOTE_K = 5


def points(spark, sf):
    """fx_points with the binary label used by the classifiers (label < 2 -> 0)."""
    return fixture(spark, sf, "fx_points").select(
        "id", "v", F.when(F.col("label") < 2, 0).otherwise(1).alias("y"), "label"
    )


def _pts_split(spark, sf):
    p = points(spark, sf)
    b = split_bucket("id", SEED)
    return p.filter(b >= 20), p.filter(b < 20)


_PTS = (
    with_fx("fx_points")
    + f""",
p AS (SELECT id, v, CASE WHEN label < 2 THEN 0 ELSE 1 END AS y, label FROM fx_points),
te AS (SELECT * FROM p WHERE {split_bucket_sql('id', SEED)} < 20),
tr AS (SELECT * FROM p WHERE {split_bucket_sql('id', SEED)} >= 20),
nn AS (SELECT qid, nid, rank, distance FROM (
         SELECT te.id AS qid, tr.id AS nid, list_distance(te.v, tr.v) AS distance,
                row_number() OVER (PARTITION BY te.id ORDER BY list_distance(te.v, tr.v), tr.id) AS rank
         FROM te, tr) WHERE rank <= 9)"""
)


@query("knn_join_topk", _PTS + f"\nSELECT qid, rank, nid, round_even(distance, 6) AS distance FROM nn WHERE rank <= {KNN_K}")
def knn_join_topk(spark, sf):
    train, test = _pts_split(spark, sf)
    nn = neighbors.knn_join(test, train, KNN_K)
    return nn.select("qid", F.col("rank").cast("long").alias("rank"), "nid", round_even("distance", 6).alias("distance"))


_VOTES = (
    _PTS
    + """,
ks AS (SELECT unnest(range(2, 10)) AS k),
v AS (SELECT qid, k, tr.y AS lab, count(*) AS c FROM nn JOIN tr ON tr.id = nn.nid, ks WHERE rank <= k GROUP BY qid, k, tr.y),
pred AS (SELECT qid, k, lab AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY qid, k ORDER BY c DESC, lab) = 1)"""
)


@query("knn_classify", _VOTES + f"\nSELECT qid AS id, CAST(prediction AS INTEGER) AS prediction FROM pred WHERE k = {KNN_K}")
def knn_classify(spark, sf):
    train, test = _pts_split(spark, sf)
    nn = neighbors.knn_join(test, train, KNN_K)
    v = neighbors.vote(nn, train, [KNN_K], "id", "y")
    return v.select(F.col("qid").alias("id"), F.col("prediction").cast("int").alias("prediction"))


@query(
    "knn_error_curve",
    _VOTES
    + "\nSELECT CAST(k AS INTEGER) AS k, round_even(avg(CASE WHEN prediction <> te.y THEN 1.0 ELSE 0.0 END), 6) AS error_rate "
    "FROM pred JOIN te ON te.id = pred.qid GROUP BY k",
)
def knn_error_curve(spark, sf):
    train, test = _pts_split(spark, sf)
    nn = neighbors.knn_join(test, train, max(KNN_KS))
    v = neighbors.vote(nn, train, KNN_KS, "id", "y")
    j = v.join(test.select(F.col("id").alias("qid"), "y"), "qid")
    return j.groupBy(F.col("k").cast("int").alias("k")).agg(
        round_even(F.avg((F.col("prediction") != F.col("y")).cast("double")), 6).alias("error_rate")
    )


# --------------------------------------------------------------------------- SMOTE

def _smote(spark, sf):
    p = points(spark, sf)
    return resample.smote(p.select("id", "v", F.col("y").alias("label")), "label", "id", "v", k=SMOTE_K, seed=SEED)


_SMOTE_SQL = (
    "WITH "
    + fx("fx_points")
    + f""",
p AS (SELECT id, v, CASE WHEN label < 2 THEN 0 ELSE 1 END AS y FROM fx_points),
cnt AS (SELECT y, count(*) AS m FROM p GROUP BY y),
mx AS (SELECT max(m) AS mm FROM cnt),
mins AS (SELECT p.id, p.v, p.y, cnt.m, mx.mm - cnt.m AS need,
                row_number() OVER (PARTITION BY p.y ORDER BY p.id) - 1 AS r
         FROM p JOIN cnt ON p.y = cnt.y, mx WHERE cnt.m < mx.mm),
kk AS (SELECT greatest(1, least({SMOTE_K}, min(m) - 1)) AS k FROM mins),
nn AS (SELECT a.id AS qid, b.id AS nid,
              row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
       FROM mins a JOIN mins b ON a.y = b.y AND a.id <> b.id),
cp AS (SELECT id, v, y, m, r, unnest(range(0, need // m + CASE WHEN r < need % m THEN 1 ELSE 0 END)) AS t FROM mins),
sel AS (SELECT cp.*, r + t * m AS j, ((id + r + t * m) % kk.k) + 1 AS nr,
               CAST((id * 7919 + (r + t * m) * 104729 + {SEED}) % 1000 AS DOUBLE) / 1000 AS u FROM cp, kk),
syn AS (SELECT sel.id AS base_id, CAST(sel.j AS INTEGER) AS copy, nn.nid AS neighbor_id, sel.u, sel.y,
               list_sum(sel.v) + sel.u * (list_sum(nb.v) - list_sum(sel.v)) AS v_sum,
               sel.v[1] + sel.u * (nb.v[1] - sel.v[1]) AS v_first
        FROM sel JOIN nn ON nn.qid = sel.id AND nn.rank = sel.nr JOIN p nb ON nb.id = nn.nid)"""
)


@query(
    "smote_rows",
    _SMOTE_SQL
    + "\nSELECT base_id, copy, neighbor_id, round_even(u, 6) AS u, CAST(y AS INTEGER) AS label, "
    "round_even(v_sum, 6) AS v_sum, round_even(v_first, 6) AS v_first FROM syn",
)
def smote_rows(spark, sf):
    s = _smote(spark, sf).filter("synthetic")
    return s.select(
        F.col("id").alias("base_id"), "copy", "neighbor_id", round_even("u", 6).alias("u"),
        F.col("label").cast("int").alias("label"),
        round_even(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("v_sum"),
        round_even(F.col("v")[0], 6).alias("v_first"),
    )


@query(
    "smote_balance_counts",
    _SMOTE_SQL
    + "\nSELECT CAST(y AS INTEGER) AS label, (SELECT count(*) FROM p WHERE p.y = c.y) + (SELECT count(*) FROM syn WHERE syn.y = c.y) AS count "
    "FROM (SELECT DISTINCT y FROM p) c",
)
def smote_balance_counts(spark, sf):
    return _smote(spark, sf).groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("count"))


@query(
    "class_distribution",
    _SMOTE_SQL
    + """
SELECT 'before' AS stage, CAST(y AS INTEGER) AS label, count(*) AS count FROM p GROUP BY y
UNION ALL
SELECT 'after', CAST(c.y AS INTEGER), (SELECT count(*) FROM p WHERE p.y = c.y) + (SELECT count(*) FROM syn WHERE syn.y = c.y)
FROM (SELECT DISTINCT y FROM p) c""",
)
def class_distribution(spark, sf):
    p = points(spark, sf)
    before = p.groupBy(F.col("y").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("count")).withColumn(
        "stage", F.lit("before")
    )
    after = smote_balance_counts(spark, sf).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


# --------------------------------------------------------------------------- folds

FOLDS = 2


@query(
    "stratified_folds",
    PREP_CTE
    + f""",
f AS (SELECT response, (row_number() OVER (PARTITION BY response ORDER BY
         ((ID % 1000003) * 48271 + {SEED}) % 1000003, ID) - 1) % {FOLDS} AS fold FROM prepared WHERE response IS NOT NULL)
SELECT CAST(fold AS INTEGER) AS fold, response, count(*) AS n FROM f GROUP BY fold, response""",
)
def stratified_folds(spark, sf):
    from scorewise.plans.relational import prepared

    p = prepared(spark, sf).filter(F.col("response").isNotNull())
    f = resample.stratified_folds(p, "response", "ID", FOLDS, seed=SEED)
    return f.groupBy("fold", "response").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- clustering

_CENTROIDS = (
    with_fx("fx_points")
    + """,
cen AS (SELECT label AS cluster, arg_min(v, id) AS c FROM fx_points GROUP BY label),
asg AS (SELECT id, v, cluster, distance FROM (
          SELECT p.id, p.v, cen.cluster, list_distance(p.v, cen.c) AS distance,
                 row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.v, cen.c), cen.cluster) AS rn
          FROM fx_points p, cen) WHERE rn = 1)"""
)


def _assigned(spark, sf):
    p = fixture(spark, sf, "fx_points")
    cents = p.groupBy("label").agg(F.min_by("v", "id").alias("c")).collect()  # one row per label (k rows)
    return cluster.assign(p.select("id", "v"), [(r["label"], list(r["c"])) for r in cents])


@query("kmeans_assign", _CENTROIDS + "\nSELECT id, CAST(cluster AS INTEGER) AS cluster, round_even(distance, 6) AS distance FROM asg")
def kmeans_assign(spark, sf):
    a = _assigned(spark, sf)
    return a.select("id", F.col("cluster").cast("int").alias("cluster"), round_even("distance", 6).alias("distance"))


@query(
    "kmeans_lloyd_step",
    _CENTROIDS
    + """,
ex AS (SELECT cluster, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM asg),
pd AS (SELECT cluster, pos, avg(x) AS m, count(*) AS n FROM ex GROUP BY cluster, pos)
SELECT CAST(cluster AS INTEGER) AS cluster, max(n) AS n, round_even(sum(m), 6) AS centroid_sum,
       round_even(sum(m * m), 6) AS centroid_sq FROM pd GROUP BY cluster""",
)
def kmeans_lloyd_step(spark, sf):
    upd = cluster.centroid_update(_assigned(spark, sf))
    return upd.select(
        F.col("cluster").cast("int").alias("cluster"), "n",
        round_even(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("centroid_sum"),
        round_even(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x), 6).alias("centroid_sq"),
    )


@query(
    "wss_k1",
    with_fx("fx_points")
    + """,
ex AS (SELECT unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM fx_points)
SELECT round_even(sum(s), 4) AS wss FROM (SELECT var_pop(x) * count(x) AS s FROM ex GROUP BY pos)""",
)
def wss_k1(spark, sf):
    return cluster.wss_single_cluster(fixture(spark, sf, "fx_points")).select(round_even("wss", 4).alias("wss"))


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    p = points(spark, sf)
    model = cluster.kmeans(p, 2, seed=SEED)
    return cluster.kmeans_predict(model, p.select("id", "v")).select("id", "cluster")


@query("elbow_wss")
def elbow_wss(spark, sf):
    rows = cluster.elbow(points(spark, sf), list(range(1, 11)), seed=SEED)
    return spark.createDataFrame(rows, "k INT, wss DOUBLE")


@query(
    "silhouette_euclidean",
    with_fx("fx_points")
    + """,
d AS (SELECT a.id, a.label AS own, b.label AS other, list_distance(a.v, b.v) AS dist
      FROM fx_points a JOIN fx_points b ON a.id <> b.id),
m AS (SELECT id, own, other, avg(dist) AS md, count(*) AS c FROM d GROUP BY id, own, other),
s AS (SELECT id, max(CASE WHEN other = own THEN md END) AS a, min(CASE WHEN other <> own THEN md END) AS b FROM m GROUP BY id)
SELECT 'label' AS labeling, round_even(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
def silhouette_euclidean(spark, sf):
    p = fixture(spark, sf, "fx_points")
    return cluster.silhouette(p, ["label"]).select("labeling", round_even("silhouette", 6).alias("silhouette"))


@query(
    "silhouette_squared",
    with_fx("fx_points")
    + """,
d AS (SELECT a.id, a.label AS own, b.label AS other, list_distance(a.v, b.v) * list_distance(a.v, b.v) AS dist
      FROM fx_points a JOIN fx_points b ON a.id <> b.id),
m AS (SELECT id, own, other, avg(dist) AS md FROM d GROUP BY id, own, other),
s AS (SELECT id, max(CASE WHEN other = own THEN md END) AS a, min(CASE WHEN other <> own THEN md END) AS b FROM m GROUP BY id)
SELECT 'label' AS labeling, round_even(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
def silhouette_squared(spark, sf):
    p = fixture(spark, sf, "fx_points")
    return cluster.silhouette_squared(p, ["label"]).select("labeling", round_even("silhouette", 6).alias("silhouette"))


@query("silhouette_curve")
def silhouette_curve(spark, sf):
    p = points(spark, sf).select("id", "v")
    ks = list(range(2, 16))
    labelled = p
    for k in ks:
        model = cluster.kmeans(p, k, seed=SEED)
        labelled = cluster.kmeans_predict(model, labelled).withColumnRenamed("cluster", f"k{k}")
    labelled = cut_lineage(labelled)  # fourteen predictions, read several times
    sil = cluster.silhouette(labelled, [f"k{k}" for k in ks])
    return sil.select(F.expr("CAST(substring(labeling, 2) AS INT)").alias("k"), round_even("silhouette", 6).alias("silhouette"))


# --------------------------------------------------------------------------- Gaussian naive Bayes

NB_FEATS = STD_COLS + ["FLAG_WORK_PHONE"]
NB_SMOOTHING = 1e-9


def _nb_data(spark, sf):
    from scorewise.operators.encode import standardize

    rows = prepared(spark, sf).select("ID", "response", *NB_FEATS).filter(F.col("response").isNotNull())
    z = cut_lineage(standardize(rows, STD_COLS, 2).select("ID", "response", *NB_FEATS))  # read by fit and predict
    b = split_bucket("ID", SEED)
    return z.filter(b >= 20), z.filter(b < 20)


def _nb_sql_prefix() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in STD_COLS)
    zcols = ", ".join(f"round_even(({c} - m_{c}) / s_{c}, 2) AS {c}" for c in STD_COLS)
    unp = "\nUNION ALL\n".join(
        f"SELECT response AS label, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM tr" for c in NB_FEATS
    )
    return (
        PREP_CTE
        + f""",
st AS (SELECT {stats} FROM prepared),
z AS (SELECT ID, response, FLAG_WORK_PHONE, {zcols} FROM prepared, st WHERE response IS NOT NULL),
tr AS (SELECT * FROM z WHERE {split_bucket_sql('ID', SEED)} >= 20),
te AS (SELECT * FROM z WHERE {split_bucket_sql('ID', SEED)} < 20),
lg AS ({unp}),
eps AS (SELECT max(v) * {NB_SMOOTHING} AS e FROM (SELECT var_pop(x) AS v FROM lg GROUP BY feature)),
pr AS (SELECT label, feature, avg(x) AS mean, var_pop(x) + (SELECT e FROM eps) AS var,
              CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tr) AS prior FROM lg GROUP BY label, feature)"""
    )


@query(
    "gaussian_nb_params",
    _nb_sql_prefix()
    + "\nSELECT label, feature, round_even(mean, 6) AS mean, round_even(var, 6) AS var, round_even(prior, 6) AS prior FROM pr",
)
def gaussian_nb_params(spark, sf):
    train, _ = _nb_data(spark, sf)
    p = bayes.fit_params(train, "response", NB_FEATS, NB_SMOOTHING)
    return p.select("label", "feature", *[round_even(c, 6).alias(c) for c in ["mean", "var", "prior"]])


def _nb_predict_sql() -> str:
    terms = []
    for c in NB_FEATS:
        terms.append(
            f"- 0.5 * ln(2 * pi() * (SELECT var FROM pr WHERE pr.label = cl.label AND feature = '{c}'))"
            f" - pow(te.{c} - (SELECT mean FROM pr WHERE pr.label = cl.label AND feature = '{c}'), 2)"
            f" / (2 * (SELECT var FROM pr WHERE pr.label = cl.label AND feature = '{c}'))"
        )
    ll = "ln((SELECT max(prior) FROM pr WHERE pr.label = cl.label)) " + " ".join(terms)
    return (
        _nb_sql_prefix()
        + f""",
cl AS (SELECT DISTINCT label FROM pr),
sc AS (SELECT te.ID, cl.label, {ll} AS ll FROM te, cl)
SELECT ID, label AS prediction FROM sc QUALIFY row_number() OVER (PARTITION BY ID ORDER BY ll DESC, label) = 1"""
    )


@query("gaussian_nb_predict", _nb_predict_sql())
def gaussian_nb_predict(spark, sf):
    train, test = _nb_data(spark, sf)
    p = bayes.fit_params(train, "response", NB_FEATS, NB_SMOOTHING)
    return bayes.predict(test.select("ID", *NB_FEATS), p, NB_FEATS).select("ID", "prediction")
