"""Clustering and partition-quality queries on the embedding features."""

from pyspark.sql import functions as F

from gyrespark.operators import clustering, filters, quality
from gyrespark.operators import partitions as many
from gyrespark.plans import climatology
from gyrespark.plans.catalog.base import load, query, r6

DIM = 64
PAIR = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
CENTRE = "c AS (SELECT label, count(*) AS n, [" + ", ".join(f"avg(embedding[{i + 1}])" for i in range(DIM)) + "] AS c FROM embeddings GROUP BY 1), gc AS (SELECT [" + ", ".join(f"avg(embedding[{i + 1}])" for i in range(DIM)) + "] AS g FROM embeddings)"


def emb(spark, folder):
    return load(spark, folder, "embeddings")


@query("within_between_ss", f"""WITH {CENTRE}, w AS (SELECT sum(pow(list_distance(e.embedding, c.c), 2)) AS w FROM embeddings e JOIN c USING (label)), b AS (SELECT sum(n * pow(list_distance(c.c, g), 2)) AS b FROM c, gc)
SELECT round(w, 5) AS within_ss, round(b, 5) AS between_ss FROM w, b""")
def within_between_ss(spark, folder):
    out = quality.scatter(emb(spark, folder), "label", "embedding")
    return out.select(F.round("within_ss", 5).alias("within_ss"), F.round("between_ss", 5).alias("between_ss"))


@query("calinski_harabasz", f"""WITH {CENTRE}, w AS (SELECT sum(pow(list_distance(e.embedding, c.c), 2)) AS w, count(*) AS n FROM embeddings e JOIN c USING (label)), b AS (SELECT sum(n * pow(list_distance(c.c, g), 2)) AS b, count(*) AS k FROM c, gc)
SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz FROM w, b""")
def calinski_harabasz(spark, folder):
    return quality.scatter(emb(spark, folder), "label", "embedding").select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query("davies_bouldin", f"""WITH {CENTRE}, s AS (SELECT label, avg(list_distance(e.embedding, c.c)) AS s FROM embeddings e JOIN c USING (label) GROUP BY 1),
p AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS m FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1) SELECT round(avg(m), 6) AS davies_bouldin FROM p""")
def davies_bouldin(spark, folder):
    return quality.davies_bouldin(emb(spark, folder), "label", "embedding").select(r6("davies_bouldin").alias("davies_bouldin"))


@query("silhouette_exact", f"""WITH d AS (SELECT a.vec_id, a.label, b.label AS other, sum({PAIR}) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
r AS (SELECT vec_id, max(CASE WHEN other = label THEN s / n END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM r""")
def silhouette_exact(spark, folder):
    return quality.silhouette(emb(spark, folder), "vec_id", "label", "embedding").select(r6("silhouette").alias("silhouette"))


@query("connectivity", f"""WITH d AS (SELECT a.vec_id, a.label <> b.label AS differs, row_number() OVER (PARTITION BY a.vec_id ORDER BY {PAIR}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT round(sum(CASE WHEN differs THEN 1.0 / rank ELSE 0 END), 6) AS connectivity FROM d WHERE rank <= 20""")
def connectivity(spark, folder):
    return quality.connectivity(emb(spark, folder), "vec_id", "label", "embedding", 20).select(r6("connectivity").alias("connectivity"))


@query("hubert_gamma", f"""SELECT round(corr({PAIR}, CASE WHEN a.label = b.label THEN 0.0 ELSE 1.0 END), 6) AS hubert_gamma FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def hubert_gamma(spark, folder):
    return quality.hubert_gamma(emb(spark, folder), "vec_id", "label", "embedding").select(r6("hubert_gamma").alias("hubert_gamma"))


@query("cluster_centroids", """WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) SELECT label, count(*) AS n, CAST(i AS INTEGER) AS i, round(avg(v), 6) AS c FROM e GROUP BY label, i""")
def cluster_centroids(spark, folder):
    out = quality.centroids(emb(spark, folder), "label", "embedding")
    return out.select("label", "n", F.posexplode("centroid").alias("i", "c")).withColumn("c", r6("c"))


@query("standard_scaling", """SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS size_z, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS price_z FROM part""")
def standard_scaling(spark, folder):
    out = clustering.scale(load(spark, folder, "part"), ["p_size", "p_retailprice"], "standard")
    return out.select("p_partkey", r6("p_size_z").alias("size_z"), r6("p_retailprice_z").alias("price_z"))


@query("robust_scaling", """SELECT p_partkey, round((p_size - (SELECT quantile_cont(p_size, 0.5) FROM part)) / (SELECT quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) FROM part), 6) AS size_z FROM part""")
def robust_scaling(spark, folder):
    return clustering.scale(load(spark, folder, "part"), ["p_size"], "robust").select("p_partkey", r6("p_size_z").alias("size_z"))


@query("median_imputation", """SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_size END, (SELECT quantile_cont(p_size, 0.5) FROM part WHERE p_size > 10)) AS s FROM part""")
def median_imputation(spark, folder):
    p = load(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("s"), F.when(F.col("p_size") > 45, F.lit(1.0)).alias("mostly_missing"))
    out, kept = clustering.impute_median(p, ["s", "mostly_missing"], 0.5)
    return out.select("p_partkey", *kept)


@query("small_cluster_merge", """WITH f AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN 9 WHEN p_size > 25 THEN 1 ELSE 0 END AS g, p_size * 1.0 AS s FROM part), c AS (SELECT g, avg(s) AS c, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 10 FROM part))
SELECT p_partkey, CASE WHEN g IN (SELECT g FROM c) THEN g ELSE (SELECT arg_min(c.g, (pow(f.s - c.c, 2), c.g)) FROM c) END AS g FROM f""")
def small_cluster_merge(spark, folder):
    p = load(spark, folder, "part")
    g = p.select("p_partkey", F.when(F.col("p_size") == 50, 9).when(F.col("p_size") > 25, 1).otherwise(0).alias("g"), F.col("p_size").cast("double").alias("s"))
    return clustering.merge_small_clusters(g, ["s"], "g", max(1, p.count() // 10)).select("p_partkey", "g")


@query("adjusted_rand_index", """WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM t), ra AS (SELECT sum(k * (k - 1) / 2.0) AS a FROM (SELECT sum(n) AS k FROM t GROUP BY a)), rb AS (SELECT sum(k * (k - 1) / 2.0) AS b FROM (SELECT sum(n) AS k FROM t GROUP BY b))
SELECT CAST(round((s - CAST(a AS DOUBLE) * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - CAST(a AS DOUBLE) * b / (n * (n - 1) / 2.0)), 6) AS DOUBLE) AS ari FROM s, ra, rb""")
def adjusted_rand_index(spark, folder):
    value = clustering.adjusted_rand_row(load(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")
    return value.select(r6("ari").alias("ari"))


def _features(spark, folder):
    e = emb(spark, folder)
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIM)])


NAMES = [f"f{i}" for i in range(DIM)]


@query("kmeans_clusters", None)
def kmeans_clusters(spark, folder):
    out, _ = clustering.clusters(_features(spark, folder), NAMES, 5, "kmeans")
    return out.select("vec_id", "cluster")


@query("gaussian_mixture_clusters", None)
def gaussian_mixture_clusters(spark, folder):
    scaled = clustering.scale(_features(spark, folder), NAMES)
    out, _ = clustering.gaussian_mixture(scaled, [f"{n}_z" for n in NAMES], 3, tries=10)
    return out.select("vec_id", "cluster")


@query("principal_components", None)
def principal_components(spark, folder):
    out = clustering.project(clustering.scale(_features(spark, folder), NAMES), [f"{n}_z" for n in NAMES], None, 0.95)
    return out.select("vec_id", *[F.abs(F.round(c, 6)).alias(c) for c in out.columns if c.startswith("pc")])


@query("cluster_number_sweep", None)
def cluster_number_sweep(spark, folder):
    return climatology.sweep_clusters(_features(spark, folder), "vec_id", NAMES, list(range(2, 16)), agreement=())


@query("partition_stability", None)
def partition_stability(spark, folder):
    return many.partition_scores(_features(spark, folder), "vec_id", NAMES, [4], "label", ["stability", "classifiability", "reproducibility"], label_k=10)


@query("partition_noise_level", None)
def partition_noise_level(spark, folder):
    return many.partition_scores(_features(spark, folder), "vec_id", NAMES, [4], n_noise=50)


@query("season_cluster_sweep", None)
def season_cluster_sweep(spark, folder):
    """Customers' largest orders, by season and number of clusters."""
    from gyrespark.operators import aggregate

    peaks = aggregate.peak_row(load(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice", ["o_orderkey"], skip_first=False, tie=["o_orderkey"])
    peaks = peaks.withColumns({"price": F.col("o_totalprice").cast("double"), "day": F.dayofyear("o_orderdate").cast("double"), "year": F.year("o_orderdate").cast("double")})
    seasons = list(filters.SEASON_MONTHS)
    rows = climatology.with_seasons(peaks, "o_orderdate", seasons)
    return climatology.sweep_clusters(rows, "o_custkey", ["price", "day", "year"], [2, 3, 4, 5], season="season", seasons=seasons)


@query("season_of_peaks", """WITH q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM q WHERE rn = 1 AND month(o_orderdate) IN (7, 8, 9)""")
def season_of_peaks(spark, folder):
    from gyrespark.operators import aggregate

    peaks = aggregate.peak_row(load(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice", ["o_orderkey"], skip_first=False, tie=["o_orderkey"])
    return climatology.season_partition(peaks, "o_orderdate", "summer").select("o_custkey", "o_orderkey", "o_totalprice")


