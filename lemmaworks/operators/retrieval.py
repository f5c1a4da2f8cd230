"""Vectors: norms, routing, exact top-k search in blocks, ranking metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lemmaworks.session import ship_code

QUERY_BLOCK = 1024
#: Vectors of the corpus that a task compares at a time, about.
PART_ROWS = 50_000


def l2_normalise(v: Column) -> Column:
    """Unit vectors; the zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def best_class(probs: Column, classes: list[str] | None = None) -> Column:
    """The key of the greatest probability of a map; of equal ones the first of ``classes``, or the smallest key without them;
    null for null or empty."""
    top = F.array_max(F.map_values(probs))
    best = F.map_keys(F.map_filter(probs, lambda k, v: v == top))
    if classes is None:
        return F.array_min(best)
    return F.get(F.filter(F.array(*map(F.lit, classes)), lambda c: F.array_contains(best, c)), F.lit(0))


def class_map(classes: list[str], probs: Column) -> Column:
    """Class names to probabilities."""
    return F.map_from_arrays(F.array(*map(F.lit, classes)), probs)


def accuracy(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    """(n, accuracy): the share of rows whose prediction is right; null unless every row has its gold value."""
    right = F.avg(F.coalesce(F.col(pred) == F.col(gold), F.lit(False)).cast("int"))
    return rows.agg(F.count("*").alias("n"), F.when(F.bool_and(F.col(gold).isNotNull()), F.round(right, 6)).alias("accuracy"))


def top_k(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", bucket_col: str | None = None) -> DataFrame:
    """(qid, docid, score, rank): the ``k`` nearest rows by cosine of each query, itself excluded; equal scores by id.

    Exact: queries are packed into blocks of 1,024 vectors, and each block meets every part of the corpus (of its bucket, with
    ``bucket_col``) once, as a matrix product; only ``k`` rows of each query leave a part.  The number of parts follows the
    corpus, PART_ROWS rows each, so that a task's memory does not grow.  Rows without vector or bucket are left out.
    """
    ship_code(corpus.sparkSession)
    bucket = F.lit("") if bucket_col is None else F.col(bucket_col).cast("string")
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), bucket.alias("bucket")).where("v is not null and bucket is not null")
    sizes = rows.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PART_ROWS)).cast("int").alias("parts"))
    docs = rows.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def pack(it):
        for pdf in it:
            for name, part in pdf[pdf["v"].notna()].groupby("bucket"):
                for lo in range(0, len(part), QUERY_BLOCK):
                    some = part.iloc[lo : lo + QUERY_BLOCK]
                    m = np.stack([np.asarray(x, np.float64) for x in some["v"]])
                    yield pd.DataFrame({"bucket": [name], "ids": [some["id"].tolist()], "m": [m.tobytes()], "d": [m.shape[1]]})

    asked = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), bucket.alias("bucket")).where("bucket is not null")
    blocks = asked.mapInPandas(pack, "bucket string, ids array<bigint>, m binary, d int")
    met = blocks.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "docid": [], "score": []}
        if len(left) and len(right):
            norm = lambda a: a / np.where((s := np.linalg.norm(a, axis=1, keepdims=True)) == 0, 1.0, s)
            m, ids = norm(np.stack([np.asarray(x, np.float64) for x in left["v"]])), left["id"].to_numpy()
            for _, b in right.iterrows():
                scores = np.round(norm(np.frombuffer(b["m"], np.float64).reshape(-1, b["d"])) @ m.T, 6)
                for s, qid in zip(scores, b["ids"]):
                    near = np.flatnonzero(s >= -np.partition(-s, k)[k]) if len(s) > k + 1 else np.arange(len(s))
                    near = near[np.lexsort((ids[near], -s[near]))[: k + 1]]
                    near = near[ids[near] != qid]
                    out["qid"] += [qid] * len(near)
                    out["docid"] += ids[near].tolist()
                    out["score"] += s[near].tolist()
        return pd.DataFrame(out).astype({"qid": "int64", "docid": "int64", "score": "float64"})

    near = docs.groupBy("bucket", "part").cogroup(met.groupBy("bucket", "part")).applyInPandas(search, "qid bigint, docid bigint, score double")
    w = W.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_centroid(queries: DataFrame, corpus: DataFrame, label_col: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """queries + ``category``: the label whose mean vector is nearest by cosine, of equal ones the smallest.

    The labels are classes: more than 10,000 are refused, so the table of means stays small.
    """
    at = corpus.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("category"), F.posexplode(vec_col).alias("i", "x"))
    mean = at.groupBy("category", "i").agg(F.avg("x").alias("x")).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("c"))
    mean = mean.select("category", l2_normalise(F.col("c")).alias("c"))
    known = mean.limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("more than 10,000 classes")
    table = F.broadcast(corpus.sparkSession.createDataFrame([(sorted((r["category"], list(r["c"])) for r in known),)], "means array<struct<category:string,c:array<double>>>"))
    unit = l2_normalise(F.col(vec_col))
    dot = lambda m: F.round(F.aggregate(F.zip_with(unit, m["c"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6)
    best = F.array_max(F.transform("means", lambda m: F.struct(dot(m).alias("s"))))["s"]
    return queries.crossJoin(table).withColumn("category", F.get(F.filter("means", lambda m: dot(m) == best), F.lit(0))["category"]).drop("means")


def routed_search(corpus: DataFrame, queries: DataFrame, k: int, bucket_col: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each query inside the bucket that it was routed to (``category`` of ``queries``).

    Every query must have a route and one only; else the run would not be a disjoint union of the buckets' runs.
    """
    bad = queries.groupBy(id_col).agg(F.count_distinct("category").alias("n")).where("n <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"query {bad[0][0]} has {bad[0]['n']} routes")
    asked = queries.select(F.col(id_col), F.col(vec_col), F.col("category").alias(bucket_col)).dropDuplicates([id_col])
    return top_k(corpus, asked, k, id_col, vec_col, bucket_col)


def rerank(run: DataFrame, scores: DataFrame, depth: int = 50) -> DataFrame:
    """(qid, docid, score, rank): the first ``depth`` of each query in the order of a second score (qid, docid, score); without
    one a row is last; equal ones keep their order."""
    few = run.where(F.col("rank") <= depth).select("qid", "docid", F.col("rank").alias("before"))
    both = few.join(scores.select("qid", "docid", "score"), ["qid", "docid"], "left")
    w = W.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "before")
    return both.select("qid", "docid", "score", F.row_number().over(w).alias("rank"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """(judged, ndcg, recall): means over all judged queries, those without a result as zeros."""
    return per_query.agg(F.count("*").alias("judged"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"))


def missing_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid) of judged queries without any result."""
    return qrels.select("qid").distinct().join(run.select("qid").distinct(), "qid", "left_anti")


def metrics(run: DataFrame, qrels: DataFrame, k_ndcg: int = 10, k_recall: int = 100) -> DataFrame:
    """(qid, ndcg, recall) of every judged query; one without any result has zeros.  Relevances are gains; ranks come
    from ``run`` (qid, docid, rank)."""
    rel = qrels.where("relevance > 0").select("qid", "docid", F.col("relevance").cast("double").alias("g")).distinct()
    ideal = rel.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("g"), "docid"))).groupBy("qid").agg(F.sum(F.when(F.col("r") <= k_ndcg, F.col("g") / F.log2(F.col("r") + F.lit(1.0)))).alias("best"), F.count("*").alias("n"))
    hits = run.join(rel, ["qid", "docid"]).groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k_ndcg, F.col("g") / F.log2(F.col("rank") + F.lit(1.0)))).alias("dcg"), F.count_if(F.col("rank") <= k_recall).alias("found")
    )
    judged = qrels.select("qid").distinct()
    out = judged.join(ideal, "qid", "left").join(hits, "qid", "left")
    return out.select("qid", F.round(F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(F.try_divide("found", "n"), F.lit(0.0)), 6).alias("recall"))


def routing_shares(routing: DataFrame, classes: DataFrame) -> DataFrame:
    """(category, n, percent) of all classes (category), also those without a query."""
    n = routing.groupBy("category").agg(F.count("*").alias("n"))
    total = routing.agg(F.count("*").alias("total"))
    rows = classes.select("category").where("category is not null").distinct().join(n, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.crossJoin(total).select("category", "n", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("total")), F.lit(0.0)), 4).alias("percent"))


def project(vectors: DataFrame, k: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", decimals: int = 5) -> DataFrame:
    """(id, x, y): the first principal components of the unit vectors, rounded; wider vectors than 50 go through 50 components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(l2_normalise(F.col(vec_col))).alias("v"))
    if (first := v.select(F.size(vector_to_array("v")).alias("n")).first()) and first["n"] > 50:
        v = PCA(k=50, inputCol="v", outputCol="w").fit(v).transform(v).select("id", F.col("w").alias("v"))
    out = PCA(k=k, inputCol="v", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("p"))
    return out.select("id", *[F.round(F.get("p", F.lit(i)), decimals).alias(n) for i, n in enumerate(["x", "y", "z"][:k])])
