"""Topics over clustered documents: class-based tf-idf, coherence, merging, taxonomy, few-label classification."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from .graph import cut


def clusters(vectors: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """``vectors`` with a cluster column (k-means)."""
    rows = vectors.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def class_tf_idf(counts: DataFrame, cluster: str, term: str, n: str) -> DataFrame:
    """(cluster, term, weight): share of the term in its cluster times log(1 + mean cluster size / term total)."""
    size = Window.partitionBy(cluster)
    total = counts.groupBy(term).agg(F.sum(n).alias("_tf"))
    mean = counts.groupBy(cluster).agg(F.sum(n).alias("s")).agg(F.avg("s").alias("_mean"))
    rows = counts.withColumn("_size", F.sum(n).over(size)).join(total, term).crossJoin(F.broadcast(mean))
    return rows.select(cluster, term, (F.col(n) / F.col("_size") * F.log(1 + F.col("_mean") / F.col("_tf"))).alias("weight"))


def top_terms(weights: DataFrame, cluster: str, term: str, k: int) -> DataFrame:
    w = Window.partitionBy(cluster).orderBy(F.desc("weight"), F.asc(term))
    return weights.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def coherence(tops: DataFrame, presence: DataFrame, cluster: str, term: str, doc: str) -> DataFrame:
    """Mean PMI of the pairs of each cluster's top terms, over (doc, term) presence."""
    # both are small and used several times: they are written once, so that the texts are read once for each
    tops = cut(tops)
    n = presence.select(doc).distinct().agg(F.count("*").alias("n"))
    wanted = cut(presence.join(F.broadcast(tops.select(term).distinct()), term, "left_semi").distinct())
    single = wanted.groupBy(term).agg(F.count("*").alias("c"))
    a = tops.select(cluster, F.col(term).alias("a"))
    pairs = a.join(tops.select(cluster, F.col(term).alias("b")), cluster).where("a < b")
    x, y = wanted.select(doc, F.col(term).alias("a")), wanted.select(doc, F.col(term).alias("b"))
    both = x.join(y, doc).where("a < b").groupBy("a", "b").agg(F.count("*").alias("ab"))
    sa, sb = single.select(F.col(term).alias("a"), F.col("c").alias("ca")), single.select(F.col(term).alias("b"), F.col("c").alias("cb"))
    rows = pairs.join(both, ["a", "b"]).join(sa, "a").join(sb, "b").crossJoin(F.broadcast(n))
    return rows.groupBy(cluster).agg(F.avg(F.log(F.col("ab") * F.col("n") / (F.col("ca") * F.col("cb")))).alias("coherence"), F.count("*").alias("pairs"))


def alike(tops: DataFrame, cluster: str, term: str, least: float = 0.8) -> DataFrame:
    """Pairs of clusters whose top terms have at least that Jaccard similarity."""
    sets = tops.groupBy(cluster).agg(F.collect_set(term).alias("t"))
    x, y = sets.select(F.col(cluster).alias("a"), F.col("t").alias("ta")), sets.select(F.col(cluster).alias("b"), F.col("t").alias("tb"))
    score = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", score.alias("jaccard")).where(F.col("jaccard") >= least)


def centres(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector of each cluster, by element."""
    e = vectors.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def nearest(vectors: DataFrame, centre: DataFrame, cluster: str, vector: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows most similar to each centre (few centres: they are broadcast)."""
    scored = vectors.crossJoin(F.broadcast(centre.select(F.col(cluster).alias("topic"), "centre"))).withColumn("score", cosine(F.col(vector), F.col("centre")))
    w = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def keyword_topics(docs: DataFrame, text: str, topics: DataFrame) -> DataFrame:
    """Rows with the topics (topic, synonyms) one of whose words the text contains (any case)."""
    low = F.lower(F.col(text))
    return docs.join(F.broadcast(topics), F.exists("synonyms", lambda s: low.contains(F.lower(s)))).drop("synonyms")


def few_label_classifier(rows: DataFrame, vector: str, label: str, folds: int = 3, seed: int = 0):
    """Logistic regression with its penalty chosen by cross-validation."""
    data = rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("_y", F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="_v", labelCol="_y", predictionCol="predicted", maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    judge = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="predicted", metricName="accuracy")
    return CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed).fit(data), data
