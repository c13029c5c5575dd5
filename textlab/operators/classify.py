"""Classification: majority baseline, stratified folds, balanced multinomial
logistic regression with out-of-fold predictions, and the scoring job.

The classifier is Spark ML (JVM); the k-fold loop launches k fits, k is a
small constant.  Terms are counted once for all folds; the documents are then
written once to the shared checkpoint folder as counts over the folds' terms, in
Parquet, which every fold weights by its own vocabulary.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_order, vector_terms, vector_unigrams
from . import features, tables


def majority_label(df: DataFrame, label: str):
    """Most frequent label; ties -> lexicographically least (one scalar)."""
    row = (df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc(label)).limit(1).first())
    return row[label] if row else None


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """Exactly stratified, deterministic folds without a per-class window.

    Rows are ranked by (label, hash(key)) with the partition-offset method;
    the rank within the label, modulo k, is the fold.  A dominant class is
    spread over all partitions instead of one task.
    """
    h = df.withColumn("_h", hash_order(key, seed))
    ranked = tables.sequential_ids(h, [label, "_h", key], "_g", start=0)
    first = ranked.groupBy(label).agg(F.min("_g").alias("_g0"))  # one row per class
    return (ranked.join(F.broadcast(first), label)
            .withColumn(fold_col, F.pmod(F.col("_g") - F.col("_g0"), F.lit(k)).cast("int"))
            .drop("_h", "_g", "_g0"))


def with_folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """``df`` with :func:`stratified_folds`: only keys and labels are ranked, the
    other columns meet their fold by key.  Keys that repeat keep their rows."""
    most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > 1:
        return stratified_folds(df, label, key, k, seed)
    folds = stratified_folds(df.select(key, label), label, key, k, seed).select(F.col(key).alias("_key"), "fold")
    return df.join(folds.checkpoint(eager=True), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def with_terms(df: DataFrame, text: str, terms_col: str = "terms") -> DataFrame:
    """Adds the 1- and 2-gram term array used by the vectorizer."""
    u = df.withColumn("_u", vector_unigrams(text))
    return u.withColumn(terms_col, vector_terms("_u", 2)).drop("_u")


def balanced_weights(train: DataFrame, label: str, weight_col: str = "w") -> DataFrame:
    """weight = n / (n_classes · n_c) (class_weight='balanced')."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    stats = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k")).first()
    n, nk = stats["_n"], stats["_k"]
    return (train.join(F.broadcast(counts), label)  # one row per class
            .withColumn(weight_col, F.lit(float(n)) / (F.lit(float(nk)) * F.col("_nc")))
            .drop("_nc")), n


def out_of_fold(df: DataFrame, key: str, text: str, label: str, k: int = 5, seed: int = 42,
                vocab_size: int = 5000, min_df: int = 2, max_iter: int = 1000, tol: float = 1e-4,
                fit_features: str = "fold") -> DataFrame:
    """Out-of-fold predictions: (key, label, fold, prediction).

    ``fit_features='fold'`` fits vocabulary and idf on each training split
    (no leakage); ``'all'`` fits them once on all rows (the original setup).
    Logistic regression: multinomial, L2 with regParam = 1/n_train (the C=1
    objective divided by the total weight), balanced weights, no
    standardisation.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer

    from ..session import checkpoint_root, shared_path

    spark = df.sparkSession
    checkpoint_root(spark)
    docs = with_folds(df.select(key, text, label), label, key, k, seed)
    tokens = docs.select(F.array(vector_unigrams(text)).alias("_u"), "fold")
    sizes = dict.fromkeys(range(k), 0) | {r["fold"]: r["count"] for r in docs.groupBy("fold").count().collect()}
    if fit_features == "all":
        vocab = features.fit_vocabulary(tokens, sum(sizes.values()), 2, min_df, max_features=vocab_size)
        idfs = [{r["term"]: r["idf"] for r in vocab.terms.collect()}] * k
    else:
        idfs = features.fit_without_each(tokens, "fold", sizes, min_df, vocab_size)
    terms = sorted(set().union(*idfs))  # bounded by k vocabularies
    path = shared_path(spark, "counts")
    counter = features.term_counter(terms or [""], "terms", "_tf")
    counter.transform(with_terms(docs, text)).select(key, label, "fold", "_tf").write.parquet(path)
    base = spark.read.parquet(path)
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(base)
    labelled = indexer.transform(base)

    def fit_fold(f: int) -> DataFrame:
        train = labelled.where(F.col("fold") != f)
        test = labelled.where(F.col("fold") == f)
        feat = features.weighting(terms or [""], idfs[f], "_tf", "features")
        train_w, n_train = balanced_weights(feat.transform(train), "_y")
        lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="w",
                                family="multinomial", regParam=1.0 / max(n_train, 1),
                                elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                                tol=tol)
        model = lr.fit(train_w)
        return model.transform(feat.transform(test)).select(key, label, "fold", "prediction")

    # the k fits are independent Spark jobs.  A fit keeps its training rows in
    # memory, so only as many run at once as leave cores idle on their own
    at_once = spark.sparkContext.defaultParallelism // max(base.rdd.getNumPartitions(), 1)
    with ThreadPoolExecutor(max_workers=max(1, min(k, at_once))) as pool:
        parts = list(pool.map(fit_fold, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    result = back.transform(out).select(key, label, "fold", F.col("predicted").alias("prediction"))
    # materialise the predictions: readers do not score again
    return result.checkpoint(eager=True)


def fold_accuracy(oof: DataFrame, label: str, pred: str = "prediction") -> DataFrame:
    """One row: per-fold accuracy mean and population std, overall accuracy."""
    per = oof.groupBy("fold").agg(F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0)).alias("acc"))
    overall = oof.agg(F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0)).alias("oof_accuracy"),
                      F.count(F.lit(1)).alias("n"))
    folds = per.agg(F.avg("acc").alias("cv_mean"), F.stddev_pop("acc").alias("cv_std"),
                    F.count(F.lit(1)).alias("k"))
    return tables.combine_rows(overall, folds)
