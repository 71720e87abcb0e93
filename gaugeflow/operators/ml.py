"""Preparation, fitting and scoring on tables. Whatever is learnt is learnt from rows whose split_role is `train`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import argmax_name, content_hash, fixed, normalized_entropy, or_null
from ..plans.dealing import dealt
from .boosting import boosted_probabilities, fit_boosted
from .ranks import medians

TRAIN = "train"


def _train(df: DataFrame, role: str) -> DataFrame:
    if role != TRAIN:
        raise ValueError("statistics are learnt from the training rows only")
    return df.where(F.col("split_role") == TRAIN)


def impute_train(df: DataFrame, columns: Sequence[str], how: str = "mean", role: str = TRAIN) -> DataFrame:
    """Every value that isn't finite is replaced by the training rows' mean or exact median of the finite ones, or 0."""
    if how == "median":
        found = medians(_train(df, role), {c: or_null(c) for c in columns})
        stats = found.agg(*[F.coalesce(F.max(F.when(F.col("name") == c, F.col("median"))), F.lit(0.0)).alias(f"_{c}") for c in columns])
    else:
        stats = _train(df, role).agg(*[F.coalesce(F.avg(or_null(c)), F.lit(0.0)).alias(f"_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.coalesce(or_null(c), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def standardize_train(df: DataFrame, columns: Sequence[str], role: str = TRAIN) -> DataFrame:
    """(x - mean) / population std of the training rows; a std of 0 counts as 1."""
    stats = _train(df, role).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def canonical_probabilities(scores: Column | str, classes: Sequence[str]) -> Column:
    """A map class -> score as an array in canonical order, absent and negative scores 0, divided by its sum."""
    m = F.col(scores) if isinstance(scores, str) else scores
    raw = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(m, c), F.lit(0.0))))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / len(classes))))


def centroid_probabilities(df: DataFrame, view: Sequence[str], x: str, classes: Sequence[str]) -> DataFrame:
    """The table with `p`: softmax over the classes of -d^2 / 2, d being the distance to the class mean in standardised space.

    Means and scales are those of each view's training rows. They are aggregated by (view, class, position), a handful of
    rows a view, and joined back; a class without training rows gets probability 0.
    """
    cells = df.where(F.col("split_role") == TRAIN).select(*view, "canonical_class", F.posexplode(x).alias("at", "v"))
    scale = cells.groupBy(*view, "at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    means = cells.groupBy(*view, "at", "canonical_class").agg(F.avg("v").alias("c"))
    by_class = F.map_from_entries(F.collect_list(F.struct("canonical_class", "c")))
    in_order = F.transform(F.array(*[F.lit(c) for c in classes]), lambda n: F.try_element_at("_c", n))
    stats = means.groupBy(*view, "at").agg(by_class.alias("_c")).withColumn("c", in_order).drop("_c").join(scale, [*view, "at"])
    stats = stats.select(*view, F.struct("at", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"), "c").alias("stat"))
    stats = stats.groupBy(*view).agg(F.array_sort(F.collect_list("stat")).alias("stats")) if view else stats.agg(F.array_sort(F.collect_list("stat")).alias("stats"))
    j = df.join(stats, list(view))

    def logit(k: int) -> Column:
        parts = F.zip_with(x, "stats", lambda v, t: ((v - t["m"]) / t["s"] - (t["c"][k] - t["m"]) / t["s"]))
        return -F.aggregate(parts, F.lit(0.0), lambda a, d: a + d * d) / 2

    logits = F.array(*[F.coalesce(logit(c), F.lit(float("-inf"))) for c in range(len(classes))])
    j = j.withColumn("_l", logits).withColumn("_e", F.transform("_l", lambda v: F.exp(v - F.array_max("_l"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    return j.withColumn("p", F.transform("_e", lambda v: v / total)).drop("stats", "_l", "_e")


def predict_records(df: DataFrame, classes: Sequence[str], p: str = "p") -> DataFrame:
    """The table with predicted_class (first of equals), confidence and normalised entropy."""
    near = F.transform(p, lambda v: F.round(v, 12))  # sums in another order must not break ties differently
    return df.withColumns({"predicted_class": argmax_name(near, classes), "confidence": F.array_max(p), "entropy": normalized_entropy(p)})


def prediction_hash(df: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    return df.withColumn("prediction_hash", content_hash(*keys, F.array_join(F.transform(p, lambda v: fixed(v)), ",")))


def linear_scores(rows: DataFrame, coefficients: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """(row_key, class, logit, probability) for long rows (row_key, feature, x) and (class, feature, coef), `intercept` being a feature.

    A model is small: its classes become columns, a feature's coefficients meet its rows by a broadcast join, and a row's sums
    are one group, with a column a class. A class none of whose features a row has is no row of the result.
    """
    classes = [r["class"] for r in coefficients.where("feature <> 'intercept'").select("class").distinct().orderBy("class").collect()]
    base = {r["class"]: r["coef"] for r in coefficients.where("feature = 'intercept'").collect()}
    wide = coefficients.where("feature <> 'intercept'").groupBy("feature").agg(*[F.sum(F.when(F.col("class").eqNullSafe(F.lit(c)), F.col("coef"))).alias(f"_c{k}") for k, c in enumerate(classes)])
    sums = [s for k in range(len(classes)) for s in (F.sum(F.col("x") * F.col(f"_c{k}")).alias(f"_s{k}"), F.count(f"_c{k}").alias(f"_n{k}"))]
    s = dealt(rows, *row_key).join(F.broadcast(wide), "feature").groupBy(*row_key).agg(*sums)
    told = [F.when(F.col(f"_n{k}") > 0, F.struct(F.lit(c).alias("class"), (F.col(f"_s{k}") + F.lit(base.get(c) or 0.0)).alias("logit"))) for k, c in enumerate(classes)]
    s = s.select(*row_key, F.array_compact(F.array(*told)).alias("_l"))
    s = s.withColumn("_m", F.array_max(F.transform("_l", lambda v: v["logit"])))
    s = s.withColumn("_t", F.aggregate("_l", F.lit(0.0), lambda t, v: t + F.coalesce(F.exp(v["logit"] - F.col("_m")), F.lit(0.0))))
    out = s.select(*row_key, "_m", "_t", F.explode("_l").alias("_v"))
    return out.select(*row_key, "_v.class", "_v.logit", (F.exp(F.col("_v.logit") - F.col("_m")) / F.col("_t")).alias("probability"))


def local_contributions(rows: DataFrame, coefficients: DataFrame, row_key: Sequence[str], scored: DataFrame) -> DataFrame:
    """(row_key, class, feature, contribution, residual) of each row's most probable class; residual is the sum's error."""
    best = scored.groupBy(*row_key).agg(F.max_by("class", F.struct(F.round("logit", 9), "class")).alias("class"), F.max("logit").alias("logit"))
    c = dealt(rows, *row_key).join(best, list(row_key)).join(F.broadcast(coefficients), ["class", "feature"])  # a model is small
    base = coefficients.where("feature = 'intercept'").select("class", F.col("coef").alias("intercept"))
    c = c.join(F.broadcast(base), "class", "left").withColumn("contribution", F.col("x") * F.col("coef"))
    total = F.sum("contribution").over(W.partitionBy(*row_key)) + F.coalesce("intercept", F.lit(0.0))
    return c.select(*row_key, "class", "feature", "contribution", (total - F.col("logit")).alias("residual"))


def permuted_scores(rows: DataFrame, repeats: int, features: Sequence[str], seed: str, row_key: str = "row_id") -> DataFrame:
    """(repeat, feature, row_key, donor): for each repeat and feature, the row whose value stands in: a permutation by hash order.

    Ranks are taken by range of the hash: 256 buckets a (repeat, feature), each with its own window, offset by the counts before.
    """
    base = rows.select(row_key).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))

    def ranked(order: Column, name: str) -> DataFrame:
        b = base.withColumn("o", order).withColumn("bucket", F.substring("o", 1, 2))
        n = b.groupBy("repeat", "feature", "bucket").agg(F.count("*").alias("n"))
        before = n.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("repeat", "feature").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
        inside = F.row_number().over(W.partitionBy("repeat", "feature", "bucket").orderBy("o", row_key))
        return b.withColumn("inside", inside).join(before, ["repeat", "feature", "bucket"]).select("repeat", "feature", (F.col("before") + F.col("inside")).alias("rank"), F.col(row_key).alias(name))

    key = F.col(row_key).cast("string")
    own = ranked(F.sha2(F.concat_ws("|", F.lit(seed), F.lit("own"), key), 256), row_key)
    other = ranked(F.sha2(F.concat_ws("|", F.lit(seed), F.col("repeat").cast("string"), "feature", key), 256), "donor")
    return own.join(other, ["repeat", "feature", "rank"]).select("repeat", "feature", row_key, "donor")


def topk_features(importance: DataFrame, k: int, group: str = "view_id") -> DataFrame:
    """(group, feature, rank): the k most important features of each group, ties by name."""
    r = F.row_number().over(W.partitionBy(group).orderBy(F.col("importance").desc(), "feature"))
    return importance.withColumn("rank", r.cast("int")).where(F.col("rank") <= k).select(group, "feature", "rank")


def feature_frequency(top: DataFrame, group: str = "view_id") -> DataFrame:
    """(feature, frequency): the share of the groups that have the feature among their top ones."""
    n = top.agg(F.count_distinct(group).alias("groups"))
    return top.groupBy("feature").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("feature", (F.col("n") / F.col("groups")).alias("frequency"))  # one row


def pairwise_jaccard(top: DataFrame, group: str = "view_id", blocks: int = 16) -> DataFrame:
    """(a, b, jaccard) of the feature sets of all ordered pairs of groups, each with itself too.

    What two groups share is counted by a join on the feature, groups by feature combining first; pairs that share nothing
    come from the groups' sizes. Every ordered pair is a row of the result; pairs meet by blocks of groups.
    """
    member = top.select(group, "feature").distinct()
    sizes = member.groupBy(group).agg(F.count("*").alias("n"))
    side = lambda g, n, own, other: sizes.select(F.col(group).alias(g), F.col("n").alias(n), F.pmod(F.xxhash64(group), F.lit(blocks).cast("long")).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias(other))
    pairs = side("a", "n_a", "i", "j").join(side("b", "n_b", "j", "i"), ["i", "j"]).drop("i", "j")
    shared = member.withColumnRenamed(group, "a").join(member.withColumnRenamed(group, "b"), "feature").groupBy("a", "b").agg(F.count("*").alias("both"))
    both = F.coalesce("both", F.lit(0))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", (both / (F.col("n_a") + F.col("n_b") - both)).alias("jaccard"))


def replay_compare(first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(verdict, n): keys by whether two runs agree on all values."""
    pack = lambda df, n: df.select(*keys, F.struct(*values).alias(n))
    j = pack(first, "x").join(pack(second, "y"), list(keys), "full_outer")
    verdict = F.when(F.col("x").isNull(), "ONLY_SECOND").when(F.col("y").isNull(), "ONLY_FIRST").when(F.col("x").eqNullSafe(F.col("y")), "EQUIVALENT").otherwise("DIFFERENT")
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def label_equivalence(predicted: DataFrame, stored: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """(rows_checked, all_equal) of predicted against stored labels."""
    j = predicted.select(*key, F.col(label).alias("x")).join(stored.select(*key, F.col(label).alias("y")), list(key), "left")
    return j.agg(F.count("*").alias("rows_checked"), F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("all_equal"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (k * n_c)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("rows"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(every)).select(label, (F.col("rows") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def fit_predict(df: DataFrame, columns: Sequence[str], classes: Sequence[str], kind: str, keys: Sequence[str], seed: int = 7, trees: int = 20, iterations: int = 50, depth: int = 8, leaves: int = 31) -> DataFrame:
    """(keys, p, predicted_class, confidence, entropy) of the held-out rows by a classifier of the training rows.

    kind is `logistic` (multinomial, L2 with C = 1) or `forest`, both of MLlib and with classes that weigh n / (k * n_c), or
    `boosted` (histograms, trees grown leaf by leaf, unweighted). Columns must be finite: impute first.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("canonical_class")).cast("double") - 1
    rows = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.withColumn("label", index))
    train = rows.where(F.col("split_role") == TRAIN)
    test = rows.where(F.col("split_role") != TRAIN).select(*keys, *columns, "features")
    if kind == "boosted":
        model = fit_boosted(train.withColumn("label", F.col("label").cast("int")), columns, "label", len(classes), iterations, leaves)
        out = boosted_probabilities(test, model, keys).withColumnRenamed("p", "_s")
        scores = F.col("_s")
    else:
        train = train.join(F.broadcast(class_weights(train, "label")), "label")
        make = {"logistic": lambda: LogisticRegression(family="multinomial", maxIter=iterations, regParam=1.0 / max(1, train.count()), standardization=False, weightCol="weight"), "forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed)}
        out = make[kind]().fit(train).transform(test)
        scores = vector_to_array(F.col("probability"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
    padded = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda i: F.coalesce(F.get("_s", i), F.lit(0.0)) / total)
    out = out.withColumn("_s", scores).withColumn("p", padded).select(*keys, "p")
    return predict_records(out, classes)

