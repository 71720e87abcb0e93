"""Train and held-out views, splits by groups, work planning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import content_hash


#: What names a view: its block of runs, and its number within the block.
VIEW = ("block", "view_id")


def exhaustive_views(acquisitions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(block, view_id, acquisition_id, canonical_class, split_role): for each block of two runs of k classes, 2^k views.

    Runs of a class are paired by rank: 1 and 2 are block 0, 3 and 4 block 1. Bit i of the view says which run of the
    block's class i trains; the other one is held out. A last run without a partner, or a block that lacks a class, stays in
    its views, and validate_views finds them incomplete.
    """
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("canonical_class")) - 1
    v = acquisitions.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit((1 << len(classes)) - 1))))
    bit = F.floor(F.col("view_id") / F.pow(F.lit(2.0), at)).cast("int") % 2
    block, run = F.floor((F.col("run_rank") - 1) / 2).cast("int").alias("block"), (F.col("run_rank") - 1) % 2
    return v.select(block, "view_id", "acquisition_id", "canonical_class", F.when(run == bit, "train").otherwise("held_out").alias("split_role"))


def materialize_view(views: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows of every view with their role; views are the small side, which adaptive execution broadcasts if it is."""
    return features.join(views.select(*VIEW, "acquisition_id", "split_role"), "acquisition_id")


def validate_views(views: DataFrame, features: DataFrame, per_role: int, classes: int) -> DataFrame:
    """(block, view_id, train_n, held_n, overlap, class_complete, unknown, ok)."""
    both = views.groupBy(*VIEW, "acquisition_id").agg(F.count_distinct("split_role").alias("roles")).groupBy(*VIEW).agg(F.count_if(F.col("roles") > 1).alias("overlap"))
    role = lambda r: F.count_if(F.col("split_role") == r)
    n = views.groupBy(*VIEW).agg(role("train").alias("train_n"), role("held_out").alias("held_n"), F.count_distinct(F.when(F.col("split_role") == "train", F.col("canonical_class"))).alias("tc"), F.count_distinct(F.when(F.col("split_role") != "train", F.col("canonical_class"))).alias("hc"))
    lost = views.join(features.select("acquisition_id").distinct(), "acquisition_id", "left_anti").groupBy(*VIEW).agg(F.count("*").alias("unknown"))
    j = n.join(both, list(VIEW)).join(lost, list(VIEW), "left").withColumn("unknown", F.coalesce("unknown", F.lit(0)))
    complete = (F.col("tc") == classes) & (F.col("hc") == classes)
    ok = complete & (F.col("train_n") == per_role) & (F.col("held_n") == per_role) & (F.col("overlap") == 0) & (F.col("unknown") == 0)
    return j.select(*VIEW, "train_n", "held_n", "overlap", complete.alias("class_complete"), "unknown", ok.alias("ok"))


def _shuffled(key: str, seed: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)


def group_split(df: DataFrame, group: str, seed: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """The table with split_role: whole groups go to train, validation or test, in the order of a seeded hash.

    With g groups the cuts are max(1, round(g * train)) and max(first + 1, round(g * (train + validation))), at most g - 1,
    rounded half to even; an empty test role takes the last group. Ranks are taken over the distinct groups, not the rows:
    within 4096 ranges of the hash, after the counts of the ranges before.
    """
    groups = df.select(group).distinct().withColumn("_o", _shuffled(group, seed)).withColumn("_range", F.substring("_o", 1, 3))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = groups.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))  # 4096 rows at most
    within = F.row_number().over(W.partitionBy("_range").orderBy("_o", group))
    ranked = groups.withColumn("_k", within).join(ranges, "_range").withColumn("_r", F.col("_k") + F.col("_before"))
    total = groups.agg(F.count("*").alias("g"))
    a = F.greatest(F.lit(1), F.bround(F.col("g") * F.lit(train)).cast("int"))
    b = F.greatest(F.col("_a") + 1, F.bround(F.col("g") * F.lit(train + validation)).cast("int"))
    cuts = total.withColumn("_a", F.least(a, F.col("g") - 1)).withColumn("_b", F.least(b, F.col("g") - 1))
    roles = ranked.crossJoin(F.broadcast(cuts)).select(group, F.when(F.col("_r") <= F.col("_a"), "train").when((F.col("_r") <= F.col("_b")) & (F.col("_r") < F.col("g")), "validation").otherwise("test").alias("split_role"))  # one row of cuts
    return df.join(roles, group)


def stratified_split(df: DataFrame, label: str, key: str, seed: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """The table with split_role by hash order within each label; all labels together if one has fewer than three rows.

    The rank within a label comes from 4096 ranges of the hash, so that a label that most rows have is not sorted whole in
    one task.
    """
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"] or 0
    h = df.withColumn("_o", _shuffled(key, seed)).withColumn("_s", F.col(label).cast("string") if least >= 3 else F.lit("*")).withColumn("_b", F.substring("_o", 1, 3))
    n = h.groupBy("_s", "_b").agg(F.count("*").alias("n"))
    w = W.partitionBy("_s")
    before = n.select("_s", "_b", F.coalesce(F.sum("n").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("n").over(w).alias("_n"))
    r = h.withColumn("_r", F.row_number().over(W.partitionBy("_s", "_b").orderBy("_o", key))).join(before, ["_s", "_b"])
    place = (F.col("_before") + F.col("_r") - 1) / F.col("_n")
    role = F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test")
    return r.withColumn("split_role", role).drop("_o", "_s", "_b", "_r", "_before", "_n")


def valid_group_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, valid): every value there, and more than one but fewer than all rows different."""
    stats = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column_name"), ((F.col(f"c_{c}") == F.col("n")) & (F.col(f"d_{c}") > 1) & (F.col(f"d_{c}") < F.col("n"))).alias("valid")) for c in columns]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def group_disjointness(df: DataFrame, group: str, roles: Sequence[str]) -> DataFrame:
    """(role_a, role_b, overlap): groups that two roles share."""
    of = lambda r: df.where(F.col("split_role") == r).select(group).distinct()
    pairs = [(a, b) for i, a in enumerate(roles) for b in roles[i + 1 :]]
    return reduce(DataFrame.unionAll, [of(a).intersect(of(b)).agg(F.count("*").alias("overlap")).select(F.lit(a).alias("role_a"), F.lit(b).alias("role_b"), "overlap") for a, b in pairs])


def partition_profile(df: DataFrame, group: str, label: str) -> DataFrame:
    """(split_role, label, rows, groups) by role and label, and with a null label by role."""
    g = df.groupingSets([["split_role", label], ["split_role"]], "split_role", label)
    return g.agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))


def tag_role(df: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """The table with split_role, `unassigned` where the assignment doesn't know the key."""
    return df.join(roles.select(key, "split_role"), key, "left").withColumn("split_role", F.coalesce("split_role", F.lit("unassigned")))


def reference_catalog(view_features: DataFrame, baseline: str) -> DataFrame:
    """(block, view_id, split_role, n, window_ids): the baseline class's windows that train or are held out, ids sorted."""
    w = view_features.where(F.col("canonical_class") == baseline)
    name = F.concat_ws(":", F.lpad(F.col("acquisition_id").cast("string"), 8, "0"), F.lpad(F.col("window_order").cast("string"), 6, "0"))
    return w.groupBy(*VIEW, "split_role").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("window_ids"))


def derive_seed(*parts: Column | str) -> Column:
    """The first eight hexadecimal digits of the parts' SHA-256, as a number."""
    return F.conv(F.substring(content_hash(*parts), 1, 8), 16, 10).cast("long")


def execution_grid(dimensions: Sequence[DataFrame]) -> DataFrame:
    """(unit columns, unit_id, status): all combinations of small dimension tables, none started yet."""
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dimensions)  # dimensions of a few rows each
    return grid.withColumn("unit_id", F.concat_ws("__", *[F.col(c).cast("string") for c in grid.columns])).withColumn("status", F.lit("NEVER_STARTED"))


def resume_plan(plan: DataFrame, registry: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units of the plan that the registry doesn't know as complete: same hash and row count as stored."""
    done = registry.where("stored_hash <=> expected_hash AND stored_rows <=> expected_rows")
    return plan.join(done, key, "left_anti")


def assignment_summary(views: DataFrame) -> DataFrame:
    """(block, view_id, training, held_out, training_n, held_out_n): ids joined by `|`."""
    ids = lambda r: F.array_join(F.array_sort(F.collect_list(F.when(F.col("split_role") == r, F.col("acquisition_id")))), "|")
    n = lambda r: F.count_if(F.col("split_role") == r)
    return views.groupBy(*VIEW).agg(ids("train").alias("training"), ids("held_out").alias("held_out"), n("train").alias("training_n"), n("held_out").alias("held_out_n"))


def leakage_safe_split(df: DataFrame, label: str, key: str, groups: Sequence[str], seed: str) -> DataFrame:
    """A group split by the first valid group column, else the stratified one; `limitation` says which.

    An error for fewer than three rows or a blank label.
    """
    size = df.agg(F.count("*").alias("n"), F.count_if(F.col(label).isNull() | (F.btrim(F.col(label).cast("string")) == "")).alias("blank")).first()
    if size["n"] < 3 or size["blank"]:
        raise ValueError("a split takes three rows or more, all labelled")
    good = {r["column_name"] for r in valid_group_columns(df, groups).where("valid").collect()} if groups else set()
    for g in groups:
        if g in good:
            return group_split(df, g, seed).withColumn("limitation", F.lit(f"GROUPED_BY_{g}"))
    return stratified_split(df, label, key, seed).withColumn("limitation", F.lit("ROWS_NOT_GROUPED"))
