"""Embedding operators on precomputed vectors, all as Column expressions over bounded broadcast sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternfish.functions.columns import dot, once, unit
from lanternfish.operators.statistics import exact_quantiles
from lanternfish.plans.staging import stage

REFERENCE_LIMIT = 10_000


def bounded(side: DataFrame, limit: int = REFERENCE_LIMIT) -> DataFrame:
    """A broadcast hint for a side whose size is checked first: references and prompts are small configuration tables."""
    if side.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} reference rows; join them by key instead")
    return F.broadcast(side)


def nearest_reference(rows: DataFrame, vec: str, refs: DataFrame, ref_key: str, ref_vec: str) -> DataFrame:
    """``rows`` with the reference of largest cosine (``ref_key``, smallest key among equals) and that cosine (``cos``).

    The references are one array beside each row, so no row is multiplied and nothing is shuffled.
    """
    entries = bounded(refs.select(F.struct(F.col(ref_key).alias("k"), unit(F.col(ref_vec)).alias("r")).alias("e")))
    table = entries.agg(F.array_sort(F.collect_list("e")).alias("__refs"))  # within the checked limit, in order of key
    scored = once(F.col("__u"), lambda u: F.transform("__refs", lambda e: F.struct(dot(u, e["r"]).alias("cos"), e["k"].alias("k"))))
    best = once(scored, lambda a: F.aggregate(a, F.get(a, F.lit(0)), lambda s, x: F.when(x["cos"] > s["cos"], x).otherwise(s)))
    one = rows.withColumn("__u", unit(F.col(vec))).crossJoin(F.broadcast(table))  # one row of references
    return one.withColumn("__best", best).withColumn(ref_key, F.col("__best.k")).withColumn("cos", F.col("__best.cos")).drop("__u", "__refs", "__best")


def top_mean_cosine(rows: DataFrame, key: str, vec: str, refs: DataFrame, ref_vec: str, k: int = 5) -> DataFrame:
    """(key, sim): mean of the ``k`` largest cosines to the references, of all if there are fewer.

    The references are one array beside each row, so nothing is multiplied out or shuffled.
    """
    table = bounded(refs.select(unit(F.col(ref_vec)).alias("r"))).agg(F.collect_list("r").alias("__refs"))  # within the checked limit
    cosines = once(F.col("__u"), lambda u: F.transform("__refs", lambda r: dot(u, r)))
    best = F.slice(F.sort_array(cosines, asc=False), 1, k)
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    return rows.withColumn("__u", unit(F.col(vec))).crossJoin(F.broadcast(table)).select(key, F.round(mean, 6).alias("sim"))


def best_match(scored: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The row of the largest score of every group, the first in order among equals."""
    w = Window.partitionBy(group).orderBy(F.desc(score), order)
    return scored.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def half_maxima(faces: DataFrame, group: str, cx: str, score: str) -> DataFrame:
    """(group, left_max, right_max): largest score on either half of the picture, null where there is none."""
    return faces.groupBy(group).agg(F.max(F.when(F.col(cx) < 0.5, F.col(score))).alias("left_max"), F.max(F.when(F.col(cx) >= 0.5, F.col(score))).alias("right_max"))


def mean_vector(rows: DataFrame, vec: str) -> DataFrame:
    """One row with the mean vector; components are averaged apart."""
    parts = rows.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))  # one entry a dimension


def trimmed_centroid(rows: DataFrame, vec: str, rounds: int = 3, share: float = 0.25) -> DataFrame:
    """(centroid): mean of unit vectors; each round keeps those at or above the share's percentile of similarity to it.

    A round is two aggregations over the staged unit vectors; one vector and one number go through the driver.  No rows
    give a null centroid.
    """
    spark = rows.sparkSession
    units = stage(rows.select(unit(F.col(vec)).alias("__v")), "unit-vectors")
    schema = "mean array<double>"
    centre = mean_vector(units, "__v").first()["mean"]
    for _ in range(rounds if centre else 0):
        scored = units.crossJoin(F.broadcast(spark.createDataFrame([(centre,)], schema).select(unit(F.col("mean")).alias("__c")))).withColumn("__s", dot(F.col("__v"), F.col("__c")))  # one row
        cut = exact_quantiles(scored, [], "__s", {"cut": share}).first()["cut"]
        centre = mean_vector(scored.where(F.col("__s") >= cut - 1e-12), "__v").first()["mean"]
    return spark.createDataFrame([(centre or None,)], schema).select(unit(F.col("mean")).alias("centroid"))


def zero_shot(rows: DataFrame, key: str, vec: str, prompts: DataFrame, prompt: str, group: str, prompt_vec: str, scene: int, heat: float = 100.0, top: int = 5) -> DataFrame:
    """(key, best_group, best_share, object_mass, best_cos, top): softmax of cosines over all prompts, summed for each group.

    The best group and the largest cosine are taken among groups that are not scenery; object mass is what scenery leaves;
    ``top`` lists the prompts of largest share with it.  The prompts are one array beside each row, so nothing is shuffled.
    """
    table = bounded(prompts.select(F.struct(F.col(prompt).cast("long").alias("p"), F.col(group).cast("long").alias("g"), unit(F.col(prompt_vec)).alias("r")).alias("e"))).agg(
        F.array_sort(F.collect_list("e")).alias("__prompts"))  # within the checked limit
    put = lambda c, **more: F.struct(c["p"].alias("p"), c["g"].alias("g"), *[v.alias(k) for k, v in more.items()])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    r = rows.select(key, unit(F.col(vec)).alias("__u")).crossJoin(F.broadcast(table))  # one row
    r = r.select(key, once(F.col("__u"), lambda u: F.transform("__prompts", lambda e: put(e, cos=dot(u, e["r"])))).alias("c"))
    r = r.withColumn("c", once(F.array_max(F.col("c.cos")), lambda most: F.transform("c", lambda e: put(e, cos=e["cos"], e=F.exp(heat * (e["cos"] - most))))))
    r = r.withColumn("c", once(total(F.col("c.e")), lambda whole: F.transform("c", lambda e: put(e, cos=e["cos"], share=e["e"] / whole))))
    within = lambda g: F.filter("c", lambda e: e["g"] == g)
    r = r.withColumn("groups", F.transform(F.array_distinct(F.col("c.g")), lambda g: F.struct(g.alias("g"), total(F.transform(within(g), lambda e: e["share"])).alias("share"))))
    things = F.filter("groups", lambda x: x["g"] != scene)
    best = F.array_max(F.transform(things, lambda x: F.struct(x["share"].alias("share"), (-x["g"]).alias("g"))))
    first = F.slice(F.array_sort(F.transform("c", lambda e: F.struct((-e["share"]).alias("s"), e["p"].alias("p")))), 1, top)
    return r.select(
        key, (-best["g"]).alias("best_group"), F.round(best["share"], 6).alias("best_share"),
        F.round(1 - total(F.transform(F.filter("groups", lambda x: x["g"] == scene), lambda x: x["share"])), 6).alias("object_mass"),
        F.round(F.array_max(F.transform(F.filter("c", lambda e: e["g"] != scene), lambda e: e["cos"])), 6).alias("best_cos"),
        F.transform(first, lambda x: F.struct(x["p"].alias("prompt"), F.round(-x["s"], 3).alias("share"))).alias("top"))


def classify(sim: Column, mass: Column, cos: Column, cx: Column, subject_least: float = 0.5, mass_least: float = 0.5, cos_least: float = 0.24) -> Column:
    """Class of a picture: who is seen, whether an object is beside, and on which side the subject stands."""
    subject = F.coalesce(sim >= subject_least, F.lit(False))
    thing = F.coalesce(mass >= mass_least, F.lit(False)) & (subject | F.coalesce(cos >= cos_least, F.lit(False)))
    return (F.when(subject & thing & (cx < 0.5), "subject_left").when(subject & thing, "subject_right")
            .when(subject, "subject_only").when(thing, "object_only").otherwise("other"))


def seam_holds(score: Column, rows: Column, straight: Column) -> Column:
    """Whether a vertical seam splits a picture; null parts mean it does not."""
    return F.coalesce((score >= 5) & (straight >= 0.80) & ((rows >= 0.75) | ((straight >= 0.95) & (rows >= 0.45))), F.lit(False))


def side_crop(face_left: Column, face_right: Column, seam: Column, object_right: Column) -> tuple[Column, Column]:
    """Range of the picture's width that shows the object: from the farthest of middle, face edge and seam to the picture's
    edge; null where hardly anything is left."""
    start = F.greatest(F.lit(0.5), face_right, F.coalesce(seam, F.lit(0.5)))
    stop = F.least(F.lit(0.5), face_left, F.coalesce(seam, F.lit(0.5)))
    left = F.when(object_right & (start < 0.92), start).when(~object_right & (stop > 0.08), 0.0)
    right = F.when(object_right & (start < 0.92), 1.0).when(~object_right & (stop > 0.08), stop)
    return left, right
