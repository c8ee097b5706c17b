"""Entity linkage: names that are spelled alike become one entity, by blocking and verified similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.functions.text import casefold
from signpost.session import written

GRAM = 3


def plain_name(name: Column | str) -> Column:
    """A name without case, marks and repeated spaces; empty for null and for names of marks alone."""
    return F.coalesce(F.trim(F.regexp_replace(casefold(name), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def _grams(plain: Column) -> Column:
    """The distinct n-grams of a plain name within spaces."""
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(padded) - (GRAM - 1)), lambda i: F.substring(padded, i, F.lit(GRAM))))


def similar_names(names: DataFrame, similarity: float = 0.7) -> DataFrame:
    """``a, b, similarity`` (a < b): plain names of ``names(name)`` that share that part of their n-grams.

    Similarity is shared n-grams over all n-grams of both. Exact: two such names share one of each
    one's rarest ``n - ceil(similarity * n) + 1`` n-grams, so only those are joined, between names whose
    counts of n-grams allow the similarity at all; whole sets are compared once for each pair found.
    """
    sets = written(names.select("name").where("name <> ''").distinct().select(
        "name", _grams(F.col("name")).alias("grams")), "names")
    held = sets.select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = held.groupBy("gram").agg(F.count("*").alias("names"))
    ordered = held.join(common, "gram").groupBy("name", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("names", "gram"))), lambda g: g["gram"]).alias("grams"))
    # The small amount keeps products such as 0.7 * 10 from being rounded up past the whole number.
    shortest = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    rare = written(ordered.select("name", "n", F.explode(F.slice("grams", F.lit(1), shortest)).alias("gram")), "rare")
    other = rare.select(F.col("name").alias("b"), F.col("n").alias("m"), "gram")
    met = rare.withColumnRenamed("name", "a").join(other, "gram").where(
        (F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9)).select("a", "b").distinct()
    both = met.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("left")), "a").join(
        sets.select(F.col("name").alias("b"), F.col("grams").alias("right")), "b")
    shared = F.size(F.array_intersect("left", "right"))
    share = shared / (F.size("left") + F.size("right") - shared)
    return both.select("a", "b", share.alias("similarity")).where(F.col("similarity") >= similarity)


def linked_entities(names: DataFrame, similarity: float = 0.7) -> DataFrame:
    """``name, entity`` of every distinct plain name: the least name reachable over :func:`similar_names`.

    Labels travel along links and then from each name to its label's own label, so that long chains
    take few rounds; every round is a written table.
    """
    pairs = similar_names(names, similarity).select("a", "b")
    links = written(pairs.union(pairs.select("b", "a")), "links")
    labels = written(links.groupBy(F.col("a").alias("name")).agg(F.least(F.col("name"), F.min("b")).alias("entity")), "labels")
    while True:
        near = links.join(labels.select(F.col("name").alias("b"), "entity"), "b").groupBy(F.col("a").alias("name")).agg(
            F.min("entity").alias("near"))
        moved = labels.join(near, "name").select("name", F.col("entity").alias("was"), F.least("entity", "near").alias("step"))
        jump = labels.select(F.col("name").alias("step"), F.col("entity").alias("far"))
        grown = written(moved.join(jump, "step", "left").select(
            "name", "was", F.least("step", F.coalesce("far", "step")).alias("entity")), "labels")
        labels = grown.select("name", "entity")
        if grown.where("was <> entity").isEmpty():
            break
    every = names.select("name").where("name <> ''").distinct()
    return every.join(labels, "name", "left").select("name", F.coalesce("entity", "name").alias("entity"))


def with_entity(rows: DataFrame, name: str, similarity: float = 0.7, into: str = "entity") -> DataFrame:
    """``rows`` with the entity their name stands for; rows without a name keep none (null)."""
    keyed = rows.withColumn("_plain", plain_name(name))
    entities = linked_entities(keyed.select(F.col("_plain").alias("name")), similarity)
    return keyed.join(entities.select(F.col("name").alias("_plain"), F.col("entity").alias(into)), "_plain", "left").drop("_plain")
