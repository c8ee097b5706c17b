"""Entity linkage against all pairs of names."""

import random

from pyspark.sql import functions as F

from signpost.operators import linkage as L
from signpost.plans import specified as P


def grams(name):
    padded = f" {name} "
    return {padded[i:i + 3] for i in range(len(padded) - 2)}


def all_pairs(names, similarity):
    out = set()
    for a in names:
        for b in names:
            shared = len(grams(a) & grams(b))
            if a < b and shared / (len(grams(a)) + len(grams(b)) - shared) >= similarity:
                out.add((a, b))
    return out


def variants(rng, count):
    words = ["clinic", "health", "legal", "aid", "office", "centre", "student", "housing", "tax", "north", "desk"]
    out = ["a", "ab", "x"]
    while len(out) < count:
        name = " ".join(rng.sample(words, rng.randint(2, 4)))
        out.append(name)
        for _ in range(rng.randint(0, 3)):  # a letter left out, doubled or changed
            at = rng.randrange(1, len(name) - 1)
            name = rng.choice([name[:at] + name[at + 1:], name[:at] + name[at] + name[at:], name[:at] + "e" + name[at + 1:]])
            out.append(" ".join(name.split()))
    return out


def test_names_and_entities_equal_all_pairs(spark):
    names = variants(random.Random(7), 160)
    table = spark.createDataFrame([(n,) for n in [*names, names[5], "", ""]], "name string")
    for similarity in (0.6, 0.8):
        want = all_pairs(set(names), similarity)
        assert len(want) > 20
        assert {(r.a, r.b) for r in L.similar_names(table, similarity).collect()} == want
    entity = {n: n for n in names}
    for _ in names:
        for a, b in want:
            entity[a] = entity[b] = min(entity[a], entity[b])
    got = L.linked_entities(table, 0.8).collect()
    assert len(got) == len(set(names)) and {r.name: r.entity for r in got} == entity


def test_spelling_variants_meet_in_the_conflict_check(spark):
    claims = spark.createDataFrame(
        [("North Legal Clinic", "phone", "1"), ("north  legal-clinic", "phone", "2"), ("North Legal Clinics", "phone", "1"),
         ("Tax Desk", "phone", "9"), (None, "phone", "3"), ("--", "phone", "4")], "name string, field string, value string")
    placed = L.with_entity(claims, "name")
    assert placed.count() == 6 and placed.where("entity is null").count() == 2
    got = P.conflicting_claims(placed.where(F.col("entity").isNotNull()), ["entity"], "field", "value").collect()
    assert [tuple(r) for r in got] == [("north legal clinic", "phone", 2, "1", "2")]
    assert L.with_entity(claims.where("false"), "name").collect() == []
