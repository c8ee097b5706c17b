"""License scans by ordered signature rules, in Spark's own expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.functions.text import let
from signpost.llm.license_rules import BASE, CONFIDENCE, SPAN, STEMS, rules

# Runs of anything but ASCII signs, space and control characters. Said without ``[^...]``, which Java reads five times slower.
_WORD = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "id int, level int, label string, pattern string, base boolean"


def _rules() -> Column:
    """The rules of each keyword, as a constant map."""
    held: dict[str, list] = {}
    for rule in rules():
        held.setdefault(rule.keyword, []).append(
            {"id": rule.id, "level": rule.level, "label": rule.label, "pattern": f"^(?:{rule.pattern}) ", "base": rule.base})
    return F.from_json(F.lit(json.dumps(held)), f"map<string, array<struct<{', '.join(c.replace(' ', ': ') for c in _RULE.split(', '))}>>>")


def _matches(words: Column) -> Column:
    """``(at, found)`` for every word at which a rule matches, in order; ``found`` holds all matches that begin there."""
    places = F.filter(
        F.transform(words, lambda w, i: F.struct(i.cast("long").alias("at"), F.element_at(_rules(), w).alias("rules"))),
        lambda p: p.rules.isNotNull())

    def at(place: Column) -> Column:
        ahead = F.concat(F.array_join(F.slice(words, (place.at + 1).cast("int"), SPAN), " "), F.lit(" "))
        tried = let(ahead, lambda text: F.transform(place.rules, lambda r: F.struct(
            place.at.alias("start"),
            (place.at + F.length(F.regexp_replace(F.call_function("regexp_extract", text, r.pattern, F.lit(0)), "[^ ]+", ""))).alias("stop"),
            r.level.alias("level"), r.id.alias("rule"), r.label.alias("label"), r.base.alias("base"))))
        return F.struct(place.at.alias("at"), F.filter(tried, lambda m: m.stop > m.start).alias("found"))

    return F.filter(F.transform(places, at), lambda p: F.size(p.found) > 0)


def _kept(matches: Column) -> Column:
    """The matches that no other one covers: one of a lower level, of the same level but longer, or as long but of an earlier rule.

    What covers a match begins at most a span before it, so only so many places are looked at.
    """
    def rank(m: Column) -> Column:
        return F.struct(m.level, m.start - m.stop, m.rule)

    def of(place: Column, nth: Column) -> Column:
        first = F.greatest(nth - SPAN + 2, F.lit(1))
        near = F.flatten(F.transform(F.slice(matches, first, SPAN), lambda p: p.found))
        return let(near, lambda others: F.filter(place.found, lambda m: ~F.exists(
            others, lambda o: (o.start <= m.start) & (o.stop >= m.stop) & (rank(o) < rank(m)))))

    return F.flatten(F.transform(matches, of))


def license_matches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, detections`` of every row of ``documents``.

    ``n_words`` counts the words of the whole text (runs of anything but ASCII signs and space).
    ``detections`` lists ``start, stop, level, rule, label`` of the rules that match, over words in
    lower case (ASCII letters only) from ``start`` up to but without ``stop``; ``base`` the places of the
    base phrases alone, covered ones too. A rule is tried where its first word stands, and only in
    texts that hold one of the stems, which are looked for first. Of matches one of which covers the
    other's words, the one of the lower level stays; of one level the longer, of one length the earlier
    rule.

    Every row is scanned by itself: nothing is shuffled, and the work follows the words. Null and
    empty texts have no words and no detections; repeated rows and rows without a ``doc_id`` are
    scanned like others; other columns are ignored.
    """
    text = F.col("text").cast("string")
    stems = F.array(*map(F.lit, STEMS))
    held = let(F.lower(text), lambda lower: F.exists(stems, lambda stem: lower.contains(stem)))
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    scanned = let(words, lambda w: let(_matches(w), lambda m: F.struct(
        F.filter(F.flatten(F.transform(m, lambda p: p.found)), lambda x: x.base).alias("base"), _kept(m).alias("detections"))))
    fields = "start: bigint, stop: bigint, level: int, rule: int, label: string, base: boolean"
    kind = f"struct<base: array<struct<{fields}>>, detections: array<struct<{fields}>>>"
    none = F.struct(F.array().alias("base"), F.array().alias("detections")).cast(kind)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.explode(F.array(F.when(held, scanned.cast(kind)).otherwise(none))).alias("scan"))
    return rows.select("doc_id", "n_words", "scan.base", "scan.detections")


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the least and
    greatest of them. ``labels`` are those of :func:`license_matches` and the base ones, ``score`` is the
    confidence of the surest detection (0 without any).
    """
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda m: m.start)
    base = F.transform("base", lambda m: F.element_at(F.create_map(*(F.lit(x) for r in rules() if r.base for x in (r.id, BASE[r.pattern]))), m.rule))
    sure = F.create_map(*(x for level, value in CONFIDENCE.items() for x in (F.lit(level), F.lit(value))))
    return license_matches(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("detections", lambda m: m.label))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda m: F.element_at(sure, m.level))), F.lit(0.0)).alias("score"))
