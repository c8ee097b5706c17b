"""License scans against a plain scan in Python, rule by rule, on planted and odd texts."""

import random
import re
from collections import Counter

import pytest

from signpost.llm import licenses
from signpost.llm.license_rules import BASE, CONFIDENCE, SPAN, STEMS, rules

SCHEMA = "doc_id long, text string, words string, scan string, base string, rule int, label string, start long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = [(r, re.compile(f"^(?:{r.pattern}) ")) for r in rules()]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", "s", "b", 1, "l", 2) for r in rows], SCHEMA)


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(doc, text):
    words = WORD.findall(folded(text))
    met, base = [], []
    if any(stem in folded(text) for stem in STEMS):
        for at in range(len(words)):
            ahead = " ".join(words[at:at + SPAN]) + " "
            for rule, pattern in RULES:
                if words[at] == rule.keyword and (m := pattern.match(ahead)):
                    met.append((at, at + m[0].count(" "), rule))
    for phrase, label in BASE.items():
        own = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i:i + len(own)] == own]
    rank = lambda m: (m[2].level, m[0] - m[1], m[2].id)
    kept = [m for m in met if not any(o[0] <= m[0] and o[1] >= m[1] and rank(o) < rank(m) for o in met)]
    starts, labels = [i for i, _ in base], {label for _, label in base}
    return (doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {m[2].label for m in kept})), max((CONFIDENCE[m[2].level] for m in kept), default=0.0))


def plain(pattern, rng):
    """A text that a rule's pattern matches: every optional part in or out."""
    pattern = re.sub(r"\[\^ \]\+", "Foo", pattern)
    while "(" in pattern:
        pattern = re.sub(r"\(([^()]*)\)(\{0,\d\}|\?)?", lambda m: rng.choice(m[1].split("|")) * (rng.random() < 0.6 if m[2] else 1), pattern)
    pattern = re.sub(r"\[([^]]*)\]", lambda m: m[1][0], pattern)
    return re.sub(r"(.)\?", r"\1", pattern)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    filler = "the work is under a term of this file may to be licensed copyright GNU MIT license Apache general public v2 2 0 3".split()
    rows = []
    for i in range(200):
        parts = [plain(rng.choice(RULES)[0].pattern, rng) if rng.random() < 0.3 else rng.choice(filler) for _ in range(rng.randint(1, 60))]
        rows.append((i, "".join(p.title() * (rng.random() < 0.3) or p for p in " ".join(parts).replace(" ", rng.choice([" ", "\n", "-", ", "])).split("§"))))
    rows += [(300, None), (301, ""), (302, " -.\n"), (303, "word " * 30_000 + "MIT-License"), (304, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]),
             (None, None), (305, "mit license " * 2_000), (306, "mıt license MİT LICENSE mit licensé K license Apache License apache license"),
             (307, "GPLv2 and general-public_license"), (308, "the mit approach to permission slips")]
    return rows


def test_reports_equal_a_plain_scan(spark, rows):
    got = licenses.license_report(frame(spark, rows))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(*r) for r in rows)


def test_stronger_rules_cover_weaker_ones(spark):
    text = "Licensed under the Apache License, Version 2.0 (see MIT License). SPDX-License-Identifier: GPL-2.0-or-later"
    row = licenses.license_matches(frame(spark, [(1, text)])).first()
    assert [(d.start, d.stop, d.level, d.label) for d in row.detections] == [
        (0, 8, 3, "apache-2.0"), (9, 11, 4, "mit"), (11, 19, 1, "gpl-2.0-or-later")]
    assert [(b.start, b.label) for b in row.base] == [(3, "apache"), (9, "mit")]


def test_every_rule_matches_its_own_text(spark):
    rng = random.Random(1)
    texts = [(r.id, plain(r.pattern, rng)) for r, _ in RULES]
    for (own, text), (rule, pattern) in zip(texts, RULES):
        assert (m := pattern.match(text + " ")) and m[0].count(" ") <= SPAN, rule
        longest = re.sub(r"\( \[\^ \]\+\)\{0,(\d)\}", lambda m: " x" * int(m[1]), rule.pattern)
        assert longest.count(" ") + 1 <= SPAN, rule
    assert len(RULES) > 200 and {r.pattern for r, _ in RULES if r.base} == set(BASE)


def test_the_scan_shuffles_nothing_and_starts_no_python(spark, rows):
    plan = licenses.license_report(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Python", "Arrow", "Pandas"))


def test_empty_table(spark):
    assert licenses.license_report(frame(spark, [])).collect() == []
