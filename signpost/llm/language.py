"""Language identification by words first, and by shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import held_out, map_arrow, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 5
TRAINING_ROWS = 20_000
WORDS_EACH = 20_000
GRAMS_EACH = 8_000
UNKNOWN = "und"
# Tokens and words whose scores a task holds before it starts anew.
CACHE = 200_000
# Texts that are Python strings at once.
SLICE = 256
_RUN = re.compile(r"[^\W\d_]+")


class Model:
    """Log frequencies by language: ``words`` and ``grams`` map to rows of ``table``."""

    def __init__(self, languages, prior, words, grams, table):
        self.languages, self.prior, self.words, self.grams, self.table = languages, prior, words, grams, table

    def parts(self) -> tuple:
        return self.languages, self.prior, self.words, self.grams, self.table


def learn(rows: DataFrame, training_rows: int = TRAINING_ROWS, words_each: int = WORDS_EACH, grams_each: int = GRAMS_EACH) -> Model:
    """A model of the languages of ``rows`` (``doc_id, text, lang``); rows without text or language are left out.

    It is fitted on about ``training_rows`` rows, those whose ``doc_id`` and text hash lowest, and
    keeps the ``words_each`` most frequent words of each language and its ``grams_each`` most
    frequent n-grams of each length up to 5 within ``^word$``. Counting is one Spark job; only the
    kept counts come to the driver, a bounded number for each language.
    """
    labelled = rows.where("lang is not null and text is not null")
    total = labelled.agg(F.count("*")).first()[0]
    if not total:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0)))
    share = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    drawn = labelled.where(share < training_rows / total).select("lang", F.lower("text").alias("text"))
    words = drawn.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("item"))
    counts = written(words.groupBy("lang", "item").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
    grams = counts.select("lang", "n", marked.alias("item")).select("lang", "n", F.explode(F.flatten(F.array(*(
        F.expr(f"if(length(item) < {k}, array(), transform(sequence(1, length(item) - {k - 1}), i -> named_struct('size', {k}, 'item', substr(item, i, {k}))))")
        for k in range(1, LONGEST + 1))))).alias("gram")).groupBy("lang", "gram.size", "gram.item").agg(F.sum("n").alias("n"))
    every = counts.select("lang", F.lit(0).alias("size"), "item", "n").unionByName(grams)
    sums = {(r["lang"], r["size"]): (r["n"], r["kinds"]) for r in every.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item"))
    most = every.withColumn("_order", order).where(F.col("_order") <= F.when(F.col("size") == 0, words_each).otherwise(grams_each)).drop("_order")
    languages = sorted({lang for lang, _ in sums})
    if not languages:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0)))
    by_item: dict[tuple[int, str], dict[str, int]] = {}
    for r in most.collect():
        by_item.setdefault((r["size"], r["item"]), {})[r["lang"]] = r["n"]
    column = {lang: i for i, lang in enumerate(languages)}
    n = {size: np.array([sums.get((lang, size), (0, 0))[0] for lang in languages], float) for size in range(LONGEST + 1)}
    kinds = {size: max(1, max(sums.get((lang, size), (0, 0))[1] for lang in languages)) for size in range(LONGEST + 1)}
    table = np.empty((len(by_item), len(languages)))
    index: tuple[dict, dict] = ({}, {})
    for row, ((size, item), seen) in enumerate(by_item.items()):
        count = np.full(len(languages), 0.5)
        for lang, c in seen.items():
            count[column[lang]] += c
        table[row] = np.log(count / (n[size] + 0.5 * kinds[size]))
        index[size > 0][item] = row
    prior = np.log((n[0] + 1) / (n[0] + 1).sum())
    # Only differences between languages matter; taking the best as 0 keeps long sums small.
    return Model(languages, prior, *index, table - table.max(axis=1, keepdims=True))


class Scorer(dict):
    """Rows of scores by token, filled as tokens are met; row 0 is no evidence."""

    def __init__(self, model: Model):
        self.model, self.scores, self.width = model, array("d", model.table.tobytes()), len(model.languages)
        self.nothing = array("d", [0.0] * self.width)
        self.by_word: dict[str, array] = {}
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.by_word.clear()
        self.rows, self.filled, self.new = np.zeros((1024, len(self.model.languages))), 1, []

    def __missing__(self, token: str) -> int:
        runs = _RUN.findall(token.lower())
        row = self.filled + len(self.new) if runs else 0
        if len(runs) == 1:
            self.new.append(self.of_word(runs[0]))
        elif runs:
            self.new.append(array("d", map(sum, zip(*map(self.of_word, runs)))))
        self[token] = row
        return row

    def row(self, row: int) -> array:
        return self.scores[row * self.width:(row + 1) * self.width]

    def of_word(self, word: str) -> array:
        score = self.by_word.get(word)
        if score is None:
            known = self.model.words.get(word)
            score = self.by_word[word] = self.row(known) if known is not None else self.of_unseen(word)
        return score

    def of_unseen(self, word: str) -> array:
        marked, row_of = f"^{word}$", self.model.grams.get
        for size in range(LONGEST, 0, -1):
            found = [self.row(row) for i in range(len(marked) - size + 1) if (row := row_of(marked[i:i + size])) is not None]
            if found:
                return array("d", [sum(column) / len(found) for column in zip(*found)])
        return self.nothing

    def known_rows(self) -> np.ndarray:
        if self.new:
            while self.filled + len(self.new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.filled:self.filled + len(self.new)] = np.array(self.new)
            self.filled += len(self.new)
            self.new = []
        return self.rows

    def of_text(self, text: str) -> tuple[str, float]:
        if not any(map(str.isalpha, text)) or not self.model.languages:
            return UNKNOWN, 0.0
        tokens = text.split()
        rows = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        total = self.model.prior + self.known_rows().take(rows, axis=0).sum(axis=0)
        best = int(np.argmax(total))
        score = 1.0 / np.exp(total - total[best]).sum()
        if len(self) > CACHE or len(self.by_word) > CACHE:
            self.start_anew()
        return self.model.languages[best], float(score)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``row, lang_pred, score`` for every row, ``row`` holding all its columns.

    The words of the whole text are scored: a known one by its log frequency in each language, an
    unseen one by the mean over its known n-grams of the greatest length that has any. ``score`` is
    the share of the best language's probability. A null text, one without a letter, and every
    text where nothing could be learned, is ``und`` with score 0.
    """
    # Plain values, which workers read without this package.
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    rows = docs.select(F.struct("*").alias("row"))
    text = docs.columns.index("text")
    from pyspark.sql.types import DoubleType, StringType, StructType

    kind = StructType([rows.schema["row"]]).add("lang_pred", StringType()).add("score", DoubleType())

    def make():
        scorer = Scorer(Model(*shared.value))

        def run(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, SLICE):
                part = batch.column(0).slice(at, SLICE)
                texts = part.flatten()[text].cast(pa.string()).to_pylist()
                found = [scorer.of_text(t) if t else (UNKNOWN, 0.0) for t in texts]
                yield [part, [f[0] for f in found], [f[1] for f in found]]
        return run

    return map_arrow(rows, make, kind)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose language may be learned: those not held out."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").where(~held_out(F.col("doc_id")))


def languages_of(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``documents``; see :func:`predict`.

    Rows without a ``doc_id`` are not held out. Rows may repeat; an empty table gives no rows.
    """
    scored = predict(docs.select("doc_id", "text"), learn(training_rows(docs)))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose language is found with at least ``least_score``, unchanged."""
    scored = predict(docs, learn(training_rows(docs)))
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
