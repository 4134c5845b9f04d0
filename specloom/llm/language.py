"""Language identification by word-first backoff.

A known word adds its log frequency in each language; an unseen word falls back to its longest known character
n-grams (five letters down to one, the word's ends marked), each known n-gram of that length adding its share. The
score is the best language's posterior, with the log likelihood tempered by the square root of the number of words.

The frequencies are fitted to a bounded sample of labelled texts: ``sample`` rows of each language, those of least seeded hash. All
words and n-grams that they hold twice or more are known; totals count all. So the table that goes with the tasks is
bounded by the sample.

A null text or one without a letter: ``und`` with score 0. Without any labelled text every text is ``und``. Rows with a
null ``lang`` teach nothing. Ties go to the language that sorts first. Rows repeat as they come; other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm.common import Memo, bounded, crc_mod, hash64, over_batches, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Backoff:
    """``counts`` maps (kind, gram) to counts by language; kind 0 is a word, n an n-gram."""

    def __init__(self, counts: dict[tuple[int, str], dict[str, int]], totals: dict[tuple[int, str], int]):
        self.langs = sorted({lang for (kind, lang), n in totals.items() if kind == 0 and n})
        self.words: dict[str, tuple[float, ...]] = {}
        self.grams: list[dict[str, tuple[float, ...]]] = [{} for _ in range(LONGEST + 1)]
        sizes = Counter(kind for kind, _ in counts)
        for (kind, gram), by in counts.items():
            row = tuple(log((by.get(x, 0) + 0.1) / (totals.get((kind, x), 0) + 0.1 * (sizes[kind] + 1))) for x in self.langs)
            (self.grams[kind] if kind else self.words)[gram] = row
        self.seen = Memo()

    def backed_off(self, word: str) -> tuple[float, ...]:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            rows = [r for g in grams(word, n) if (r := self.grams[n].get(g))]
            if rows:
                return tuple(sum(x) / len(rows) for x in zip(*rows, strict=True))
        return (0.0,) * len(self.langs)

    def of_word(self, word: str) -> tuple[float, ...]:
        return self.words.get(word) or self.seen.get(word) or self.seen.put(word, self.backed_off(word))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        by = Counter(words)
        rows = [(n, self.of_word(w)) for w, n in by.items()]
        sums = [sum(n * r[k] for n, r in rows) / sqrt(len(words)) for k in range(len(self.langs))]
        best = max(range(len(sums)), key=lambda k: (sums[k], -k))
        return self.langs[best], 1 / sum(exp(x - sums[best]) for x in sums)


def train(docs: DataFrame, sample: int = 1_000, least: int = 2, seed: int = 11) -> Backoff:
    """Learns from documents with a ``lang`` whose crc32(doc_id as text) mod 4 is not 2, from ``sample`` of each language at most; words and n-grams seen less than ``least`` times are unknown."""
    fit = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "lang").where("lang is not null and text is not null").where(crc_mod(F.col("doc_id"), 4) != 2)
    _, sizes = bounded(fit.groupBy("lang").agg(F.count("*").alias("all")), "languages", 10_000)
    chance = F.shiftrightunsigned(hash64(seed, F.col("doc_id"), F.col("h")), 11) / float(1 << 53)
    ids = fit.select("doc_id", "lang", F.xxhash64("text").alias("h")).join(sizes, "lang").withColumn("o", chance)
    ids = ids.where(F.col("o") * F.col("all") < 1.5 * sample + 50).select("doc_id", "lang", "h", "o").distinct()  # about half more than are taken, of any language
    ids = ids.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("o", "doc_id"))).where(F.col("r") <= sample)
    _, few = bounded(ids.select(F.col("doc_id").alias("picked"), F.col("lang").alias("l"), "h"), "sample", 200_000)
    picked = fit.join(few, F.col("doc_id").eqNullSafe(F.col("picked")) & (F.col("lang") == F.col("l")) & (F.xxhash64("text") == F.col("h")), "left_semi").dropDuplicates(["doc_id", "lang", "text"])

    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            rows = []
            for lang, by in words.items():
                rows += [(lang, 0, w, n) for w, n in by.items()]
                for n in range(1, LONGEST + 1):
                    c: Counter = Counter()
                    for w, k in by.items():
                        for g in grams(w, n):
                            c[g] += k
                    rows += [(lang, n, g, k) for g, k in c.items()]
            return {k: [r[i] for r in rows] for i, k in enumerate(("lang", "kind", "gram", "n"))}

        return step

    counted = picked.select("text", "lang").mapInArrow(over_batches(make, schema), "lang string, kind int, gram string, n bigint").groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    totals = {(r["kind"], r["lang"]): r["n"] for r in counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language and kind
    kept = counted.groupBy("kind", "gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("all") >= least)
    counts = {(r["kind"], r["gram"]): dict(r["by"]) for r in kept.select("kind", "gram", "by").toArrow().to_pylist()}  # what the sample holds
    return Backoff(counts, totals)


def identify(docs: DataFrame, model: Backoff) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most`` rows
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def make():
        predict = shared.value.predict

        def step(batch: pa.RecordBatch) -> dict:
            both = [predict(x) for x in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "lang_pred": [x for x, _ in both], "score": [x for _, x in both]}

        return step

    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(over_batches(make, schema), "doc_id bigint, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
