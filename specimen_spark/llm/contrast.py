"""Contrast of bad against good labelled text: words that tell toxic or low-quality documents.

A word's weight is the log ratio of the shares of bad and of good labelled documents that hold it, by its full
64-bit hash; a document's contrast is the largest weight of its words, at least ``FLOOR``. There is one
contrast for toxic and one for low-quality text.

1. One scan counts, per word, the good, toxic and low-quality documents that hold it.
2. Words that can weigh more than ``FLOOR`` stay. Another scan emits them with the documents that hold
   them, and a join by word gives each document its largest weights. A labelled document's own count
   is left out of its words' weights, so labelled documents are judged as others are.
3. The limit is a quantile of the contrasts of good documents.

The tables of words grow with the labelled text. A bitmap of the words that stay thins out what the scan emits;
it is a hint, and the join decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark.llm.common import batches_of, staged
from specimen_spark.llm.words import CHUNK, Words

KINDS = ("toxic", "low")
#: Share of good labelled documents that each contrast keeps.
CLEAN = 0.99
FLOOR = 1.0
#: Labels up to this are sent to all tasks; more meet the documents in a join.
MAX_BROADCAST = 2_000_000
#: Words up to this are told to the scan as a bitmap of 2^BITMAP bits (hint only).
MAX_HINT, BITMAP = 4_000_000, 25
#: A piece of the bitmap has 2^_PIECE bits.
_PIECE = 19
#: Distinct words a task counts before it sends them on.
COUNTED = 2_000_000
_SLICE = 100_000


def label_classes(labels: DataFrame) -> DataFrame:
    """(labelled, class) per labelled doc_id: 1 good, 2 toxic, 4 low quality, 6 both."""
    per = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t"))
    bad = F.when(F.col("t") == 1, 2).otherwise(0) + F.when(F.col("q") == 0, 4).otherwise(0)
    good = (F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)
    return per.select("labelled", F.when(good, 1).otherwise(bad).cast("int").alias("class")).filter("class > 0")


def _distinct(batches):
    """Per part of a batch: the part, and its distinct (document, word) pairs."""
    for batch in batches:
        for at, end in batches_of(batch, "text", CHUNK):
            part = batch.slice(at, end - at)
            words = Words(part.column("text"), lower=True)
            owner = np.repeat(np.arange(part.num_rows), np.diff(words.bounds))
            order = np.lexsort((words.hash, owner))
            doc, word = owner[order], words.hash[order].view(np.int64)
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
            yield part, doc[first], word[first]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, good, toxic, low): by how many labelled documents of each kind a word is held."""

    def out(words, counts):
        for at in range(0, len(words), _SLICE):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at : at + _SLICE]), *[pa.array(c[at : at + _SLICE]) for c in counts]], names=["word", "good", *KINDS])

    def run(batches):
        seen, counts = np.zeros(0, np.int64), np.zeros((3, 0), np.int64)
        for part, doc, word in _distinct(batches):
            kind = part.column("class").to_numpy(zero_copy_only=False)[doc]
            words, at = np.unique(np.concatenate([seen, word]), return_inverse=True)
            total = np.stack([np.bincount(at, np.concatenate([c, (kind >> i) & 1]), len(words)).astype(np.int64) for i, c in enumerate(counts)])
            seen, counts = words, total
            if len(seen) > COUNTED:
                yield from out(seen, counts)
                seen, counts = seen[:0], counts[:, :0]
        yield from out(seen, counts)

    rows = docs.filter("class > 0").select("text", "class").mapInArrow(run, "word long, good long, toxic long, low long")
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("good", *KINDS)])


def weight(bad: Column, good: Column, n_bad: Column, n_good: Column) -> Column:
    """Log ratio of smoothed document shares; 0 for words that neither side has."""
    ratio = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
    return F.when(bad + good > 0, ratio).otherwise(0.0)


def bitmap(words: DataFrame) -> np.ndarray:
    """2^BITMAP bits, those of the words set. Tasks make pieces of it, so the driver gets its bytes, never a row per word."""

    def piece(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _PIECE, bool)
        bits[rows.column("bit").to_numpy() & ((1 << _PIECE) - 1)] = True
        return pa.table({"piece": rows.column("piece")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bit = F.col("word").bitwiseAND(F.lit((1 << BITMAP) - 1))
    pieces = words.select(F.shiftright(bit, _PIECE).alias("piece"), bit.alias("bit")).groupBy("piece").applyInArrow(piece, "piece long, bits binary")
    table = np.zeros((1 << BITMAP - _PIECE, 1 << _PIECE - 3), np.uint8)
    for row in pieces.toLocalIterator():
        table[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def held_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(mark, class, held): the words of ``words``, and few others, that each document holds."""
    hint = None
    if words.count() <= MAX_HINT:
        hint = bitmap(words)

    def run(batches):
        for part, doc, word in _distinct(batches):
            if hint is not None:
                bit = word & ((1 << BITMAP) - 1)
                some = (hint[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                doc, word = doc[some], word[some]
            for at in range(0, len(doc), _SLICE):
                rows = pa.array(doc[at : at + _SLICE])
                yield pa.RecordBatch.from_arrays(
                    [part.column("mark").take(rows), part.column("class").take(rows), pa.array(word[at : at + _SLICE])], names=["mark", "class", "held"])

    return docs.select("text", "mark", "class").mapInArrow(run, "mark long, class int, held long")


def contrasts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(m, toxic, low) of rows (doc_id, text, mark) with a contrast above ``FLOOR``, and each kind's limit.

    Without labelled documents of a kind, or without good ones, its limit is infinite.
    """
    classes = staged(label_classes(labels), "classes")
    few = classes.count() <= MAX_BROADCAST
    wide = docs.join(F.broadcast(classes) if few else classes, F.col("doc_id") == F.col("labelled"), "left").withColumn(
        "class", F.coalesce("class", F.lit(0)))
    sizes = wide.filter("class > 0").groupBy("class").count().collect()
    n = [sum(r["count"] for r in sizes if r["class"] >> i & 1) for i in range(3)]
    limits = dict.fromkeys(KINDS, math.inf)
    if not n[0] or not n[1] + n[2]:
        return wide.sparkSession.createDataFrame([], "m long, toxic double, low double"), limits
    counts = staged(word_counts(wide), "word_counts")

    def weights(own: Column | None):
        """Weights by kind; ``own`` is the class of the document that looks."""
        less = [F.lit(0) if own is None else F.shiftright(own, i).bitwiseAND(F.lit(1)) for i in range(3)]
        return {k: weight(F.col(k) - less[i], F.col("good") - less[0], n[i] - less[i], n[0] - less[0]) if n[i] else F.lit(0.0)
                for i, k in enumerate(KINDS, 1)}

    # Highest where a good document looks, whose own count is left out.
    able = weights(F.least(F.col("good"), F.lit(1)).cast("int"))
    words = staged(counts.filter((able["toxic"] > FLOOR) | (able["low"] > FLOOR)), "telling_words")
    found = held_words(wide, words).join(words, F.col("held") == F.col("word"))
    own = weights(F.col("class"))
    most = staged(
        found.select("mark", "class", *[own[k].alias("w_" + k) for k in KINDS]).filter(f"w_toxic > {FLOOR} or w_low > {FLOOR}")
        .groupBy(F.col("mark").alias("m")).agg(F.max("class").alias("class"), *[F.max("w_" + k).alias(k) for k in KINDS]),
        "contrasts",
    )
    # Good documents without such words are at the floor; the quantile counts them without listing them.
    good = most.filter("class = 1")
    above = good.count()
    below = n[0] - above
    for i, k in enumerate(KINDS, 1):
        if n[i]:
            at = (CLEAN * n[0] - below) / above if above else 0.0
            got = good.agg(F.percentile_approx(F.greatest(F.col(k), F.lit(FLOOR)), min(at, 1.0), 100_000)).first()[0] if at > 0 else None
            limits[k] = FLOOR if got is None else got
    return most.select("m", *KINDS), limits
