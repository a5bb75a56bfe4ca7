"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

Words are told by their whole 64-bit hashes and bigrams by 64-bit hashes of both, so the model grows with its text, and words
that the trusted text lacks share one unknown word's mass. (``vocabulary`` folds words into so many ids.) A token adds

    log((c - d) / S(v) + lower(w)) + log rest(v)    of a bigram (v, w) seen c times, else    log lower(w) + log rest(v)

to its document's log-likelihood, where S(v) sums the discounts of a context, rest(v) is S(v) by its tokens, and
lower(w) counts the contexts of w. Each word is also the context of the next, so all but S(v) is known where w is: bigrams are
dealt out by their last word, and with it lie its contexts, its rest and the documents that hold it.

1. Bigrams of training documents are counted, contexts and counts of counts summed, and S(v) put to each bigram.
2. Documents become blocks: per block and shard the words and bigrams with the document each belongs to, sorted and compressed.
3. Blocks meet the bigrams of their shard in a co-grouped join; each shard gives every document of a
   block its share of the log-likelihood, and the shares of a block are added up. Shards grow in number with the text; those
   of very frequent words are dealt to several groups of blocks.
4. A language's limit is a quantile of the perplexities of held-out trusted documents, drawn towards
   that of all languages: their mean of logarithms, weighted by the language's number of these documents and
   by ``POOLED``. Languages without any have the limit of all. Documents above it are rejected.
5. ``judge`` also rejects documents by their contrast to good labelled text (``contrast.py``).

1 reads the training text in ``COUNT_PASSES`` turns, 2 and 3 all texts in ``PASSES``, each for a part of the words, so that only that
part of all tokens is on disk at once.

Training text: all documents labelled good and not toxic. Their ids are written, and go to all tasks up to
``MAX_BROADCAST``, so that no text moves; more meet the documents in a join. One in ``FOLDS`` is held out. Scoring and limits cover all documents.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import batches_of, prepared, release, staged, table, without
from specimen_spark.llm.contrast import KINDS, MAX_BROADCAST, contrasts
from specimen_spark.llm.words import CHUNK, Words, mix

#: Ids of a folded vocabulary, from 1, where one is asked for; ``BEGIN`` begins a document, whole words too.
VOCABULARY = 1 << 13
BEGIN = 0
#: Turns over the training text, and over all texts.
COUNT_PASSES, PASSES = 2, 4
FOLDS = 10
QUANTILE = 0.995
#: The limit of all languages counts as so many held-out documents in that of a language.
POOLED = 30
#: Tokens that a group of the join holds, about, and bytes of text for each.
TOKENS_A_GROUP, BYTES_A_TOKEN = 3_000_000, 6
#: Tokens a task counts at once before it sends their bigrams on.
COUNTED = 1_000_000
#: Documents of a block; their number and a mark take 16 bits.
BLOCK_ROWS = 30_000
_LAST = 1 << 15

#: shard -1: the documents of a block; else the block's tokens in that shard.
BLOCKS = (
    "block long, shard int, codes binary, "
    "doc_id array<long>, mark array<long>, lang array<string>, n_words array<int>, trust array<int>"
)
_BLOCK_TYPES = {
    "block": pa.int64(), "shard": pa.int32(), "codes": pa.binary(), "share": pa.binary(), "doc_id": pa.list_(pa.int64()),
    "mark": pa.list_(pa.int64()), "lang": pa.list_(pa.string()), "n_words": pa.list_(pa.int32()), "trust": pa.list_(pa.int32()),
}
HEAD = -1
_DOC = ("doc_id", "mark", "lang", "n_words", "trust")


def _planes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def pack_codes(words: np.ndarray, grams: np.ndarray, docs: np.ndarray) -> bytes:
    """Tokens sorted by word and bigram: both as differences, and documents, byte plane by byte plane, compressed."""
    steps = [np.diff(x.view(np.uint64), prepend=np.zeros(1, np.uint64)) for x in (words, grams)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*[_planes(x, "<u8") for x in steps], _planes(docs, "<u2")]))


def unpack_codes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 18

    def column(at: int, size: int) -> np.ndarray:
        return np.ascontiguousarray(raw[at * n : (at + size) * n].reshape(size, n).T).view(f"<u{size}").ravel()

    words, grams = (np.cumsum(column(at, 8), dtype=np.uint64) for at in (0, 8))
    return words.view(np.int64), grams, column(16, 2).astype(np.int64)


def word_ids(words: Words, vocabulary: int | None = None) -> np.ndarray:
    """Whole 64-bit hashes, or ids from 1 of a folded vocabulary."""
    return words.hash.view(np.int64) if vocabulary is None else (words.hash % np.uint64(vocabulary - 1)).astype(np.int64) + 1


def bigrams(words: Words, vocabulary: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the one before it, itself, and whether it ends its document."""
    ids, some = word_ids(words, vocabulary), np.diff(words.bounds) > 0
    before, last = np.full(len(ids), BEGIN, np.int64), np.zeros(len(ids), bool)
    before[1:] = ids[:-1]
    before[words.bounds[:-1][some]] = BEGIN
    last[words.bounds[1:][some] - 1] = True
    return before, ids, last


def gram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a bigram."""
    return mix(mix(before.view(np.uint64)) * np.uint64(0xA0761D6478BD642F) + word.view(np.uint64))


def _parts(batches):
    for batch in batches:
        for at, end in batches_of(batch, "text", CHUNK):
            for some in range(at, end, BLOCK_ROWS):
                yield batch.slice(some, min(BLOCK_ROWS, end - some))


def training_counts(docs: DataFrame):
    """A function of (turn, turns, vocabulary): (v, w, c), bigram counts of the training text by task, of the contexts of a turn."""
    texts = docs.filter("trust = 1").select("text")

    def of(turn: int, turns: int, vocabulary: int | None) -> DataFrame:
        def sums(held):
            v, w = (np.concatenate(x) for x in zip(*held))
            _, first, c = np.unique(gram(v, w), return_index=True, return_counts=True)
            for at in range(0, len(c), 100_000):
                some = first[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(w[some]), pa.array(c[at : at + 100_000])], names=["v", "w", "c"])

        def run(batches):
            held, n = [], 0
            for part in _parts(batches):
                v, w, _ = bigrams(Words(part.column("text"), lower=True), vocabulary)
                mine = v % turns == turn
                held.append((v[mine], w[mine]))
                n += int(mine.sum())
                if n > COUNTED:
                    yield from sums(held)
                    held, n = [], 0
            if n:
                yield from sums(held)

        return texts.mapInArrow(run, "v long, w long, c long")

    return of


def blocks(docs: DataFrame, shards: int, turn: int = 0, turns: int = 1, vocabulary: int | None = None) -> DataFrame:
    """Blocks of documents (doc_id, text, lang, mark, trust), for scoring, with the tokens of a turn's shards."""

    def row(**cells):
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([cells.get(n)], _BLOCK_TYPES[n]) for n in names], names=names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for part in _parts(batches):
            words = Words(part.column("text"), lower=True)
            sizes = np.diff(words.bounds)
            v, w, last = bigrams(words, vocabulary)
            shard = w % shards
            mine = np.flatnonzero(shard % turns == turn)
            owner = np.repeat(np.arange(len(sizes)), sizes)[mine] | np.where(last[mine], _LAST, 0)
            shard, g, w = shard[mine], gram(v[mine], w[mine]), w[mine]
            yield row(block=number, shard=HEAD, n_words=sizes.tolist(),
                      **{c: part.column(c).to_pylist() for c in ("doc_id", "mark", "lang", "trust")})
            order = np.lexsort((g, w, shard))
            shard, g, w, owner = shard[order], g[order], w[order], owner[order]
            cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
            for at, end in zip(cuts, cuts[1:]):
                yield row(block=number, shard=int(shard[at]), codes=pack_codes(w[at:end], g[at:end], owner[at:end]))
            number += 1

    return docs.select("text", "doc_id", "lang", "mark", "trust").mapInArrow(run, BLOCKS)


def discounts(n: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from n1..n4; within (0, count)."""
    n1, n2, n3, n4 = (max(x, 1e-9) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)])


class Model:
    """The numbers that every task needs: discounts and the mass of the lower order."""

    def __init__(self, counts: DataFrame, vocabulary: int | None = None):
        of_counts = dict(counts.filter("c <= 4").groupBy("c").count().collect())
        self.d = discounts([of_counts.get(i, 0) for i in (1, 2, 3, 4)])
        ends = counts.groupBy("w").agg(F.count(F.lit(1)).alias("n")).groupBy(F.least("n", F.lit(5)).alias("n")).agg(
            F.count(F.lit(1)).alias("words"), F.sum("n").alias("pairs")).collect()
        of_ends = {r["n"]: r["words"] for r in ends}
        self.pairs = sum(r["pairs"] for r in ends)
        self.e = discounts([of_ends.get(i, 0) for i in (1, 2, 3, 4)])
        taken = sum(self.e[min(n, 3) - 1] * words for n, words in of_ends.items())
        # all words that are known and one that is not
        size = sum(of_ends.values()) + 1 if vocabulary is None else vocabulary
        self.unknown = taken / self.pairs / size if self.pairs else 1 / size
        self.begin = 0.0  # log rest of the context that begins a document

    def lower(self, n: np.ndarray) -> np.ndarray:
        """Probability of words by the number of their contexts."""
        return np.where(n > 0, n - self.e[np.clip(n, 1, 3) - 1], 0) / max(self.pairs, 1) + self.unknown

    def discounted(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, c - self.d[np.clip(c, 1, 3) - 1], 0)


def contexts_of(counts: DataFrame, model: Model) -> DataFrame:
    """(v, s, rest): the discounts taken from a context, and their share of its tokens."""
    n = [F.sum(F.when(test, 1).otherwise(0)) for test in (F.col("c") == 1, F.col("c") == 2, F.col("c") >= 3)]
    s = sum(x * float(d) for x, d in zip(n, model.d))
    return counts.groupBy("v").agg(s.alias("s"), (s / F.sum("c")).alias("rest"))


SHARES = BLOCKS.replace("shard int, codes", "share")


def shares(rows: DataFrame, known: DataFrame, model: Model, slices: DataFrame) -> DataFrame:
    """Each shard's part of the log-likelihood of the documents of a block; heads pass.

    ``known`` (shard, w, v, c, s, rest) holds bigrams by last word, and contexts as words with their rest. ``slices`` (heavy, slices)
    says over how many groups a shard's blocks are dealt.
    """
    dealt = F.coalesce("slices", F.lit(1))
    left = rows.join(F.broadcast(slices), F.col("shard") == F.col("heavy"), "left").withColumn(
        "slice", F.pmod(F.xxhash64("block"), dealt).cast("int")).drop("heavy", "slices")
    right = known.join(F.broadcast(slices), F.col("shard") == F.col("heavy"), "left").select(
        *known.columns, F.explode(F.sequence(F.lit(0), dealt - 1)).alias("slice"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        w, rest, c = (right.column(x).to_numpy() for x in ("w", "rest", "c"))
        pair = ~np.isnan(c)
        words, at = np.unique(w, return_inverse=True)
        lower = np.log(p_lower := model.lower(np.bincount(at[pair], minlength=len(words))))
        log_rest = np.zeros(len(words))
        log_rest[at[~pair]] = np.log(rest[~pair])
        g = gram(right.column("v").to_numpy()[pair].astype(np.int64), w[pair])
        # what a seen bigram has beyond the lower order
        more = np.log(model.discounted(c[pair].astype(np.int64)) / right.column("s").to_numpy()[pair] + p_lower[at[pair]]) - lower[at[pair]]
        order = np.argsort(g)
        g, more = g[order], more[order]
        unknown = np.log(model.unknown)
        out = []
        for data in left.column("codes"):
            if not data.is_valid:
                out.append(None)
                continue
            word, gram_, doc = unpack_codes(data.as_py())
            value = np.full(len(word), unknown)
            if len(words):
                i = np.minimum(np.searchsorted(words, word), len(words) - 1)
                found = words[i] == word
                value = np.where(found, lower[i], unknown) + np.where(found & (doc < _LAST), log_rest[i], 0)
            if len(g):
                i = np.minimum(np.searchsorted(g, gram_), len(g) - 1)
                value += np.where(g[i] == gram_, more[i], 0)
            docs, i = np.unique(doc & (_LAST - 1), return_inverse=True)
            out.append(docs.astype("<u2").tobytes() + np.bincount(i, value).astype("<f8").tobytes())
        return pa.table({"block": left.column("block"), "share": pa.array(out, pa.binary()), **{c: left.column(c) for c in _DOC}})

    return left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(score, SHARES)


def added(parts: DataFrame) -> DataFrame:
    """(doc_id, mark, lang, n_words, trust, total) of every document row."""
    types = [_BLOCK_TYPES[c].value_type for c in _DOC]

    def add(part: pa.Table) -> pa.Table:
        shares_ = part.column("share").to_pylist()
        head = shares_.index(None)
        total = np.zeros(len(part.column("mark")[head].values))
        for share in shares_:
            if share is not None:
                n = len(share) // 10
                total[np.frombuffer(share, "<u2", n)] += np.frombuffer(share[2 * n :], "<f8")
        return pa.table([*[pa.array(part.column(c)[head].values, t) for c, t in zip(_DOC, types)], pa.array(total)], names=[*_DOC, "total"])

    return parts.groupBy("block").applyInArrow(
        add, "doc_id long, mark long, lang string, n_words int, trust int, total double")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def perplexities(wide: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """(doc_id, mark, lang, n_words, trust, perplexity) of every row (doc_id, text, lang, mark, trust)."""
    n_bytes = wide.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = PASSES * max(4, math.ceil(n_bytes / BYTES_A_TOKEN / PASSES / TOKENS_A_GROUP))
    counted = training_counts(wide)
    counts = [
        staged(counted(turn, COUNT_PASSES, vocabulary).groupBy("v", "w").agg(F.sum("c").alias("c")), "bigrams")
        for turn in range(COUNT_PASSES)]
    model = Model(union(counts), vocabulary)
    shard = F.pmod("w", F.lit(shards)).cast("int").alias("shard")
    # shards of very frequent words, by the training text
    loads = {r[0]: r[1] for r in union(counts).groupBy(shard).agg(F.sum("c")).collect()}
    usual = sum(loads.values()) / shards
    heavy = [(int(k), math.ceil(load / usual / 2)) for k, load in loads.items() if load > 2 * usual]
    slices = wide.sparkSession.createDataFrame(heavy, "heavy int, slices int")
    contexts, known = [], []
    for some in counts:
        contexts.append(staged(contexts_of(some, model), "contexts"))
        known.append(staged(some.join(contexts[-1].drop("rest"), "v"), "known_bigrams"))
        release(some)
    begin = union(contexts).filter(F.col("v") == BEGIN).first()
    model.begin = math.log(begin["rest"]) if begin else 0.0
    bigram_rows = union(known).select(shard, "w", "v", F.col("c").cast("double").alias("c"), "s", F.lit(None).cast("double").alias("rest"))
    none = F.lit(None).cast("double")
    word_rows = union(contexts).withColumnRenamed("v", "w").select(shard, "w", F.lit(BEGIN).cast("long").alias("v"), none.alias("c"), none.alias("s"), "rest")
    totals = []
    for turn in range(PASSES):
        mine = bigram_rows.union(word_rows).filter(F.col("shard") % PASSES == turn)
        totals.append(staged(added(shares(blocks(wide, shards, turn, PASSES, vocabulary), mine, model, slices)), "shares"))
    release(*known, *contexts)
    # Turns may read rows in another order, so their parts meet by mark; rows of one mark have equal parts.
    by_mark = union([t.groupBy("mark").agg(F.max("total").alias("total")) for t in totals]).groupBy("mark").agg(F.sum("total").alias("total"))
    value = F.exp(F.least(-(F.col("total") + F.lit(model.begin)) / F.col("n_words"), F.lit(700.0)))
    return totals[0].drop("total").join(by_mark, totals[0]["mark"].eqNullSafe(by_mark["mark"])).drop(by_mark["mark"]).select(
        *_DOC, F.when(F.col("n_words") > 0, value).alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents that every label calls good and none calls toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter(
        "doc_id is not null and q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").cast("long").alias("trusted"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, vocabulary: int | None = VOCABULARY) -> DataFrame:
    """One row per document row: doc_id, mark, lang, n_words, perplexity, threshold, keep.

    Words are folded into ``vocabulary`` ids; with None they are told whole, as ``judge`` does.
    Documents without words have no perplexity and are rejected. A null language is one of its
    own. Without any trusted text nothing is rejected but documents without words. Rows are told by
    ``mark``, a hash of doc_id and text, so repeated rows get equal results. An empty table gives
    no rows. Columns other than doc_id, text and lang are not read.
    """
    spark = prepared(docs.sparkSession)
    fold = F.pmod(F.xxhash64("trusted", F.lit("fold")), F.lit(FOLDS))
    trust = F.when(F.col("trusted").isNull(), 0).when(fold == 0, 2).otherwise(1).cast("int")
    trusted = staged(trusted_ids(labels), "trusted")
    if trusted.count() <= MAX_BROADCAST:
        trusted = F.broadcast(trusted)
    wide = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("mark"),
    ).join(trusted, F.col("doc_id") == F.col("trusted"), "left").withColumn("trust", trust)
    scored = staged(perplexities(wide, vocabulary), "perplexities")
    held = scored.filter("trust = 2 and perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, 100_000).alias("threshold")
    overall = held.agg(limit).first()["threshold"]
    overall = math.inf if overall is None else overall
    own = held.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n"), limit)
    mixed = F.exp((F.col("n") * F.log("threshold") + POOLED * math.log(overall)) / (F.col("n") + POOLED))
    limits = F.broadcast(staged(own.select("l", mixed.alias("threshold")), "limits"))  # one row per language
    threshold = F.coalesce("threshold", F.lit(overall))
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "doc_id", "mark", "lang", F.col("n_words").cast("long").alias("n_words"), "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"),
    )


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """As ``classify``, with a document's contrasts to toxic and low-quality text; ``keep`` asks for all three.

    ``toxic_contrast`` and ``low_contrast`` are null for documents without telling words (see ``contrast``).
    """
    judged = classify(docs, labels, quantile, vocabulary=None)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.xxhash64("doc_id", "text").alias("mark"))
    most, limits = contrasts(plain, labels)
    most = most.select("m", *[F.col(k).alias(k + "_contrast") for k in KINDS])
    bad = [F.coalesce(F.col(k + "_contrast") > F.lit(limits[k]), F.lit(False)) for k in KINDS]
    return judged.join(most, F.col("mark") == F.col("m"), "left").drop("m").withColumn("keep", F.col("keep") & ~bad[0] & ~bad[1])


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bad = staged(judge(docs, labels, quantile).filter("not keep").select("mark").distinct(), "rejected")
    return without(docs, "xxhash64(row.doc_id, row.text)", bad)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, trained on the labelled ones."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mark")
