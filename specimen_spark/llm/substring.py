"""Substring deduplication with difference-cover anchors.

Every run of ``length`` words that also starts earlier (smaller doc_id, or the same document further
on top) loses its words. Hashing every run of every document would multiply the corpus. Instead
shorter anchor runs are hashed at places that lie in a difference cover modulo a period: for any two
places i and j some shift below the period moves both into the cover, so two equal long runs share
an anchor at the same distance from their starts, wherever they stand.

1. One scan finds anchors; a task keeps the first of each and knows its own repeats, so a passage in
   most documents sends one row per task. Anchors of two tasks, and repeats, go back to their documents.
2. Documents that have repeated anchors are read again; only runs around such anchors are hashed in
   full (96 bits) and compared: the earliest of each stays.
3. Documents that lose words are read a last time and written without them.

A run is judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import batches_of, prepared, staged, table
from specimen_spark.llm.words import CHUNK, Words

LENGTH = 20
#: Anchors or runs a task holds before it sends them.
HELD = 1_500_000
_LAST = (1 << 63) - 1

# Perfect difference covers, period -> cover.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

#: Rows to be dealt by key: an anchor (pos >= 0), or what passes: a task's repeats of a document
#: (x: places) or a document row itself (x: HEAD).
ANCHORS = "h long, doc long, pos int, x binary"
RUNS = "h long, g int, d long, t long, pos int, x binary"
_TYPES = {"h": pa.int64(), "g": pa.int32(), "d": pa.int64(), "t": pa.int64(), "doc": pa.int64(), "pos": pa.int32(), "x": pa.binary()}
SENT, PLACES, HEAD = -1, -2, -3  # SENT: an anchor whose documents know that it is repeated
_HEAD = "<qqq32s"  # d, t, words, SHA-256 of the words


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least 8 words, or else the shortest."""
    fit = [p for p in COVERS if length - p + 1 >= 8]
    period = max(fit) if fit else min(COVERS)
    if length < period:
        raise ValueError(f"runs must have at least {period} words")
    return period, COVERS[period]


def _rows(schema: str, n: int, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], _TYPES[k]) if k in columns else pa.nulls(n, _TYPES[k]) for k in names], names=names)


class Held:
    """Keys of a task's segment with their places, and the documents they lie in.

    ``docs`` columns tell a document: (doc,) for anchors, (d, t) for runs.
    """

    def __init__(self, names: tuple):
        self.names, self.keys, self.docs, self.size, self.n = names, [], [], 0, 0

    def add(self, h, g, owner, pos, *docs):
        self.keys.append((h, g, owner + self.n, pos))
        self.docs.append(docs)
        self.n += len(docs[0])
        self.size += len(h)

    def flush(self):
        """Batches: each key once, and for each document the places known to repeat.

        A run's earliest place is sent and all other places are repeats. An anchor met once is sent;
        of one met more often all places are repeats.
        """
        if not self.size:
            return
        h, g, doc, pos = (np.concatenate(c) for c in zip(*self.keys))
        ids = [np.concatenate(c) for c in zip(*self.docs)]
        runs = len(ids) == 2
        order = np.lexsort((pos, ids[1][doc], ids[0][doc], g, h)) if runs else np.argsort(h, kind="stable")
        h, g, doc, pos = h[order], g[order], doc[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        if runs:
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            repeat = (ids[0][doc] != ids[0][doc[first]]) | (ids[1][doc] != ids[1][doc[first]]) | (pos != pos[first])
        else:
            repeat = np.zeros(len(h), bool)
            repeat[1:] = ~new[1:]
            repeat[:-1] |= ~new[1:]
        at = np.flatnonzero(new)
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            place = pos[k] if runs else np.where(repeat[k], SENT, pos[k])
            cells = {n: c[doc[k]] for n, c in zip(self.names, ids)}
            yield _rows(RUNS if runs else ANCHORS, len(k), h=h[k].view(np.int64), pos=place.astype(np.int32), **cells,
                        **({"g": g[k]} if runs else {}))
        k = np.flatnonzero(repeat)
        k = k[np.lexsort((pos[k], doc[k]))]
        cuts = np.flatnonzero(np.diff(doc[k], prepend=-1))
        for i in range(0, len(cuts), 10_000):
            some = cuts[i : i + 10_000]
            ends = [*cuts[i + 1 : i + 1 + len(some)], len(k)][: len(some)]
            own = doc[k[some]]
            yield _rows(
                RUNS if runs else ANCHORS, len(some), h=h[k[some]].view(np.int64), pos=np.full(len(some), PLACES, np.int32),
                x=[pos[k[a:b]].astype("<i4").tobytes() for a, b in zip(some, ends)],
                **{n: c[own] for n, c in zip(self.names, ids)})
        self.__init__(self.names)


def _texts(batches):
    for batch in batches:
        for at, end in batches_of(batch, "text", CHUNK):
            yield batch.slice(at, end - at)


def _ids(part: pa.RecordBatch):
    return part.column("d").to_numpy(), part.column("t").to_numpy()


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Anchors, known repeats and heads of all documents; ``doc`` numbers the rows of this scan."""
    period, cover = cover_for(length)
    size = length - period + 1
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True

    def run(batches):
        held, number = Held(("doc",)), TaskContext.get().partitionId() << 33
        for part in _texts(batches):
            words = Words(part.column("text"))
            counts = np.diff(words.bounds)
            ids = number + np.arange(len(counts))
            number += len(counts)
            heads = [
                struct.pack(_HEAD, d, t, n, hashlib.sha256(b" ".join((x or "").encode().split())).digest())
                for d, t, n, x in zip(*(part.column(c).to_pylist() for c in ("d", "t")), counts.tolist(), part.column("text").to_pylist())
            ]
            yield _rows(ANCHORS, len(ids), h=ids * 0x5851F42D4C957F2D, doc=ids, pos=np.full(len(ids), HEAD, np.int32), x=heads)
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(owner)) - words.bounds[:-1][owner]
            # an anchor matters only inside a run of the full length
            long = (counts >= length)[owner]
            h, whole = words.grams(size)
            at = np.flatnonzero(whole & long[: len(h)] & in_cover[place[: len(h)] % period])
            held.add(h[at], np.zeros(len(at), np.int32), owner[at], place[at], ids)
            if held.size > HELD:
                yield from held.flush()
        yield from held.flush()

    return docs.mapInArrow(run, ANCHORS)


FOUND = "doc long, pos int, known binary, d long, t long, n_words long, sha string"


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(doc, pos) of anchors that two tasks have, (doc, known) repeats, and heads, spelled out."""

    def passed(batch):
        doc, pos, x = batch.column("doc"), batch.column("pos").to_numpy(), batch.column("x")
        n, places, head = len(pos), pos == PLACES, pos == HEAD
        heads = [struct.unpack(_HEAD, v) for v in x.filter(pa.array(head)).to_pylist()]
        empty = pa.nulls
        yield pa.RecordBatch.from_arrays(
            [doc.filter(pa.array(places)), empty(int(places.sum()), pa.int32()), x.filter(pa.array(places)),
             *(empty(int(places.sum()), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=_FOUND)
        k = len(heads)
        d, t, words, sha = zip(*heads) if heads else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [doc.filter(pa.array(head)), empty(k, pa.int32()), empty(k, pa.binary()), pa.array(d, pa.int64()), pa.array(t, pa.int64()),
             pa.array(words, pa.int64()), pa.array([v.hex() for v in sha], pa.string())], names=_FOUND)

    def repeats(doc, pos, keep):
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[keep]), pa.array(pos[keep]), pa.nulls(k, pa.binary()),
             *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=_FOUND)

    def run(batches):
        held, met = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], False
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            anchor = pos >= SENT
            if not anchor.all():
                yield from passed(batch.filter(pa.array(~anchor)))
            h, doc, pos = (np.concatenate([was, c[anchor]]) for was, c in zip(
                held, (batch.column("h").to_numpy(), batch.column("doc").to_numpy(), pos)))
            if not len(h):
                continue
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            same[0] = met
            keep = (same[:-1] | same[1:]) & (pos >= 0)
            keep[-1] = False
            yield repeats(doc, pos, keep)
            held, met = [h[-1:], doc[-1:], pos[-1:]], bool(same[-2])
        if met:
            yield repeats(held[1], held[2], held[2] >= 0)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, FOUND)


_FOUND = [x.split()[0] for x in FOUND.split(", ")]


def candidate_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs around repeated anchors, ``places`` per document, and known repeats."""
    period, _ = cover_for(length)

    def run(batches):
        held = Held(("d", "t"))
        for part in _texts(batches):
            words = Words(part.column("text"))
            counts = np.diff(words.bounds)
            around = np.zeros(len(words.hash) + 1, np.int32)
            for i, places in enumerate(part.column("places").to_pylist()):
                p = np.frombuffer(b"".join(places), "<i4").astype(np.int64)
                np.add.at(around, words.bounds[i] + np.maximum(p - period + 1, 0), 1)
                np.add.at(around, words.bounds[i] + p + 1, -1)
            h, whole = words.grams(length, 1)
            g, _ = words.grams(length, 2)
            at = np.flatnonzero(whole & (np.cumsum(around)[: len(h)] > 0))
            owner = np.repeat(np.arange(len(counts)), counts)[at]
            held.add(h[at], (g[at] >> np.uint64(33)).astype(np.int32), owner, at - words.bounds[:-1][owner], *_ids(part))
            if held.size > HELD:
                yield from held.flush()
        yield from held.flush()

    return docs.mapInArrow(run, RUNS)


def repeated_runs(rows: DataFrame) -> DataFrame:
    """Places of runs that are not the first of their kind; known repeats pass."""

    def run(batches):
        first = None  # h, g, d, t, pos of the first place of the run that was last
        for batch in batches:
            own = batch.column("pos").to_numpy() >= 0
            yield batch.filter(pa.array(~own))
            batch = batch.filter(pa.array(own))
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("h", "g", "d", "t", "pos")]
            if first is not None:
                cols = [np.concatenate([[f], c]) for f, c in zip(first, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = np.zeros(len(new), bool)
            for c in cols[2:]:
                later |= c != c[lead]
            yield batch.filter(pa.array(later[1:] if first is not None else later))
            first = [c[lead[-1]] for c in cols]

    return rows.repartition("h").sortWithinPartitions("h", "g", "d", "t", "pos").mapInArrow(run, RUNS)


def _per_document(rows: DataFrame, *least: str) -> DataFrame:
    """(kd, kt, places, ...) of rows (d, t, pos, known): packed places, bounded by the document,
    and the least value of other columns."""
    byte = lambda i: F.lpad(F.hex(F.shiftright("pos", 8 * i).bitwiseAND(F.lit(255))), 2, "0")
    packed = F.unhex(F.concat(*[byte(i) for i in range(4)]))  # four bytes, least first
    return rows.select("d", "t", F.coalesce("known", packed).alias("p"), *least).groupBy(
        F.col("d").alias("kd"), F.col("t").alias("kt")).agg(
        F.collect_list("p").alias("places"), *[F.min(c).alias(c) for c in least])


def kept_words(docs: DataFrame, length: int, with_text: bool) -> DataFrame:
    """(d, t, n_words, n_removed, sha[, text]) of documents that lose runs starting at ``places``."""

    def run(batches):
        for part in _texts(batches):
            d, t = _ids(part)
            n_words, removed, digests, texts = [], [], [], []
            for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist()):
                words = (text or "").encode().split()
                p = np.unique(np.frombuffer(b"".join(places), "<i4"))
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + length, -1)
                stay = np.cumsum(edge)[:-1] == 0
                kept = b" ".join([w for w, s in zip(words, stay) if s])
                n_words.append(len(words))
                removed.append(int(len(words) - stay.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d), pa.array(t), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["d", "t", "n_words", "n_removed", "sha", "text"])

    return docs.mapInArrow(run, "d long, t long, n_words long, n_removed long, sha string, text string")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256 [, text].

    ``text``, on request, holds the words that stay, one space between; null where none was removed.
    Null and empty texts have no words. A null doc_id comes after all others. A document is told by its
    id and text: repeated rows do not remove each other's words, and get equal results; of different texts
    under one id, one (by hash) comes first. An empty table gives no rows. Only doc_id and text are
    read.
    """
    prepared(docs.sparkSession)
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"),
        F.col("text").cast("string").alias("text"),
    )
    found = staged(repeated_anchors(anchors(docs, length)), "anchors")
    heads = found.filter("n_words is not null").select("doc", "d", "t", "n_words", "sha")
    places = staged(
        _per_document(found.filter("n_words is null").select("doc", "pos", "known").join(heads.select("doc", "d", "t"), "doc"), "doc"),
        "anchor_places",
    )

    def with_places(rows, t):
        """Documents with places; ``t`` tells documents of one id apart."""
        joined = docs.withColumnRenamed("t", "t_").join(rows, (F.col("d") == F.col("kd")) & (F.col("t_") == F.col("kt")))
        return joined.select("d", F.col(t).alias("t"), "text", "places")

    # From here the number of a document's first row stands for its hash: it is shorter to send.
    runs = staged(repeated_runs(candidate_runs(with_places(places, "doc"), length)), "runs")
    lost = _per_document(runs.select("d", "t", "pos", F.col("x").alias("known"))).select(F.col("kt").alias("doc"), "places")
    gone = staged(lost.join(places.select("doc", "kd", "kt"), "doc"), "run_places")
    changed = kept_words(with_places(gone, "kt"), length, with_text)
    same = heads.join(gone.select("kd", "kt"), (F.col("d") == F.col("kd")) & (F.col("t") == F.col("kt")), "left_anti").select(
        "d", "t", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", F.lit(None).cast("string").alias("text"))
    out = changed.select(same.columns).union(same).select(
        F.when(F.col("d") != _LAST, F.col("d")).alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"), "text")
    return out if with_text else out.drop("text")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
s as (
  select doc_id, i, array_to_string(w[i:i + 19], ' ') run from (select doc_id, w, unnest(range(1, len(w) - 18)) i from w where len(w) >= 20)),
f as (select run, min((doc_id, i)) first from s group by 1 having count(*) > 1),
p as (select distinct doc_id, unnest(range(i, i + 20)) p from s join f using (run) where (doc_id, i) <> first),
r as (select doc_id, count(*) n_removed, list(p) ps from p group by 1)
select w.doc_id, cast(len(w) as bigint) n_words, coalesce(n_removed, 0) n_removed,
  sha256(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' ')) kept_sha256
from w left join r using (doc_id)
"""
