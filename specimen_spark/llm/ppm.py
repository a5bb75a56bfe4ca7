"""Language-model scores by prediction by partial matching.

A byte-context trie holds, for each context of up to ORDER bytes, how often each byte (or the end of the text)
followed it in the training documents. A byte's probability is read at the longest context that was seen: its
count less DISCOUNT over the context's total. What the discounts leave, DISCOUNT for each different follower, is the
estimated probability of escaping to the context that is a byte shorter, where bytes that followed the
longer one are excluded. Below the empty context all bytes that are left are alike. A document's score is the sum of
log10 probabilities of its bytes, with A-Z lowered, and its end.

A trie node and its byte are one number: nine bits a symbol, the nearest lowest, so a shorter context is
the same number with high bits off, and no two contexts share one. A byte's probability depends only on this number.
Each block of documents sends its different numbers, dealt by context over shards whose count grows with the
input; a shard adds them up and knows all followers of its contexts. Numbers of training documents are
found at full length. Others escape: level by level they are joined with counts of shorter contexts, which are
sums over the level above. Probabilities go back to the blocks, which read their texts again.
Words are counted by the same shards under 64-bit hashes: among 10^8 different words the odds that any two share
one are 3 in 10^4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import batches_of, prepared, staged, table
from specimen_spark.llm.words import Words, mix

#: Bytes before a byte that its probability may depend on; at most 6, so that a number has 63 bits.
ORDER = 5
#: Taken from each follower's count for escapes.
DISCOUNT = 0.5
BITS = 9
END, ALPHABET = 257, 257  # symbols: 0 before the text, 1 + byte, END
#: Bytes of text that a task works on at once; a longer text goes in parts, cut behind white space.
BLOCK = 4 << 20
#: Numbers made at once, so that intermediate arrays stay small.
SLICE = 1 << 19
#: Bytes of text whose numbers a shard gets.
SHARD_BYTES = 32 << 20
GRAM, WORD = 0, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def codes(data: np.ndarray, offsets: np.ndarray, context: int, ends: bool, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each byte and end, text by text, and where each text's numbers begin.

    ``context`` bytes of each text are only read as what comes before; ``ends`` tells whether texts end.
    """
    lengths = np.diff(offsets)
    room = lengths + order + ends
    begins = np.cumsum(room) - room
    own = np.ones(room.sum(), bool)  # bytes of texts, not what stands before them or their ends
    for i in range(order):
        own[begins + i] = False
    if ends:
        own[begins + room - 1] = False
    symbols = np.zeros(len(own), np.int16)
    symbols[own] = _LOWER[data].astype(np.int16) + 1
    if ends:
        symbols[begins + room - 1] = END
        own[begins + room - 1] = True
    for i in range(context):
        own[begins + order + i] = False
    out = np.empty(int((room - order - context).sum()), np.int64)
    done = 0
    for at in range(0, len(symbols), SLICE):
        near = symbols[max(0, at - order) : at + SLICE].astype(np.int64)
        skip = min(at, order)
        total = near[skip:].copy()
        for back in range(1, order + 1):
            first = max(0, back - skip)
            total[first:] += near[skip - back + first : len(near) - back] << (BITS * back)
        kept = total[own[at : at + SLICE]]
        out[done : done + len(kept)] = kept
        done += len(kept)
    return out, np.concatenate([[0], np.cumsum(room - order - context)])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class _Part:
    """Numbers and word hashes of the texts of a block."""

    def __init__(self, data: bytes, lengths: list[int], context: int, ends: bool, order: int):
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.grams, self.at = codes(np.frombuffer(data, np.uint8), offsets, context, ends, order)
        offsets[0] = context  # only a text alone in its unit has context
        joined = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data)])
        words = Words(joined, lower=True)
        n = np.diff(words.bounds) + ends
        self.word_at = np.concatenate([[0], np.cumsum(n)])
        self.words = np.full(self.word_at[-1], _END_WORD, np.uint64)
        own = np.ones(len(self.words), bool)
        if ends:
            own[self.word_at[1:] - 1] = False
        self.words[own] = words.hash
        self.words >>= np.uint64(1)  # as signed numbers


_END_WORD = np.uint64(0x5851F42D4C957F2D)


def distinct(keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each stands in what is not held out."""
    both = keys.astype(np.uint64)
    both <<= np.uint64(1)
    np.bitwise_or(both, held, out=both)
    both.sort()
    out = (both & np.uint64(1)).astype(np.uint8)
    both >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(both)))
    if len(first):
        counts -= np.add.reduceat(out, first, dtype=np.int64)
    return both[first].astype(np.int64), counts


def by_shard(keys: np.ndarray, kind: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted keys into shards, and each shard's begin; contexts stay together."""
    shard = shard_of(keys >> BITS if kind == GRAM else keys, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def parts_of(text: bytes, order: int):
    """(bytes, context length, whether it ends) of a text's parts; each holds the bytes before it as context."""
    at = 0
    while len(text) - at > BLOCK:
        cut, look = None, at + BLOCK
        while cut is None and look < len(text):
            near = np.frombuffer(text[look : look + (1 << 16)], np.uint8)
            found = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            cut = look + int(found[0]) + 1 if len(found) else None
            look += 1 << 16
        if cut is None or cut >= len(text):
            break
        context = min(order, at)
        yield text[at - context : cut], context, False
        at = cut
    context = min(order, at)
    yield text[at - context :], context, True


_FIELDS = pa.schema([
    ("block", pa.int64()), ("row", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("text", pa.binary()), ("context", pa.int32()), ("ends", pa.bool_()), ("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_STAGED = ("block long, row long, doc_ids array<long>, held array<boolean>, lengths array<long>, text binary, context int, ends boolean, "
           "kind int, shard int, keys binary, counts binary")


def _zipped(data: np.ndarray | bytes) -> bytes:
    data = data if isinstance(data, bytes) else data.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _zipped_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers as their differences, all first bytes first, then all second ones and so on."""
    return _zipped(np.ascontiguousarray(np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T))


def _unzipped_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzipped(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _unzipped(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _batch(fields: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)


def _units(batches, order: int):
    """(first row's number, ids, held, texts, context, ends): what a task works on at once."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, held, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for lo, hi in batches_of(batch, batch.schema.names[2], BLOCK):
            found = [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
            for part, context, ends in parts_of(found[0], order) if len(found) == 1 else [(None, 0, True)]:
                yield number, ids[lo:hi], held[lo:hi], found if part is None else [part], context, ends
            number += hi - lo


def merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of a shard in order and their counts over all blocks."""
    keys = np.concatenate([_unzipped_keys(k) for k in rows.column("keys").to_pylist()])
    counts = np.frombuffer(b"".join(map(_unzipped, rows.column("counts").to_pylist())), "<u4")
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def contexts(keys: np.ndarray, counts: np.ndarray):
    """Per key: its context's place; per context: total and different followers."""
    context = keys >> BITS
    fresh = np.concatenate([[True], context[1:] != context[:-1]])
    first = np.flatnonzero(fresh)
    return np.cumsum(fresh) - 1, np.add.reduceat(counts, first), np.add.reduceat((counts > 0).astype(np.int64), first)


def _spread(keys: np.ndarray, values: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """The value of each key, from those of the different keys, which are in order of shard and key."""
    keys = keys.astype(np.int64, copy=False)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    dealt, _ = by_shard(ordered[first], kind, shards)
    value = np.empty(len(first), values.dtype)
    value[dealt] = values
    out = np.empty(len(keys), values.dtype)
    out[order] = np.repeat(value, np.diff(np.append(first, len(keys))))
    return out


LEVEL, NOVEL, SEEN, TOTALS = range(4)
_MODEL = pa.schema([("what", pa.int32()), ("shard", pa.int32()), ("key", pa.int64()), ("context", pa.int64()), ("count", pa.int64()), ("total", pa.int64()), ("kinds", pa.int64())])


def _summed(rows: pa.Table, order: int) -> pa.Table:
    """What a shard tells: of words their totals; of numbers the level below, and those that no training document holds."""
    kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
    keys, counts = merged(rows)
    if kind == WORD:
        return pa.Table.from_batches([_batch(_MODEL, what=[TOTALS], count=[int(counts.sum())], kinds=[int((counts > 0).sum())])])
    place, total, kinds = contexts(keys, counts)
    below = keys & ((1 << (BITS * order)) - 1)
    known, novel = counts > 0, counts == 0
    level, at = np.unique(below[known], return_inverse=True)
    sums = np.bincount(at, weights=counts[known], minlength=len(level)).astype(np.int64)
    escaping = np.zeros(len(total), bool)
    escaping[place[novel]] = True
    seen = known & escaping[place]
    return pa.Table.from_batches([
        _batch(_MODEL, what=[LEVEL] * len(level), key=level, count=sums),
        _batch(_MODEL, what=[NOVEL] * int(novel.sum()), shard=[shard] * int(novel.sum()), key=keys[novel], total=total[place[novel]], kinds=kinds[place[novel]]),
        _batch(_MODEL, what=[SEEN] * int(seen.sum()), key=below[seen], context=keys[seen] >> BITS)])


def _escaped(model: DataFrame, order: int) -> DataFrame:
    """(shard, key, score) of numbers that no training document holds."""
    def low(column, symbols):
        return column.bitwiseAND(F.lit((1 << (BITS * symbols)) - 1))

    def joined(left, right, on, symbols):
        # Numbers of at most two symbols are fewer than 258 * 258, so their tables are small at any size.
        return left.join(F.broadcast(right) if symbols <= 2 else right, on, "left")

    levels = [staged(model.filter(F.col("what") == LEVEL).groupBy("key").agg(F.sum("count").alias("n")), "ppm-level")]
    for k in range(order - 1, 0, -1):  # a level's numbers have one symbol less than those of the one above
        levels.append(staged(levels[-1].groupBy(low(F.col("key"), k).alias("key")).agg(F.sum("n").alias("n")), "ppm-level"))
    shifted = F.shiftright("key", BITS)
    start = F.when(F.col("total") > 0, F.log10(F.col("kinds") * DISCOUNT / F.col("total"))).otherwise(0.0)
    rows = model.filter(F.col("what") == NOVEL).select("shard", "key", start.alias("score"), F.col("kinds").alias("out_kinds"))
    excluded = model.filter(F.col("what") == SEEN).join(levels[0], "key").groupBy(F.col("context").alias("out_of")).agg(F.sum("n").alias("out_n"))
    done = None
    for k in range(order - 1, -1, -1):  # contexts of k bytes
        level = levels[order - 1 - k]
        rows = joined(rows.withColumn("out_of", low(F.shiftright("key", BITS), k + 1)), excluded, "out_of", k + 1).drop("out_of")
        rows = rows.withColumn("at", low(F.col("key"), k + 1))
        rows = joined(rows, level.withColumnRenamed("key", "at"), "at", k + 1).drop("at")
        of = level.groupBy(shifted.alias("c")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = joined(rows.withColumn("c", low(F.shiftright("key", BITS), k)), of, "c", k).drop("c")
        total = F.coalesce("total", F.lit(0)) - F.coalesce("out_n", F.lit(0))
        kinds = F.coalesce("kinds", F.lit(0)) - F.col("out_kinds")
        step = F.when(F.col("n").isNotNull(), F.log10((F.col("n") - DISCOUNT) / total)).when(kinds > 0, F.log10(kinds * DISCOUNT / total)).otherwise(0.0)
        if k == 0:
            step = F.when(F.col("n").isNotNull(), step).otherwise(step - F.log10(ALPHABET - F.coalesce("kinds", F.lit(0))))
        rows = staged(rows.select("shard", "key", (F.col("score") + step).alias("score"), F.coalesce("kinds", F.lit(0)).alias("out_kinds"), "n"), "ppm-escaped")
        ended = rows.filter(F.col("n").isNotNull()) if k else rows
        done = ended.select("shard", "key", "score") if done is None else done.union(ended.select("shard", "key", "score"))
        rows = rows.filter(F.col("n").isNull()).drop("n")
        if k:
            shorter = levels[order - k].select(F.col("key").alias("short"), F.col("n").alias("short_n"))
            pairs = joined(level.select(shifted.alias("out_of"), low(F.col("key"), k).alias("short")), shorter, "short", k)
            excluded = pairs.groupBy("out_of").agg(F.sum("short_n").alias("out_n"))
    return done


def score(docs: DataFrame, held, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` is a column expression of ``docs``: rows where it is not true train the model. ``score`` is the log10
    probability of the lowered text and its end. Tokens are words and an end; ``n_known`` counts those of
    training documents, ``base_score`` is their log10 probability by counts with one added. Null and
    empty texts are an end. Null ids and repeated rows are rows like others, and train. Without
    training documents every symbol has the same probability. An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= order <= 6:
        raise ValueError("the order must be between 1 and 6")
    spark = prepared(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").cast("binary").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(2, int(size // SHARD_BYTES).bit_length())

    def counted(batches):
        block = TaskContext.get().partitionId() << 40
        for row, ids, held_, texts, context, ends in _units(batches, order):
            part = _Part(b"".join(texts), [len(t) for t in texts], context, ends, order)
            yield _batch(_FIELDS, block=[block], row=[row], doc_ids=[ids], held=[held_], lengths=[[len(t) for t in texts]],
                         text=[_zipped(b"".join(texts))], context=[context], ends=[ends])
            out = np.array(held_, np.uint8)
            for kind, keys, at in ((GRAM, part.grams, part.at), (WORD, part.words, part.word_at)):
                keys, counts = distinct(keys, np.repeat(out, np.diff(at)))
                dealt, begins = by_shard(keys, kind, shards)
                keys, counts = keys[dealt], counts[dealt].astype("<u4")
                some = np.flatnonzero(np.diff(begins))
                if len(some):
                    yield _batch(_FIELDS, block=[block] * len(some), kind=[kind] * len(some), shard=some,
                                 keys=[_zipped_keys(keys[begins[s] : begins[s + 1]]) for s in some],
                                 counts=[_zipped(counts[begins[s] : begins[s + 1]]) for s in some])
            block += 1

    rows = staged(plain.mapInArrow(counted, _STAGED), "ppm-blocks")
    keys = rows.filter(F.col("kind").isNotNull()).select("block", "kind", "shard", "keys", "counts")
    texts = rows.filter(F.col("kind").isNull()).drop("kind", "shard", "keys", "counts")
    model = staged(
        keys.groupBy("kind", "shard").applyInArrow(lambda t: _summed(t, order), "what int, shard int, key long, context long, count long, total long, kinds long"),
        "ppm-model")
    tokens, vocabulary = model.filter(F.col("what") == TOTALS).agg(F.sum("count"), F.sum("kinds")).first()
    tokens, vocabulary = tokens or 0, vocabulary or 0
    escaped = _escaped(model, order).withColumn("kind", F.lit(GRAM))

    def looked_up(mine, theirs):
        """Of each block's keys: the count, of numbers also the context's total, and the score where the count is 0."""
        out = {"counts": [], "totals": [], "scores": []}
        if mine.num_rows:
            kind = mine.column("kind")[0].as_py()
            keys, counts = merged(mine)
            if kind == GRAM:
                place, total, _ = contexts(keys, counts)
                score_of = np.zeros(len(keys))
                score_of[np.searchsorted(keys, theirs.column("key").to_numpy())] = theirs.column("score").to_numpy()
            for found in mine.column("keys").to_pylist():
                at = np.searchsorted(keys, _unzipped_keys(found))
                out["counts"].append(_zipped(counts[at]))
                out["totals"].append(_zipped(total[place[at]]) if kind == GRAM else b"")
                out["scores"].append(_zipped(score_of[at[counts[at] == 0]]) if kind == GRAM else b"")
        return pa.table({**{c: mine.column(c) for c in ("block", "kind", "shard")}, **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    values = keys.groupBy("kind", "shard").cogroup(escaped.groupBy("kind", "shard")).applyInArrow(
        looked_up, "block long, kind int, shard int, counts binary, totals binary, scores binary")

    def added(mine, theirs):
        (unit,) = mine.to_pylist()
        part = _Part(_unzipped(unit["text"]), unit["lengths"], unit["context"], unit["ends"], order)
        out = {"row": pa.array(np.arange(len(unit["lengths"])) + unit["row"]), "doc_id": pa.array(unit["doc_ids"], pa.int64()), "held_out": pa.array(unit["held"], pa.bool_())}
        theirs = theirs.sort_by([("kind", "ascending"), ("shard", "ascending")])
        kinds = theirs.column("kind").to_numpy()

        def joined(column, kind, dtype):
            return np.frombuffer(b"".join(_unzipped(d) for d, k in zip(theirs.column(column).to_pylist(), kinds) if k == kind), dtype)

        counts = joined("counts", GRAM, "<i8")
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.log10((counts - DISCOUNT) / joined("totals", GRAM, "<i8"))
        scores[counts == 0] = joined("scores", GRAM, "<f8")
        each = _spread(part.grams, scores, GRAM, shards)
        out["score"] = [float(each[i:j].sum()) for i, j in zip(part.at[:-1], part.at[1:])]
        each, at = _spread(part.words, joined("counts", WORD, "<i8"), WORD, shards), part.word_at
        known = np.concatenate([[0], np.cumsum(each > 0)])
        logs = np.log10((each + 1) / (tokens + vocabulary + 1))
        out |= {"n_tokens": np.diff(at), "n_known": known[at[1:]] - known[at[:-1]],
                "base_score": [float(logs[i:j].sum()) for i, j in zip(at[:-1], at[1:])]}
        return pa.table(out)

    parts = texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        added, "row long, doc_id long, held_out boolean, score double, n_tokens long, n_known long, base_score double")
    return parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")).drop("row")


def held_out(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 7 is 2; a null id counts as the empty text, which trains."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return score(table(spark, sf_dir, "documents"), held_out())
