"""N-gram Jaccard join: exact set similarity with index skipping and reuse of similar sets' answers.

A document's set is its distinct 5-word shingles. Documents with one set are one class; all else
works on classes.

* Shingles are ordered by how often they occur, rare first. Two sets that reach the threshold share a
  shingle among the first ``n - ceil(0.75 n) + 1`` of each (the prefix), so only prefixes are
  shuffled, and only shingles found in two classes' prefixes stay in the index.
* Index skipping: lists are cut into blocks by set size and by place, the number of shingles of a
  set before the list's. Size and what is left after that place bound the overlap: an
  entry is joined only to blocks that hold a set within its bounds, and skips the others.
* Sketches of 512 bytes rule out most remaining pairs, by a bound that loses none; only pairs that
  stay have their whole sets compared.
* Answer reuse: a set's answer is derived from that of the sets most like it. Sets linked so far have one
  answer, their component (at first each set is its own). In each list, entries outside the list's
  main component are first compared with its hubs only, its sets with the least place: those have the
  fewest shingles of their own and are the likeliest to be linked. A set linked to a hub takes the hub's answer. After
  such rounds all entries of different components are compared, and pairs inside a component never, nor a
  pair twice. So a group of near copies costs comparisons in proportion to its size, and no link
  between components is lost.

The order of shingles only affects cost: any order gives the same links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import batches_of, few, prepared, release, staged, table, without
from specimen_spark.llm.components import components
from specimen_spark.llm.words import CHUNK, Words, gram_hash, mix

SHINGLE = 5
PERCENT = 75
#: Shingles whose frequency is told to all tasks: 16 bytes each. A bound on a hint, not on data.
FREQUENT = 100_000
#: Entries of a task's running count; beyond twice that, the rarest are forgotten (hint only).
COUNTED = 200_000
#: Rounds that compare with the main component of a list before the rest is compared in full.
MAIN_ROUNDS = 3
#: Sets of a list's main component that others are compared with in such a round.
HUBS = 4
#: Blocks of an index list for sizes that differ by a factor of e, and for a reach as large as the set.
BLOCKS = 12
#: Bits of the sketch that rules pairs out before whole sets are compared.
SKETCH = 4096


def sets_of(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes, _ = words.grams(shingle)
    out = []
    for begin, end in zip(words.bounds[:-1], words.bounds[1:]):
        n = end - begin
        if n >= shingle:
            out.append(np.unique(hashes[begin : end - shingle + 1]))
        elif n:
            out.append(gram_hash(words.hash[begin:end], 1, int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(members: np.ndarray) -> int:
    """A 64-bit id of a set, as a signed integer."""
    total = mix(members + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(members))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def _chunks(batches, column: str):
    for batch in batches:
        for at, end in batches_of(batch, column, CHUNK):
            yield batch.slice(at, end - at)


def profile(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, mark, n, cls) of every document, and (shingle, count) of a task's frequent ones."""

    def run(batches):
        seen, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in _chunks(batches, "text"):
            sets = sets_of(batch.column("text"), shingle)
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array([class_of(s) if len(s) else 0 for s in sets], pa.int64()),
                 pa.nulls(len(n), pa.int64()), pa.array([False] * len(n))],
                names=["doc_id", "mark", "n", "cls", "gram", "frequent"],
            )
            some, c = np.unique(np.concatenate([seen, *sets]), return_counts=True)
            c[np.searchsorted(some, seen)] += counts - 1
            if len(some) > 2 * COUNTED:
                keep = np.sort(np.argpartition(-c, COUNTED)[:COUNTED])
                some, c = some[keep], c[keep]
            seen, counts = some, c
        often = np.flatnonzero(counts >= 3)
        if len(often) > FREQUENT // 5:
            often = often[np.argpartition(-counts[often], FREQUENT // 5)[: FREQUENT // 5]]
        for at in range(0, len(often), 10_000):
            part = often[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), pa.array(counts[part]), pa.nulls(len(part), pa.int64()),
                 pa.array(seen[part].view(np.int64)), pa.array([True] * len(part))],
                names=["doc_id", "mark", "n", "cls", "gram", "frequent"],
            )

    return docs.mapInArrow(run, "doc_id long, mark long, n long, cls long, gram long, frequent boolean")


def prefixes(docs: DataFrame, frequent: tuple, shingle: int, percent: int) -> DataFrame:
    """(gram, cls, n, place) of each set's prefix; a task sends a class once."""
    grams, counts = frequent

    def run(batches):
        sent = set()
        for batch in _chunks(batches, "text"):
            out = []
            for members in sets_of(batch.column("text"), shingle):
                if not len(members):
                    continue
                cls = class_of(members)
                if cls in sent:
                    continue
                sent.add(cls)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, members), len(grams) - 1)
                    rank = np.where(grams[at] == members, counts[at], 0)
                    members = members[np.argsort(rank, kind="stable")]
                p = prefix_length(len(members), percent)
                out.append((members[:p], cls, len(members)))
            if out:
                lengths = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
                     pa.array(np.repeat(np.array([x[1] for x in out], np.int64), lengths)),
                     pa.array(np.repeat(np.array([x[2] for x in out], np.int32), lengths)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]))],
                    names=["gram", "cls", "n", "place"],
                )

    return docs.mapInArrow(run, "gram long, cls long, n int, place int")


def shared_only(rows: DataFrame) -> DataFrame:
    """Distinct rows of grams that two classes have; one pass over sorted partitions."""

    def run(batches):
        held = None  # the last row of what came before, and whether the row before it had its gram
        met = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            keep = np.ones(len(cols[0]), bool)
            keep[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[keep] for c in cols]
            same = np.zeros(len(cols[0]) + 1, bool)
            same[1:-1] = cols[0][1:] == cols[0][:-1]
            same[0] = met
            shared = same[:-1] | same[1:]
            yield _posting([c[:-1][shared[:-1]] for c in cols])
            held, met = [c[-1:] for c in cols], bool(same[-2])
        if held is not None and met:
            yield _posting(held)

    return rows.repartition("gram").sortWithinPartitions("gram", "n", "cls").mapInArrow(run, rows.schema)


def _posting(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "cls", "n", "place"])


def _possible(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sizes and places let two sets reach the threshold, this being their first shared gram."""
    left = F.least(n1 - p1, n2 - p2).cast("long")
    return (
        (F.least(n1, n2).cast("long") * 100 >= F.greatest(n1, n2).cast("long") * percent)
        & (left * (100 + percent) >= (n1.cast("long") + n2) * percent)
    )


def packed_sets(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(cls, n, sketch, members) of the classes of ``needed`` (rep, cls), read from the row marked rep.

    The sketch has a bit for each shingle's hash modulo its length.
    """

    def run(batches):
        sent = set()  # repeated rows meet in a task, as the join is by mark
        for batch in _chunks(batches, "text"):
            out = {"cls": [], "n": [], "sketch": [], "members": []}
            for cls, members in zip(batch.column("cls").to_pylist(), sets_of(batch.column("text"), shingle)):
                if cls not in sent and class_of(members) == cls:
                    sent.add(cls)
                    bits = np.zeros(SKETCH, bool)
                    bits[(members % np.uint64(SKETCH)).astype(np.int64)] = True
                    out["cls"].append(cls)
                    out["n"].append(len(members))
                    out["sketch"].append(np.packbits(bits).tobytes())
                    out["members"].append(members.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out.values(), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=list(out))

    rows = docs.join(needed, F.col("mark") == F.col("rep")).select("cls", "text")
    return rows.mapInArrow(run, "cls long, n long, sketch binary, members binary")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule the threshold out.

    Each bit that only a's sketch has stands for at least one shingle that b lacks, which bounds the
    overlap from above: no pair is lost.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            lacks = [np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))]
            both = np.minimum(n - lacks[0], m - lacks[1])
            keep = pa.array(both * (100 + percent) >= (n + m) * percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    left = sets.select(F.col("cls").alias("a"), F.col("sketch").alias("x"), "n")
    right = sets.select(F.col("cls").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. Only their sets are made again."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select("rep", "cls"), "needed")
    sets = staged(packed_sets(docs, few(needed), shingle), "sets")
    close = staged(likely(pairs, sets, percent), "likely")
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    both = close.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    found = staged(both.mapInArrow(run, "a long, b long"), "verified")
    release(needed, sets, close)
    return found


def mixed_entries(index: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Entries, with their component, of lists that hold several; ``main`` is the component with most
    entries of the list, ``hubs`` those of its sets that stand out there.

    A hub is the set with the least place among those of the same hash modulo ``HUBS``: few of its shingles
    are rarer than the list's, so it lies in the middle of a group of near copies, and no place
    leaves more of a set to be shared.
    """
    if roots is None:
        known = index.withColumn("comp", F.col("cls"))
    else:
        known = staged(
            index.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
                "gram", "cls", "n", "place", F.coalesce("root", "cls").alias("comp")),
            "index_components",
        )
    entry = F.struct("place", "n", "cls")
    hubs = [F.min(F.when(F.pmod("cls", F.lit(HUBS)) == i, entry)).alias(f"hub{i}") for i in range(HUBS)]
    per = known.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("m"), *hubs).select(
        "gram", "comp", "m", F.array_compact(F.array(*[f"hub{i}" for i in range(HUBS)])).alias("hubs"))
    first = F.struct("m", (-F.array_min("hubs.place")).alias("place"), "comp", "hubs")
    mixed = per.groupBy("gram").agg(F.count(F.lit(1)).alias("comps"), F.max(first).alias("top")).filter("comps > 1").select(
        F.col("gram").alias("g"), F.col("top.comp").alias("main"), "top.hubs")
    mixed = staged(mixed, "mixed_lists")
    entries = staged(known.join(mixed, F.col("gram") == F.col("g")).drop("g"), "mixed_entries")
    release(mixed, *([] if roots is None else [known]))
    return entries


def pairs_with_main(entries: DataFrame, percent: int) -> DataFrame:
    """Entries outside their list's main component, paired with its hubs there."""
    return entries.filter("comp <> main").select("cls", "n", "place", F.explode("hubs").alias("o")).filter(
        _possible(F.col("n"), F.col("place"), F.col("o.n"), F.col("o.place"), percent)
    ).select(F.least("cls", "o.cls").alias("a"), F.greatest("cls", "o.cls").alias("b"))


def pairs_across(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of entries of different components that bounds don't rule out.

    A set's reach is the largest size of another set that this place leaves open. Each list is
    cut into blocks of near sizes and near reach, and a summary of a block is its least size and
    largest reach: an entry is sent only to blocks whose summary it fits, all others are skipped.
    """
    reach = F.floor((F.col("n") - F.col("place")).cast("long") * (100 + percent) / percent) - F.col("n")
    block = F.struct(
        F.floor(F.log("n") * BLOCKS).alias("size"), F.floor(F.col("reach") * BLOCKS / F.col("n")).alias("room"))
    cut = entries.select("gram", "cls", "n", "comp", "main", reach.alias("reach")).withColumn("block", block)
    summary = cut.groupBy("gram", "block").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    blocks = summary.groupBy(F.col("gram").alias("g")).agg(F.collect_list(F.struct("block", "least", "most")).alias("blocks"))
    minor = cut.filter("comp <> main").join(blocks, F.col("gram") == F.col("g")).select(
        F.col("gram").alias("gram2"), F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("reach").alias("reach2"),
        F.col("comp").alias("comp2"),
        F.explode(F.filter("blocks", lambda b: (b.least <= F.col("reach")) & (F.col("n") <= b.most))).alias("to"))
    return cut.join(minor, (F.col("gram") == F.col("gram2")) & (F.col("block") == F.col("to.block"))).filter(
        (F.col("comp") != F.col("comp2")) & ((F.col("comp") == F.col("main")) | (F.col("cls") < F.col("cls2")))
        & (F.col("n2") <= F.col("reach")) & (F.col("n") <= F.col("reach2"))
    ).select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"))


def link_classes(docs: DataFrame, classes: DataFrame, frequent: tuple, shingle: int, percent: int) -> DataFrame:
    """(node, root) of every class that has a link."""
    index = staged(shared_only(prefixes(docs, frequent, shingle, percent)), "index")
    entries, links, roots, tried = mixed_entries(index, None), None, None, None
    turn = 0
    while turn <= MAIN_ROUNDS:
        pairs = pairs_with_main(entries, percent) if turn < MAIN_ROUNDS else pairs_across(entries, percent)
        pairs = pairs.distinct()
        # A pair that an earlier round compared has its answer.
        fresh = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = fresh if tried is None else tried.union(fresh)
        found = verified(fresh, docs, classes, shingle, percent)
        news = links is None or not found.isEmpty()
        if news:
            links = found if links is None else links.union(found)
            if roots is not None:
                release(roots)
            roots = components(links)
        # Without new links the hubs are the same as before: the rest is compared in full.
        turn = turn + 1 if news else max(turn + 1, MAIN_ROUNDS)
        if news and turn <= MAIN_ROUNDS:
            release(entries)
            entries = mixed_entries(index, roots)
    release(index, entries, tried, links)
    return roots


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, mark, n_shingles, cls (equal sets), component_id, lead.

    Rows are told by ``mark``, a hash of doc_id and text. ``lead`` is the mark of the component's first
    row by doc_id, nulls last, then mark; it is null without a set.

    Empty and null texts have no set: component_id is their own doc_id. A null doc_id is greater
    than others: it names a component only where no member has an id. Repeated rows get equal
    results. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    found = staged(profile(docs, shingle), "profile")
    own = found.filter("not frequent").select("doc_id", "mark", "n", "cls")
    top = (
        found.filter("frequent").groupBy("gram").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas()
    )
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    frequent = (grams[order], top["n"].to_numpy(np.int64)[order])
    classes = staged(
        own.filter("n > 0").groupBy("cls").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("mark").alias("rep"))).alias("first")),
        "classes",
    )
    reps = classes.select("cls", "first.rep")
    roots = link_classes(docs, reps, frequent, shingle, percent)
    rooted = staged(
        classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root")),
        "rooted",
    )
    least = staged(rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least")), "least")
    named = staged(
        rooted.join(least, F.col("root") == F.col("r")).select(
            F.col("cls").alias("c"), F.col("least.doc").alias("component"), F.col("least.rep").alias("lead")),
        "named",
    )
    return own.join(named, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), "cls", F.coalesce("component", "doc_id").alias("component_id"), "lead"
    )


def keep_leaders(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The first document of each group of linked ones: smallest doc_id, null last, then least mark.

    Rows are told by doc_id and text: of two texts under one id, or of rows with a null id, only those
    go that a row before them is linked to.
    Documents without words stay; repeated rows of the first document stay together.
    """
    gone = staged(linked(docs, shingle, percent).filter("mark <> lead").select("mark").distinct(), "not_first")
    return without(docs, "xxhash64(cast(row.doc_id as long), cast(row.text as string))", gone)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents where text is not null),
s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
r as (select doc_id x, doc_id y from documents union select r.x, e.b from r join e on r.y = e.a),
c as (select x, min(y) component_id from r group by 1)
select doc_id, coalesce(n, 0) n_shingles, component_id from documents d left join n using (doc_id) join c on c.x = d.doc_id
"""
