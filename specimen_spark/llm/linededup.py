"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

A line is a run of words. Two lines match if they are equal or one word was replaced, inserted or
deleted. A line goes if it matches a line that stands earlier (smaller doc_id, then line number);
this is judged on the input. Lines of fewer than ``min_words`` words have no near copies: they go if
an earlier line has the same words.

Emitting one variant per word of every line would multiply the corpus, so variants come at two
levels. Level 1 leaves out one of ``SEGMENTS`` parts of a line: a matching pair agrees on all parts
but one. Level 2 leaves out single words, only inside the part whose level-1 variant another
line shares. Both levels are hashed keys joined by equality; within a key only the earliest
line counts, so no pairs of a group are built, and the earliest match found is verified word by word.
Only distinct lines take part: copies of a line need no comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import few, staged, table

MIN_WORDS = 8
SEGMENTS = 2
#: Documents that lose lines are told to all tasks up to this number, so that no text moves; more meet the texts in a join.
MAX_LOST = 500_000

_LAST = (1 << 63) - 1


def words_of(line: Column) -> Column:
    """Words stand between spaces; case is ignored."""
    return F.array_remove(F.split(F.lower(line), " "), "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _identity(of: str = "") -> tuple[Column, Column]:
    """d and t, which tell a document: repeated rows share them, a null id comes last."""
    return F.coalesce(F.col(of + "doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(of + "text").alias("t")


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(*_identity(), F.col("text").cast("string").alias("text"))


def worded_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(lid, n, d, t, l, v0, v1, ...) of every line with words, with the level-1 variants of those that have near copies.

    Variants 0 to SEGMENTS - 1 are the line's own (role 0), the others those of the longer line of a
    pair (role 1); null in lines of fewer than ``min_words`` words. Words are made inside the generator, so
    that a filter on their number does not make them again.
    """
    lines = identified(docs).select(
        "d", "t", F.posexplode_outer(F.transform(lines_of(F.col("text")), words_of)).alias("l", "w")
    ).withColumn("n", F.size("w")).filter(F.col("n") > 0)
    keys = [
        F.when(F.col("n") >= min_words, _part_key(F.col("w"), F.col("n"), F.col("n") - role, j)).alias(f"v{role * SEGMENTS + j}")
        for role in (0, 1) for j in range(SEGMENTS)
    ]
    return lines.select(F.xxhash64("w").alias("lid"), "n", "d", "t", "l", *keys)


def _part_key(w: Column, n: Column, length: Column, j: int) -> Column:
    """Key of a line without its part j, cut as a line of ``length`` words is cut."""
    begin, rest = _begin(length, j), length - _begin(length, j + 1)
    return F.xxhash64(length, F.lit(j), F.slice(w, 1, begin), F.lit(-1), F.slice(w, n - rest + 1, rest))


def _begin(length: Column, j: int) -> Column:
    return F.floor(length * j / SEGMENTS).cast("int")


def earliest_lines(lines: DataFrame) -> DataFrame:
    """Each distinct line once: lid, n, first position, and its level-1 variants."""
    keys = [F.min(f"v{i}").alias(f"v{i}") for i in range(2 * SEGMENTS)]
    return lines.groupBy("lid", "n").agg(F.min(F.struct("d", "t", "l")).alias("first"), *keys)


def replaced_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """lids of distinct lines with an earlier line one word away."""
    variants = F.explode(F.array(*[
        F.struct(F.lit(i // SEGMENTS).alias("role"), F.lit(i % SEGMENTS).alias("j"), F.col(f"v{i}").alias("k1"))
        for i in range(2 * SEGMENTS)
    ])).alias("v")
    shared = staged(
        firsts.select(variants).groupBy("v.k1").agg(F.count(F.lit(1)).alias("m"), F.min("v.role").alias("least"))
        .filter("m > 1 and least = 0").select(F.col("k1").alias("key")),
        "shared_variants",
    )
    candidates = (
        firsts.select("lid", "n", "first", variants).select("lid", "n", "first", "v.*")
        .join(shared, F.col("k1") == F.col("key"))
        .groupBy("first.d", "first.t").agg(F.collect_list(F.struct("first.l", "lid", "n", "role", "j", "k1")).alias("cs"))
        .select(F.col("d").alias("cd"), F.col("t").alias("ct"), "cs")
    )
    # Only documents that hold a candidate are cut into lines again; their number bounds each list.
    texts = staged(
        identified(docs).join(
            staged(candidates, "line_candidates"), (F.col("d") == F.col("cd")) & (F.col("t") == F.col("ct")))
        .select("d", "t", lines_of(F.col("text")).alias("ls"), F.explode("cs").alias("c"))
        .select("d", "t", "c.*", words_of(F.element_at("ls", F.col("c.l") + 1)).alias("w"))
        .groupBy("lid").agg(
            F.first("n").alias("n"), F.min(F.struct("d", "t", "l")).alias("first"), F.first("w").alias("w"),
            F.collect_set(F.struct("role", "j", "k1")).alias("parts")),
        "line_texts",
    )

    # Level 2: leave out one word of the part, or nothing (the shorter line of a pair).
    length = F.col("n") - F.col("v.role")
    begin = F.floor(length * F.col("v.j") / SEGMENTS).cast("int")
    end = F.floor(length * (F.col("v.j") + 1) / SEGMENTS).cast("int")
    part = texts.select("lid", "n", "first", "w", F.explode("parts").alias("v")).select(
        "lid", "first", F.col("v.role").alias("role"), F.col("v.k1").alias("k1"),
        F.slice("w", begin + 1, end - begin + F.col("v.role")).alias("mid"),
    )
    size = F.size("mid")

    def replaced():
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
            F.lit(0).alias("kind"),
            F.xxhash64(F.col("k1"), F.lit(0), i, F.slice("mid", F.lit(1), i - 1), F.lit(-1), F.slice("mid", i + 1, size - i)).alias("k2"),
        )))

    # kind 0: replaced word at place i; kind 1: the longer line less a word; kind 2: the shorter line
    # kinds 1 and 2 must meet, so both hash the words that are left
    def less_word():
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
            F.lit(1).alias("kind"),
            F.xxhash64(F.col("k1"), F.lit(1), F.concat(F.slice("mid", F.lit(1), i - 1), F.slice("mid", i + 1, size - i))).alias("k2"),
        )))

    as_is = F.array(F.struct(F.lit(2).alias("kind"), F.xxhash64(F.col("k1"), F.lit(1), F.col("mid")).alias("k2")))
    empty = F.array().cast("array<struct<kind:int,k2:bigint>>")
    variants = F.when(
        F.col("role") == 0, F.concat(F.coalesce(replaced(), empty), as_is)
    ).otherwise(F.coalesce(less_word(), empty))
    words = staged(
        part.select("lid", "first", F.explode(variants).alias("u")).select("lid", "first", "u.kind", "u.k2").distinct(),
        "line_variants",
    )
    groups = words.groupBy("k2").agg(
        F.count(F.lit(1)).alias("m"),
        F.min(F.when(F.col("kind") != 1, F.col("first"))).alias("as_is"),
        F.min(F.when(F.col("kind") == 1, F.col("first"))).alias("longer"),
    ).filter("m > 1").select(F.col("k2").alias("key"), "as_is", "longer")
    # kind 0 keys hold only kind 0 rows: the earliest of them. Else the earliest of the other kind.
    other = F.when(F.col("kind") == 2, F.col("longer")).otherwise(F.col("as_is"))
    found = (
        words.join(groups, F.col("k2") == F.col("key")).withColumn("before", other)
        .filter(F.col("before") < F.col("first"))
        .groupBy("lid").agg(F.min("before").alias("before"))
    )
    mine = texts.select(F.col("lid").alias("a_lid"), F.col("w").alias("a"))
    theirs = texts.select(F.col("first").alias("b_first"), F.col("w").alias("b"))
    return (
        found.join(mine, F.col("lid") == F.col("a_lid")).join(theirs, F.col("before") == F.col("b_first"))
        .filter(one_word_apart(F.col("a"), F.col("b"))).select("lid").distinct()
    )


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether two word arrays are equal but for one word replaced, inserted or deleted."""
    long = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    short = F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x != y)
    at = F.array_position(differ, True)  # of the first difference; 0: none
    skip = F.when(at == 0, F.size(short) + 1).otherwise(at).cast("int")
    same = F.size(a) == F.size(b)
    rest_long = F.slice(long, skip + 1, F.greatest(F.size(long) - skip, F.lit(0)))
    gone = F.when(same, skip + 1).otherwise(skip)
    rest_short = F.slice(short, gone, F.greatest(F.size(short) - gone + 1, F.lit(0)))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (rest_long == rest_short)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents with ``n_lines``, ``n_removed`` and the text of the lines that stay.

    Null text has no lines and stays null; lines without words stay; line order is kept. Other
    columns pass through, whatever their names. An empty table gives no rows.
    """
    lines = staged(worded_lines(docs, min_words), "lines")
    firsts = staged(earliest_lines(lines.filter(F.col("n") >= min_words)), "distinct_lines")
    gone = replaced_lines(docs, firsts).select(F.col("lid").alias("gone"))
    stay = staged(
        firsts.select(F.col("lid").alias("key"), "first").join(gone, F.col("key") == F.col("gone"), "left")
        .select("key", "first", F.col("gone").isNull().alias("stays")),
        "staying_lines",
    )
    short = lines.filter(F.col("n") < min_words)
    earliest = short.groupBy(F.col("lid").alias("key")).agg(F.min(F.struct("d", "t", "l")).alias("first"))
    stay = stay.union(staged(earliest.withColumn("stays", F.lit(True)), "short_firsts"))
    lost = staged(
        lines.select("lid", "d", "t", "l").join(stay, F.col("lid") == F.col("key"))
        .filter(~(F.col("stays") & (F.struct("d", "t", "l") == F.col("first"))))
        .groupBy(F.col("d").alias("ld"), F.col("t").alias("lt")).agg(F.collect_set("l").alias("lost")),
        "lost_lines",
    )
    rows = docs.select(F.struct("*").alias("row")).select("row", *_identity("row."))
    text, lines_ = F.col("row.text"), lines_of(F.col("row.text").cast("string"))
    kept = F.array_join(F.filter(lines_, lambda line, i: ~F.array_contains("lost", i)), "\n")
    return rows.join(few(lost, MAX_LOST), (F.col("d") == F.col("ld")) & (F.col("t") == F.col("lt")), "left").select(
        *[F.when(F.col("lost").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"row.{c}").alias(c)
          for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines_)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays)."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
with l as (
  select doc_id, i - 1 l, ls[i] line,
    list_filter(regexp_split_to_array(lower(ls[i]), ' +'), lambda x: x <> '') w
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null))),
every as (select w, min((doc_id, l)) first from l where len(w) >= 1 group by w),
f as (select * from every where len(w) >= 8),
v as (select w, first, len(w) n, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') rest from (select *, unnest(range(1, len(w) + 1)) i from f)),
gone as (
  select distinct w from (
    select a.w from v a join v b on a.n = b.n and a.i = b.i and a.rest = b.rest where b.first < a.first
    union all
    select a.w from v a join f b on a.rest = array_to_string(b.w, ' ') and a.n = len(b.w) + 1 where b.first < a.first
    union all
    select b.w from v a join f b on a.rest = array_to_string(b.w, ' ') and a.n = len(b.w) + 1 where a.first < b.first)),
k as (
  select doc_id, l.l, line, len(l.w) = 0 or ((doc_id, l.l) = f.first and not exists (select 1 from gone where gone.w = l.w)) stay
  from l left join every f on l.w = f.w),
g as (
  select doc_id, count(*) n_lines, sum(case when stay then 0 else 1 end)::bigint n_removed,
    sha256(coalesce(string_agg(line, chr(10) order by l) filter (where stay), '')) kept_sha256 from k group by doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, coalesce(kept_sha256, sha256('')) kept_sha256
from documents d left join g using (doc_id)
"""
