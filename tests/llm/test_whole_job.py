"""Cases that parts of the operators used to leave out."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from specimen_spark.llm import jaccard, linededup, quality
from tests.llm import cases

OTHER = " ".join(f"other{i}" for i in range(30))


def texts(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_null_and_shared_ids_lose_only_copies(spark):
    near = cases.SENTENCE + " again"
    rows = [cases.doc(3, cases.SENTENCE), cases.doc(None, near), cases.doc(None, OTHER), cases.doc(None, None), cases.doc(7, cases.SENTENCE),
            cases.doc(7, cases.PASSAGE), cases.doc(None, ""), cases.doc(None, OTHER)]
    docs = cases.documents(spark, rows)
    kept = jaccard.keep_leaders(docs)
    assert kept.columns == docs.columns
    cases.same(texts(kept), [(3, cases.SENTENCE), (None, OTHER), (None, None), (7, cases.PASSAGE), (None, ""), (None, OTHER)])
    assert sorted(texts(corpus_pipeline.near_duplicates(spark, docs, "")), key=str) == sorted(texts(kept), key=str)


def test_near_copies_whose_ids_are_all_null_are_linked(spark):
    near = OTHER + " end"
    docs = cases.documents(spark, [cases.doc(None, OTHER), cases.doc(None, near), cases.doc(9, near + " more"), cases.doc(1, cases.SENTENCE)])
    cases.same(jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect(), cases.linked(texts(docs)))
    cases.same(texts(jaccard.keep_leaders(docs)), [(9, near + " more"), (1, cases.SENTENCE)])
    nulls = docs.filter(F.col("doc_id").isNull())
    assert jaccard.keep_leaders(nulls).count() == 1


def test_exact_copies_of_short_lines_go(spark):
    near, one = "home about us contact page", "Home  about us"
    rows = [cases.doc(2, "\n".join([one, near, "", "ok", cases.SENTENCE])), cases.doc(1, "home about us\n \nfirst"),
            cases.doc(3, "OK\n\n" + near + "\nlast " + cases.SENTENCE), cases.doc(None, "ok\nown"), cases.doc(4, None)]
    docs = cases.documents(spark, rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (3, 0, "home about us\n \nfirst"), 2: (5, 1, "\n".join([near, "", "ok", cases.SENTENCE])),
                   3: (4, 3, ""), None: (2, 1, "own"), 4: (0, 0, None)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert 3 not in kept and kept[2] == got[2][2]


def test_toxic_and_low_documents_are_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(docs, labels).join(labels, "doc_id").select("quality", "toxic", "keep").collect()

    def kept(test):
        some = [r.keep for r in rows if test(r)]
        return sum(some) / len(some)

    clean, toxic, low = (kept(t) for t in (
        lambda r: r.quality == 1 and r.toxic == 0, lambda r: r.toxic == 1, lambda r: r.quality == 0))
    assert clean > 0.95 and toxic < 0.5 and low < 0.2, (clean, toxic, low)


def test_a_language_moves_gradually_to_its_own_limit(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.union(docs.limit(1).selectExpr("-1L", "text", "'xx'", "source", "n_chars"))
    rows = quality.classify(docs, labels).collect()
    fold = F.pmod(F.xxhash64("trusted", F.lit("fold")), F.lit(quality.FOLDS))
    held = {r[0] for r in quality.trusted_ids(labels).filter(fold == 0).collect()}
    by_lang = defaultdict(list)
    for r in rows:
        if r.doc_id in held and r.perplexity is not None:
            by_lang[r.lang].append(r.perplexity)

    def limit(values):
        return sorted(values)[math.ceil(quality.QUANTILE * len(values)) - 1]

    pooled = limit([x for values in by_lang.values() for x in values])
    assert min(map(len, by_lang.values())) < 30
    for r in rows:
        n = len(by_lang[r.lang])
        share = n / (n + 30)
        want = math.exp(share * math.log(limit(by_lang[r.lang])) + (1 - share) * math.log(pooled)) if n else pooled
        assert math.isclose(r.threshold, want, rel_tol=1e-9), (r.lang, n)


def test_all_trusted_documents_teach(spark):
    from specimen_spark.llm.quality import trusted_ids

    labels = spark.range(1_100_000).selectExpr("id as doc_id", "1 as quality", "cast(id % 11 = 0 as int) as toxic")
    assert trusted_ids(labels).count() == 1_000_000
    labels = spark.range(1_200_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert trusted_ids(labels).count() == 1_200_000


def test_texts_do_not_move_for_the_trusted_ids(spark, monkeypatch):
    """However low Spark's own limit for broadcasts is."""
    plans = []

    def noted(docs, run=quality.training_counts):
        plans.append(docs._jdf.queryExecution().optimizedPlan().toString() + docs._jdf.queryExecution().sparkPlan().toString())
        return run(docs)

    monkeypatch.setattr(quality, "training_counts", noted)
    docs = cases.documents(spark, [cases.doc(1, cases.SENTENCE), cases.doc(2, OTHER)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert quality.classify(docs, labels).count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_lines_are_cut_into_words_once(spark, monkeypatch):
    """Short and long lines come from one scan of the texts."""
    scans = []

    def noted(df, name, run=linededup.staged):
        scans.extend([name] * ("posexplode" in df._jdf.queryExecution().optimizedPlan().toString()))
        return run(df, name)

    monkeypatch.setattr(linededup, "staged", noted)
    docs = cases.documents(spark, [cases.doc(1, "short line\n" + OTHER), cases.doc(2, "Short  line\n\n" + OTHER + " x"), cases.doc(3, None)])
    got = {r.doc_id: (r.n_removed, r.text) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (0, "short line\n" + OTHER), 2: (2, ""), 3: (0, None)}
    assert scans == ["lines"]
