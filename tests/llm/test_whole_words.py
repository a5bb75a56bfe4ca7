"""The quality model tells words whole."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from specimen_spark.llm import quality
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def plain(docs, learn):
    """Perplexity by text of an interpolated modified Kneser-Ney bigram model over whole words and one unknown word."""
    words = lambda t: [None] + re.findall(r"[^\x20\x09-\x0D]+", cases.lowered(t or ""))
    c = Counter(p for t in learn for p in zip(words(t), words(t)[1:]))
    d = quality.discounts([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
    follow, total, taken = Counter(w for _, w in c), Counter(), Counter()
    for (v, _), n in c.items():
        total[v] += n
        taken[v] += d[min(n, 3) - 1]
    e = quality.discounts([sum(n == k for n in follow.values()) for k in (1, 2, 3, 4)])
    spare = sum(e[min(n, 3) - 1] for n in follow.values()) / len(c) / (len(follow) + 1)

    def p(v, w):
        low = (follow[w] - e[min(follow[w], 3) - 1] if follow[w] else 0) / len(c) + spare
        if not total[v]:
            return low
        n = c[v, w]
        return ((n - d[min(n, 3) - 1] if n else 0) + taken[v] * low) / total[v]

    assert abs(sum(p(None, w) for w in follow) + p(None, ("unknown",)) - 1) < 1e-9
    out = {}
    for t in docs:
        x = words(t)
        out[t] = math.exp(-sum(math.log(p(v, w)) for v, w in zip(x, x[1:])) / (len(x) - 1)) if len(x) > 1 else None
    return out


def test_quality_against_a_plain_model_of_whole_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "TOKENS_A_GROUP", 5_000)  # several shards a turn, some of them dealt to groups of blocks
    monkeypatch.setattr(quality, "COUNTED", 10_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(
        cases.documents(spark).selectExpr("doc_id + 1000000", "text", "lang"))
    docs = docs.union(docs.limit(5)).repartition(3, "doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    trusted = {r[0] for r in quality.trusted_ids(labels).collect()}
    fold = F.pmod(F.xxhash64("trusted", F.lit("fold")), F.lit(quality.FOLDS))
    learnt = {r[0] for r in quality.trusted_ids(labels).filter(fold != 0).collect()}
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    want = plain({t for _, t in rows}, [t for i, t in rows if i in learnt])
    got = quality.classify(docs, labels, vocabulary=None).collect()
    text = {r.mark: r.text for r in docs.select(F.xxhash64("doc_id", "text").alias("mark"), "text").collect()}
    assert trusted and len(got) == len(rows)
    for r in got:
        value = want[text[r.mark]]
        assert (r.perplexity is None) == (value is None)
        assert value is None or math.isclose(r.perplexity, value, rel_tol=1e-9)


def test_the_query_tells_words_apart_that_shared_an_id(spark):
    """8,191 ids hold 20,000 words several times over: unknown words took the counts of known ones."""
    known = [" ".join(f"w{i * 40 + j}" for j in range(40)) for i in range(500)]
    rows = [cases.doc(i, t) for i, t in enumerate(known)] + [cases.doc(-1 - i, t.replace("w", "x")) for i, t in enumerate(known[:50])]
    docs = cases.documents(spark, rows)
    labels = spark.range(500).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    value = {r.doc_id: r.perplexity for r in quality.judge(docs, labels).collect()}
    unknown = [value[-1 - i] for i in range(50)]
    assert max(unknown) / min(unknown) < 1 + 1e-9  # words never seen are all one
    # one in ten is held out, and its words are not seen either
    assert sum(min(unknown) > 2 * value[i] for i in range(500)) > 400
