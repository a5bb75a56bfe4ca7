"""Operators on documents against plain versions, on whole small tables and on hard cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specimen_spark.llm import catalog, decontaminate, jaccard, linededup, packing, quality, sharding, substring
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["table", "hard", "empty"])
def docs(request, spark):
    if request.param == "table":
        return spark.read.parquet(f"{SF}/documents.parquet")
    return cases.documents(spark, None if request.param == "hard" else [])


def test_decontamination(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(
        spark.createDataFrame([(9001, cases.PASSAGE), (9002, "brown FOX, jumps"), (9003, None), (9004, "-"), (None, cases.SENTENCE),
                               (9001, cases.PASSAGE)], "item_id long, text string"))
    got = decontaminate.contamination(docs, items).drop("spans").collect()
    cases.same(got, cases.contamination(pairs(docs), [tuple(r) for r in items.collect()]))
    clean = decontaminate.keep_uncontaminated(docs, items)
    assert clean.columns == docs.columns
    bad = {tuple(x) for x, r in zip(pairs(docs), cases.contamination(pairs(docs), [tuple(r) for r in items.collect()])) if r[-1]}
    cases.same(pairs(clean), [x for x in pairs(docs) if x not in bad])


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs, items = cases.documents(spark), spark.createDataFrame([(1, cases.PASSAGE)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    got = decontaminate.contamination(docs, items).drop("spans").collect()
    cases.same(got, cases.contamination(pairs(docs), [(1, cases.PASSAGE)]))
    none = decontaminate.contamination(docs, items.limit(0)).filter("contaminated or n_hit > 0")
    assert none.count() == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    got, seen = [], set()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.sequence_id not in seen
        seen.add(r.sequence_id)
        if r.start == 0:
            by_doc = {"doc": r.doc_id, "ids": [], "total": r.doc_tokens}
            got.append(by_doc)
        assert r.start == len(by_doc["ids"]) and r.doc_id == by_doc["doc"]
        by_doc["ids"] += r.ids
    texts = pairs(docs)
    want = [(i, tuple(e.ids) + (2,)) for (i, _), e in zip(texts, plain.encode_batch([t or "" for _, t in texts], add_special_tokens=False))]
    cases.same([(g["doc"], tuple(g["ids"])) for g in got], want)
    assert all(g["total"] == len(g["ids"]) for g in got)


def test_special_marks_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "It's  they'LL  é é ΑΣ 123 \x1c\x1d!!", "<|", "\n\n a\r\nb"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_sharding(docs):
    rows = sharding.shard_documents(docs, sharding.even_tree(3, 2, 4)).collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs(docs)]
    cases.same([(r.doc_id, r["size"], r.text_crc32) for r in rows], want)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_changed_weight_moves_rows_only_inside_its_subtree(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.even_tree(3, 2, 4)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier[0][0][0], heavier[0][0][1] = 1.5, 0.5  # the rack's own weight stays
    moved = sharding.place(sharding.place(ids, tree, "doc_id"), heavier, "doc_id", "new").filter("shard <> new")
    assert {r[0] for r in moved.select("shard").collect()} | {r[0] for r in moved.select("new").collect()} <= {0, 1, 2, 3}
    counts = [r[1] for r in sharding.place(ids, tree, "doc_id").groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.3 * 20_000 / 24 and min(counts) > 0.7 * 20_000 / 24


def test_substrings(docs):
    got = substring.dedup_substrings(docs, with_text=True).collect()
    expected = cases.substrings(pairs(docs))
    if any(r[0] == 15 for r in expected):  # two texts under one id share its places
        assert len(got) == len(expected)
    cases.same([tuple(r)[:4] for r in got], expected)
    assert all(cases.sha(r.text) == r.kept_sha256 for r in got if r.text is not None)


def test_lines(docs):
    got = linededup.dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_removed"}
    cases.same(got.select("doc_id", "n_lines", "n_removed", "text").collect(), cases.line_dedup(pairs(docs)))


def test_lines_one_word_apart(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    lines = [base, base[:3] + base[4:], base + ["end"], ["start"] + base, base[:5] + ["x"] + base[6:], base[:5] + ["x", "y"] + base[7:],
             base[:5] + ["y"] + base[6:], base[1:] + base[:1], base[:4] + ["new"] + base[4:], base * 2, base * 2 + ["b"]]
    rows = [cases.doc(i, " ".join(x)) for i, x in enumerate(lines)] + [cases.doc(50 + i, " ".join(x)) for i, x in enumerate(lines[::-1])]
    docs = cases.documents(spark, rows)
    cases.same(linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text").collect(), cases.line_dedup(pairs(docs)))


def test_jaccard(docs):
    rows = jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect()
    cases.same(rows, cases.linked(pairs(docs)))
    kept = jaccard.keep_leaders(docs)
    assert kept.columns == docs.columns
    leads = {(d, t) for (d, t), (_, n, c) in zip(pairs(docs), cases.linked(pairs(docs))) if n and c == d}
    wordless = [x for x, (_, n, _) in zip(pairs(docs), cases.linked(pairs(docs))) if not n]
    cases.same(pairs(kept), [x for x in pairs(docs) if x in leads] + wordless)


def counted_pairs(monkeypatch):
    """Numbers of pairs that the join's rounds compare, filled as it runs."""
    made, write = [], jaccard.staged

    def staged(df, name):
        out = write(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", staged)
    return made


def test_jaccard_compares_a_group_of_copies_with_its_hubs(spark, monkeypatch):
    """Copies with up to a quarter of their shingles changed: few links are left for the full round."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for doc in range(400):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        rows.append((doc, " ".join(words)))
    made = counted_pairs(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cases.same(jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect(), cases.linked(rows))
    assert sum(made) < 20 * len(rows)


def test_jaccard_skips_blocks_of_a_shingle_in_many_components(spark, monkeypatch):
    """One common passage in texts of many sizes: most entries of its lists are never joined."""
    rng = np.random.default_rng(6)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(doc, " ".join([common, *[f"y{rng.integers(10**9)}" for _ in range(4 + doc)]])) for doc in range(200)]
    rows += [(1000 + doc, text.replace("c0 ", "z ")) for doc, text in rows[::10]]
    made = counted_pairs(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cases.same(jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect(), cases.linked(rows))
    assert sum(made) < 10 * len(rows)


def test_jaccard_chain_of_many_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):  # each one word further from the first: neighbours link, ends do not
        words = words[:]
        words[(7 * i) % 60] = f"n{i}"
        rows.append(cases.doc(1000 - i, " ".join(words)))
    docs = cases.documents(spark, rows)
    cases.same(jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect(), cases.linked(pairs(docs)))


def test_quality_against_a_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").union(
        spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    docs = docs.union(docs.limit(5)).repartition(3, "doc_id")
    got = quality.classify(docs, labels).collect()
    import pyarrow as pa
    from collections import Counter, defaultdict

    from specimen_spark.llm.words import Words

    trusted = {r[0] for r in quality.trusted_ids(labels).collect()}
    fold = dict(spark.createDataFrame([(i,) for i in trusted], "trusted long").select(
        "trusted", F.pmod(F.xxhash64("trusted", F.lit("fold")), F.lit(quality.FOLDS))).collect())
    texts = dict(pairs(docs))
    ids = {}
    for i, t in texts.items():
        w = Words(pa.array([t]), lower=True)
        ids[i] = [0] + [int(h % np.uint64(quality.VOCABULARY - 1)) + 1 for h in w.hash]
    c = Counter(p for i, _ in pairs(docs) if i in trusted and fold[i] for p in zip(ids[i], ids[i][1:]))
    d = quality.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    follow, total, rest = Counter(w for _, w in c), Counter(), defaultdict(float)
    for (v, _), n in c.items():
        total[v] += n
        rest[v] += d[min(n, 3) - 1]
    e = quality.discounts([sum(v == k for v in follow.values()) for k in (1, 2, 3, 4)])
    spare = sum(e[min(n, 3) - 1] for n in follow.values()) / len(c) / quality.VOCABULARY

    def p(v, w):
        low = (follow[w] - e[min(follow[w], 3) - 1] if follow[w] else 0) / len(c) + spare
        if not total[v]:
            return low
        n = c[v, w]
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[v] + rest[v] / total[v] * low

    assert abs(sum(p(0, w) for w in range(quality.VOCABULARY)) - 1) < 1e-6
    assert len(got) == docs.count()
    for r in got:
        x = ids[r.doc_id]
        assert r.n_words == len(x) - 1
        if r.n_words:
            want = np.exp(-sum(np.log(p(v, w)) for v, w in zip(x, x[1:])) / r.n_words)
            assert abs(r.perplexity - want) < 1e-6 * want
            assert r.keep == (r.perplexity <= r.threshold)


def test_quality_of_hard_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.keep == (r.n_words > 0) for r in rows)  # no trusted text: nothing but empty texts goes
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in rows)
    assert quality.classify(cases.documents(spark, []), labels).count() == 0


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    share = dict(judged)
    assert share[1] > 0.97 and share[0] < 0.5


def test_every_query_is_registered():
    names = list(catalog.QUERIES)
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
