"""WARC, nearest neighbours, chat repair and the pipeline."""

import base64
import hashlib
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from specimen_spark.llm import ann, chat, warc
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_warc(spark):
    schema = "page_id long, url string, html string, kind string, refers_to string, _digest string"
    extra = [(i, u, h, "k", "r", "d") for i, u, h in [
        (9000, "http://a", "<p>same</p>"), (9001, None, "<p>same</p>"), (9001, None, "<p>same</p>"), (None, "http://b", "<p>same</p>"),
        (9002, "http://c\r\nX: y", None), (9003, "", ""), (None, None, "alone"), (None, None, "alone"), (9004, "u", "é漢\r\n\r\nWARC/1.1\r\n\r\n"),
        (9005, "u", "x" * 3_000_000), (9006, "u", "x" * 3_000_000)]]
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("*", "'k' kind", "'r' refers_to", "'d' _digest").union(
        spark.createDataFrame(extra, schema))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = {}
    for i, p in rows:
        last[p] = max((x for x in (last.get(p), i) if x is not None), default=None)
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == last[p] else "revisit",
             None if i == last[p] else last[p]) for i, p in rows]
    cases.same(warc.round_trip(pages).collect(), want)
    small = warc.round_trip(pages, min_bytes=1000).filter("record_type = 'revisit'").collect()
    assert [r.page_id for r in small] == [9005]
    assert warc.round_trip(pages.limit(0)).count() == 0


def vectors(spark, n=3000, dim=16):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(n, dim)), rng.normal(size=(n // 2, dim)) * 0.1 + 2])
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    copy = x[0].tolist()
    rows += [(10_000 + i, copy, "e") for i in range(800)] + [(10_000, copy, "e")]
    rows += [(20_000, None, "e"), (20_001, [0.0] * dim, "e"), (20_002, [float("nan")] * dim, "e"), (20_003, [None] * dim, "e"),
             (20_004, [float("inf")] + [1.0] * (dim - 1), "e"), (None, copy, "e"), (20_050, [], "e"), (20_100, [1.0, 2.0], "e"),
             (20_101, [2.0, 4.0], "e"), (20_150, (x[0] * 3).tolist(), "e")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, edges string")


def test_nearest_neighbours(spark):
    rows = vectors(spark)
    got = {}
    for r in ann.nearest(rows, rows.filter("vec_id % 50 = 0"), shard_rows=1024).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v)) for i, v, _ in rows.distinct().collect()
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    hit = total = 0
    for q, v in good:
        if q % 50:
            continue
        all_ = sorted((-float(v @ u / (np.linalg.norm(v) * np.linalg.norm(u))), i) for i, u in good if i != q and len(u) == len(v))
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, min(5, len(all_)) + 1))
        exact = {i: -s for s, i in all_}
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += sum(f[2] >= -all_[len(found) - 1][0] - 1e-12 for f in found)
        total += len(found)
    assert hit / total >= 0.95 and total > 100
    assert {20_001, 20_050}.isdisjoint(got) and [f[1] for f in sorted(got[20_100])] == [20_101]
    assert all(abs(f[2] - 1) < 1e-12 for f in got[10_000])  # of hundreds of copies
    assert ann.nearest(rows.limit(0), rows.limit(0)).count() == 0


def cheapest(roles, costs=chat.Costs()):
    """Least cost over all sequences of choices, by trying all."""
    options, ends = chat.choices(costs), chat.endings(costs)
    best = np.inf
    for picks in itertools.product(range(max(len(v) for v in options.values())), repeat=len(roles)):
        state, cost = chat.START, 0
        for role, k in zip(roles, picks):
            found = options[state, role]
            if k >= len(found):
                break
            state, c = found[k][0], found[k][1]
            cost += c
        else:
            best = min(best, cost + ends[state][0])
    return best


def test_chat_repair_is_cheapest_and_legal(spark):
    random.seed(3)
    names = ["system", "user", "assistant", "tool", None, " User "]
    convs = [[random.choice(names) for _ in range(random.randint(1, 4))] for _ in range(40)]
    rows = [(c, t, r, f"text {c} {t} <|end|>", "z") for c, roles in enumerate(convs) for t, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {}
    for r in chat.repair(turns.union(turns)).collect():
        got.setdefault(r.conv_id, []).append(r)
    code = {"system": 1, "user": 2, "assistant": 3, " User ": 2}
    for c, roles in enumerate(convs):
        found = got[c]
        assert len(found) == len(roles)
        assert sum(r.cost for r in found) == cheapest([code.get(r, 0) for r in roles])
    for conv, text in chat.conversations(chat.repair(turns)).collect():
        said = [x.split("\n", 1)[0] for x in text.split("<|turn|>")[1:]]
        if said[0] == "system":
            said = said[1:]
        assert said[::2] == ["user"] * (len(said) // 2) and said[1::2] == ["assistant"] * (len(said) // 2) and len(said) % 2 == 0
        assert text.count("<|end|>") == text.count("<|turn|>") and text.endswith("<|end|>\n")
        assert all(f"text {conv} {t} < |end|>" in text for t in range(len(convs[conv])))


def test_chat_segments_agree_with_one_walk(spark):
    random.seed(4)
    names = ["system", "user", "assistant", "tool"]
    rows = [(1, t, random.choice(names), f"t{t}") for t in range(4000)] + [(2, None, None, None), (None, 1, "user", ""), (3, 1, "user", "a"), (3, 1, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    got = chat.repair(turns).collect()
    code = {"system": 1, "user": 2, "assistant": 3}
    one = chat.steps(chat.Costs())
    cost = np.array([0, np.inf, np.inf, np.inf])
    for _, _, role, _ in rows[:4000]:
        cost = (cost[:, None] + one[code.get(role, 0)]).min(axis=0)
    assert sum(r.cost for r in got if r.conv_id == 1) == min(c + e for c, (e, _) in zip(cost, chat.endings(chat.Costs())))
    assert len(got) == len(rows)
    assert chat.repair(turns.limit(0)).count() == 0
    labels = spark.read.parquet(f"{SF}/conversations.parquet")
    assert chat.repair(labels).count() == labels.select("conv_id", "turn", "role", "text").distinct().count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, empty):
    docs = cases.documents(spark, [] if empty else None).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before = {r.doc_id for r in docs.collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r.doc_id for r in docs.collect()} <= before
    rows = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    if not empty:
        assert 8 in {r.doc_id for r in rows} and not {4, 5, 10} & {r.doc_id for r in rows}
