"""Prediction by partial matching against a plain trie of dicts with explicit exclusion."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from specimen_spark.llm import ppm
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def lowered(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def symbols(text, order):
    """(context, symbol) of each byte and the end; None stands before the text."""
    seq = [None] * order + list(lowered(text)) + ["end"]
    return [(tuple(seq[i - order : i]), seq[i]) for i in range(order, len(seq))]


def plain(docs, order, held):
    trie, words = defaultdict(Counter), Counter()
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", lowered(t)), None] for i, (_, t) in enumerate(docs)}
    for i, (doc, text) in enumerate(docs):
        if not held(doc):
            words.update(tokens[i])
            for context, symbol in symbols(text, order):
                for k in range(order + 1):
                    trie[context[order - k :]][symbol] += 1

    def probability(context, symbol):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            found = {s: n for s, n in trie.get(context[order - k :], {}).items() if s not in excluded}
            total = sum(found.values())
            if symbol in found:
                return p * (found[symbol] - ppm.DISCOUNT) / total
            if found:
                p *= len(found) * ppm.DISCOUNT / total
            excluded |= set(found)
        return p / (257 - len(excluded))

    known, out = {}, []
    n, v = sum(words.values()), len(words)
    for i, (doc, text) in enumerate(docs):
        score = 0.0
        for pair in symbols(text, order):
            if pair not in known:
                known[pair] = math.log10(probability(*pair))
            score += known[pair]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens[i])
        out.append((doc, held(doc), len(tokens[i]), sum(words[w] > 0 for w in tokens[i]), n, base, score))
    return out


def is_held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def close(got, want):
    key = lambda r: (r[0] is None, *(x if x is not None else 0 for x in r[:5]), round(r[5], 4), round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9), (a, b)


@pytest.mark.parametrize("order,block,shard", [(5, None, None), (1, None, 2000), (2, 3000, 20_000), (6, 50_000, 50_000)])
def test_against_a_plain_trie(spark, monkeypatch, order, block, shard):
    docs = cases.documents(spark).union(cases.documents(spark, [cases.doc(i, f"Held {i} zebra\x00 quiz\tÀ") for i in range(100, 130)]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if shard:
        monkeypatch.setattr(ppm, "SHARD_BYTES", shard)
    held = {d for d, _ in rows if is_held(d)}
    assert held and len(held) < len(rows)
    close(ppm.score(docs.repartition(3), ppm.held_out(), order).collect(), plain(rows, order, is_held))


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK", 1000)
    text = " ".join(f"word{i}É" for i in range(2000)).encode()
    parts = list(ppm.parts_of(text, 5))
    assert len(parts) > 10 and b"".join(p[c:] for p, c, _ in parts) == text
    assert [e for _, _, e in parts] == [False] * (len(parts) - 1) + [True]
    whole = ppm._Part(text, [len(text)], 0, True, 5)
    each = [ppm._Part(p, [len(p)], c, e, 5) for p, c, e in parts]
    assert [x for p in each for x in p.grams] == list(whole.grams)
    assert [x for p in each for x in p.words] == list(whole.words)
    assert len(list(ppm.parts_of(b"x" * 5000, 5))) == 1


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark)
    for r in ppm.score(docs, ppm.F.lit(True)).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0
    want = {r.doc_id: -math.log10(257) * (len((r.text or "").encode()) + 1) for r in docs.collect() if r.doc_id == 8}
    got = {r.doc_id: r.score for r in ppm.score(docs, ppm.F.lit(True)).collect()}
    assert math.isclose(got[8], want[8], rel_tol=1e-9)
    assert ppm.score(docs.limit(0), ppm.held_out()).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ppm.op11_ppm(spark, SF).collect()
    close(got, plain(rows, ppm.ORDER, is_held))


def test_better_than_words_on_held_out_documents(spark):
    rows = [r for r in ppm.op11_ppm(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
