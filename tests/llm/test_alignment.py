"""Alignment against a plain walk over the tokens of the two libraries' own encoders."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from specimen_spark.llm import alignment
from tests.llm import cases

A_PATH, B_PATH = alignment.tokenizer_paths()


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def tokens(encoders, text):
    """(id, byte range) lists of both tokenizers, empty where one does not spell the text."""
    a, b = encoders
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unit = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    first = [(i, bytes(unit[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
              for i in b.encode(text)]
    if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in (first, second)):
        return [], []
    out = []
    for side in (first, second):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain(encoders, docs):
    """What ``align`` returns: links are the overlapping pairs, groups lie between shared ends."""
    found, counts = [], Counter()
    for doc, text in docs:
        a, b = tokens(encoders, text or "")
        links, near = [], 0
        for i, lo, hi in a:
            while near < len(b) and b[near][2] <= lo:
                near += 1
            at = near
            while at < len(b) and b[at][1] < hi:
                links.append((i, b[at][0]))
                at += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = [(end, [], []) for end in ends]
        for k, side in ((1, a), (2, b)):
            for i, _, e in side:
                groups[bisect.bisect_left(ends, e)][k].append(str(i))
        groups = [(end, ",".join(x), ",".join(y)) for end, x, y in groups]
        counts.update(links)
        found.append((doc, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(doc, n_a, n_b, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x),
             hashlib.sha256(";".join(f"{a}|{b}" for _, a, b in g).encode()).hexdigest() if g else "") for doc, n_a, n_b, g, x in found]


ODD = [" a", "a ", "  two  spaces ", "x ▁ y", "<|endoftext|> <s> <0x41> <unk>", "tab\tnew\nline \n end", "東 京 é à ﬁ  x", "a\x00b", "don't I'll 1234 5678",
       "\x85 next x   y", "​ ́ z", " ", "\n", "😀 👩‍🚀 ok", "a" * 5000, "é" * 3000 + " end", "word " * 900]


def rows_of(texts):
    return [cases.doc(i, t) for i, t in enumerate(texts)]


def test_against_a_plain_walk(spark, encoders):
    random.seed(7)
    letters = ["a", "the", " ", "  ", "\n", "\t", "é", "東", "▁", "'s", "1", ".", "<s>", " ", "　", "ing", "X"]
    texts = ODD + ["".join(random.choice(letters) for _ in range(random.randint(0, 12))) for _ in range(300)]
    docs = cases.documents(spark, rows_of(texts) + [cases.doc(None, "the same"), cases.doc(5, "the same"), cases.doc(5, "the same"), cases.doc(6, None), cases.doc(7, "")])
    docs = docs.union(cases.documents(spark))
    for frame in (docs, docs.repartition(5)):
        want = plain(encoders, [(r.doc_id, r.text) for r in docs.collect()])
        got = alignment.align(frame, A_PATH, B_PATH).select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256").collect()
        cases.same(got, want)
    assert alignment.align(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_given_documents(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = alignment.op13_alignment(spark, "/root/testdata/sf0.001")
    got = got.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256").collect()
    cases.same(got, plain(encoders, [(r.doc_id, r.text) for r in docs.collect()]))


def test_very_long_texts_go_in_parts(spark, encoders, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "BLOCK", 4000)
    a, b = alignment.ByteSide(A_PATH), alignment.PieceSide(B_PATH)
    long = " ".join(f"word{i % 500} é東" for i in range(4000))
    whole = alignment.Block(a, b, alignment.spaced(pa.array([long])))
    columns, pairs, times = alignment._digested(whole)
    for text, ok in ((long, True), (long + " ▁", False), ("東" * 9000, True)):
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["short", text, None])], names=["doc_id", "text"])
        found = [(r, [x] if isinstance(x, alignment.Block) else list(x)) for r, x in alignment._blocks(batch, a, b)]
        parts = next(x for r, x in found if list(r) == [1])
        if text == long:
            assert len(parts) > 5
            got, got_pairs, got_times = alignment._digested_parts(iter(parts))
            assert {k: list(v) for k, v in got.items() if k in alignment.COUNTS} == {k: list(columns[k]) for k in alignment.COUNTS}
            assert got["groups_sha256"] == columns["groups_sha256"] and list(got_pairs) == list(pairs) and list(got_times) == list(times)
        elif not ok:
            assert parts == []
        else:
            assert [x.good.tolist() for x in parts] == [[True]]
    assert alignment._digested_parts(iter([]))[0]["groups_sha256"] == [""]


def test_links_and_cuts(spark, encoders):
    docs = cases.documents(spark, rows_of(ODD))
    for r in alignment.alignments(docs, A_PATH, B_PATH).collect():
        a, b = tokens(encoders, ODD[r.doc_id])
        assert r.a_ids == [x[0] for x in a] and r.b_ids == [x[0] for x in b]
        if len(a) < 1000:
            assert list(zip(r.a_index, r.b_index)) == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        assert r.cuts == sorted({x[2] for x in a} & {x[2] for x in b})
