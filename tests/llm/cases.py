"""Inputs that operators must survive, and plain versions of what they compute."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

# Columns beside those the operators read; their names clash with names used inside.
DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, mark long, row string, "
    "d int, t int, lid long, w string, key string, gone string, lost string, places string, trusted long"
)
SENTENCE = "the quick brown fox jumps over the lazy dog while seven quiet owls watch from a tall old pine tree tonight"
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def doc(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None if text is None else len(text), 1, "x", 2, 3, 4, "w", "k", "g", "l", "p", 5)


def documents(spark, rows=None):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, copies and near copies."""
    long = " ".join(f"word{i % 5000}x{i % 7}" for i in range(60_000))
    near = SENTENCE.replace("seven", "eight")
    lines = "\n".join([SENTENCE, near, "short line", SENTENCE + " again", ""])
    texts = [
        doc(5, SENTENCE), doc(3, SENTENCE), doc(9, near), doc(1, None), doc(2, ""), doc(4, " \t\n "),
        doc(None, SENTENCE), doc(None, None), doc(6, "one two"), doc(7, "one two"), doc(8, long), doc(10, long + " end"),
        doc(11, PASSAGE + " " + SENTENCE), doc(12, "start " + PASSAGE + " tail " + PASSAGE), doc(13, lines), doc(13, lines),
        doc(14, "ÀÉ Straße naïve façade 東京 " + PASSAGE, None), doc(15, "a b c d e f g h i j"), doc(15, "k l m n o p q r s t"),
    ]
    return spark.createDataFrame(texts if rows is None else rows, DOC_SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(docs, items, n=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def substrings(docs, length=20):
    """(doc_id, n_words, n_removed, kept_sha256); documents by (doc_id, text), null ids last."""
    rows = [(i, (t or ""), (t or "").encode().split()) for i, t in docs]
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t, w in rows:
        for p in range(len(w) - length + 1):
            k, at = tuple(w[p : p + length]), (order(i), p)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t, w in rows:
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] != (order(i), p):
                gone |= set(range(p, p + length))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked(docs):
    """(doc_id, n_shingles, component_id)."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)]


def one_word_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def line_dedup(docs, min_words=8):
    """(doc_id, n_lines, n_removed, kept text); repeated rows are one."""
    first = {}
    place = lambda i, t, at: ((i is None, i or 0), t, at)
    lines = defaultdict(list)
    for i, t in docs:
        for at, line in enumerate([] if t is None else t.split("\n")):
            w = tuple(x for x in line.lower().split(" ") if x)
            lines[i, t].append((line, w, at))
            if w:
                p = place(i, t, at)
                first[w] = min(first.get(w, p), p)
    long = [w for w in first if len(w) >= min_words]
    gone = {w for w in long if any(first[v] < first[w] and one_word_apart(w, v) for v in long)}
    out = []
    for i, t in docs:
        found = lines.get((i, t), []) if t is not None else []
        found = found[: len(t.split("\n"))] if t is not None else []
        kept = [x for x, w, at in found if not w or (first[w] == place(i, t, at) and w not in gone)]
        out.append((i, len(found), len(found) - len(kept), None if t is None else "\n".join(kept)))
    return out


def same(rows, expected):
    assert Counter(map(tuple, rows)) == Counter(expected)
