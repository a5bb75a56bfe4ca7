"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers cut the same bytes, a space and the text, into tokens A and B. Walking both lists side by
side gives a link for each A and B token that share bytes, and a cut wherever both end. A block of
documents is walked at once: one numpy state vector holds each document's A and B pointers; a step
emits every document's link and cut, moves the pointer whose token ends first (both at a cut), and
finished documents leave the vector. Long documents enter in parts, cut at spaces where both
tokenizers end a token, so a block takes few steps.

Both tokenizers end a token before a single space between other characters, so each different
word of a block is tokenized once. Counts of linked id pairs are summed per block before they are shuffled
and joined; a document carries its pairs as places in its block's list.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import batches_of, prepared, staged, table
from specimen_spark.llm.packing import _byte_units
from specimen_spark.llm.words import _SPACE, text_bytes

#: Bytes of text that a task tokenizes and walks at once; a longer text goes in parts of this size.
BLOCK = 2 << 20
#: Bytes of a document's part in the state vector.
LANE = 2048
#: How a byte-level file splits text before merging: a fixed value of that format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Side:
    """Token ids of words, and each id's bytes."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.begins[ids], self.lengths[ids])]


class ByteSide(_Side):
    """A ``tokenizers`` file of the byte-level kind, run by ``tiktoken``, which reads ids as merge ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = spec["normalizer"] is None and model["type"] == "BPE" and not model.get("ignore_merges")
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        special = {t["content"] for t in spec["added_tokens"]}
        to_byte = {ord(chr(b)): b for b in range(256)} | {unit: b for b, unit in _byte_units().items()}
        entries = {i: bytes(to_byte[ord(c)] for c in token) for token, i in model["vocab"].items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = [model["vocab"][a + b] for a, b in merges]
        if ranks != sorted(ranks):
            raise ValueError(f"{path} does not number its tokens in order of merging")
        self.encoding = tiktoken.Encoding(
            "own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={e: i for i, e in entries.items()}, special_tokens={})
        super().__init__([entries.get(i, b"") for i in range(max(entries) + 1)])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, bounds of each word's ids); words begin with a space.

        Words that neither hold white space at their end nor after the first space are encoded as
        one text, the others apart.
        """
        odd = np.array([not w[1:2].strip() or not w[-1:].strip() for w in words], bool)
        ids = np.asarray(self.encoding.encode_to_numpy("".join(itertools.compress(words, ~odd)), disallowed_special=()), np.int64)
        ends = np.cumsum([len(w.encode()) for w in itertools.compress(words, ~odd)], dtype=np.int64)
        bounds = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right")
        counts = np.empty(len(words), np.int64)
        counts[~odd] = np.diff(bounds, prepend=0)
        apart = [self.encoding.encode_ordinary(w) for w in itertools.compress(words, odd)]
        counts[odd] = [len(a) for a in apart]
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(at[-1], np.int64)
        own = np.repeat(odd, counts)
        out[~own] = ids
        out[own] = list(itertools.chain.from_iterable(apart))
        return out, at


class PieceSide(_Side):
    """A ``sentencepiece`` model that writes a space as U+2581 and puts one before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError(f"{path} has pieces that cross spaces")
        super().__init__([
            bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([w[1:] for w in words], num_threads=1) if words else []
        at = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, at[-1]), at


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for lengths[0] values, then those of begins[1] and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def lockstep(a_ends, b_ends, a0, a1, b0, b1):
    """Links (places in A, places in B) and whether both tokens end there, part by part in order.

    Part i holds the tokens a0[i]:a1[i] and b0[i]:b1[i], whose byte ends begin and end alike.
    """
    room = (a1 - a0) + (b1 - b0)  # more than a part's links
    out = np.cumsum(room) - room
    link_a = np.full(room.sum(), -1, np.int64)
    link_b, cut = np.empty(len(link_a), np.int64), np.zeros(len(link_a), bool)
    active = a1 > a0
    at_a, at_b, stop, out = a0[active], b0[active], a1[active], out[active]
    while len(at_a):
        end_a, end_b = a_ends[at_a], b_ends[at_b]
        link_a[out], link_b[out] = at_a, at_b
        cut[out] = end_a == end_b
        at_a = at_a + (end_a <= end_b)
        at_b = at_b + (end_b <= end_a)
        out = out + 1
        active = at_a < stop
        if not active.all():
            at_a, at_b, stop, out = at_a[active], at_b[active], stop[active], out[active]
    used = link_a >= 0
    return link_a[used], link_b[used], cut[used]


class Block:
    """The alignment of a list of texts, each given with the space before it.

    For text i: ``a[i]:a[i + 1]`` are its tokens in ``a_ids``, likewise ``b``, and ``links[i]:links[i + 1]``
    its links. Texts that are only the space, or whose tokens don't spell them, have none.
    """

    def __init__(self, side_a: _Side, side_b: _Side, spaced: pa.Array):
        data, offsets = text_bytes(spaced)
        n = len(offsets) - 1
        begins = np.flatnonzero(cut_places(data, offsets))
        word_text = np.searchsorted(offsets, begins, "right") - 1
        ends = np.append(begins[1:], len(data))
        buffers = [None, pa.py_buffer(np.append(begins, len(data)).astype("<i8").tobytes()), pa.py_buffer(data.tobytes())]
        coded = pa.Array.from_buffers(pa.large_string(), len(begins), buffers).dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        ids_a, at_a = side_a.encode(words)
        ids_b, at_b = side_b.encode(words)
        spelled = spells(side_a, ids_a, at_a, words) & spells(side_b, ids_b, at_b, words)
        self.good = np.bincount(word_text[~spelled[place]], minlength=n) == 0 if len(begins) else np.zeros(n, bool)
        self.good &= np.diff(offsets) > 1
        keep = self.good[word_text]
        place, word_text, begins, ends = place[keep], word_text[keep], begins[keep], ends[keep]
        count_a, count_b = np.diff(at_a)[place], np.diff(at_b)[place]
        self.a_ids = ids_a[ranges(at_a[place], count_a)]
        self.b_ids = ids_b[ranges(at_b[place], count_b)]
        self.a_ends, self.b_ends = np.cumsum(side_a.lengths[self.a_ids]), np.cumsum(side_b.lengths[self.b_ids])
        # Parts of documents: a new one with each document, and with each LANE bytes of it.
        lane = (begins - offsets[word_text]) // LANE
        first = np.ones(len(begins), bool)
        first[1:] = (np.diff(word_text) != 0) | (np.diff(lane) != 0)
        parts = np.append(np.flatnonzero(first), len(begins))
        to_a, to_b = np.concatenate([[0], np.cumsum(count_a)]), np.concatenate([[0], np.cumsum(count_b)])
        self.link_a, self.link_b, self.cut = lockstep(
            self.a_ends, self.b_ends, to_a[parts[:-1]], to_a[parts[1:]], to_b[parts[:-1]], to_b[parts[1:]])
        by_text = np.searchsorted(word_text, np.arange(n + 1))
        self.a, self.b = to_a[by_text], to_b[by_text]
        self.links = np.searchsorted(self.link_a, self.a)
        self.groups = np.concatenate([[0], np.cumsum(self.cut)])[self.links]
        self.pairs = self.a_ids[self.link_a] * side_b.size + self.b_ids[self.link_b]

    def group_texts(self) -> list[memoryview]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        group = np.cumsum(self.cut) - self.cut
        n = int(self.cut.sum())
        a_group = group[np.searchsorted(self.link_a, np.arange(len(self.a_ids)))]
        b_group = group[np.searchsorted(self.link_b, np.arange(len(self.b_ids)))]
        a_of, b_of = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
        ids = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        ids[np.arange(len(self.a_ids)) + np.concatenate([[0], b_of])[a_group]] = self.a_ids
        ids[np.arange(len(self.b_ids)) + a_of[b_group]] = self.b_ids
        mark[a_of + np.concatenate([[0], b_of])[:n] - 1] = ord("|")
        mark[a_of + b_of - 1] = ord(";")
        written, at = decimals(ids, mark)
        at = at[self.a + self.b]
        view = memoryview(written)
        return [view[i : max(i, j - 1)] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: with each text, and at single spaces between other characters of which one is ASCII."""
    out = np.zeros(len(data), bool)
    if len(data) > 2:
        other, plain = ~_SPACE[data], data < 128
        out[1:-1] = (data[1:-1] == 32) & other[:-2] & other[2:] & (plain[:-2] | plain[2:])
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    out[begins[begins > 0] - 1] = False  # the last byte of a text
    out[begins] = True
    return out


def spells(side: _Side, ids: np.ndarray, at: np.ndarray, words: list[str]) -> np.ndarray:
    """Of each word, whether its tokens' bytes are the word's."""
    own = [w.encode() for w in words]
    lengths = np.array([len(w) for w in own], np.int64)
    sums = np.concatenate([[0], np.cumsum(side.lengths[ids])])
    out = np.diff(sums[at]) == lengths
    if not out.all():
        keep = np.repeat(out, np.diff(at))
        ids, own, lengths = ids[keep], list(itertools.compress(own, out)), lengths[out]
    differ = side.joined(ids) != np.frombuffer(b"".join(own), np.uint8)
    wrong = np.bincount(np.repeat(np.arange(len(own)), lengths)[differ], minlength=len(own)) > 0
    out[np.flatnonzero(out)[wrong]] = False
    return out


_DIGITS = {}


def decimals(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids in decimal, each with its mark behind it, and where each begins."""
    most = int(ids.max(initial=0)) + 1
    if _DIGITS.get("n", 0) < most:
        texts = [str(i).encode() for i in range(most)]
        width = len(texts[-1]) + 1
        _DIGITS.update(n=most, length=np.array([len(t) for t in texts]), digits=np.frombuffer(
            b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(most, width))
    rows, length = _DIGITS["digits"][ids], _DIGITS["length"][ids]
    rows[np.arange(len(ids)), length] = marks
    return rows[rows != 0].tobytes(), np.concatenate([[0], np.cumsum(length + 1)])


def parts_of(text: bytes) -> list[bytes]:
    """A text of over BLOCK bytes in parts of about that size, cut where words begin."""
    out, at = [], 0
    while len(text) - at > BLOCK:
        cut, look = None, at + BLOCK
        while cut is None and look < len(text) - 2:
            near = np.frombuffer(text[look - 1 : look + (1 << 16) + 1], np.uint8)
            found = np.flatnonzero(cut_places(near, np.array([0, len(near)]))[1:])
            cut = look + int(found[0]) if len(found) else None
            look += 1 << 16
        if cut is None:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def spaced(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()))


def _blocks(batch: pa.RecordBatch, side_a: _Side, side_b: _Side):
    """(row numbers, Block) over a batch; a very long text is a list of Blocks, empty if its tokens don't spell it."""
    for lo, hi in batches_of(batch, batch.schema.names[1], BLOCK):
        texts = spaced(batch.column(1).slice(lo, hi - lo))
        if hi - lo == 1 and len(parts := parts_of(texts[0].as_buffer().to_pybytes())) > 1:
            each = (pa.array([p.decode()], pa.large_string()) for p in parts)
            fits = all(Block(side_a, side_b, p).good[0] for p in each)
            yield range(lo, hi), (Block(side_a, side_b, pa.array([p.decode()], pa.large_string())) for p in parts if fits)
        else:
            yield range(lo, hi), Block(side_a, side_b, texts)


def _small(values: np.ndarray) -> bytes:
    """Unsigned numbers in the least width that holds them, which the first byte tells."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(values.max(initial=0)) <= np.iinfo(k).max)
    return kind[-1:].encode() + values.astype(kind).tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_STAGED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, place int, pair long, n long"
_ROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()),
                  ("places", pa.binary()), ("times", pa.binary()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)


def _digested(block: Block) -> tuple[dict, np.ndarray, np.ndarray]:
    """A block's document columns, and its pairs with their counts."""
    pairs, place, times = np.unique(block.pairs, return_inverse=True, return_counts=True)
    links = np.diff(block.links)
    doc = np.repeat(np.arange(len(links)), links)
    own, own_times = np.unique(doc * max(1, len(pairs)) + place, return_counts=True)
    at = np.searchsorted(own, np.arange(len(links) + 1) * max(1, len(pairs)))
    own = own % max(1, len(pairs))
    columns = {
        "n_a": np.diff(block.a), "n_b": np.diff(block.b), "n_groups": np.diff(block.groups), "n_links": links,
        "groups_sha256": [hashlib.sha256(t).hexdigest() if len(t) else "" for t in block.group_texts()],
        "places": [_small(np.diff(own[i:j], prepend=0)) for i, j in zip(at[:-1], at[1:])],
        "times": [_small(own_times[i:j]) for i, j in zip(at[:-1], at[1:])],
    }
    return columns, pairs, times


def _digested_parts(blocks) -> tuple[dict, np.ndarray, np.ndarray]:
    """The same of one document, block by block."""
    sums, digest = dict.fromkeys(COUNTS, 0), hashlib.sha256()
    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in blocks:
        for name, bounds in zip(COUNTS, (block.a, block.b, block.groups, block.links)):
            sums[name] += int(bounds[-1] - bounds[0])
        if pairs.size:
            digest.update(b";")
        digest.update(block.group_texts()[0])
        found, n = np.unique(block.pairs, return_counts=True)
        pairs, place = np.unique(np.concatenate([pairs, found]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([times, n])).astype(np.int64)
    columns = {k: [v] for k, v in sums.items()} | {
        "groups_sha256": [digest.hexdigest() if pairs.size else ""],
        "places": [_small(np.diff(np.arange(len(pairs)), prepend=0))], "times": [_small(times)]}
    return columns, pairs, times


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair's count is the number of links that hold it, over all documents. ``n_best`` counts a
    document's links whose count is the highest of their B id, ties included; ``count_sum`` adds its links'
    counts. Null and empty texts, and those that either tokenizer doesn't spell, have zeros
    and an empty digest. Null ids and repeated rows are rows like others and their links count. An
    empty table gives no rows. Other columns are not read.
    """
    prepared(docs.sparkSession)

    def tokenized(batches):
        side_a, side_b = ByteSide(a_path), PieceSide(b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            for rows, block in _blocks(batch, side_a, side_b):
                columns, pairs, times = _digested(block) if isinstance(block, Block) else _digested_parts(block)
                yield _rows(columns | {"block": np.full(len(rows), number), "doc_id": ids.slice(rows[0], len(rows))})
                if len(pairs):
                    yield _rows({"block": np.full(len(pairs), number), "place": np.arange(len(pairs)), "pair": pairs, "n": times})
                number += 1

    rows = staged(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tokenized, _STAGED), "alignment")
    pairs = rows.filter(F.col("pair").isNotNull()).select("block", "place", "pair", "n")
    documents = rows.filter(F.col("pair").isNull()).drop("place", "pair", "n")
    counts = staged(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-pairs")
    side_b = F.col("pair") % F.lit(PieceSide(b_path).size)
    best = counts.groupBy(side_b.alias("b")).agg(F.max("count").alias("most"))
    known = counts.join(best, side_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    looked = pairs.join(known, "pair").select(F.col("block").alias("of"), "place", "count", "best")

    def summed(mine, theirs):
        place = theirs.column("place").to_numpy()
        count, is_best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], is_best[place] = theirs.column("count").to_numpy(), theirs.column("best").to_numpy()
        n_best, sums = [], []
        for places, times in zip(mine.column("places").to_pylist(), mine.column("times").to_pylist()):
            at, n = np.cumsum(_large(places)), _large(times)
            n_best.append(int(n[is_best[at]].sum()))
            sums.append(int((count[at] * n).sum()))
        kept = mine.select(["doc_id", *COUNTS])
        return pa.Table.from_arrays(
            [*kept.columns, pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), mine.column("groups_sha256")],
            names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    return documents.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(
        summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links themselves, a row per document, very long ones in several: doc_id, part, a_ids, b_ids, a_index, b_index, cuts.

    ``a_index`` and ``b_index`` are each link's tokens, numbered in the row; ``cuts`` are byte places of
    a space and the row's text where both tokenizers end a token. Rows without tokens have empty lists.
    """
    prepared(docs.sparkSession)
    lists = ("a_ids", "b_ids", "a_index", "b_index", "cuts")

    def run(batches):
        side_a, side_b = ByteSide(a_path), PieceSide(b_path)
        for batch in batches:
            for rows, found in _blocks(batch, side_a, side_b):
                blocks = [found] if isinstance(found, Block) else found
                for part, block in enumerate(blocks):
                    base = np.concatenate([[0], block.a_ends])[block.a]
                    cells = {c: [] for c in lists}
                    for i in range(len(block.good)):
                        links = slice(block.links[i], block.links[i + 1])
                        cells["a_ids"].append(block.a_ids[block.a[i] : block.a[i + 1]])
                        cells["b_ids"].append(block.b_ids[block.b[i] : block.b[i + 1]])
                        cells["a_index"].append(block.link_a[links] - block.a[i])
                        cells["b_index"].append(block.link_b[links] - block.b[i])
                        cells["cuts"].append(block.a_ends[block.link_a[links][block.cut[links]]] - base[i])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(rows[0], len(rows)), pa.array([part] * len(rows), pa.int32()),
                         *(pa.array(cells[c], pa.list_(pa.int64())) for c in lists)], names=["doc_id", "part", *lists])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, part int, " + ", ".join(f"{c} array<long>" for c in lists))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return align(table(spark, sf_dir, "documents"), *tokenizer_paths())
