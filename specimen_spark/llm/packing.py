"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two: as many whole sequences
as fit, then the binary digits of the rest, longest first. Every piece is a sequence of its own, so no
sequence crosses documents and none is padded. Sequences of one length form a bucket, and each bucket is
packed into batches of as many tokens as the longest sequence has: ``batch`` holds ``longest / length`` sequences, in
``slot`` 0 on. Each task fills batches of its own, so nothing is shuffled, and leaves at most one of each bucket part-filled.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import prepared, table

END_ID = 2
SEQUENCE = 4096
#: Entries a worker's word cache may hold before it begins anew; bounds its memory.
CACHE_ENTRIES = 600_000
#: Words that stay known to a worker's later tasks: those met first, among them the frequent ones.
KEPT = 50_000


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file, encoding each different word once.

    For files that split at white space and never merge across it (`word_bpe_49k.json`): the ids of
    a text are those of its space-separated chunks in order. Chunks without special-token marks
    go through the file's own normalizer, split pattern and BPE model; others through its encoder.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.normalize = self.whole.normalizer.normalize_str
        self.model = self.whole.model
        self.to_units = _byte_units()
        self.words = _Made(self._word)
        self.units: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            mapped = unit.encode().decode("latin-1").translate(self.to_units)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
            self.units[unit] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if "<|" in word:
            ids = self.whole.encode(word, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        low = word.lower() if word.isascii() else self.normalize(word)
        return b"".join([self._unit(p) for p in self.pieces(low)])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self.words) > CACHE_ENTRIES:
            self.trim()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def trim(self) -> None:
        """Forget all words but the first ``KEPT``, so that an idle worker holds little."""
        kept = list(itertools.islice(self.words.items(), KEPT))
        self.words.clear()
        self.words.update(kept)
        self.units.clear()


class _Made(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder: its tasks share the file read and the words known."""
    return WordEncoder(path)


def _byte_units() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stand for
    themselves, the others are numbered from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + i for i, b in enumerate(rest)}


def cuts(total: int, longest: int):
    """(start, length) of each piece of ``total`` tokens."""
    at = 0
    while total - at >= longest:
        yield at, longest
        at += longest
    while at < total:
        length = 1 << ((total - at).bit_length() - 1)
        yield at, length
        at += length


class Batches:
    """Where sequences go: per length the batch that is being filled, numbered from the partition's first."""

    def __init__(self, longest: int, partition: int):
        self.longest, self.next, self.open = longest, partition << 33, {}

    def place(self, length: int) -> tuple[int, int]:
        """(batch, slot) of the next sequence of this length."""
        batch, slot = self.open.get(length, (0, 0))
        if not slot:
            batch = self.next
            self.next += 1
        self.open[length] = batch, (slot + 1) % (self.longest // length)
        return batch, slot


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, "
    "batch long, slot int, ids array<int>"
)


def pack(
    docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, batch, slot, ids.

    ``longest`` must be a power of two. ``length`` is also the bucket. Null and empty texts are
    one end token. Rows with a null or repeated id are packed like any other; ``sequence_id`` tells
    pieces apart. An empty table gives no rows. Sequence ids and batches come from the input partition and
    the place in it: unique, not dense. Sequences with equal ``batch`` have one length and ``longest`` tokens
    together, fewer only in the last batch of a length in a partition.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    prepared(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder, filling = encoder_of(tokenizer), Batches(longest, TaskContext.get().partitionId())
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for at in range(0, len(ids), 512):
                    out = {k: [] for k in ("doc", "start", "length", "crc", "tokens", "batch", "slot", "ids")}
                    for doc, text in zip(ids[at : at + 512], texts.slice(at, 512).to_pylist()):
                        data = (encoder.encode(text) if text else b"") + end
                        total = len(data) // 4
                        for start, length in cuts(total, longest):
                            piece = data[start * 4 : (start + length) * 4]
                            out["doc"].append(doc)
                            out["start"].append(start)
                            out["length"].append(length)
                            out["crc"].append(zlib.crc32(piece))
                            out["tokens"].append(total)
                            batch_id, slot = filling.place(length)
                            out["batch"].append(batch_id)
                            out["slot"].append(slot)
                            out["ids"].append(piece)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array(out[k], pa.int64()) for k in ("doc", "start", "length", "crc", "tokens")],
                            pa.array([0] * len(out["doc"]), pa.int64()),
                            pa.array(out["batch"], pa.int64()),
                            pa.array(out["slot"], pa.int32()),
                            _int_lists(out["ids"]) if with_ids else pa.nulls(len(out["doc"]), pa.list_(pa.int32())),
                        ],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "batch", "slot", "ids"],
                    )
        finally:
            encoder.trim()

    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
    out = pieces.withColumn("sequence_id", F.monotonically_increasing_id())
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "batch", "slot"]
    return out.select(*columns, "ids") if with_ids else out.select(*columns)


def _int_lists(pieces: list[bytes]) -> pa.ListArray:
    lengths, at = [0], 0
    for p in pieces:
        at += len(p) // 4
        lengths.append(at)
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(pieces))])
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the digest columns of each piece."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
