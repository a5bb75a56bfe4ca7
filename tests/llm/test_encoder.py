"""What a worker keeps of words between tasks, and what it makes of the pieces."""

from collections import Counter, defaultdict

import corpus_pipeline
from specimen_spark.llm import packing


def test_tasks_of_a_worker_share_an_encoder():
    path = packing.tokenizer_path()
    first = packing.encoder_of(path)
    text = "Some words, some WORDS\nand  néw ones <|end|> 1234"
    ids = first.encode(text)
    assert packing.encoder_of(path) is first and first.encode(text) == ids == packing.WordEncoder(path).encode(text)
    assert ids == b"".join(i.to_bytes(4, "little") for i in first.whole.encode(text, add_special_tokens=False).ids)


def test_an_idle_worker_holds_few_words(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 3)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    ids = encoder.encode("a b c d e f")
    encoder.trim()
    assert list(encoder.words) == ["a", "b", "c"] and not encoder.units
    assert encoder.encode("a b c d e f") == ids


def test_sequences_of_one_length_are_packed_into_batches(spark):
    """A bucket's sequences fill batches of as many tokens as the longest has; one in a partition may stay part-filled."""
    texts = [" ".join(f"word{i}" for i in range(n)) for n in (0, 1, 3, 7, 50, 900, 3000) for _ in range(9)]
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    rows = corpus_pipeline.packing(spark, docs, "").collect()
    batches = defaultdict(list)
    for r in rows:
        batches[r.batch].append(r)
    part = Counter()
    for batch, held in batches.items():
        assert len({r.length for r in held}) == 1 and sorted(r.slot for r in held) == list(range(len(held)))
        assert [r.slot for r in sorted(held, key=lambda r: r.sequence_id)] == list(range(len(held)))
        tokens = sum(len(r.ids) for r in held)
        assert tokens <= packing.SEQUENCE
        part[batch >> 33, held[0].length] += tokens < packing.SEQUENCE
    assert max(part.values()) == 1 and len(batches) < len(rows) / 4
    assert len({r.sequence_id for r in rows}) == len(rows)
