"""What the pipeline's stages leave behind on executors."""

import public_tokenizers

from attestra.llm import neardup, packing, quality


def test_workers_hold_one_operators_words():
    """A Python worker goes from stage to stage: what it remembers for one goes when it works for the next."""
    quality.features("some words of a text", 20)
    before = neardup.shingles("other words of a text", 2).tolist()
    assert neardup._words and not quality._bucket
    encoder = packing._encoder(public_tokenizers.path(packing.TOKENIZER))
    encoder.batch(["words of a text"])
    assert not neardup._words and packing._encoder(public_tokenizers.path(packing.TOKENIZER)) is encoder
    assert neardup.shingles("other words of a text", 2).tolist() == before and not packing._encoders


def test_words_are_bounded(monkeypatch):
    monkeypatch.setattr(neardup, "WORDS", 50)
    monkeypatch.setattr(quality, "WORDS", 50)
    monkeypatch.setattr(packing, "WORDS", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(40)]
    told = [packing.Encoder(public_tokenizers.path(packing.TOKENIZER)).batch([t])[0] for t in texts[-3:]]
    encoder = packing._encoder(public_tokenizers.path(packing.TOKENIZER))
    assert [encoder.batch([t])[0] for t in texts][-3:] == told
    assert len(encoder.words) <= 60
    for t in texts:
        quality.features(t, len(t))
    assert len(quality._bucket) <= 61
    for t in texts:
        neardup.shingles(t, 5)
    assert len(neardup._words) <= 61


def test_small_tables_lie_in_few_files(spark):
    """Tables of labels are narrow: one file for each of many partitions only starts processes on the executors."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chains = [(1000 * k + i, 1000 * k + i + 1) for k in range(60) for i in range(7)]
        labels = neardup.components(spark.createDataFrame(chains, "a long, b long"))
        assert len(labels.inputFiles()) <= 24
        assert sorted(map(tuple, labels.select("node", "comp").collect())) == [(1000 * k + i, 1000 * k) for k in range(60) for i in range(8)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
