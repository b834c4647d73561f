import random

import pytest

from lodestone.llm import tokens as T


def texts(seed=1):
    rng = random.Random(seed)
    bits = ["the", "Ünï", " ", "  ", "\n", "\t", "a", "zz", "▁", "ﬁ", "1234", "</s>", "<s>", "<0x0A>", "日本", "!!", "x" * 40]
    out = ["".join(rng.choice(bits) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    return [*out, "", None, " ", "a", "x" * 5000, " " * 300, "a b " * 2000, "  ".join(["ab"] * 900)]


@pytest.mark.parametrize("piece", [64, 1000])
def test_counts_equal_whole_texts(spark, monkeypatch, piece):
    import sentencepiece

    monkeypatch.setattr(T, "PIECE_BYTES", piece)
    model = sentencepiece.SentencePieceProcessor(model_file=T.tokenizer_path("piece_bpe_32k.model"))
    counter = T.PieceCounter(T.tokenizer_path("piece_bpe_32k.model"))
    assert counter.cuts
    for t in texts():
        if t:
            parts = counter.pieces(t)
            assert len(parts) == 1 or max(map(len, parts)) < len(t)
            assert sum(counter.count(parts)) == len(model.encode(t)), repr(t[:60])


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_operator(spark, name):
    rows = [(i, t) for i, t in enumerate(texts(2))] + [(3, "again"), (None, "no id")]
    d = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, n_tokens double")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in T.token_counts(spark, d, name).collect()), key=str)
    c = T.counter(T.tokenizer_path(name))
    assert got == sorted([(i, len((t or "").encode()), c.count([t])[0] if t else 0) for i, t in rows], key=str)
    assert T.token_counts(spark, d.limit(0), name).count() == 0
