import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import sentencepiece_bpe as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return S.model_bytes(PATH)


def strings(n, seed):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "é", "▁", "漢", "😀", "\x00", "<s>", "the", "ing", "\t", "0", "xyz", "=====", " " * 25, "�", "ﬁ", "́"]
    for _ in range(n):
        if r.random() < 0.3:
            yield "".join(chr(r.choice([32, 32, r.randint(33, 126), r.randint(160, 0x500)])) for _ in range(r.randint(0, 40)))
        else:
            yield "".join(r.choice(parts) for _ in range(r.randint(0, 14)))


def test_like_the_library(model):
    ours, lib = S.Bpe(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for s in [*strings(3000, 1), "x" * 5000, "ab" * 3000, " " * 700, "ê" * 500]:
        ids = lib.encode(s)
        assert ours.encode(s) == ids and ours.decode(ids) == lib.decode(ids), s
    r = random.Random(2)
    for _ in range(2000):
        ids = [r.randint(0, 700) for _ in range(r.randint(0, 8))]
        assert ours.decode(ids) == lib.decode(ids), ids


def test_dataframes(spark, model):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(i, s, 1) for i, s in enumerate(strings(60, 3))] + [(100, None, 1), (101, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.token_digests(df, model).collect()}
    for i, s, _ in rows:
        ids = lib.encode(s or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    back = {r.doc_id: r.text for r in S.decode(S.encode(df, model), model).collect()}
    assert back == {i: lib.decode(lib.encode(s or "")) for i, s, _ in rows}
    assert S.token_digests(df.limit(0), model).count() == 0


def test_caches_are_compact(model):
    import tracemalloc

    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(6000)]
    bpe = S.Bpe(model, 50_000)
    tracemalloc.start()
    bpe.digest(" ".join(words))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 7_000_000, kept  # 8.3 MB with tuples and decoded texts
    # what decodes to other text than it came from, cached or not
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    for s in ["▁ a▁b", "! !", "▁", " ▁", "x!y ▁!", "▁ a▁b"]:
        ids = lib.encode(s)
        assert bpe.digest(s) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
