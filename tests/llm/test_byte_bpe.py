import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BPE = byte_bpe.loaded(PATH, PATTERN)
TRUTH = tiktoken.Encoding("truth", pat_str=PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def texts():
    random.seed(7)
    letters = ["a", "b", "é", "the", " ", "  ", "\n", "'s", "1", "२", "日本", "😀", "\x1c", "́", "_", "²", "ing", "<|endoftext|>", " "]
    return ["", " ", "a" * 3000, "ab" * 2000, " " * 900, "é" * 999] + ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(3000)]


def test_like_tiktoken():
    for text, ids in zip(texts(), BPE.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TRUTH.encode_ordinary(text)
        assert BPE.decode(ids) == text.encode()


def test_matrix_and_list_trees_agree():
    random.seed(8)
    for _ in range(300):
        piece = bytes(random.choices(b"etaoin hs\xc3\xa9", k=random.randint(2, 70)))
        assert BPE._encode_rows([piece] * 7, 1 << (len(piece) - 1).bit_length())[3] == BPE._encode_long(piece)


def test_unknown_id():
    with pytest.raises(ValueError):
        BPE.decode(np.array([60_000], "<u4").tobytes())


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 10)
    own = byte_bpe.ByteBPE(BPE.ranks, PATTERN)
    for text in texts()[:400]:
        assert own.encode([text, text])[1] == np.array(TRUTH.encode_ordinary(text), "<u4").tobytes()
        assert len(own.memo) <= 10


def test_table(spark):
    rows = [(1, "Hello hello", "x"), (None, None, None), (1, "Hello hello", "y"), (2, "", "z"), (3, "wörd " * 60_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = sorted(byte_bpe.encode_digest(docs, PATH, PATTERN).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = TRUTH.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    encoded = byte_bpe.encode_documents(docs, PATH, PATTERN)
    assert encoded.columns == ["doc_id", "text", "token_ids"]
    assert sorted(len(r.token_ids) for r in encoded.collect()) == sorted(w[1] for w in want)
    back = byte_bpe.decode_documents(encoded.withColumnRenamed("text", "was"), PATH, PATTERN)
    assert all(bytes(r.text).decode() == (r.was or "") for r in back.collect())
    assert byte_bpe.encode_digest(docs.limit(0), PATH, PATTERN).count() == 0


def test_rank_file_is_what_the_loader_reads():
    with open(PATH, "rb") as lines:
        assert {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)} == BPE.ranks
