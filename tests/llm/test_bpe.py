import random
from pathlib import Path

import pytest

from tracemill.llm import bpe

FILE = Path(bpe.TOKENIZER_DIR, "byte_bpe_50k.json")
TEXTS = [
    "", " ", "Hello world", "<|endoftext|> is text", "a" * 5000, " " * 3000 + "x", "é́​﻿ 日本語 🙂🙂 \r\n\t mixed\n\n\nends  ", "don't we'll I'M it's", "x_y(z) == 0xDEADBEEF;" * 50, "\x00\x01\x7f", "ﬀ İ ß ſ", "1234567890" * 100, "abababababab" * 400, "ооо" * 900,
]


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(FILE))
    t.encode_special_tokens = True
    return bpe.encoder(FILE.read_bytes()), t


def test_same_as_library(pair):
    enc, lib = pair
    r = random.Random(1)
    alphabet = list("abcdefgh ABC  \n\t.,'0123_/é日🙂 -") + [" the", "ing", "tion"]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(500)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(text) == want.ids, text[:40]
        assert enc.count(text) == len(want.ids)


def test_every_token_is_itself(pair):
    enc, _ = pair
    assert all(enc.encode_bytes(s) == [r] for s, r in enc.rank.items())


def test_frame(spark, pair):
    _, lib = pair
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string, n_tokens array<int>")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).collect()}
    want = [*(e.ids for e in lib.encode_batch(TEXTS, add_special_tokens=False)), []]
    assert got == dict(enumerate(want))
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, ["doc_id"]).collect()}
    assert counts == {i: len(w) for i, w in enumerate(want)}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
