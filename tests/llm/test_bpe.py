import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import bpe

PATH = f"{bpe.FOLDER}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")

TEXTS = [
    "", " ", "\n", "  \n\t x", "don't we'll I'd've", "<|endoftext|>", "a" * 3000, "=-" * 800, "x\r\n\r\n  y\r", " 　\x85z\x1c\x1fw", "日本語テキスト😀😀 é​x",
    "\x00\x01" + "".join(map(chr, range(0x80, 0x250))), "def f(x):\n    return x**2  # sq\n", "0123456789" * 60, " " * 700 + "q",
]


def hf():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids(texts, e=None):
    return [np.frombuffer(b, np.int32).tolist() for part in (e or bpe.Encoder(PATH)).encode(texts) for b in part]


def test_same_as_tokenizers():
    rng = random.Random(6)
    alphabet = "ab AB12.,'\n\tséß日é\U0001f600​_-"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    assert ids(texts) == [x.ids for x in hf().encode_batch(texts, add_special_tokens=False)]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize(("n", "size"), [(2000, 300), (1200, 500), (20, 20_000)])
def test_many_long_words(n, size):
    """Within the 512 MB that a query may take, whatever the length."""
    rng = random.Random(size)
    words = ["".join(rng.choices(LETTERS, k=size)) for _ in range(n)]
    assert ids(words) == [x.ids for x in hf().encode_batch(words, add_special_tokens=False)]


def test_seams():
    """Words of several parts whose tokens lie over the seams, runs of one letter and of a few."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(60, 3000))) for _ in range(30)] + ["aaab" * 400, "a" * 20_001, "ab" * 999, " " * 1999 + "q", "=" * 4097, "日本語" * 500]
    words += ["x" * n for n in range(bpe.PART - 2, 3 * bpe.PART)]
    assert ids(words) == [x.ids for x in hf().encode_batch(words, add_special_tokens=False)]


def test_merges_out_of_order(tmp_path):
    """Merges of a token that rank before the one that makes it."""
    merges = [("abc", "a"), ("b", "c"), ("a", "bc"), ("abca", "bca"), ("bc", "a"), ("d", "d"), ("dd", "d")]
    tokens = [*bpe.byte_characters(), *dict.fromkeys(a + b for a, b in merges)]
    path = tmp_path / "small.json"
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": pre, "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [f"{a} {b}" for a, b in merges]}}))
    words = ["abc" * n + "d" * m for n in range(1, 40) for m in range(4)] + ["d" * 99]
    want = pytest.importorskip("tokenizers").Tokenizer.from_file(str(path)).encode_batch(words, add_special_tokens=False)
    assert ids(words, bpe.Encoder(str(path))) == [x.ids for x in want]


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TEXT_CHARS", 50)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 40)
    texts = [f"word{i} and some more words {i}" for i in range(60)]
    e = bpe.Encoder(PATH)
    assert ids(texts, e) == [x.ids for x in hf().encode_batch(texts, add_special_tokens=False)]
    assert e.of_byte.shape == (256,) and len(set(e.of_byte.tolist())) == 256 and len(e.words) < 20


def test_vocabulary_words_are_one_token():
    e = bpe.Encoder(PATH)
    e.contract(["the", " the", " return", "\n\n"])
    assert all(len(e.words[w]) == 4 for w in ("the", " the", " return", "\n\n"))


def test_encoded(spark):
    data = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(100, None, 5), (None, "x", 5), (3, "same id", 5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids int").repartition(3)
    out = bpe.encoded(df, F.col("doc_id"), F.col("text")).collect()
    assert len(out) == len(data)
    by = {r["doc_id"]: r["ids"] for r in out if r["doc_id"] not in (3, None)}
    want = hf().encode_batch(TEXTS, add_special_tokens=False)
    assert all(by[i] == w.ids for i, w in enumerate(want) if i != 3) and by[100] == [] and by[0] == []
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.encoded(df, F.col("doc_id"), F.col("text"), lengths_only=True).collect() if r["doc_id"] not in (3, None)}
    assert n == {i: len(x) for i, x in by.items()}
    assert bpe.encoded(df.where("false"), F.col("doc_id"), F.col("text")).count() == 0
    again = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(df, F.col("doc_id"), F.col("text")), F.col("doc_id"), F.col("ids")).collect() if r["doc_id"] not in (3, None)}
    assert again == {i: t or "" for i, t, _ in data if i not in (3, None)}
