"""Token counts against encoding whole texts."""

import random

import pytest
from gristmill.llm.token_counts import _spliced, margin, token_counts
from gristmill.llm.tokens import default_tokenizer
from pyspark.sql import functions as F

R = random.Random(11)
PARTS = [" ", "  ", "\n\n", " \t ", "don't", "we'll", "'l", "l'", "word", "éèà", "数据处理", "😀😀", "12345", "!?...", "<|endoftext|>", "<|endof", "text|>", " ", "x" * 30, " the"]


def jumble(n):
    return "".join(R.choice(PARTS) for _ in range(n))


LONG = [jumble(400) for _ in range(12)] + ["y" * 3000, " " * 2500, "a b " * 700, "<|endoftext|>" * 200, jumble(150) + "z" * 900 + jumble(150), "数" * 1500, ("\r\n" * 9 + "q") * 90]
ROWS = list(enumerate(LONG)) + [(100, None), (101, ""), (102, " "), (103, "short"), (0, LONG[0]), (0, LONG[0]), (0, LONG[1]), (None, LONG[2]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash") for k, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, k string").repartition(4)


def whole(rows, limit=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]
    return sorted(((k, len((x or "").encode()), c, c > limit) for (k, x), c in zip(rows, n)), key=str)


@pytest.mark.parametrize("span,overlap", [(100, 40), (257, 64), (1 << 14, 512)])
def test_counts(docs, span, overlap):
    got = token_counts(docs, span=span, overlap=overlap, limit=500)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == whole(ROWS, 500)
    assert token_counts(docs.where("false")).count() == 0


def test_seams_hold_and_fail(spark):
    """Prose is spliced at once; a word that is longer than the overlap is not, and never counted wrongly."""
    path = default_tokenizer()
    d = spark.createDataFrame([(1, "some words, and more. " * 90), (2, "y" * 3000)], "doc_id long, text string")
    d = d.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"))
    got = {r["doc_id"]: r["n_tokens"] for r in _spliced(d, path, 200, 60, margin(path)).collect()}
    assert got == {1: whole([(1, "some words, and more. " * 90)])[0][2], 2: None}


def test_models(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert margin(path) is None and margin(public_tokenizers.path("word_bpe_49k.json")) is None and margin(default_tokenizer()) == 16
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    some = docs.where("doc_id >= 100")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(some, path).collect()) == sorted((k, len(sp.encode(t or ""))) for k, t in ROWS if k and k >= 100)
    word = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(word)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(some, word).collect()) == sorted((k, len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in ROWS if k and k >= 100)
