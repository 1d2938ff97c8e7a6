import random

import pytest

from lodestone.llm.token_counts import Counter, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
POOLS = [" ab\n", " aA1.,'\t", "the cat's don't we'll I'M 12 ", " éüßñçĀƒɏ", "日本語 тест العربية हिन्दी ", " \x00\x1f\x7f\x85\xa0 　​", "🙂👩‍👩‍👧 é́", "<|endoftext|> <|", "²½Ⅷ١२ "]


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts(n, seed):
    pick = random.Random(seed)
    out = ["", " ", "\n", "a", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "x" * 3000, " " * 3000, "é" * 999]
    for _ in range(n):
        pool = "".join(pick.sample(POOLS, pick.randint(1, 3)))
        out.append("".join(pick.choices(pool, k=pick.randint(1, 90))))
    return out


def test_counts_are_the_librarys():
    texts = odd_texts(6000, 1)
    assert Counter(BYTE).count(texts) == library(BYTE, texts)


def test_forced_splits_change_nothing():
    texts = odd_texts(1500, 2) + [" ".join(odd_texts(40, 3))]
    want = library(BYTE, texts)
    for size in (1, 7, 20):
        small = Counter(BYTE, split_bytes=size)
        assert small.count(texts) == want
        assert any(len(small.parts(t)) > 1 for t in texts)
        assert all("".join(small.parts(t)) == t for t in texts)


def test_other_files():
    texts = odd_texts(500, 4)
    word = public_tokenizers.path("word_bpe_49k.json")
    assert Counter(word, split_bytes=10).count(texts) == library(word, texts)
    import sentencepiece

    piece = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert Counter(piece, split_bytes=10).count(texts) == [len(model.encode(t)) for t in texts]


def test_rows(spark):
    texts = [None, "", *odd_texts(200, 5), "word " * 600, "word " * 600]
    docs = spark.createDataFrame([(i if i else None, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_bytes string")
    for batch_bytes in (2 << 20, 100):
        rows = {r["doc_id"]: r for r in token_counts(docs, BYTE, batch_bytes=batch_bytes).collect()}
        assert len(rows) == len(texts)
        for i, (t, n) in enumerate(zip(texts, library(BYTE, [t or "" for t in texts]), strict=True)):
            r = rows[i or None]
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert token_counts(docs.limit(0), BYTE).count() == 0
