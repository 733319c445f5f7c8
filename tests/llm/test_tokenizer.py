import os
import random

import pytest

from kinfold.llm import tokenizer as T

if not os.path.exists(T.tokenizer_path()):
    pytest.skip("no vocabulary file here", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    t = T.transducer(T.tokenizer_path())
    return t, tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


TEXTS = ["", " ", "  \n\n x", "don't they'LL we've", "<|endoftext|>", "é​﻿", "日本語 🙂🙂", "a" * 5000, " " * 3000 + "x", "=" * 999, "x\x00y", "０１２ 12345678901234567890"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_public_encoder_and_round_trips(pair, text):
    t, public = pair
    assert t.encode(text) == public.encode_ordinary(text)
    assert t.decode(t.encode(text)) == text


def test_random_texts_whole_and_in_chunks(pair):
    t, public = pair
    rng = random.Random(4)
    for k in range(150):
        text = "".join(rng.choice("ab cde'tllre  éüß漢🙂\n\t019-=_") for _ in range(rng.randint(1, 400)))
        want = public.encode_ordinary(text)
        step = rng.randint(1, 9)
        assert t.encode(text) == want
        assert list(t.encode_stream(text[i : i + step] for i in range(0, len(text), step))) == want


def test_transducer_needs_only_its_lookahead(pair):
    t, public = pair
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
    emitted, fed = [], 0

    def feed():
        nonlocal fed
        for b in text.encode():
            fed += 1
            yield b

    for token in t.transduce(feed()):
        emitted.append(token)
        assert fed - sum(len(t.items[i]) for i in emitted) <= 6 * t.lookahead or fed == len(text)
    assert emitted == public.encode_ordinary(text)


def test_column(spark, pair):
    t, _ = pair
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (3, None)], "doc_id long, text string").withColumn("ids", T.size_column("text"))
    got = sorted((r["doc_id"], r["ids"]) for r in T.encode_corpus(df).collect())
    assert got == [(1, t.encode("Hello world")), (2, []), (3, None), (3, None)]
    assert [r["ids"] for r in df.orderBy("doc_id").collect()] == [2, 0, None, None]
    back = T.encode_corpus(df).select("doc_id", T.decode_column("ids").alias("text")).collect()
    assert {(r["doc_id"], r["text"]) for r in back} == {(1, "Hello world"), (2, ""), (3, None)}
