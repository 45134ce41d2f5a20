from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ladderlens.llm import langid


def brute_bits(train: list[bytes], text: bytes) -> float:
    """PPM, method C with exclusion, frozen, from plain dictionaries."""
    seen = defaultdict(Counter)
    for t in train:
        s = langid.START + t
        for i in range(langid.ORDER, len(s)):
            for k in range(langid.ORDER + 1):
                seen[s[i - k : i]][s[i]] += 1
    s, bits = langid.START + text, 0.0
    for i in range(langid.ORDER, len(s)):
        out: set[int] = set()
        for k in range(langid.ORDER, -2, -1):
            if k < 0:
                bits -= math.log2(1 / (256 - len(out)))
                break
            count = {x: c for x, c in seen.get(s[i - k : i], {}).items() if x not in out}
            n, q = sum(count.values()), len(count)
            if not q:
                continue
            if s[i] in count:
                bits -= math.log2(count[s[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
            out |= set(count)
    return bits


def test_code_lengths_equal_brute_force():
    train = {"a": ["the cat sat on the mat".encode(), b"that hat"], "b": ["le chat était là".encode(), "ça va".encode()]}
    counts = {}
    for lang, texts in train.items():
        grams = Counter()
        for t in texts:
            s = langid.START + t
            grams.update(int.from_bytes(s[i - 3 : i + 1], "big") for i in range(3, len(s)))
        keys = sorted(grams)
        counts[lang] = (np.array(keys, dtype=np.int64), np.array([grams[k] for k in keys], dtype=float))
    model, texts = langid.Model(counts), [b"the chat", "été ça".encode(), b"", b"zzz\xff\x00", b"that mat on"]
    got = model.bits(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - brute_bits(train[lang], t)) < 1e-3


def test_held_out_accuracy(spark, smallest):
    rows = langid.op1_language_id(spark, smallest).join(spark.read.parquet(f"{smallest}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9


def test_no_labels_and_no_letters(spark, odd):
    assert langid.learn(odd.select("text", "lang").where("false")) == {}
    rows = langid.identify(odd, {}, ["doc_id"]).select("row.*", "lang_pred", "score").collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}
    counts = langid.learn(odd.select("text", "lang"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, counts, ["doc_id"]).select("row.*", "lang_pred").collect()}
    assert got[1] == got[2] == got[6] == "und" and got[5] == "en"


def test_copies_count_once_in_the_sample(spark):
    """The text that hashes lowest has thousands of copies: the sample still holds as many different texts."""
    texts = spark.createDataFrame([(f"text number {i} of the sample", "en") for i in range(50)], "text string, lang string")
    lowest = texts.orderBy(F.xxhash64("text")).first()["text"]
    copies = spark.range(3000).select(F.lit(lowest).alias("text"), F.lit("en").alias("lang"))
    want, got = langid.learn(texts, 20), langid.learn(texts.union(copies), 20)
    assert got.keys() == want.keys() == {"en"}
    assert all((x == y).all() for x, y in zip(got["en"], want["en"]))
    assert got["en"][1].max() <= 20 * len(lowest)
