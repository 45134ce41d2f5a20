"""The filter audit, exact search and spelling variants against plain code."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

import __spark_entry__
from ladderlens.llm import audit, topk, variants
from ladderlens.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text: str):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def test_transducer_counts_whole_texts(texts):
    """Several texts of a block at once, and each in slices of few bytes, as very long ones are read."""
    odd = ["", " ", "\t\n", "A", "é 日本 é É", "a\x1cb a\x1cb", "x" * 700 + " " + "x" * 699 + "y " + "x" * 700, "a#b $ |", "THE the The the"]
    every = odd + [t or "" for t in texts.values()]
    want = np.array([plain_measures(t) for t in every])
    assert (audit.measures([t.encode() for t in every]) == want).all()
    for size in (1, 7, 1000):
        assert all((audit.long_measures(t.encode(), size) == w).all() for t, w in zip(odd + every[-5:], [*want[: len(odd)], *want[-5:]]))


def test_equal_hashes_keep_words_apart(monkeypatch):
    """All words of a block in one chain of the table: the bytes alone tell them apart."""
    monkeypatch.setattr(audit, "xxh64", lambda data, starts, sizes: np.zeros(len(starts), dtype=np.uint64))
    texts = ["aa ab aa abcdefgh abcdefghi abcdefghi ba", "aa", "ba ba"]
    assert audit.measures([t.encode() for t in texts])[:, 1].tolist() == [5, 1, 1]


def plain_audit(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for doc_id, text, lang in docs:
            words, distinct, capitals, points, symbols = plain_measures(text or "")
            fails = {x for x, bad in zip("ABCDE", (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols, doc_id is not None and doc_id > first[text or ""])) if bad}
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((lang or "", order, step), Counter())
                row["redundant"] += gone and x in fails
                row["removed"] += not gone and x in fails
                row["good_lost"] += not gone and x in fails and (doc_id, "good") in labels
                row["toxic_lost"] += not gone and x in fails and (doc_id, "toxic") in labels
                row["unique_fails"] += fails == {x}
                gone = gone or x in fails
                row["kept"] += not gone
    for (part, order, step), row in out.items():
        row["shapley"] = sum(r["removed"] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1])
    return out


def test_audit_of_odd_tables(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()] + [(7, "A B", None), (8, "A B", "fr"), (9, "A B", "fr")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' AS fails", "'y' AS digest", "1 AS part")
    labels = spark.createDataFrame([(8, 1, 0), (9, 0, 1), (4, 1, 1), (4, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("doc_id", "quality = 1 AS good", "toxic = 1 AS toxic").groupBy("doc_id").agg({"good": "max", "toxic": "max"}).toDF("doc_id", "good", "toxic")
    rows = audit.interactions(audit.failed(table).select("doc_id", "part", "fails").join(labels, "doc_id", "left")).collect()
    want = plain_audit(docs, {(8, "good"), (9, "toxic"), (4, "good"), (4, "toxic")})
    assert {(r["part"], r["filter_order"], r["step"]) for r in rows} == want.keys() and len(rows) == len(want)
    for r in rows:
        assert {c: r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == {c: int(want[r["part"], r["filter_order"], r["step"]][c]) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_exact_topk"])
def test_matches_duckdb(spark, smallest, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    theirs = con.sql(ORACLES[name])
    mine = QUERIES[name](spark, smallest)
    assert set(theirs.columns) == set(mine.columns)
    assert sorted(tuple(r[c] for c in theirs.columns) for r in mine.collect()) == sorted(theirs.fetchall())


def plain_top(vectors, k):
    """vectors: (id, list or None)."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda v: ([t for t, x in enumerate(v) if x], [x for x in v if x]))
    out = set()
    for i, v in asked.items():
        scored = sorted((-max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in whole if j != i)
        out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("size", [0, 4, 700])
def test_search_is_exact(spark, size, monkeypatch):
    """Ties, sparse and unlike rows, nulls, infinities, components beyond 64 bits, repeated ids, several groups."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 50)
    rng = random.Random(size)
    rows = [(i, [rng.choice((0.0, 0.0, 0.0, 1.0, -0.5, 0.003, rng.random())) for _ in range(rng.choice((5, 5, 8)))]) for i in range(size)]
    if size > 100:
        rows += [(50, [1.0, 1.0]), (50, [0.0, 2.0]), (60, rows[60][1]), (None, [1.0]), (1000, None), (1050, [None, 1.0]), (1100, [float("nan")]), (1150, [float("inf")]), (1200, []), (1250, [1e15, 3.0]), (1251, [-1e15, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS g", "3 AS term")
    got = [tuple(r) for r in topk.top_k(table, topk.F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(set(got)) or size > 100
    best = {(q, r, s) for q, r, _, s in got}
    want = plain_top(rows, 5)
    assert best == {(q, r, s) for q, r, _, s in want} and set(got) == want


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts):
    near_to = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in near_to.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near_to[w]), counts[form[w]] if form[w] else None))
    return out


def plain_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def test_words_and_deletions(spark, docs, odd):
    more = spark.createDataFrame([(None, "Wonderful wonderful WONDERFUL"), (70, "naïveté×÷ÿ naïveté×÷ÿ Éclairage éclairage Éclairage " + "longest" * 3000), (70, "longest" * 3000)], "doc_id long, text string")
    for table in (docs, odd.select("doc_id", "text").union(more)):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        got = {r["word"]: r["n"] for r in variants.word_counts(table).where("n >= 2").collect()}
        assert got == plain_words(rows) and got


@pytest.mark.parametrize("few", [0, 3, 64])
def test_every_near_word_is_found(spark, few, monkeypatch):
    """Words of few letters, so lists are long and grams of every length are cut; roots over several steps."""
    monkeypatch.setattr(variants, "FEW", few)
    rng = random.Random(few)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))): rng.choice((2, 3, 25, 300, 4000)) for _ in range(500)}
    for w in list(counts)[:60]:  # edits at both ends and within, and of words of every length
        long = w * rng.randint(1, 4)
        at = rng.randrange(len(long) + 1)
        counts |= {long: 2, long[:at] + "z" + long[at:]: 30, long[1:] if len(long) > 7 else long: 400, long[:-1] + "q": 6000}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in variants.spelling_forms(words).collect()]
    assert len(got) == len(counts) and set(got) == plain_forms(counts)


def test_query_on_a_folder(spark, folder, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in __spark_entry__.queries()["op13_spelling_variants"](spark, f"{folder}/docs").collect()}
    assert got == plain_forms(plain_words(rows)) and any(r[1] for r in got)


def test_two_grams_survive_every_edit():
    """No edit changes both grams of the pair, and the other one is where the shift says."""
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(7, 14)))
        dictionary = {w[i : i + n] for i in range(len(w)) for n in (2, 3, 4) if rng.random() < 0.5}
        at, kind = rng.randrange(len(w)), rng.choice(("replace", "insert", "delete"))
        e = w[:at] + {"replace": "x" + w[at + 1 :], "insert": "x" + w[at:], "delete": w[at + 1 :]}[kind]
        short, long = sorted((w, e), key=len)
        mine = variants.rarest_pair(variants.decomposed(short, len(long), dictionary), dictionary)
        theirs = set(variants.decomposed(long, len(long), dictionary))
        shifts = (0,) if len(short) == len(long) else (0, 1)
        assert any((at + d, g) in theirs for at, g in mine for d in shifts)
