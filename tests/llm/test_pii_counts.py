"""Which terms disclose an entity, against a second count over the corpus, and how many rows that takes."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from ladderlens.llm import pii


def plain_disclosing(texts: list[str]) -> set[tuple[str, str]]:
    """The same by sets of documents and surroundings."""
    docs_of_entity: dict[str, set[int]] = {}
    docs_of_term: dict[str, set[int]] = {}
    seen: dict[tuple[str, str], set] = {}
    for i, text in enumerate(texts):
        words = [(m.start(), m.end(), m[0]) for m in pii._WORD.finditer(text)]
        terms = {pii.term_of(w) for _, _, w in words} - {None}
        for t in terms:
            docs_of_term.setdefault(t, set()).add(i)
        near: dict[str, list[list[str]]] = {}
        for span in pii.base_spans(text):
            before = [w for _, b, w in words if b <= span[1]][-pii.WINDOW_WORDS :]
            after = [w for a, _, w in words if a >= span[2]][: pii.WINDOW_WORDS]
            # a word that the address is glued to counts by the part that is outside
            glued = next(((a, b) for a, b, _ in words if a <= span[1] and span[2] <= b), (span[1], span[2]))
            before = (before + ([text[glued[0] : span[1]]] if glued[0] < span[1] else []))[-pii.WINDOW_WORDS :]
            after = (([text[span[2] : glued[1]]] if span[2] < glued[1] else []) + after)[: pii.WINDOW_WORDS]
            near.setdefault(pii.entity(text, span), []).append(before + after)
        for name, windows in near.items():
            docs_of_entity.setdefault(name, set()).add(i)
            for t in terms | {pii.term_of(w) for ws in windows for w in ws} - {None}:
                own = {tuple(ws) for ws in windows if t in {pii.term_of(w) for w in ws}}
                seen.setdefault((name, t), set()).update(own or {text})
    out = set()
    for (name, t), contexts in seen.items():
        both = len(docs_of_entity[name] & docs_of_term[t]) if t in docs_of_term else 0
        if len(contexts) < pii.MIN_CONTEXTS or not both:
            continue
        ic = math.log2(len(texts) / len(docs_of_entity[name]))
        pmi = math.log2(len(texts) * both / (len(docs_of_entity[name]) * len(docs_of_term[t])))
        if ic > 0 and pmi >= pii.DISCLOSURE * ic - 1e-12:
            out.add((name, t))
    return out


def test_disclosing_terms_equal_a_second_count(spark):
    rng = random.Random(11)
    common, texts = [f"word{i}" for i in range(40)], []
    for i in range(160):
        words = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        for who in range(4):
            if rng.random() < 0.08:
                at = rng.randrange(len(words) + 1)
                words[at:at] = [f"Dr{who}", rng.choice(common), f"person{who}@mail.example"] if rng.random() < 0.9 else [f"person{who}@mail.example"]
            elif rng.random() < 0.02:
                words.append(f"dr{who},")
        texts.append(" ".join(words))
    texts += [texts[0]] * 3 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["entity"], r["term"]) for r in pii.disclosing(docs, pii.mentions(docs)).collect()}
    assert got == plain_disclosing([t or "" for t in texts]) and any(t.startswith("dr") for _, t in got)


def test_many_addresses_of_one_text_take_a_row_each(spark):
    """1,000 addresses and as many terms: entities that are seen once have no pairs."""
    text = " ".join(f"name{i} user{i}@mail.example" for i in range(1000))
    docs = spark.createDataFrame([(1, text), (2, "someone else")], "doc_id long, text string")
    found = pii.mentions(docs)
    assert found.count() == 1000
    assert pii.occurrences(docs, found.select("entity").where(F.lit(False))).count() == 0
    assert pii.disclosing(docs, found).count() == 0
