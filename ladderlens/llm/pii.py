"""Personal data: base patterns plus terms that disclose the found entities (information-theoretic).

An entity c is a found e-mail address, IP address, card or phone number. A term t in its documents reveals as
much of it as their pointwise mutual information over the corpus, PMI(c, t) = log2(N n(c,t) / (n(c) n(t))),
of the information content IC(c) = log2(N / n(c)) that it has (Sanchez and Batet, C-sanitized, 2016).
Terms with PMI >= DISCLOSURE * IC are sanitised in the documents that hold the entity. To tell
disclosure from mere copying, a pair must occur in at least MIN_CONTEXTS different surroundings: the
WINDOW_WORDS words on either side of the entity, whichever document they are in, where the term is one of
them; else the document's text. All three counts n are of whole documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import claim, documents, short_lived_shuffles, staged

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW_WORDS = 8
MIN_CONTEXTS = 3
DISCLOSURE = 0.95
#: Different terms that a task counts before it passes them on.
TERMS_HELD = 100_000
TERM_BITS = 1 << 20
#: Rows of pairs that a task holds before it passes them on.
ROWS_PER_BATCH = 50_000
EDGE = ".,;:!?()[]{}<>\"'`*#|=$%&"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, found from each @ so that long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start: leftmost matches that don't overlap within
    a kind; a match that fails its check is dropped and not retried."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x) <= 255 for x in m[0].split(".") if len(x) < 20) and all(len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= x <= "9" for x in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(text: str, span: tuple[str, int, int]) -> str:
    kind, start, end = span
    value = text[start:end].lower()
    return f"{kind}:{value if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def term_of(word: str) -> str | None:
    """A word without surrounding punctuation, lower-cased; None if it has no letter or is an address."""
    word = word.strip(EDGE).lower()
    return word if word and "@" not in word and any(x.isalpha() for x in word) else None


def _around(text: str, start: int, end: int) -> list[str]:
    """Up to WINDOW_WORDS words on either side."""
    size = 512
    while True:
        low, high = max(0, start - size), min(len(text), end + size)
        before, after = _WORD.findall(text, low, start), _WORD.findall(text, end, high)
        if low:
            before = before[1:]
        if high < len(text):
            after = after[:-1]
        if (len(before) >= WINDOW_WORDS or not low) and (len(after) >= WINDOW_WORDS or high == len(text)):
            return before[-WINDOW_WORDS:] + after[:WINDOW_WORDS]
        size *= 4


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _surroundings(text: str) -> dict[str, list[list[str]]]:
    """The words around each occurrence of each entity."""
    near: dict[str, list[list[str]]] = {}
    for span in base_spans(text):
        near.setdefault(entity(text, span), []).append(_around(text, span[1], span[2]))
    return near


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, entity, contexts): a row for each document and entity, with the hashes of all surroundings that a pair of it
    with a term can have there: the words around the entity, and the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for batch in batches:
            held = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                near = _surroundings(text)
                whole = _hash(text) if near else 0
                held += [(i, name, [whole, *{_hash("\n".join(x)) for x in own}]) for name, own in near.items()]
            columns = list(zip(*held)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column("doc_id").type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64()))], names=["doc_id", "entity", "contexts"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, entity string, contexts array<long>")


def occurrences(docs: DataFrame, live: DataFrame) -> DataFrame:
    """(entity, term, context, first): a row for each document, entity of ``live`` (entity), term of the document and
    different surroundings of the pair in it; ``first`` in one of a pair's. Entities that are not asked for, as
    nearly all are that occur once, cost no row."""
    known = _asked(docs, live, "entity")

    def pairs(text: str) -> Iterator[tuple[str, str, int, bool]]:
        near = {name: own for name, own in _surroundings(text).items() if known.value[_bit(name)]}
        if not near:
            return
        whole, terms = _hash(text), {term_of(x) for x in set(_WORD.findall(text))} - {None}
        for name, windows in near.items():
            own: dict[str, set[int]] = {}
            for words in windows:
                context = _hash("\n".join(words))
                for term in {term_of(x) for x in words} - {None}:
                    own.setdefault(term, set()).add(context)
            for term in terms | own.keys():
                for i, context in enumerate(own.get(term, (whole,))):
                    yield name, term, context, i == 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        held: list[tuple] = []

        def full() -> pa.RecordBatch:
            columns = list(zip(*held)) or [[]] * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["entity", "term", "context", "first"])

        for batch in batches:
            for text in batch.column("text"):
                for row in pairs(text.as_py() or ""):
                    held.append(row)
                    if len(held) >= ROWS_PER_BATCH:
                        yield full()
        yield full()

    return docs.select("text").mapInArrow(rows, "entity string, term string, context long, first boolean").join(live, "entity", "left_semi")


def _bit(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode()) % TERM_BITS


def _asked(docs: DataFrame, names: DataFrame, column: str):
    """A set of TERM_BITS bits of the names asked for, broadcast, whatever their number."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bit(x) for x in batch.column(column).to_pylist()], pa.int64())], names=["bit"])

    marked = bytearray(TERM_BITS)
    for r in names.mapInArrow(bits, "bit long").distinct().toLocalIterator():
        marked[r["bit"]] = 1
    return docs.sparkSession.sparkContext.broadcast(bytes(marked))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): in how many documents each of ``terms`` (term) occurs, in one pass over the texts. Tasks pass
    on what a set of TERM_BITS bits does not exclude, added up over up to TERMS_HELD terms; Spark keeps the terms
    asked for and sums them."""
    terms = staged(terms.distinct(), "terms")
    shipped = _asked(docs, terms, "term")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = Counter(), shipped.value

        def summed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])
            total.clear()
            return rows

        for batch in batches:
            for text in batch.column("text"):
                total.update(x for x in {term_of(x) for x in set(_WORD.findall(text.as_py() or ""))} - {None} if known[_bit(x)])
                if len(total) >= TERMS_HELD:
                    yield summed()
        yield summed()

    counted = docs.select("text").mapInArrow(count, "term string, n long")
    return counted.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, pmi, ic) of the pairs over the disclosure threshold; found: ``mentions``.

    An entity that all its documents together show in fewer than MIN_CONTEXTS surroundings has no pair that is
    seen in as many; the others' pairs are counted."""
    contexts = found.select("entity", F.explode("contexts").alias("context")).distinct()
    with short_lived_shuffles(docs.sparkSession):
        live = staged(contexts.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS).select("entity"), "live")
    by_context = occurrences(docs, live).groupBy("entity", "term", "context").agg(F.sum(F.col("first").cast("long")).alias("n"))
    pairs = by_context.groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS).drop("contexts")
    with short_lived_shuffles(docs.sparkSession):
        pairs = staged(pairs, "pairs")
    entities = found.groupBy("entity").agg(F.count("*").alias("n_c"))
    terms = document_counts(docs, pairs.select("term"))
    n = docs.count()
    scored = pairs.join(entities, "entity").join(terms, "term")
    scored = scored.withColumn("ic", F.log2(F.lit(float(n)) / F.col("n_c"))).withColumn("pmi", F.log2(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))))
    return scored.where((F.col("ic") > 0) & (F.col("pmi") >= DISCLOSURE * F.col("ic"))).select("entity", "term", "pmi", "ic")


def all_spans(text: str, flagged: list[tuple[str, str]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans of flagged (entity, term) pairs whose entity the text holds; a term
    within a base span is not marked again."""
    base = base_spans(text)
    if not flagged:
        return base, []
    held = {entity(text, x) for x in base}
    wanted = {t for e, t in flagged if e in held}
    extra, covered = [], sorted((s, e) for _, s, e in base)
    at, reach = 0, 0
    for m in _WORD.finditer(text) if wanted else ():
        if term_of(m[0]) in wanted:
            start = m.start() + len(m[0]) - len(m[0].lstrip(EDGE))
            end = m.end() - (len(m[0]) - len(m[0].rstrip(EDGE)))
            while at < len(covered) and covered[at][0] < end:
                reach, at = max(reach, covered[at][1]), at + 1
            if reach <= start:
                extra.append((TERM, start, end))
    return base, extra


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span generalised to its kind; overlapping spans become the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def with_flags(docs: DataFrame) -> DataFrame:
    """docs with ``flagged``: the (entity, term) pairs that may be sanitised in each document."""
    found = staged(mentions(docs), "mentions")
    pairs = found.select("doc_id", "entity").join(disclosing(docs, found).select("entity", "term"), "entity")
    per_doc = pairs.groupBy("doc_id").agg(F.collect_set(F.struct("entity", "term")).alias("flagged"))
    return docs.join(per_doc.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").drop("__id")


def _flags(column) -> list[list[tuple[str, str]]]:
    return [[(y["entity"], y["term"]) for y in x or ()] for x in column.to_pylist()]


def find(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans of every document; a null text counts
    as empty, and an empty one has no spans. Repeated rows stay, each with all its spans, and equal texts have
    equal base spans; rows without a doc_id get no term spans. A text of any length is searched whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{x}" for x in KINDS], "base_sha256", "spans"]

    def spell(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for batch in batches:
            counts, digests, spans = {x: [] for x in KINDS}, [], []
            for text, flagged in zip(batch.column("text"), _flags(batch.column("flagged"))):
                base, extra = all_spans(text.as_py() or "", flagged)
                for x in KINDS:
                    counts[x].append(sum(k == x for k, _, _ in base))
                digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(base + extra))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(counts[x], pa.int64()) for x in KINDS], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    flagged = with_flags(docs.select("doc_id", "text"))
    return flagged.mapInArrow(rows, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data and disclosing terms in ``text`` generalised. Null texts stay null, an empty
    text stays empty, and all other columns stay, whatever their names; repeated rows stay, and rows
    without a doc_id lose their personal data but no terms, as nothing says which documents they are in."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for batch in batches:
            texts = []
            for text, flagged in zip(batch.column("text").to_pylist(), _flags(batch.column("flagged"))):
                texts.append(None if text is None else redact(text, sum(all_spans(text, flagged), [])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, batch.column("text").type), batch.column("carried")], names=["doc_id", "text", "carried"])

    narrow = docs.select("doc_id", "text", carried.alias("carried"))
    clean = with_flags(narrow).select("doc_id", "text", "carried", "flagged").mapInArrow(rows, narrow.schema)
    return clean.select(*[F.col(c) if c in ("doc_id", "text") else F.col("carried").getField(c).alias(c) for c in docs.columns])


def op10_pii(spark, sf_dir):
    return find(documents(spark, sf_dir))
