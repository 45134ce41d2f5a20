"""Spelling variants by a variable-length gram index.

1. Words and their counts over all documents.
2. A gram dictionary, pruned by frequency: the grams (of words between marks for their ends) that occur more
   often than a bound which keeps the dictionary small. It only holds what must be extended.
3. A word decomposes into the gram at each place that is the shortest one outside the dictionary, at most half
   the word long, or ends with the word. A gram depends on its own characters alone, so an edit changes only
   the grams that span it, and all others are found in the edited word, shifted by what the edit shifts.
4. The index lists words by gram, place and length. How many of a set of grams one edit can change is the
   set's affected-gram bound; a word takes the rarest two grams that no edit can change together (bound 1),
   so a word one edit away is in at least one of these two lists, and merging two lists finds every one.
5. Members of the lists are verified by their edit distance.

Words of length n look for partners of lengths n and n + 1 with grams cut as for that length, which finds
every pair once from its shorter (or either) word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlens.llm.common import claim, documents, staged, text_blocks

#: Code points and occurrences that a word needs.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs so many times as often.
TIMES = 10
#: One in so many words a document is misspelled by the query.
ONE_IN = 31
#: Shortest and longest gram.
LEAST_GRAM, MOST_GRAM = 2, 8
#: Grams of one length in the dictionary at most, and occurrences up to which no gram is extended.
MOST_GRAMS, FEW = 50_000, 64
#: Different words that a task gathers before it hands on their counts.
GATHERED = 200_000
#: Marks of a word's ends; no letters.
BEGIN, END = "^", "$"
#: Doublings of the path to a root: counts grow tenfold at each step and fit in 64 bits, so 18 steps are the most.
DOUBLINGS = 5


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of all runs of letters, in lower case, that have ``least`` code points after the deletion which
    their document and run decide."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
            found.clear()
            return out

        for batch, texts in text_blocks(batches, owner="variants"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs.findall(text.lower().decode())).items():
                    h = zlib.crc32(run.encode(), before)
                    if h % one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    found[run] += n
            if len(found) > GATHERED:
                yield flushed()
        yield flushed()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame) -> set[str]:
    """The grams to extend: those with more occurrences than FEW and than a MOST_GRAMS-th of all places, which
    bounds them by MOST_GRAMS of each length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("variants")
        for batch in batches:
            found: Counter = Counter()
            for word in batch.column("word").to_pylist():
                w = f"{BEGIN}{word}{END}"
                for size in range(LEAST_GRAM, MOST_GRAM):
                    found.update(w[i : i + size] for i in range(len(w) - size + 1))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    places = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    often = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > max(FEW, places // MOST_GRAMS))
    return {r["gram"] for r in often.select("gram").toLocalIterator()}


def decomposed(word: str, target: int, dictionary: set[str]) -> list[tuple[int, str]]:
    """(place, gram) of the word between its marks, cut as for words of ``target`` code points."""
    w, most = f"{BEGIN}{word}{END}", min(MOST_GRAM, (target + 2) // 2)
    out = []
    for at in range(len(w) - LEAST_GRAM + 1):
        end, last = at + LEAST_GRAM, min(at + most, len(w))
        while end < last and w[at:end] in dictionary:
            end += 1
        out.append((at, w[at:end]))
    return out


def rarest_pair(grams: list[tuple[int, str]], dictionary: set[str]) -> tuple[tuple[int, str], tuple[int, str]]:
    """Two grams that no single edit changes together: the first ends before the second begins. Grams outside
    the dictionary are rarer than those in it, and longer ones rarer than shorter ones."""
    cost = [(2.0 if g in dictionary else 0.0) + 1.0 / len(g) for _, g in grams]
    by_end: dict[int, int] = {}
    for i, (at, g) in enumerate(grams):
        end = at + len(g)
        if end not in by_end or cost[i] < cost[by_end[end]]:
            by_end[end] = i
    best, least, first = None, float("inf"), None
    for j, (at, _) in enumerate(grams):
        if at in by_end and (first is None or cost[by_end[at]] < cost[first]):
            first = by_end[at]
        if first is not None and cost[first] + cost[j] < least:
            best, least = (grams[first], grams[j]), cost[first] + cost[j]
    return best


def list_key(gram: str, at: int, length: int) -> int:
    return xxhash.xxh64_intdigest(f"{length}:{at}:{gram}") - (1 << 63)


def listed(words: DataFrame, dictionary: set[str], asks: bool) -> DataFrame:
    """(key, word, letters): the lists that each word is in, or (``asks``) those that it must look into.
    letters has a bit for each letter that comes an odd number of times."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("variants")
        known = shared.value
        for batch in batches:
            keys, which, letters = [], [], []
            for word in batch.column("word").to_pylist():
                n = len(word)
                if asks:
                    mine = {list_key(g, at, n) for at, g in rarest_pair(decomposed(word, n, known), known)}
                    mine |= {list_key(g, at + d, n + 1) for at, g in rarest_pair(decomposed(word, n + 1, known), known) for d in (0, 1)}
                else:
                    mine = {list_key(g, at, n) for at, g in decomposed(word, n, known)}
                bits = 0
                for x in word:
                    bits ^= 1 << (ord(x) % 63)
                keys += mine
                which += [word] * len(mine)
                letters += [bits] * len(mine)
            for i in range(0, max(1, len(keys)), 50_000):
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[i : i + 50_000], pa.int64()), "word": pa.array(which[i : i + 50_000], pa.string()), "letters": pa.array(letters[i : i + 50_000], pa.int64())})

    return words.select("word").mapInArrow(run, "key long, word string, letters long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): all pairs of words one inserted, deleted or replaced code point apart, each once."""
    dictionary = gram_dictionary(words)
    asking = listed(words, dictionary, True).toDF("key", "a", "a_letters")
    lists = listed(words, dictionary, False).toDF("key", "b", "b_letters")
    longer = F.char_length("b") > F.char_length("a")
    few = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2  # else more than one letter differs
    near = (longer | (F.col("a") < F.col("b"))) & few & (F.levenshtein("a", "b", 1) == 1)
    return asking.join(lists, (asking["key"] == lists["key"]) & near).select("a", "b").distinct()


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n: each word once) with form, root, n_near and form_n."""
    found = near_pairs(words)
    both = found.union(found.select("b", "a")).toDF("word", "near")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    often = -F.col("best.less") >= times * F.col("n").cast("decimal(38,0)")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    rows = staged(rows, "forms")
    ways = rows.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    for _ in range(DOUBLINGS):
        on = ways.select(F.col("word").alias("to"), F.col("to").alias("further"))
        ways = staged(ways.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "ways")
        if ways.where("moved").isEmpty():
            break
    return rows.join(ways.select("word", F.col("to").alias("root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least 7 code points and 2 occurrences over all whole texts, with its near words, form and root.

    Null and empty texts have no words; a null doc_id counts as an empty one in the deletions. Repeated rows count as often
    as they come. Texts and runs may have any length; ties of forms go to the smallest word in code-point
    order. No words, no rows. Other columns are not read.
    """
    words = staged(word_counts(documents(spark, sf_dir)).where(F.col("n") >= LEAST_COUNT), "words")
    return spelling_forms(words)
