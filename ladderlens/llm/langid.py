"""Language identification by prediction by partial matching (PPM, escape method C).

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted once and frozen. A
text's exact code length under a language is the sum of -log2 p(byte | longest known context), where
a context spends q / (n + q) on escaping to the next shorter one (n: its bytes, q: distinct ones) and
bytes already offered by a longer context are excluded from the shorter ones, so that the
probabilities of each context sum to 1. The language with the shortest code is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ladderlens.llm.common import claim, joined, text_blocks

ORDER = 3
#: Different labelled texts per language that the trees are counted from, by ascending hash.
ROWS_PER_LANG = 400
START = b"\n" * ORDER
HAS_LETTER = r"\p{L}"

OWNER = "langid"


class Model:
    """Code lengths of every byte after every known context, for all languages side by side."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: by language, 4-grams as big-endian numbers (ascending) and how often each occurs."""
        self.langs = sorted(counts)
        every = np.unique(np.concatenate([counts[x][0] for x in self.langs])).astype(np.int64)
        used = np.unique(every & 255)
        #: Bytes that no language has share one column: their code lengths are equal everywhere.
        self.symbol = np.full(256, len(used), dtype=np.int32)
        self.symbol[used] = np.arange(len(used))
        width, rare = len(used) + 1, 256 - len(used)
        known = {k: np.unique((every >> 8) & ((1 << 8 * k) - 1)) for k in range(ORDER, -1, -1)}
        table = np.zeros((sum(map(len, known.values())), width, len(self.langs)), dtype=np.float32)
        for at, lang in enumerate(self.langs):
            grams, n = counts[lang]
            dense = {}
            for k in range(ORDER + 1):
                one = np.zeros((len(known[k]) + 1, width))
                np.add.at(one, (np.searchsorted(known[k], (grams.astype(np.int64) >> 8) & ((1 << 8 * k) - 1)), self.symbol[grams & 255]), n)
                dense[k] = one
            row = 0
            for k in range(ORDER, -1, -1):
                for low in range(0, len(known[k]), 4096):
                    part = known[k][low : low + 4096]
                    p = self._p(dense, known, k, part, np.zeros((len(part), width), dtype=bool), rare)
                    table[row + low : row + low + len(part), :, at] = -np.log2(p)
                row += len(known[k])
        self.table = table.reshape(-1, len(self.langs))
        self.width = width
        base = np.cumsum([0, len(known[3]), len(known[2]), len(known[1])])
        pairs = known[2]
        self.pair = np.empty(65536, dtype=np.int32)
        self.pair[:] = len(pairs) + (np.arange(65536) & 255)
        self.pair[pairs] = np.arange(len(pairs))
        one = np.full(256, base[3], dtype=np.int32)
        one[known[1]] = base[2] + np.arange(len(known[1]))
        rows = np.concatenate([np.repeat(base[1] + np.arange(len(pairs)), 256), np.repeat(one, 256)]).astype(np.int32)
        rows[self.pair[known[3] & 65535].astype(np.int64) * 256 + (known[3] >> 16)] = np.arange(len(known[3]))
        self.row = rows

    @staticmethod
    def _p(dense, known, k, contexts, out, rare):
        """Probabilities after ``contexts`` of order k, with the symbols in ``out`` excluded. The last
        column stands for ``rare`` bytes and holds the probability of one of them."""
        if k < 0:
            left = (~out[:, :-1]).sum(1, keepdims=True) + rare
            return np.where(out, 1.0, 1.0 / np.maximum(left, 1))
        at = np.searchsorted(known[k], contexts)
        at = np.where((at < len(known[k])) & (known[k][np.minimum(at, len(known[k]) - 1)] == contexts), at, len(known[k]))
        count = np.where(out, 0.0, dense[k][at])
        seen = count > 0
        n, q = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        rest = Model._p(dense, known, k - 1, contexts & ((1 << 8 * max(k - 1, 0)) - 1), out | seen, rare)
        escape = np.where(q > 0, q / np.maximum(n + q, 1), 1.0)
        return np.where(seen, count / np.maximum(n + q, 1), escape * rest)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths in bits: a row for each text, a column for each language."""
        data, starts = joined(texts, START)
        wide = data.astype(np.int32)
        pair = self.pair[(wide[1:-2] << 8) | wide[2:-1]]
        row = self.row[pair * 256 + wide[:-3]]
        cost = self.table[row * self.width + self.symbol[data[3:]]]
        total = np.zeros((len(texts), len(self.langs)))
        size = np.diff(starts) - len(START)
        # cost[i] belongs to byte i + 3; the bytes of START themselves cost nothing
        skip = (starts[1:-1, None] - len(START) + np.arange(len(START))).ravel()
        cost[skip] = 0
        full = np.flatnonzero(size)
        if len(full):
            total[full] = np.add.reduceat(cost, starts[full], axis=0, dtype=np.float64)
        return total


def learn(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG):
    """Counts of 4-grams by language from a bounded sample of (text, lang); null texts or languages are left out.

    The sample is the ``rows_per_lang`` different texts of each language that hash lowest, each once
    however many copies it has. Only distinct hashes are ranked; the texts are then fetched by them and
    counted by Spark, and what reaches the driver is one row per language and distinct 4-gram of the sample.
    """
    known = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    least = known.select("lang", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_lang)
    limits = {r["lang"]: r["m"] for r in least.groupBy("lang").agg(F.max("h").alias("m")).collect()}
    if not limits:
        return {}
    wanted = F.lit(False)
    for lang, limit in limits.items():
        wanted |= (F.col("lang") == lang) & (F.col("h") <= limit)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            langs = part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                data, starts = joined([t for t, x in zip(texts, langs) if x == lang], START)
                wide = data.astype(np.int64)
                if len(wide) < ORDER + 1:
                    continue
                key = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
                keep = np.ones(len(key), dtype=bool)
                keep[(starts[1:-1, None] - ORDER + np.arange(ORDER)).ravel()] = False
                key, n = np.unique(key[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "gram", "n"])

    found = known.where(wanted).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, one in found.groupby("lang"):
        one = one.sort_values("gram")
        counts[lang] = (one["gram"].to_numpy(np.int64), one["n"].to_numpy(np.float64))
    return counts


def identify(docs: DataFrame, counts, columns: list[str]) -> DataFrame:
    """(row, lang_pred, score, bits_per_byte): ``columns`` of docs in one struct, whatever their names, with
    the predicted language, its posterior under equal priors and the bits a byte of its code.

    Null texts and texts without a letter: ``und``, score 0. Ties go to the language first in order, equal
    texts have equal results, repeated rows stay. Without any learned language, all are ``und``. A text of
    any length is scored whole.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(counts)
    key = f"{spark.sparkContext.applicationId}-{shipped._jbroadcast.id() if shipped._jbroadcast else id(shipped)}"
    inside = "text" in columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = claim(OWNER)
        if key not in models:
            models.clear()
            models[key] = Model(shipped.value) if shipped.value else None
        model = models[key]
        if inside:
            batches = (pa.RecordBatch.from_arrays([*b.columns, pc.struct_field(b.column("row"), "text")], names=[*b.schema.names, "text"]) for b in batches)
        for part, texts in text_blocks(batches, "text", OWNER):
            lettered = np.array(part.column("lettered").to_pylist(), dtype=bool)
            if model:
                bits = model.bits(texts)
                best = bits.argmin(1)
                low = bits[np.arange(len(texts)), best]
                score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                lettered &= np.array([len(x) > 0 for x in texts])
                pred = [model.langs[b] if x else "und" for b, x in zip(best, lettered)]
                per = low / np.maximum([len(x) for x in texts], 1)
            else:
                pred, score, per = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                lettered[:] = False
            out = [part.column("row"), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, per, 0.0))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "lang_pred", "score", "bits_per_byte"])

    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    source = docs.select(row, *([] if inside else [F.col("text").alias("text")]), F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)).alias("lettered"))
    return source.mapInArrow(predict, StructType([source.schema["row"], *StructType.fromDDL("lang_pred string, score double, bits_per_byte double")]))


def held_out():
    """A quarter of the documents, by id, that learning never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir):
    from ladderlens.llm.common import documents

    docs = documents(spark, sf_dir)
    counts = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))
    return identify(docs.withColumn("held_out", held_out()), counts, ["doc_id", "held_out"]).select("row.doc_id", "row.held_out", "lang_pred", "score", "bits_per_byte")
