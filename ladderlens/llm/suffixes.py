"""Removal of repeated 50-byte strings, found by sorting positions at three growing lengths.

This is not prefix doubling, which ranks every position by its first bytes and then by pairs of ranks at
doubling offsets: no ranks are paired here. As there, what is unique at one length drops out before the
next; but only sampled positions are sorted, and a string is named by a hash and the smallest document that
has it:

1. *Seeds.* Of each LENGTH-byte window the place whose first 8 bytes hash least is an anchor (of equal hashes the
   leftmost), so equal windows have equal anchors of their own at equal offsets. Anchors are ranked by their first
   SEED bytes. A window whose own anchor no other document has is unique and drops out.
2. *Pairs.* The anchors around a window are paired: the rank of the string from one to the other, which
   covers the window, and of where the anchors inside stand. If a smaller document has the same
   pair, it has the window. If the pair occurs as often as the window's own anchor, every place that
   has the window has the pair, and so the pair's rank is the window's.
3. *Windows.* What is left (near the ends of repeated passages) is ranked by all LENGTH bytes. Windows
   around one anchor are sent as one run of bytes to the anchor's task and spread out there. Where runs stand
   is kept by part, so the last pass only ranks their windows and cuts.

Each level sorts (rank, part) rows, aggregated before the shuffle; texts are written once and never
shuffled. A string is named by a 64-bit hash of its bytes and a second number: a seed's and a span's by 32 bits of
another hash, a window's by the hash of the seed that it is found by. Windows that meet in a task are compared
byte by byte as well. Windows of one own anchor with the same anchors around them are one range of places; single
ones are looked at only in ranges that no pair decides.

This departs from plain doubling, which would sort a pair of ranks for each of a text's bytes at each of
six offsets: the lengths named grow (SEED, the spans between anchors, LENGTH), but by hashing, not by
pairing the ranks of the length before.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.llm.common import documents, shared_dir, short_lived_shuffles
from ladderlens.llm.parts import NO_ID, Blocks, ids_of, keep_rows, over_saved, save_rows, write_parts, written_parts

LENGTH, SEED = 50, 18
REACH = LENGTH - SEED  # from a window's start to its last seed's start
BASE = np.uint64(0x9E3779B97F4A7C15)
SEEDS, PAIRS, WINDOWS, CUTS = "seeds", "pairs", "windows", "cuts"
#: Runs that one numpy pass spreads out; a longer group of one anchor is spread out as a whole.
RUNS_AT_ONCE = 200_000
#: Bytes of text that one numpy pass ranks; its numbers stay in the processor's cache.
BLOCK = 1 << 18
#: Bits of a key that order seeds, the same for all blocks; the others are for its place.
ORDER_BITS = 14
#: So many bytes can be read from any place of a block on.
SPARE = bytes(64)
RUNS = "m long, part int, least long, most long, bytes binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RANKS = "h long, g int, least long, spread long, n long, part int"

_rng = np.random.default_rng(20)
ODD = _rng.integers(1, 1 << 63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of the 16 bytes behind a seed, those that stand before an anchor at some distance from the seed's own.
_behind = [(1 << 8 * max(0, d - SEED)) - 1 for d in range(REACH + 2)]
BEHIND = [np.array([x >> shift & (1 << 64) - 1 for x in _behind], dtype=np.uint64) for shift in (0, 64)]
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse up to n."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            out = np.ones(size, dtype=np.uint64)
            out[1:2] = base
            have = 2
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _powers[k] = out
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _chained(words: list[np.ndarray]) -> np.ndarray:
    """One hash of the words in their order; each word's bits reach all others before the next one comes, as
    else differences in bytes that stand 8 apart could cancel."""
    x = _mixed(words[0])
    for word in words[1:]:
        x = _mixed(x + word)
    return x


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    np.any([x[1:] != x[:-1] for x in columns], axis=0, out=out[1:])
    return out


def _bytes(data: np.ndarray) -> np.ndarray:
    """8 bytes from each place on as a number; SPARE stands behind the data."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def window_hash(words: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The hash of the LENGTH bytes from each place on."""
    return _chained([words[p + k] for k in (*range(0, LENGTH - 8, 8), LENGTH - 8)])


def together(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([*texts, SPARE]), dtype=np.uint8)


def _places(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and each one's range."""
    size = end - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (first - np.cumsum(size) + size)[of], of


class Block:
    """The anchors of a block of texts, and the windows that each one is the own anchor of, as positions in the
    texts' concatenation. Own anchors never go back, so these windows are a range, ``first`` to ``end``."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        self.data, self.ids = together(texts), ids
        self.words, self.ends = _bytes(self.data), np.cumsum([len(x) for x in texts])
        n = len(self.data) - len(SPARE)
        if n < LENGTH:
            self.first = self.end = self.a = self.text = np.zeros(0, dtype=np.int64)
        else:
            self._find(n)
        words = [self.words[self.a + k] for k in (0, 8, SEED - 8)]
        self.seed = _chained(words)
        self.check = (_chained([x ^ y for x, y in zip(words, ODD)]) >> np.uint64(32)).astype(np.uint32)

    def _find(self, n: int) -> None:
        key = self.words[:n] * BASE
        if n <= 1 << 32 - ORDER_BITS:
            low, place = key.view("<u4")[1::2] & np.uint32((1 << ORDER_BITS) - 1 << 32 - ORDER_BITS), np.uint32((1 << 32 - ORDER_BITS) - 1)
        else:
            low, place = key & np.uint64((1 << ORDER_BITS) - 1 << 64 - ORDER_BITS), np.uint64((1 << 64 - ORDER_BITS) - 1)
        low |= np.arange(n, dtype=low.dtype)
        width = 1
        while width * 2 <= REACH + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (REACH + 1 - width)], low[REACH + 1 - width :])
        change = np.ones(len(low), dtype=bool)
        np.not_equal(low[1:], low[:-1], out=change[1:])
        begin = np.concatenate([[0], self.ends[:-1]])
        change[begin[begin < len(low)]] = True
        change[np.maximum(begin, self.ends - LENGTH + 1)[begin < len(low)]] = True  # here no window begins any more
        first = np.flatnonzero(change)
        text = np.searchsorted(self.ends, first, side="right")
        whole = first <= self.ends[text] - LENGTH
        self.first, self.end, self.text = first[whole], np.append(first[1:], len(low))[whole], text[whole]
        self.a = (low[self.first] & place).astype(np.int64)

    def seeds(self) -> tuple[np.ndarray, ...]:
        return self.seed, self.check, self.ids[self.text]

    def look_at(self, seeds: "Ranks") -> None:
        """Windows whose own anchors repeat, in ranges that have the same anchors around them, and the pairs of these."""
        n, _ = seeds.of(self.seed, self.check)
        mark = np.zeros(len(self.data) + 1, dtype=np.uint8)
        mark[self.end] = 8
        mark[self.first] = 1
        mark[self.a] |= 2
        after = self.a - REACH + 1  # from here on, a window's last seed stands behind this anchor
        mark[after[after > 0]] |= 4
        p = np.flatnonzero(mark != 0)
        kind = mark[p]
        own, left = np.cumsum(kind & 1, dtype=np.int64) - 1, np.cumsum(kind >> 1 & 1, dtype=np.int64) - 1
        right = np.cumsum(kind >> 2 & 1, dtype=np.int64) + int((after <= 0).sum())
        at = np.flatnonzero((own >= 0) & (p < self.end[own]) & (n[own] > 1)) if len(n) else own[:0]
        self.p, self.to, self.anchor = p[at], np.append(p[1:], len(mark))[at], own[at]
        self.own, left, right, text = n[self.anchor], left[at], right[at], self.text[self.anchor]
        at = np.flatnonzero((left >= 0) & (right < len(self.a)))
        left, right, text = left[at], right[at], text[at]
        lone = np.concatenate([[0], np.cumsum(n == 1)])  # a pair with an anchor that no other document has is unique too
        inside = (self.text[left] == text) & (self.text[right] == text) & (lone[right + 1] == lone[left])
        self.inside, left, right = at[inside], left[inside], right[inside]
        new = _new(left, right)
        self.pair_of = np.cumsum(new) - 1
        self.left, self.right = left[new], right[new]
        self._name_pairs()

    def _name_pairs(self) -> None:
        """A pair's name is made of the seeds from its first to its last anchor and what stands between them."""
        step = np.clip(np.diff(self.a, append=0), 0, REACH + 1)  # of a text's last anchor it is not used
        link = _chained([self.seed + step.astype(np.uint64) * ODD[3], *(self.words[self.a + SEED + 8 * k] & BEHIND[k][step] for k in (0, 1))])
        up, down = _power(len(link))
        up, down, zero = up[: len(link)], down[self.left], np.zeros(1, dtype=np.uint64)
        sums, checks = (np.concatenate([zero, np.cumsum(x * up, dtype=np.uint64)]) for x in (link, self.check * ODD[4]))
        self.pair = _mixed((sums[self.right] - sums[self.left]) * down + self.seed[self.right] * ODD[5])
        check = (checks[self.right] - checks[self.left]) * down + self.check[self.right] * ODD[6]
        self.pair_check = (_mixed(check) >> np.uint64(32)).astype(np.uint32)

    def pairs(self) -> tuple[np.ndarray, ...]:
        return self.pair, self.pair_check, self.ids[self.text[self.left]]

    def decide(self, pairs: "Ranks") -> None:
        """Ranges of windows that a smaller document has by their pair, and those still to be ranked."""
        n, least = pairs.of(self.pair, self.pair_check)
        self.gone, closed = np.zeros(len(self.p), dtype=bool), np.zeros(len(self.p), dtype=bool)
        self.gone[self.inside] = least[self.pair_of] < self.ids[self.text[self.left]][self.pair_of]
        closed[self.inside] = n[self.pair_of] == self.own[self.inside]
        self.open = np.flatnonzero(~self.gone & ~closed)

    def runs(self) -> tuple[np.ndarray, ...]:
        """Open windows as runs around one anchor: the anchor's rank, the run's hash, id, start and end."""
        p, to, a = self.p[self.open], self.to[self.open], self.anchor[self.open]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != to[:-1]) | (a[1:] != a[:-1])
        at = np.flatnonzero(new)
        start, last, a = p[at], to[np.append(at[1:], len(p)) - 1] - 1 if len(p) else p, a[at]
        name = _mixed(window_hash(self.words, start) * ODD[7] + window_hash(self.words, last) * ODD[8] + (last - start).astype(np.uint64))  # the two cover the run
        return self.seed[a], name, self.ids[self.text[a]], start, last + LENGTH

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs of bytes that windows cover which a smaller document has by their pair."""
        return merged(self.ends, self.p[self.gone], self.to[self.gone] - 1 + LENGTH)[1:]


def merged(ends: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of what ranges in the order of their starts, each within a text, cover together."""
    text, end = np.searchsorted(ends, start, side="right"), np.maximum.accumulate(end)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] > end[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], start[at], end[np.append(at[1:], len(end)) - 1] if len(end) else end


def removed(texts: list[bytes], ids: np.ndarray, cuts: tuple[np.ndarray, ...], windows: "Ranks") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of bytes that windows cover which a smaller document has. cuts: (start, end, m, open) of
    runs that it has, and of open ones around anchors of rank m."""
    start, end, m, opened = cuts
    words, ends = _bytes(together(texts)), np.cumsum([len(x) for x in texts])
    p, of = _places(start[opened], end[opened] - LENGTH + 1)
    own = ids[np.searchsorted(ends, start[opened], side="right")] if opened.any() else start[opened]
    p = p[windows.of(window_hash(words, p), m[opened][of])[1] < own[of]]
    start, end = np.concatenate([start[~opened], p]), np.concatenate([end[~opened], p + LENGTH])
    order = np.argsort(start)
    return merged(ends, start[order], end[order])


class Ranks:
    """How often a string occurs, and the smallest document that has it, for those of several documents."""

    def __init__(self, h: np.ndarray, g: np.ndarray, n: np.ndarray, least: np.ndarray):
        g = g.view(np.uint32 if g.itemsize == 4 else np.uint64)
        order = np.argsort(h.view(np.uint64))
        self.h, self.g, self.n, self.least = h.view(np.uint64)[order], g[order], n[order], least[order]
        self.shared = bool((self.h[1:] == self.h[:-1]).any())  # different strings of one hash
        bits = max(1, len(h).bit_length())
        self.shift = np.uint64(64 - bits)
        size = np.bincount((self.h >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = (np.cumsum(size) - size).astype(np.int32 if len(h) < 1 << 31 else np.int64)

    def of(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """1 and the largest id for strings that don't repeat."""
        n, least = np.ones(len(h), dtype=np.int64), np.full(len(h), NO_ID)
        if not len(self.h):
            return n, least
        at, todo, last = self.start[h >> self.shift], np.arange(len(h)), len(self.h) - 1
        at = np.minimum(at, last)
        while len(todo):  # hashes are spread evenly, so few stand before the one looked for
            found, own = self.h[at], h[todo]
            hit = np.flatnonzero(found == own)
            hit = hit[self.g[at[hit]] == g[todo[hit]]]
            n[todo[hit]], least[todo[hit]] = self.n[at[hit]], self.least[at[hit]]
            more = found < own
            if self.shared:
                more |= found == own
                more[hit] = False
            more = np.flatnonzero(more & (at < last))
            at, todo = at[more] + 1, todo[more]
        return n, least


def by_name(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal names together, and where in it each name begins."""
    order = np.argsort(h)
    new = _new(h[order])
    if (g[order][1:] != g[order][:-1])[~new[1:]].any():
        order = np.lexsort((g, h))
        new = _new(h[order], g[order])
    return order, np.flatnonzero(new)


class Tally:
    """How often each string occurs in a part, the smallest document that has it, and how far off the largest is."""

    def __init__(self):
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, found: tuple[np.ndarray, ...]) -> None:
        self.found.append(found)

    def batches(self, part: int) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        h, g, ids = map(np.concatenate, zip(*self.found))
        self.found.clear()
        order, first = by_name(h, g)
        ids, n, names = ids[order], np.diff(first, append=len(order)), order[first]
        for low in range(0, len(first), 1 << 16):
            to = slice(low, low + (1 << 16))
            own, end = first[to], len(order) if low + (1 << 16) >= len(first) else first[low + (1 << 16)]
            least, most = (x.reduceat(ids[own[0] : end], own - own[0]) for x in (np.minimum, np.maximum))
            columns = h[names[to]].view(np.int64), g[names[to]].view(np.int32), least, most - least, n[to], np.full(len(own), part, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["h", "g", "least", "spread", "n", "part"])


class Runs:
    """The runs of a part, equal ones once, with the smallest and largest documents that have them; and where runs stand in
    the concatenation of the part's texts, with those that a smaller document has by their pairs."""

    def __init__(self):
        self.found, self.bytes, self.cuts, self.base = [], [], [], 0

    def add(self, block: Block) -> None:
        m, h, ids, start, end = block.runs()
        taken, until = block.taken()
        opened = np.repeat([True, False], [len(start), len(taken)])
        at = np.concatenate([start, taken])
        order = np.argsort(at)
        columns = at + self.base, np.concatenate([end, until]) + self.base, np.concatenate([m, np.zeros(len(taken), dtype=np.uint64)]), opened
        self.cuts.append([x[order] for x in columns])
        self.base += len(block.data) - len(SPARE)
        if not len(m):
            return
        order, first = by_name(h, m)
        pick = order[first]
        self.found.append((h[pick], m[pick], np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)))
        self.bytes += [block.data[x:y].tobytes() for x, y in zip(start[pick].tolist(), end[pick].tolist())]

    def places(self) -> pa.Table:
        return pa.table([np.concatenate(x) for x in zip(*self.cuts)], names=["start", "end", "m", "open"])

    def batches(self, part: int) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        h, m, least, most = map(np.concatenate, zip(*self.found))
        order, first = by_name(h, m)
        least, most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
        pick = order[first]
        for low in range(0, len(pick), 1 << 15):
            at = pick[low : low + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(m[at].view(np.int64)), pa.array(np.full(len(at), part, dtype=np.int32)), pa.array(least[low : low + len(at)].astype(np.int64)), pa.array(most[low : low + len(at)].astype(np.int64)), pa.array([self.bytes[i] for i in at.tolist()], pa.binary())], names=["m", "part", "least", "most", "bytes"])


def ranked_windows(runs: DataFrame) -> DataFrame:
    """(part, h, g, n, least) of the windows that a smaller document has, for the parts whose documents have them.
    Equal windows have equal anchors, so they meet in the task of their anchor's rank."""

    def spread(group: pa.Table) -> pa.RecordBatch:
        texts = group.column("bytes").to_pylist()
        part, least, most, m = (group.column(x).to_numpy() for x in ("part", "least", "most", "m"))
        words, size = _bytes(together(texts)), np.array([len(x) for x in texts])
        p, row = _places(np.cumsum(size) - size, np.cumsum(size) - LENGTH + 1)
        h, g = window_hash(words, p), m.view(np.uint64)[row]
        order, first = by_name(h, g)
        size = np.diff(np.append(first, len(h)))
        again = np.flatnonzero(np.repeat(size, size) > 1)  # windows that have company: are they the same bytes?
        mine, theirs = p[order[again]], p[order[np.repeat(first, size)[again]]]
        for step in (0, 8, 16, 24, 32, 40, LENGTH - 8):
            if (words[mine + step] != words[theirs + step]).any():
                raise ValueError("two windows have one name")
        lowest = np.repeat(np.minimum.reduceat(least[row[order]], first), size)
        hit = order[lowest < most[row[order]]]
        key = np.empty(len(h), dtype=np.int64)
        key[order] = lowest
        if len(hit):
            by_part = np.lexsort((part[row[hit]], g[hit], h[hit]))
            hit = hit[by_part]
            hit = hit[np.concatenate([[True], (h[hit][1:] != h[hit][:-1]) | (g[hit][1:] != g[hit][:-1]) | (part[row[hit]][1:] != part[row[hit]][:-1])])]
        return pa.RecordBatch.from_arrays([pa.array(part[row[hit]].astype(np.int32)), pa.array(h[hit].view(np.int64)), pa.array(g[hit].view(np.int64)), pa.array(np.full(len(hit), 2)), pa.array(key[hit])], names=["part", "h", "g", "n", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows < RUNS_AT_ONCE:
                continue
            m = table.column("m").to_numpy()
            cut = int(np.searchsorted(m, m[-1]))  # the last anchor's group may go on
            if cut:
                yield spread(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield spread(table)

    return runs.repartition("m").sortWithinPartitions("m").mapInArrow(run, "part int, h long, g long, n long, least long")


def repeated(ranks: DataFrame) -> DataFrame:
    """Of rows RANKS, those whose string more than one document has, with the totals
    over all parts. A string has at most one row a part, whatever the number of its copies."""
    same = Window.partitionBy("h", "g")
    totals = ranks.select("part", "h", "g", F.sum("n").over(same).alias("n"), F.min("least").over(same).alias("least"), F.max(F.col("least") + F.col("spread")).over(same).alias("most"))
    return totals.where("least != most").select("part", "h", "g", "n", "least")


def _ranks(rows: pa.Table | None) -> Ranks:
    empty = np.zeros(0, dtype=np.int64)
    return Ranks(*(rows.column(x).to_numpy() for x in ("h", "g", "n", "least"))) if rows is not None else Ranks(empty, empty, empty, empty)


def remove_repeats(docs: DataFrame, bytes_too: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every document without the bytes covered
    by a LENGTH-byte string that also starts in a document with a smaller doc_id. Without ``bytes_too`` there is no
    ``kept``, which then does not leave the tasks.

    A null text counts as empty and stays empty. Documents of the same id don't remove each other's
    bytes; a null id counts as larger than all others. Equal texts of one id keep the same bytes. A text is
    taken whole, whatever its length (up to 2 GB, Arrow's limit). An empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder, dealt = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}", max(docs.rdd.getNumPartitions(), 1)

    def seeds(part: int, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch, texts in blocks:
            tally.add(Block(texts, ids_of(batch)).seeds())
        yield from tally.batches(part)

    with short_lived_shuffles(spark):
        save_rows(repeated(write_parts(docs, folder, seeds, RANKS, size=BLOCK)), dealt, folder, SEEDS)
    parts = written_parts(folder)
    if not parts:
        return spark.createDataFrame([], RESULT)

    def pairs(part: int, saved: dict, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        tally, known = Tally(), _ranks(saved[SEEDS])
        for batch, texts in blocks:
            block = Block(texts, ids_of(batch))
            block.look_at(known)
            tally.add(block.pairs())
        yield from tally.batches(part)

    with short_lived_shuffles(spark):
        save_rows(repeated(over_saved(spark, parts, folder, [SEEDS], pairs, RANKS, BLOCK)), parts, folder, PAIRS)

    def runs(part: int, saved: dict, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        found, known = Runs(), {x: _ranks(y) for x, y in saved.items()}
        for batch, texts in blocks:
            block = Block(texts, ids_of(batch))
            block.look_at(known[SEEDS])
            block.decide(known[PAIRS])
            found.add(block)
        keep_rows(folder, CUTS, part, found.places())
        yield from found.batches(part)

    with short_lived_shuffles(spark):
        save_rows(ranked_windows(over_saved(spark, parts, folder, [SEEDS, PAIRS], runs, RUNS, BLOCK)), parts, folder, WINDOWS)

    names = [x.split()[0] for x in RESULT.split(", ")][: 6 if bytes_too else 5]

    def cut(part: int, saved: dict, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        windows, cuts, base, low = _ranks(saved[WINDOWS]), [saved[CUTS].column(x).to_numpy() for x in ("start", "end", "m", "open")], 0, 0
        for batch, texts in blocks:
            size = np.array([len(x) for x in texts], dtype=np.int64)
            high = int(np.searchsorted(cuts[0], base + size.sum()))
            start, end, m, opened = (x[low:high] for x in cuts)
            text, start, end = removed(texts, ids_of(batch), (start - base, end - base, m, opened), windows)
            base, low, begin = base + int(size.sum()), high, np.cumsum(size) - size
            gone, spans = np.zeros(len(texts), dtype=np.int64), np.bincount(text, minlength=len(texts))
            np.add.at(gone, text, end - start)
            kept, last = list(texts), np.cumsum(spans)
            for i in np.flatnonzero(spans).tolist():
                own = slice(last[i] - spans[i], last[i])
                edges = [0, *np.stack([start[own], end[own]], axis=1).ravel() - begin[i], size[i]]
                kept[i] = b"".join([texts[i][x:y] for x, y in zip(edges[::2], edges[1::2])])
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if bytes_too else columns, names=names)

    return over_saved(spark, parts, folder, [WINDOWS, CUTS], cut, RESULT if bytes_too else RESULT.rpartition(",")[0], BLOCK)


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir), bytes_too=False)
