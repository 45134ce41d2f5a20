"""Near-duplicate passages by compact windows.

For each of HASHES hash functions, the runs of SHINGLE_WORDS-word shingles in which a given shingle has
the least hash are the nodes of a Cartesian tree; a node (l, c, r) stands for all passages from [l, c]
to [c, r], which share that signature, and only nodes of at least MIN_SHINGLES shingles are kept: about
2 in MIN_SHINGLES (Deng et al., Near-duplicate sequence search at scale, 2021). So that a phrase of a few
words that thousands of documents hold does not bring them all together, a window's key is its signature
with the words that follow, or precede, it for REACH shingles.

1. Tasks pack their windows' keys by bucket; keys that occur once drop out (most do).
2. Windows of shared keys are joined, each with the one of the nearest smaller document, so a passage with
   any number of copies costs one link a copy. Texts of equal words count once.
3. Windows of different classes are joined with each other (see ``remaining``).

Where the intervals of at least MIN_MATCHES hash functions overlap in a document, the pair is verified on
the shingles themselves. Two passages of resemblance J share a signature with probability J for each hash
function, wherever they differ; a shared one is lost to the key if its common run goes on for fewer than
REACH shingles on either side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.llm.common import connected_components, documents, joined, shared_dir, short_lived_shuffles, staged
from ladderlens.llm.hashing import SPARE, xxh64
from ladderlens.llm.parts import NO_ID, Blocks, ids_of, over_parts, over_saved, save_rows, table_of, write_parts, written_parts

SHINGLE_WORDS = 5
#: Passages of at least this many words are found.
MIN_WORDS = 50
MIN_SHINGLES = MIN_WORDS - SHINGLE_WORDS + 1
SIMILARITY = 0.8
HASHES, MIN_MATCHES = 6, 2
#: Shingles on one side of a window's least one that its key holds too. Passages of resemblance SIMILARITY
#: have a common run of more than twice as many.
REACH = 2 * (SHINGLE_WORDS - 1)
#: Hits that make up for a miss: where both stretches differ alike, 2 S / (1 + S) of each match; where
#: all that differs is in one of them, S of it does.
COSTS = (2 * SIMILARITY / (1 - SIMILARITY), SIMILARITY / (1 - SIMILARITY))
#: Intervals whose offsets between the two documents differ by no more may be of one passage.
DRIFT = 16
#: Windows of one key that are joined with each other; of more, blocks of so many are compared by their shingles.
PER_TASK = 100
#: Windows of a class that a window of another meets at first, of each block that agrees with it.
FIRST = 3
#: Parts of the shingles of large keys.
BUCKETS = 256
SALTS = [np.uint64(int(x)) for x in np.random.default_rng(8).integers(1, 1 << 63, HASHES)]
SEVERAL = -1
#: Windows of one key that a text has up to which each is one of its own.
SEPARATE = 4
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: What of 8 bytes is kept of a word's last 0 to 8 bytes.
KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Of MIN_SHINGLES shingles in a row around c, how many two windows of a passage of that length have in common at
#: least. Shifts of up to so many words by words inserted or deleted are allowed for.
LEAST_COMMON, SHIFT = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * MIN_SHINGLES)), 3
#: Keys that a task holds before it packs them.
KEYS_HELD = 4_000_000
WINDOWS = "key long, doc long, part int, k int, l int, c int, r int"
WINDOW = [x.split()[0] for x in WINDOWS.split(", ")]
KEYS = "part int, bucket int, keys binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each word of ``data`` (16 spare bytes at its end): mixed from its bytes up to 16 of them, XXH64 beyond."""
    u8 = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        h = _mixed((u8[begins] & KEPT[np.minimum(sizes, 8)]) * np.uint64(0x9E3779B97F4A7C15))
        h = _mixed((h ^ (u8[begins + 8] & KEPT[np.clip(sizes - 8, 0, 8)]) ^ sizes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(sizes > 16)
    if len(long):
        h[long] = xxh64(data, begins[long], sizes[long], 1)
    return h


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (ASCII letters lower-cased, words between ASCII white space) and how many each
    text has: hashes of the words, combined as the digits of a number."""
    data, starts = joined([x.lower() for x in texts], b" ")
    data = np.concatenate([data, np.full(2 * SPARE, 32, dtype=np.uint8)])
    inside = ~WHITE[data]
    begins, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    words = np.diff(np.searchsorted(begins, starts))
    n = np.maximum(words - SHINGLE_WORDS + 1, 0)
    if not n.sum():
        return np.zeros(0, dtype=np.uint64), n
    word = _word_hashes(data, begins, ends - begins)
    with np.errstate(over="ignore"):
        h = word[: len(word) - SHINGLE_WORDS + 1].copy()
        for i in range(1, SHINGLE_WORDS):
            h = h * np.uint64(0x9E3779B97F4A7C15) + word[i : len(word) - SHINGLE_WORDS + 1 + i]
        first = np.cumsum(words) - words
        return _mixed(h[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]), n


class Laid(NamedTuple):
    """The shingle hashes of a block's texts in one row with a separator on either side of each text."""

    h: np.ndarray
    separators: np.ndarray
    first: np.ndarray
    longest: int


def laid_out(h: np.ndarray, n: np.ndarray) -> Laid:
    first = np.cumsum(n) - n + np.arange(len(n)) + 1
    out = np.zeros(len(h) + len(n) + 1, dtype=np.uint64)
    separators = np.concatenate([[0], first + n])
    inside = np.ones(len(out), dtype=bool)
    inside[separators] = False
    out[inside] = h
    return Laid(out, separators, first, int(n.max(initial=0)))


def _sliding(x: np.ndarray, spare: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i, by doubling; both arrays are written over."""
    size, reach = len(x), 1
    while 2 * reach <= width:
        size -= reach
        pick(x[:size], x[reach : reach + size], out=spare[:size])
        x, spare, reach = spare, x, 2 * reach
    more = width - reach
    if more:
        size -= more
        pick(x[:size], x[more : more + size], out=spare[:size])
        x = spare
    return x[:size]


def compact_windows(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    return _nodes(laid_out(h, n), k)


def _nodes(laid: Laid, k: int) -> tuple[np.ndarray, ...]:
    """(text, signature, l, c, r) of the k-th hash function's nodes of at least MIN_SHINGLES shingles.

    Separators are below all hashes. A place is least in some run of MIN_SHINGLES if the greatest of the minima
    of the runs that hold it is its own hash. How far such a place stays least is told by the nearest
    smaller one on either side, which is an ancestor in the tree and so one of these places too, or a
    separator: doubling over these few finds it. Of equal hashes the leftmost counts as least.
    """
    empty = np.zeros(0, dtype=np.int64)
    if laid.longest < MIN_SHINGLES:
        return empty, laid.h[:0], empty, empty, empty
    v = laid.h ^ SALTS[k]
    with np.errstate(over="ignore"):
        v *= np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
    np.maximum(v, np.uint64(1), out=v)
    v[laid.separators] = 0
    size = len(v)
    padded, spare = np.zeros(size + MIN_SHINGLES - 1, dtype=np.uint64), np.empty(size + MIN_SHINGLES - 1, dtype=np.uint64)
    low = _sliding(v.copy(), spare[:size], MIN_SHINGLES, np.minimum)
    padded[MIN_SHINGLES - 1 : MIN_SHINGLES - 1 + len(low)] = low  # the runs that start up to MIN_SHINGLES - 1 before a place hold it
    held = v == _sliding(padded, np.empty_like(padded), MIN_SHINGLES, np.maximum)
    held[laid.separators] = True
    some = np.flatnonzero(held)
    of, n = v[some], len(some)
    table, width = [of], 1
    while width < n:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]) if len(table[-1]) > width else table[-1][:0])
        width *= 2
    mine = np.flatnonzero(of)
    goal, left, right = of[mine], mine.copy(), mine + 1
    for level in range(len(table) - 1, -1, -1):
        t, step = table[level], 1 << level
        if not len(t):
            continue
        down = left - step
        ok = down >= 0
        ok[ok] = t[down[ok]] > goal[ok]
        left[ok] -= step
        ok = right + step <= n
        ok[ok] = t[right[ok]] >= goal[ok]
        right[ok] += step
    l, c, r = some[left - 1] + 1, some[mine], some[np.minimum(right, n - 1)] - 1
    keep = r - l + 1 >= MIN_SHINGLES
    l, c, r = l[keep], c[keep], r[keep]
    owner = np.searchsorted(laid.first, c, side="right") - 1
    base = laid.first[owner]
    return owner, goal[keep], l - base, c - base, r - base


def keyed_windows(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, text, key, l, c, r) of all windows of a block, once for each side of c on which the window goes on
    for REACH shingles: the key is of the signature and of the words that far to this side. Where these are
    one shingle again and again, the window counts only if it goes on so for MIN_SHINGLES. More than SEPARATE windows of
    a text with one key, as repeated words have them, are one with c = SEVERAL, from the first l to the last r.
    By text and key, ascending."""
    h, n = shingle_hashes(texts)
    begin, laid = np.cumsum(n) - n, laid_out(h, n)
    for k in range(HASHES):
        owner, _, l, c, r = _nodes(laid, k)
        for side in (1, -1):
            ok = np.flatnonzero(c + REACH <= r if side > 0 else c - REACH >= l)
            place = (begin[owner] + c)[ok]
            # one word, or two in turn, over and over: only where they fill a passage
            same = (h[place] == h[place + side * (SHINGLE_WORDS - 1)]) & (h[place] == h[place + side * REACH])
            at = ok[same]
            long = (r[at] - c[at] if side > 0 else c[at] - l[at]) >= MIN_SHINGLES - 1
            for step in range(REACH, MIN_SHINGLES, SHINGLE_WORDS - 1):
                long &= h[place[same]] == h[np.clip(place[same] + side * step, 0, len(h) - 1)]
            keep = ~same
            keep[same] = long
            ok, place = ok[keep], place[keep]
            with np.errstate(over="ignore"):
                key = np.full(len(ok), 2 * k + (side > 0), dtype=np.uint64)
                for step in range(0, REACH + 1, SHINGLE_WORDS - 1):
                    key = _mixed((key ^ h[place + side * step]) * np.uint64(0x9E3779B97F4A7C15))
            if not len(ok):
                continue
            order = np.lexsort((key, owner[ok]))
            at, key = ok[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[at][1:] != owner[at][:-1])]))
            sizes = np.diff(np.append(first, len(at)))
            few = np.flatnonzero(np.repeat(sizes <= SEPARATE, sizes))  # these stay as they are
            many = np.flatnonzero(sizes > SEPARATE)
            of, place = np.concatenate([at[few], at[first[many]]]), np.concatenate([few, first[many]])
            low, high = np.concatenate([l[at[few]], np.minimum.reduceat(l[at], first)[many]]), np.concatenate([r[at[few]], np.maximum.reduceat(r[at], first)[many]])
            middle = np.concatenate([c[at[few]], np.full(len(many), SEVERAL)])
            order = np.argsort(place, kind="stable")
            yield k, owner[of[order]], key[place[order]], low[order], middle[order], high[order]


def bucketed(key: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket and 32 bits of it as one number; a bucket holds few enough keys for these to do."""
    return (key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)


def _per_bucket(part: int, sorted_keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, bucket, keys) rows of ascending numbers from ``bucketed``."""
    bucket = (sorted_keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    keys = [x.astype("<u4").tobytes() for x in np.split(sorted_keys & np.uint64(0xFFFFFFFF), first[1:])] if len(first) else []
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(bucket[first].astype(np.int32)), pa.array(keys, pa.binary())], names=["part", "bucket", "keys"])


def shared_keys(rows: DataFrame, buckets: int) -> DataFrame:
    """Of (part, bucket, keys), where keys are packed numbers, those that occur twice anywhere, for each part that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            for part, bucket, keys in zip(*(batch.column(x).to_pylist() for x in ("part", "bucket", "keys"))):
                held.setdefault(bucket, []).append((part, np.frombuffer(keys, dtype="<u4")))
        for bucket, lists in held.items():
            every = np.sort(np.concatenate([x for _, x in lists]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            if not len(twice):
                continue
            for part, keys in lists:
                own = np.unique(keys)
                own = own[twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own]
                if len(own):
                    yield from _per_bucket(part, own.astype(np.uint64) | np.uint64(bucket << 32))

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, KEYS)


def overlaps(found: list[tuple[int, int, int, int | None, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of one pair's intervals (k, low, high, offset, other's low, other's high), the spans where at least
    MIN_MATCHES hash functions overlap at nearly one offset, with the other's span; joined where they touch.
    Intervals without an offset, if any, make one span with all others."""
    if any(x[3] is None for x in found):
        return [(min(x[1] for x in found), max(x[2] for x in found), min(x[4] for x in found), max(x[5] for x in found))]
    found.sort(key=lambda x: (x[3], x[1]))
    out, at = [], 0
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end][3] - found[end - 1][3] <= DRIFT:
            end += 1
        one, at = found[at:end], end
        offset = one[len(one) // 2][3]
        events = sorted([(x[1], 0, x[0]) for x in one] + [(x[2] + 1, -1, x[0]) for x in one], key=lambda x: x[:2])
        active, start = [0] * HASHES, None
        for place, ends, k in events:
            active[k] += -1 if ends else 1
            many = sum(x > 0 for x in active) >= MIN_MATCHES
            if many and start is None:
                start = place
            elif not many and start is not None:
                out.append((start, place - 1, start + offset - DRIFT, place - 1 + offset + DRIFT))
                start = None
    return [x for x in out if x[1] - x[0] + 1 >= MIN_SHINGLES]


def longest(hit: np.ndarray, cost: float) -> tuple[int, int]:
    """The longest [first, last) whose hits are worth its misses at ``cost`` hits a miss; the earliest of equals."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(hit, 1.0, -cost))])
    most = np.maximum.accumulate(sums[::-1])
    # the last place whose sum is not below that at the start, from the maxima of what follows
    last = len(hit) - np.searchsorted(most, sums)
    first = int((last - np.arange(len(sums))).argmax())
    return first, int(last[first])


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b."""
    if not len(b):
        return np.zeros(len(a), dtype=bool)
    ordered = np.sort(b)
    return ordered[np.minimum(np.searchsorted(ordered, a), len(b) - 1)] == a


def _tightened(hit: np.ndarray, first: int, last: int) -> tuple[int, int]:
    """[first, last) without misses at its ends, but not below MIN_SHINGLES."""
    at = np.flatnonzero(hit[first:last])
    if not len(at):
        return first, last
    low, high = first + int(at[0]), first + int(at[-1]) + 1
    low = max(first, min(low, max(high, first + MIN_SHINGLES) - MIN_SHINGLES))
    return low, min(last, max(high, low + MIN_SHINGLES))


def _resembles(mine: np.ndarray, b: np.ndarray) -> bool:
    """Whether ``mine`` and some stretch of at least MIN_SHINGLES of b are alike."""
    if len(b) < MIN_SHINGLES:
        return False
    # place by place, where the first shingle is: enough for copies with words replaced
    for at in np.flatnonzero(b[: len(b) - len(mine) + 1] == mine[0])[:4].tolist() if MIN_SHINGLES <= len(mine) <= len(b) else ():
        same = mine[b[at : at + len(mine)] == mine]
        if len(same) >= SIMILARITY * (2 * len(mine) - len(same)) and len(both := np.unique(same)) >= SIMILARITY * (2 * len(mine) - len(both)):
            return True
    mine = np.unique(mine)
    hit = _among(b, mine)
    held, width = np.concatenate([[0], np.cumsum(hit)]), min(max(len(mine), MIN_SHINGLES), len(b))
    start = int((held[width:] - held[:-width]).argmax())
    for first, last in [(start, start + width), *(longest(hit, x) for x in COSTS), (0, len(b))]:
        first, last = _tightened(hit, first, last)
        if last - first >= MIN_SHINGLES:
            other = np.unique(b[first:last])
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if both >= SIMILARITY * (len(mine) + len(other) - both):
                return True
    return False


def verified(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [first, last] of a's shingles of which SIMILARITY or more are b's too, longest first in
    each part, if they have MIN_SHINGLES and resemble a stretch of b as much."""
    hit, out, todo = _among(a, b), [], [(0, len(a))]
    while todo:
        low, high = todo.pop()
        if high - low < MIN_SHINGLES or hit[low:high].sum() < SIMILARITY * MIN_SHINGLES:
            continue
        widest = None
        for cost in COSTS:
            first, last = longest(hit[low:high], cost)
            if last - first < MIN_SHINGLES:
                continue
            first, last = _tightened(hit, low + first, low + last)
            widest = widest or (first, last)
            if _resembles(a[first:last], b):
                out.append((first, last - 1))
                todo += [(low, first), (last, high)]
                break
        else:
            # nothing is alike enough as a whole: try both sides of the longest run of mismatches
            if widest is None:
                continue
            first, last = widest
            gaps = np.flatnonzero(~hit[first:last])
            if len(gaps):
                gap = max(np.split(gaps, np.flatnonzero(np.diff(gaps) > 1) + 1), key=len)
                todo += [(low, first + int(gap[0])), (first + int(gap[-1]) + 1, high)]
            else:
                todo += [(low, first), (last, high)]
    return out


def candidates(rows: DataFrame, *more: str) -> DataFrame:
    """Windows with another document's window ``o`` of their key as intervals of ``doc`` that hold a passage,
    with the slack that words inserted or deleted between its ends and c need."""
    offset = F.when((F.col("c") != SEVERAL) & (F.col("o.c") != SEVERAL), F.col("o.c") - F.col("c"))
    low, high = F.greatest("l", F.col("o.l") - offset - DRIFT), F.least("r", F.col("o.r") - offset + DRIFT)
    rows = rows.select("doc", "part", F.col("o.doc").alias("other"), F.col("o.part").alias("other_part"), "k", low.alias("low"), high.alias("high"), offset.alias("offset"), F.col("o.l").alias("other_low"), F.col("o.r").alias("other_high"), *more)
    return rows.where(F.col("high") - F.col("low") + 1 >= MIN_SHINGLES)


def with_surroundings(part: int, rows: pa.Table, blocks: Blocks) -> Iterator[pa.RecordBatch]:
    """rows (doc, c, many and others) with ``near``: a byte for each of the shingles of ``doc`` less than MIN_SHINGLES from
    c, 0 beyond the text's ends; and, of those that are one of ``many``, ``bag``: 32 bits of each different one of them,
    and ``least``: how many different ones of any MIN_SHINGLES in a row a passage like it has in common with them."""
    wanted: dict[int, list[int]] = {}
    for i, x in enumerate(rows.column("doc").to_pylist()):
        wanted.setdefault(x, []).append(i)
    c, many = rows.column("c").to_pylist(), rows.column("many").to_pylist()
    for batch, texts in blocks:
        ids = ids_of(batch).tolist()
        some = [i for i, x in enumerate(ids) if x in wanted]
        h, n = shingle_hashes([texts[i] for i in some])
        small, picked, near, bag, least = (h >> np.uint64(56)).astype(np.uint8) | np.uint8(1), [], [], [], []
        edge = bytes(MIN_SHINGLES)
        for i, begin, count in zip(some, (np.cumsum(n) - n).tolist(), n.tolist()):
            own = edge + small[begin : begin + count].tobytes() + edge
            for row in wanted[ids[i]]:
                at = max(c[row], 0)
                picked.append(row)
                near.append(own[at + 1 : at + 2 * MIN_SHINGLES])
                around = h[begin + max(0, at - MIN_SHINGLES + 1) : begin + min(count, at + MIN_SHINGLES)].astype(np.uint32) if many[row] else h[:0].astype(np.uint32)
                bag.append(np.unique(around).view(np.int32))
                least.append(max(1, int(np.ceil(SIMILARITY * (MIN_SHINGLES - (len(around) - len(bag[-1])))))))
        chosen = rows.take(pa.array(picked, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(chosen.column(x).to_pylist(), rows.schema.field(x).type) for x in rows.column_names] + [pa.array(near, pa.binary()), pa.array(bag, pa.list_(pa.int32())), pa.array(least, pa.int32())], names=[*rows.column_names, "near", "bag", "least"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and b (``near``), whether MIN_SHINGLES shingles in a row, c among them, have LEAST_COMMON in
    common within a few words' shift."""
    width = 2 * MIN_SHINGLES - 1
    hit = a == b
    for step in range(1, SHIFT + 1):
        hit[:, step:] |= a[:, step:] == b[:, :-step]
        hit[:, :-step] |= a[:, :-step] == b[:, step:]
    sums = np.zeros((len(a), width + 1), dtype=np.uint8)
    np.cumsum(hit & (a > 0), axis=1, dtype=np.uint8, out=sums[:, 1:])
    return (sums[:, MIN_SHINGLES:] - sums[:, :MIN_SHINGLES]).max(axis=1, initial=0) >= LEAST_COMMON


def _near(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 2 * MIN_SHINGLES - 1)


def surroundings_agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (with near and o_near) whose surroundings agree, without these columns; those without one offset stay."""
    for batch in batches:
        keep = _agree(_near(batch.column("near")), _near(batch.column("o_near")))
        keep |= batch.column("offset").is_null().to_numpy(zero_copy_only=False)
        yield batch.drop_columns(["near", "o_near"]).filter(pa.array(keep))


def telling_shingles(windows: DataFrame) -> DataFrame:
    """(key, shingles) of windows (key, component, bag): shingles, packed, that windows of several classes of the key have.

    A task sends each shingle once for all of its windows of one class, packed by bucket of key and shingle.
    """

    def distinct(key: np.ndarray, shingle: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((component, shingle, key))
        key, shingle, component = key[order], shingle[order], component[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (shingle[1:] != shingle[:-1]) | (component[1:] != component[:-1])
        return key[new], shingle[new], component[new]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bag = batch.column("bag")
            row = np.repeat(np.arange(len(bag)), bag.value_lengths().to_numpy())
            key, shingle, component = distinct(batch.column("key").to_numpy()[row], bag.flatten().to_numpy(), batch.column("component").to_numpy()[row])
            with np.errstate(over="ignore"):
                bucket = (_mixed((key ^ shingle).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            parts = [[x.tobytes() for x in np.split(y[order], first[1:])] if len(first) else [] for y in (key, shingle, component)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first].astype(np.int32)), *[pa.array(x, pa.binary()) for x in parts]], names=["bucket", "key", "shingle", "component"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=t) for x, t in (("key", np.int64), ("shingle", np.int32), ("component", np.int64))) for batch in batches]
        if not held:
            return
        key, shingle, _ = distinct(*map(np.concatenate, zip(*held)))
        again = np.zeros(len(key), dtype=bool)  # the second of a shingle's classes
        again[1:] = (key[1:] == key[:-1]) & (shingle[1:] == shingle[:-1])
        again[2:] &= (key[2:] != key[:-2]) | (shingle[2:] != shingle[:-2])
        key, shingle = key[again], shingle[again]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array([x.tobytes() for x in np.split(shingle, first[1:])] if len(first) else [], pa.binary())], names=["key", "shingles"])

    return windows.select("key", "component", "bag").mapInArrow(packed, "bucket int, key binary, shingle binary, component binary").repartition("bucket").mapInArrow(told, "key long, shingles binary")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, piece), which come one group after the other."""
    held: list[pa.Table] = []
    for batch in batches:
        key, piece = batch.column("key").to_numpy(), batch.column("piece").to_numpy()
        for low, high in zip(*(lambda x: (x, np.append(x[1:], len(key))))(np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(piece, prepend=piece[:1]) != 0)))):
            if held and (held[0].column("key")[0].as_py(), held[0].column("piece")[0].as_py()) != (key[low], piece[low]):
                yield pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
    if held:
        yield pa.concat_tables(held)


def qualified(windows: DataFrame) -> DataFrame:
    """Windows that have at least ``least`` shingles in common with other classes of their key."""
    pieces, columns = F.ceil(F.col("n") / (10 * PER_TASK)).cast("int"), windows.columns
    told = telling_shingles(windows).join(windows.groupBy("key").agg(F.max("n").alias("n")), "key").select("key", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "shingles")
    rows = windows.withColumn("piece", F.pmod(F.hash("doc", "c"), pieces)).unionByName(told, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches):
            words = [x for x in group.column("shingles").to_pylist() if x is not None]
            group = group.filter(group.column("bag").is_valid()).combine_chunks()
            if not words or not group.num_rows:
                continue
            vocabulary, bag = np.sort(np.frombuffer(b"".join(words), dtype=np.int32)), group.column("bag").combine_chunks()
            flat = bag.flatten().to_numpy()
            hit = vocabulary[np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)] == flat
            row = np.repeat(np.arange(len(bag)), bag.value_lengths().to_numpy())
            some = group.filter(pa.array(np.bincount(row[hit], minlength=len(bag)) >= group.column("least").to_numpy()))
            yield from some.select(columns).combine_chunks().to_batches()

    return rows.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(run, windows.schema)


def meetings(windows: DataFrame) -> DataFrame:
    """(key, doc, c, component, theirs, found) of windows (key, n, doc, c, component, bag, least) of large keys: the windows
    ``found`` of class ``theirs`` (doc, c; smallest doc first) that have at least ``least`` different shingles in common
    with one of a class ``component``, and, where windows have ``near``, whose surroundings agree with its.

    All pairs of windows of different classes count, in blocks of PER_TASK; but a window that shares too few shingles
    with all other classes together is alike to none. A key's largest class, which has most windows of copied passages,
    asks nobody: it is asked by the others. So the work is a key's windows times those outside of its largest class.
    """
    spark, names = windows.sparkSession, ["key", "doc", "c", "component", "bag", "least", *[x for x in windows.columns if x == "near"]]
    with short_lived_shuffles(spark):
        rows = staged(qualified(windows.select(*names, "n")).select(*names), "qualified")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(F.sum("size").alias("windows"), F.max_by("component", F.struct("size", "component")).alias("top"), F.count("*").alias("classes"))
    rows = rows.join(sizes.where("classes > 1").select("key", "top", F.ceil(F.col("windows") / PER_TASK).cast("int").alias("pieces")), "key")
    asked = rows.select(*names, "top", F.pmod(F.hash("doc"), "pieces").alias("piece"), F.lit(False).alias("asks"))
    asking = rows.where("component != top").select(*names, "top", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("asks"))

    def matrix(bag: pa.ListArray, vocabulary: np.ndarray) -> np.ndarray:
        flat, row = bag.flatten().to_numpy(), np.repeat(np.arange(len(bag)), bag.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        hit, out = vocabulary[at] == flat, np.zeros((len(bag), len(vocabulary)), dtype=np.float32)
        out[row[hit], at[hit]] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches):
            every = group.filter(group.column("asks")).combine_chunks()
            theirs = group.filter(pa.array(~group.column("asks").to_numpy())).sort_by("doc").combine_chunks()
            for low in range(0, every.num_rows if theirs.num_rows else 0, PER_TASK):
                mine = every.slice(low, PER_TASK).combine_chunks()
                vocabulary = np.unique(mine.column("bag").combine_chunks().flatten().to_numpy())
                if not len(vocabulary):
                    continue
                common = matrix(mine.column("bag").combine_chunks(), vocabulary) @ matrix(theirs.column("bag").combine_chunks(), vocabulary).T
                ours, other, top = mine.column("component").to_numpy()[:, None], theirs.column("component").to_numpy()[None, :], mine.column("top").to_numpy()[:, None]
                ok = (common >= np.maximum(mine.column("least").to_numpy()[:, None], theirs.column("least").to_numpy()[None, :])) & (ours != other) & ((other == top) | (other < ours))
                i, j = np.nonzero(ok)
                if "near" in names:
                    a, b = _near(mine.column("near").combine_chunks()), _near(theirs.column("near").combine_chunks())
                    keep = np.concatenate([np.zeros(0, dtype=bool), *[_agree(a[i[x : x + 4096]], b[j[x : x + 4096]]) for x in range(0, len(i), 4096)]])
                    i, j = i[keep], j[keep]
                order = np.lexsort((j, other[0, j], i))
                i, j = i[order], j[order]
                first = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(other[0, j], prepend=other[0, j[:1]]) != 0))
                found = pa.ListArray.from_arrays(pa.array(np.append(first, len(i)).astype(np.int32)), pa.StructArray.from_arrays([theirs.column(x).combine_chunks().take(pa.array(j)) for x in ("doc", "c")], ["doc", "c"]))
                chosen = mine.take(pa.array(i[first]))
                yield pa.RecordBatch.from_arrays([*[chosen.column(x).combine_chunks() for x in ("key", "doc", "c", "component")], pa.array(other[0, j[first]]), found], names=["key", "doc", "c", "component", "theirs", "found"])

    return asked.union(asking).repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(run, "key long, doc long, c int, component long, theirs long, found array<struct<doc: bigint, c: int>>")


def unfolded(met: DataFrame) -> DataFrame:
    """Pairs (key, doc, c, o_doc, o_c), the smaller document second, of ``meetings``."""
    pairs = met.select("key", "doc", "c", F.explode("found").alias("o"))
    mine, later = F.struct("doc", "c"), F.col("doc") > F.col("o.doc")
    pairs = pairs.select("key", F.when(later, mine).otherwise(F.col("o")).alias("a"), F.when(later, F.col("o")).otherwise(mine).alias("b"))
    return pairs.select("key", "a.doc", "a.c", F.col("b.doc").alias("o_doc"), F.col("b.c").alias("o_c")).distinct()


def by_shingles(windows: DataFrame) -> DataFrame:
    """Pairs (key, doc, c, o_doc, o_c) of windows (key, n, doc, c, component, bag, least) of one key and different classes that
    have at least ``least`` different shingles in common: see ``meetings``."""
    return unfolded(meetings(windows))


class Remaining(NamedTuple):
    """Candidates beyond the nearest smaller document; of large keys, windows that met, and their rows; and the classes
    (node, component) from before."""

    first: DataFrame
    met: DataFrame
    windows: DataFrame
    classes: DataFrame

    def of(self, met: DataFrame) -> DataFrame:
        pairs = unfolded(met)
        others = self.windows.select("key", F.col("doc").alias("o_doc"), F.col("c").alias("o_c"), F.struct("doc", "part", "l", "c", "r").alias("o"))
        return candidates(pairs.join(self.windows.select(*WINDOW), ["key", "doc", "c"]).join(others, ["key", "o_doc", "o_c"]))

    def rest(self, links: DataFrame) -> DataFrame | None:
        """All pairs of ``met`` whose classes ``links``, which ``first`` has led to, have not made one; None if there are none."""
        if self.met.isEmpty():
            return None
        of = [self.classes.select(F.col("node").alias(x), F.col("component").alias(f"{x}_class")) for x in ("doc", "other")]
        ends = links.join(of[0], "doc", "left").join(of[1], "other", "left")
        now = connected_components(ends.select(F.coalesce("doc_class", "doc").alias("a"), F.coalesce("other_class", "other").alias("b")))
        mine, other = (now.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("component", "mine"), ("theirs", "other")))
        met = staged(self.met.join(mine, "component", "left").join(other, "theirs", "left").where("coalesce(mine, component) != coalesce(other, theirs)").select(*self.met.columns), "rest")
        return None if met.isEmpty() else self.of(met)


def remaining(shared: DataFrame, links: DataFrame, parts: int, folder: str) -> Remaining:
    """Candidates beyond the nearest smaller document, given the links to those: all pairs of windows of one
    key whose documents are not in one class yet, so that documents alike in any pair of their windows end in
    one; and, with the smallest document of its key, each window that lies in no linked passage.

    Pairs whose surroundings of c differ too much for a passage there are not passed on. Of a key with more than
    PER_TASK windows, as phrases of 13 to 49 words in very many documents have, windows meet in blocks (see ``meetings``),
    at first up to FIRST of each class and block: one link makes one class of two, and only pairs of classes that have
    none by then need the others (``Remaining.rest``). Windows of repeated words have no one place and meet all, in blocks.
    """
    component = connected_components(links.select(F.col("doc").alias("a"), F.col("other").alias("b")))
    with short_lived_shuffles(shared.sparkSession):
        named = shared.groupBy("key", "doc").agg(F.max(F.col("c") == SEVERAL).alias("several")).join(component, F.col("doc") == F.col("node"), "left").select("key", "several", F.coalesce("component", "doc").alias("component"))
        mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), F.count_if("several").alias("repeated")).where("a != b")
        rows = shared.join(mixed.select("key", "n", "repeated"), "key").join(component, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc"))
        rows = rows.select("key", "doc", "part", "k", "l", "c", "r", "component", "n", "repeated", (F.col("n") > PER_TASK).alias("many"), F.col("o").isNotNull().alias("later"))
        rows = staged(over_parts(rows, parts, folder, with_surroundings, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", near binary, bag array<int>, least int"), "mixed")
        spans = links.groupBy(F.col("doc").alias("node")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        low, high = F.when(F.col("c") == SEVERAL, F.col("l")).otherwise(F.col("c")), F.when(F.col("c") == SEVERAL, F.col("r")).otherwise(F.col("c"))
        inside = F.exists("spans", lambda x: (x["start"] <= low) & (high + SHINGLE_WORDS <= x["end"]))
        lone = shared.where("f.doc < o.doc").join(spans, F.col("doc") == F.col("node"), "left").where(~F.coalesce(inside, F.lit(False)))
    big, several = F.col("many"), F.col("c") == SEVERAL
    pieces = F.when(big, F.ceil(F.col("repeated") / PER_TASK)).otherwise(1).cast("int")
    all_meet = rows.where(~big | (F.col("repeated") > 0))
    # whom a window meets: 0 all of a small key; in a big one 1 every earlier window, 2 earlier ones of repeated words
    asks = F.when(~big, 0).when(several, 1).otherwise(2)
    heard = F.when(~big, F.array(F.lit(0))).when(several, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    later = all_meet.where("later").select(*WINDOW, "component", "near", asks.alias("meets"), F.pmod(F.hash("doc", "c"), pieces).alias("piece"))
    earlier = all_meet.select("key", F.struct("doc", "part", "l", "c", "r").alias("o"), F.col("component").alias("theirs"), F.col("near").alias("o_near"), F.explode(heard).alias("meets"), pieces.alias("pieces"))
    earlier = earlier.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    across = candidates(later.join(earlier, ["key", "meets", "piece"]).where("o.doc < doc AND component != theirs"), "near", "o_near")
    plain = rows.where(big & ~several)
    met = staged(meetings(plain), "met")
    alone = candidates(lone.drop("o").withColumnRenamed("f", "o"))
    out = Remaining(across, met, plain, component)
    first = out.of(met.withColumn("found", F.slice("found", 1, FIRST)))
    return out._replace(first=across.mapInArrow(surroundings_agree, alone.schema).union(first).union(alone).distinct())


def near_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, links): (doc, n_words) of every row, and verified links (doc, other, start, end) where
    words [start, end) of ``doc`` are a near copy of a passage of ``other``, a document of smaller id.

    Texts of equal words link to the smallest document that has them and are not compared further. Null
    and empty texts have no passages; rows without an id are not compared; rows of one id count as one
    document. Any length of text is taken whole. An empty table gives empty ones.
    """
    spark = docs.sparkSession
    folder, buckets = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}", max(2 * docs.rdd.getNumPartitions(), 1)

    def about(texts: list[bytes]) -> dict[str, pa.Array]:
        split = [x.lower().split() for x in texts]
        return {"n_words": pa.array([len(x) for x in split], pa.int64()), "digest": pa.array([blake2b(b" ".join(x), digest_size=16).digest() for x in split], pa.binary())}

    def tally(part: int, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint64)
            held.clear()
            # a key that is there several times is sent twice, which says that it is shared
            third = np.concatenate([[False, False], (keys[2:] == keys[1:-1]) & (keys[1:-1] == keys[:-2])]) if len(keys) > 2 else np.zeros(len(keys), dtype=bool)
            yield from _per_bucket(part, keys[~third])

        for batch, texts in blocks:
            known = ids_of(batch) != NO_ID
            for _, owner, key, *_ in keyed_windows(texts):
                once = known[owner]
                once[1:] &= (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])  # a text's own repetitions don't share a key
                held.append(bucketed(key[once], buckets))
            if sum(map(len, held)) > KEYS_HELD:
                yield from packed()
        yield from packed()

    with short_lived_shuffles(spark):
        save_rows(shared_keys(write_parts(docs, folder, tally, KEYS, about), buckets), buckets, folder, "shared")
    if not (parts := written_parts(folder)):
        return spark.createDataFrame([], "doc long, n_words long"), spark.createDataFrame([], "doc long, other long, start long, end long")
    listed = table_of(spark, folder, "doc_id long, n_words long, digest binary")
    first = listed.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = staged(listed.join(first, "digest").where("doc_id > first").select("part", F.col("doc_id").alias("doc"), "first", "n_words", "digest").distinct(), "copies")
    with short_lived_shuffles(spark):
        save_rows(copies.select("part", "doc", "digest"), parts, folder, "copies")

    def windows_of(part: int, saved: dict, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        if saved["shared"] is None:
            return
        known = np.sort(np.concatenate([np.frombuffer(x, dtype="<u4").astype(np.uint64) | np.uint64(b << 32) for b, x in zip(*(saved["shared"].column(y).to_pylist() for y in ("bucket", "keys")))]))
        again = set(zip(*(saved["copies"].column(x).to_pylist() for x in ("doc", "digest")))) if saved["copies"] is not None else set()
        suspects = {x for x, _ in again}
        for batch, texts in blocks:
            ids = ids_of(batch)
            for i, x in enumerate(ids.tolist()):
                if x == NO_ID or (x in suspects and (x, blake2b(b" ".join(texts[i].lower().split()), digest_size=16).digest()) in again):
                    texts[i] = b""
            for k, owner, key, l, c, r in keyed_windows(texts):
                number = bucketed(key, buckets)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, number), len(known) - 1)] == number)
                yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), pa.array(ids[owner[hit]]), *[pa.array(np.asarray(x, dtype=np.int32)) for x in (np.full(len(hit), part), np.full(len(hit), k), l[hit], c[hit], r[hit])]], names=["key", "doc", "part", "k", "l", "c", "r"])

    by_key = Window.partitionBy("key")
    smaller = by_key.orderBy("doc").rangeBetween(Window.unboundedPreceding, -1)
    place = F.struct("doc", "part", "l", "c", "r")
    with short_lived_shuffles(spark):
        windows = over_saved(spark, parts, folder, ["shared", "copies"], windows_of, WINDOWS)
        shared = staged(windows.withColumns({"o": F.last(place).over(smaller), "f": F.first(place).over(smaller), "most": F.max("doc").over(by_key)}).where("o is not null or most > doc").drop("most"), "shared")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            flat = found.flatten()
            rows, items, at = [], list(zip(*(flat.field(x).to_pylist() for x in ("k", "low", "high", "offset", "other_low", "other_high")))), 0
            pairs = zip(*(batch.column(x).to_pylist() for x in ("doc", "part", "other", "other_part")))
            for pair, n in zip(pairs, found.value_lengths().to_pylist()):
                # a passage may reach beyond the windows that found it
                rows += [(*pair, a - MIN_SHINGLES, b + MIN_SHINGLES, c - MIN_SHINGLES, d + MIN_SHINGLES) for a, b, c, d in overlaps(items[at : at + n])]
                at += n
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5))], names=["doc", "part", "other", "other_part", "low", "high", "other_low", "other_high"])

    def by_doc(rows: pa.Table, column: str) -> dict[int, list[int]]:
        at: dict[int, list[int]] = {}
        for i, x in enumerate(rows.column(column).to_pylist()):
            at.setdefault(x, []).append(i)
        return at

    def fetch(part: int, rows: pa.Table, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        """The other document's shingles around each span, 32 bits of each, go to the document's part."""
        wanted = by_doc(rows, "other")
        low, high = (rows.column(x).to_pylist() for x in ("other_low", "other_high"))
        for batch, texts in blocks:
            ids = ids_of(batch)
            some = [i for i, x in enumerate(ids.tolist()) if x in wanted]
            h, n = shingle_hashes([texts[i] for i in some])
            at, picked, found = np.cumsum(n) - n, [], []
            for i, begin, count in zip(some, at.tolist(), n.tolist()):
                for row in wanted[int(ids[i])]:
                    first, last = max(0, low[row]), min(count, high[row] + 1)
                    picked.append(row)
                    found.append(h[begin + first : begin + max(first, last)].astype(np.uint32).tobytes())
            chosen = rows.take(pa.array(picked, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([chosen.column(x).combine_chunks() if len(picked) else pa.array([], chosen.schema.field(x).type) for x in ("back", "doc", "other", "low", "high")] + [pa.array(found, pa.binary())], names=["part", "doc", "other", "low", "high", "theirs"])

    def verify(part: int, rows: pa.Table, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        wanted, theirs = by_doc(rows, "doc"), rows.column("theirs")
        low, high, other = (rows.column(x).to_pylist() for x in ("low", "high", "other"))
        for batch, texts in blocks:
            ids = ids_of(batch).tolist()
            some = [i for i, x in enumerate(ids) if x in wanted]
            h, n = shingle_hashes([texts[i] for i in some])
            out = set()
            for i, begin, count in zip(some, (np.cumsum(n) - n).tolist(), n.tolist()):
                for row in wanted[ids[i]]:
                    first = max(low[row], 0)
                    for a, b in verified(h[begin + first : begin + min(high[row] + 1, count)].astype(np.uint32), np.frombuffer(theirs[row].as_buffer(), dtype=np.uint32)):
                        out.add((ids[i], other[row], first + a, first + b + SHINGLE_WORDS))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in list(zip(*out)) or [[]] * 4], names=["doc", "other", "start", "end"])

    def confirmed(paired: DataFrame) -> DataFrame:
        """Verified links among ``candidates``."""
        pairs = paired.groupBy("doc", "part", "other", "other_part").agg(F.collect_list(F.struct("k", "low", "high", "offset", "other_low", "other_high")).alias("found"))
        pairs = pairs.where(F.size(F.array_distinct(F.col("found.k"))) >= MIN_MATCHES)
        with short_lived_shuffles(spark):
            spans = staged(pairs.mapInArrow(meet, "doc long, part int, other long, other_part int, low int, high int, other_low int, other_high int"), "spans")
            asked = spans.select(F.col("other_part").alias("part"), F.col("part").alias("back"), "doc", "other", "low", "high", "other_low", "other_high")
            answers = over_parts(asked, parts, folder, fetch, "part int, doc long, other long, low int, high int, theirs binary")
            return staged(over_parts(answers, parts, folder, verify, "doc long, other long, start long, end long").distinct(), "links")

    whole = copies.where(F.col("n_words") >= MIN_WORDS).select("doc", F.col("first").alias("other"), F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    links = confirmed(candidates(shared.where("o is not null")))
    left = remaining(shared, links, parts, folder)
    more = confirmed(left.first)
    rest = left.rest(more)
    if rest is not None:
        more = more.union(confirmed(rest))
    return listed.select(F.col("doc_id").alias("doc"), "n_words"), links.union(more).union(whole).distinct()


def op8_near_passages(spark, sf_dir):
    """A row for each document: its class (the smallest doc_id reachable over shared passages), the
    number of its links, and its passages as start-end:partner, in words."""
    sizes, links = near_passages(documents(spark, sf_dir))
    component = connected_components(links.select(F.col("doc").alias("a"), F.col("other").alias("b")))
    listed = links.groupBy("doc").agg(F.count("*").alias("n_links"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "other"))), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(":"), x["other"].cast("string"))), ",").alias("passages"))
    rows = sizes.join(listed, "doc", "left").join(component, F.col("doc") == F.col("node"), "left")
    return rows.select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("component", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("passages", F.lit("")).alias("passages"))
