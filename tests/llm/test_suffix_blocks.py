"""Blocks of texts: ranges of windows instead of windows, anchors of long texts, names of strings."""

from __future__ import annotations

import numpy as np

from ladderlens.llm import suffixes


def words(n: int, seed: int) -> bytes:
    rng = np.random.default_rng(seed)
    return b" ".join(b"w%d" % x for x in rng.integers(0, 5000, n))


def looked_at(texts: list[bytes], ids: list[int]) -> suffixes.Block:
    tally, block = suffixes.Tally(), suffixes.Block(texts, np.array(ids))
    tally.add(block.seeds())
    columns = [np.concatenate(x) for x in zip(*([b.column(c).to_numpy() for c in ("h", "g", "n", "least")] for b in tally.batches(0)))]
    block.look_at(suffixes.Ranks(*columns))
    return block


def test_work_follows_anchors_not_windows():
    text = words(8000, 1)
    block = looked_at([text, text], [1, 2])
    assert 0 < 3 * len(block.p) < 2 * (len(text) - suffixes.LENGTH + 1)


def test_ranges_hold_each_window_of_a_repeating_anchor_once():
    text = words(3000, 2)
    block = looked_at([text, b"short", b"", text[:60], text], [1, 2, 3, 4, 5])
    p = np.concatenate([np.arange(x, y) for x, y in zip(block.p, block.to)])
    begin = np.concatenate([[0], block.ends[:-1]])
    assert p.tolist() == [x for low, high in zip(begin.tolist(), block.ends.tolist()) for x in range(low, high - suffixes.LENGTH + 1)]


def test_long_texts_have_the_anchors_of_their_pieces():
    text = words(90_000, 3)
    assert len(text) > suffixes.BLOCK
    whole, cut = suffixes.Block([text], np.array([1])), 150_000
    piece = suffixes.Block([text[:cut]], np.array([1]))
    assert len(piece.a) > cut // 40 and whole.a[: len(piece.a)].tolist() == piece.a.tolist()
    assert whole.seed[: len(piece.a)].tolist() == piece.seed.tolist()


def test_bytes_eight_apart_do_not_cancel():
    rng = np.random.default_rng(4)
    rows = np.full((200_000, suffixes.LENGTH), ord("a"), dtype=np.uint8)
    rows[:, 7::8] = rng.integers(0, 256, (len(rows), len(range(7, suffixes.LENGTH, 8))))
    data = suffixes.together([rows.tobytes()])
    found = suffixes.window_hash(suffixes._bytes(data), np.arange(len(rows)) * suffixes.LENGTH)
    assert len(np.unique(found)) == len(np.unique(rows, axis=0))


def test_ranges_cover_together_what_each_covers():
    rng = np.random.default_rng(5)
    ends = np.cumsum(rng.integers(0, 400, 50))
    begin, rows = np.concatenate([[0], ends[:-1]]), []
    for low, high in zip(begin.tolist(), ends.tolist()):
        for _ in range(int(rng.integers(0, 6))):
            x = int(rng.integers(low, high)) if high > low else high
            rows += [(x, int(rng.integers(x + 1, high + 1)))] if x < high else []
    rows.sort()
    start, end = np.array(rows).T
    want = np.zeros(ends[-1], dtype=bool)
    for x, y in rows:
        want[x:y] = True
    text, low, high = suffixes.merged(ends, start, end)
    found = np.zeros(ends[-1], dtype=int)
    for t, x, y in zip(text.tolist(), low.tolist(), high.tolist()):
        found[x:y] += 1
        assert begin[t] <= x < y <= ends[t]
    assert found.tolist() == want.astype(int).tolist()
    adjacent = (low[1:] == high[:-1]) & (text[1:] == text[:-1])
    assert not adjacent.any()


def test_pairs_with_an_anchor_of_one_document_are_not_asked_for():
    text = words(4000, 6)
    block, other = suffixes.Block([text], np.array([1])), suffixes.Block([text], np.array([2]))
    tally, pick = suffixes.Tally(), np.arange(len(other.a)) % 9 != 4
    tally.add(block.seeds())
    tally.add(tuple(x[pick] for x in other.seeds()))
    columns = [np.concatenate(x) for x in zip(*([b.column(c).to_numpy() for c in ("h", "g", "n", "least", "spread")] for b in tally.batches(0)))]
    shared = columns[-1] > 0
    block.look_at(suffixes.Ranks(*(x[shared] for x in columns[:-1])))
    assert 0 < len(block.pair) and not any((np.arange(x, y + 1) % 9 == 4).any() for x, y in zip(block.left.tolist(), block.right.tolist()))
