"""Which windows of a large key meet."""

from __future__ import annotations

from ladderlens.llm import passages

WINDOWS = "key long, n long, doc long, c int, component long, bag array<int>, least int"


def test_windows_of_the_greater_part_of_a_key_meet(spark):
    """Four of five windows of a key share 45 shingles around it, the fifth a phrase of 20: what most windows have may
    be the passage itself."""
    passage, own = list(range(45)), lambda i: list(range(1000 * i, 1000 * i + 40))
    rows = [(7, 5, i, 3, i, sorted((passage[:20] if i == 2 else passage) + own(i)), 37) for i in range(1, 6)]
    found = {(r["o_doc"], r["doc"]) for r in passages.by_shingles(spark.createDataFrame(rows, WINDOWS)).collect()}
    assert found == {(1, 3), (1, 4), (1, 5), (3, 4), (3, 5), (4, 5)}


def test_all_windows_with_a_rare_shingle_meet(spark):
    """Windows 1 and 3 have 40 shingles in common, and window 2 some of these, others with 4: none comes between."""
    a, b = list(range(40)), list(range(100, 140))
    rows = [(7, 4, i, 3, i, bag, 37) for i, bag in ((1, a), (2, a[:25] + b[:30]), (3, a), (4, b))]
    found = {(r["o_doc"], r["doc"]) for r in passages.by_shingles(spark.createDataFrame(rows, WINDOWS)).collect()}
    assert (1, 3) in found


def test_a_window_meets_all_of_a_larger_class(spark):
    """Window 200 is like window 1 of a class of 150, whose other windows have 36 of the 45 shingles each, in lists of over 100,
    and 30 others that window 201 has: none that is nearer comes between."""
    passage, line, own = list(range(45)), list(range(500, 530)), lambda i: list(range(1000 * i, 1000 * i + 20))
    bags = {1: passage, 200: passage, 201: line} | {i: [x for x in passage if (x - 7 * i) % 45 >= 9] + line for i in range(2, 151)}
    rows = [(7, len(bags), i, 3, i if i > 150 else 1, sorted(bag + own(i)), 37) for i, bag in bags.items()]
    found = {(r["o_doc"], r["doc"]) for r in passages.by_shingles(spark.createDataFrame(rows, WINDOWS)).collect()}
    assert found == {(1, 200)}


def test_shingles_leave_a_task_once_for_a_class(spark):
    """150 windows with 85 shingles each, of which one other class has 30."""
    rows = [(7, 151, i, 3, 1 if i < 200 else 200, list(range(85)) if i < 200 else list(range(55, 140)), 37) for i in [*range(1, 151), 200]]
    told = passages.telling_shingles(spark.createDataFrame(rows, WINDOWS).coalesce(1)).collect()
    assert sorted(x for r in told for x in memoryview(r["shingles"]).cast("i")) == list(range(55, 85))
