"""Operators whose results are checked against brute force over whole small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

from ladderlens.llm import chunking, flac, packing, passages, pii, records, simhash, suffixes, tokens


def brute_simhash(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_and_components(spark, docs, texts):
    base = list(texts.values())[:40]
    edited = [(1000 + i, t + " tail", None, None, 0) for i, t in enumerate(base)] + [(2000, None, None, None, 0), (2001, "", None, None, 0)]
    table = docs.union(spark.createDataFrame(edited, docs.schema))
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    fps = {r["doc_id"]: brute_simhash(r["text"]) for r in table.collect()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: (fps[i], find(i)) for i in ids}
    assert len({find(i) for i in ids}) < len(ids)


def test_dense_ball_of_fingerprints_is_one_component(spark):
    """Many fingerprints within two bits of a centre: all linked, some only through others."""
    rng, centre = np.random.default_rng(3), 0x0123456789ABCDEF
    fps = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))}
    far = {(centre ^ 0x7F7F7F7F7F7F7F7F) ^ i for i in (0, 1, 255)}
    prints = spark.createDataFrame([(i, x if x < 1 << 63 else x - (1 << 64)) for i, x in enumerate(sorted(fps | far))], "id long, fp long")
    linked = {(r["a"], r["b"]) for r in simhash.links(prints).collect()}
    seen, todo = {centre}, [centre]
    while todo:
        x = todo.pop()
        for a, b in linked:
            if x in (a, b) and (y := a + b - x) not in seen:
                seen.add(y), todo.append(y)
    assert seen == fps


def sequential_chunks(data: bytes) -> dict[int, int]:
    """Digests and lengths of the distinct chunks, byte by byte."""
    out, start = {}, 0
    while start < len(data):
        h, end = 0, min(len(data), start + chunking.MAX_BYTES)
        for i in range(start, min(len(data), start + chunking.MAX_BYTES)):
            h = ((h << 1) + int(chunking.GEAR[data[i]])) & 0xFFFFFFFF
            size = i + 1 - start
            if size >= chunking.MIN_BYTES:
                # the gear hash of the last 16 bytes: what is older has been shifted out only after 32, so take it afresh
                near = 0
                for x in data[i - 15 : i + 1]:
                    near = ((near << 1) + int(chunking.GEAR[x])) & 0xFFFFFFFF
                bits = chunking.STRICT_BITS if size < chunking.NORMAL_BYTES else chunking.LOOSE_BITS
                if near >> (32 - bits) == 0:
                    end = i + 1
                    break
        out[xxhash.xxh64_intdigest(data[start:end])] = end - start
        start = end
    return out


def test_chunks(docs, texts):
    ordered = sorted(texts.items(), reverse=True)
    rows = {r["doc_id"]: r for r in chunking.fingerprint_pairs(docs, 5).collect()}
    assert len(rows) == len(ordered)
    share = lambda a, b: sum(n for x, n in a.items() if x in b) / sum(a.values()) if a else float(not b)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, changed, after = (sequential_chunks(x.encode()) for x in (t[:20_000], e, following)) if len(t) <= 20_000 else (None, None, None)
        assert rows[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        if own is not None:
            assert {int(x["digest"]): int(x["length"]) for x in chunking.decoded(rows[i]["fingerprint"])} == own
            assert {int(x["digest"]): int(x["length"]) for x in chunking.decoded(rows[i]["edited_fingerprint"])} == changed
            assert abs(rows[i]["near_edited"] - share(own, changed)) < 1e-12 and abs(rows[i]["near_next"] - share(own, after)) < 1e-12
    shifted = sequential_chunks(b"x" + ordered[3][1].encode())
    assert share(sequential_chunks(ordered[3][1].encode()), shifted) > 0.5


class Bits:
    """A plain reader of big-endian bits."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x, self.at = x << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1, self.at + 1
        return x

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def plain_flac(media: bytes) -> bytes:
    """A second decoder, bit by bit, from the format's description; only for what a mono 8-bit stream needs."""
    assert media[:4] == b"fLaC"
    at, last, out = 4, False, []
    while not last:
        last, size = bool(media[at] & 128), int.from_bytes(media[at + 1 : at + 4], "big")
        at += 4 + size
    while at < len(media):
        r = Bits(media, at)
        assert r.take(14) == 0b11111111111110
        r.take(2), r.take(16)
        lead = r.take(8)
        for _ in range(max(0, len(f"{lead:08b}".split("0")[0]) - 1)):
            r.take(8)
        assert flac.CRC8(np.frombuffer(media, dtype=np.uint8), np.array([at]), np.array([r.at // 8]))[0] == r.take(8)
        assert r.take(1) == 0
        kind, _ = r.take(6), r.take(1)
        n = flac.BLOCK_SAMPLES
        if kind == 0:
            s = [r.signed(8)] * n
        elif kind == 1:
            s = [r.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            s = [r.signed(8) for _ in range(order)]
            weights, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order, []), 0
            if kind >= 32:
                precision, shift = r.take(4) + 1, r.signed(5)
                weights = [r.signed(precision) for _ in range(order)]
            wide, parts = (5 if r.take(2) else 4), r.take(4)
            for part in range(1 << parts):
                k = r.take(wide)
                for _ in range((n >> parts) - (order if part == 0 else 0)):
                    u = r.unary() << k | r.take(k)
                    s.append((u >> 1 ^ -(u & 1)) + (sum(w * s[-1 - j] for j, w in enumerate(weights)) >> shift))
        out += s
        at = -(-r.at // 8) + 2
    return bytes((x + 128) & 255 for x in out)


def test_flac_query_against_a_second_decoder(spark, folder, texts):
    rows = {r["doc_id"]: r for r in flac.op7_flac_media(spark, f"{folder}/docs").collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in flac.with_media(spark.read.parquet(f"{folder}/docs/documents.parquet")).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + bytes([255]) * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        if len(raw) < 6000:
            assert plain_flac(media[i]) == payload


def test_flac_round_trip_seek_and_corruption(texts):
    rng = np.random.default_rng(1)
    raw = [t.encode() for t in texts.values()] + [b"", b"a" * 576, bytes(range(256)) * 9, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), (np.sin(np.arange(4000) / 9) * 90 + 128).astype(np.uint8).tobytes()]
    payloads = [flac.payload(x) for x in raw]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads
    assert flac.decode_range(media[0], 600, 900) == payloads[0][600:1500]
    bad = bytearray(media[0])
    bad[-30] ^= 1
    try:
        flac.decode([bytes(bad)])
        raise AssertionError("a corrupt frame was read")
    except flac.CorruptMedia:
        pass


def test_flac_pcm_blocks(docs, texts):
    rows = flac.pcm_blocks(flac.with_media(docs.limit(5)), 1000).collect()
    for i in {r["doc_id"] for r in rows}:
        assert b"".join(bytes(r["pcm"]) for r in sorted(rows, key=lambda r: r["first_sample"]) if r["doc_id"] == i) == flac.payload(texts[i].encode())


def test_word_encoder_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.default_path()), tokens.WordEncoder(tokens.default_path())
    rows = [*texts.values(), "a\x1cb", "<|endoftext|> x<|startoftext|>", "don't STOP... (now)", "İstanbul ΑΣ. été, ÉTÉ!", "", "é 　x\xa0y"]
    assert [x.tolist() for x in e.encode(rows)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in rows]


def test_records_round_trip(spark, docs, texts, tmp_path):
    path = tokens.default_path()
    folder = f"file://{tmp_path}/r"
    rows = sorted(records.read_records(records.write_records(docs, folder, 4, path), folder).collect(), key=lambda r: r["doc_id"])
    start, ids = 0, tokens.encoder(path).encode([texts[i] for i in sorted(texts)])
    for r, i, x in zip(rows, sorted(texts), ids):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(x), zlib.crc32(x.astype("<u4").tobytes()))
        start += len(x)
    assert records.masked_crc32c([b"123456789"])[0] == ((0xE3069283 >> 15 | 0xE3069283 << 17) + records.MASK_DELTA) & 0xFFFFFFFF
    data = [b"abcdefgh" * n for n in (1, 64, 65, 300)]
    raw = b"".join(records.framed(data))
    assert records.unframed(raw, [len(x) for x in data]) == data
    try:
        records.unframed(raw[:40] + b"?" + raw[41:], [len(x) for x in data])
        raise AssertionError("a corrupt record was read")
    except records.CorruptRecord:
        pass


def test_packing(docs, texts):
    rows = packing.pack(docs, tokens.default_path()).collect()
    ids = dict(zip(texts, tokens.encoder(tokens.default_path()).encode(list(texts.values()))))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[i]) == own[0]["doc_tokens"]
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE
        padding += 0 if at & (at - 1) == 0 else packing.SEQUENCE - at
    assert by_doc.keys() == ids.keys() and padding <= 0.02 * sum(map(len, ids.values()))


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(4)
    demand = {int(s): int(n) for s, n in zip(rng.integers(1, 128, 60), rng.integers(0, 500, 60))}
    held = {}
    for n, pieces in packing.patterns(demand):
        assert sum(s * c for s, c in pieces.items()) <= packing.CAPACITY
        for s, c in pieces.items():
            held[s] = held.get(s, 0) + n * c
    assert held == {s: n for s, n in demand.items() if n}


def test_suffixes_equal_brute_force(docs, texts):
    first, length = {}, suffixes.LENGTH
    raw = {i: t.encode() for i, t in texts.items()}
    for i in sorted(raw):
        for k in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][k : k + length], i)
    rows = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], bytes(rows[i]["kept"])) == (len(b), sum(gone), spans, kept)


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(1)
    h, n = rng.integers(1, 150, 400).astype(np.uint64), np.array([0, 130, 20, 250])
    order = {x: passages.compact_windows(np.array([x], dtype=np.uint64).repeat(passages.MIN_SHINGLES), np.array([passages.MIN_SHINGLES]), 0)[1][0] for x in set(h.tolist())}
    want, at = set(), 0
    for o, m in enumerate(n.tolist()):
        v = [order[x] for x in h[at : at + m].tolist()]
        at += m
        for c in range(m):
            low, high = c, c
            while low > 0 and v[low - 1] > v[c]:
                low -= 1
            while high + 1 < m and v[high + 1] >= v[c]:
                high += 1
            if high - low + 1 >= passages.MIN_SHINGLES:
                want.add((o, low, c, high))
    got = {tuple(map(int, x)) for x in zip(*(y for i, y in enumerate(passages.compact_windows(h, n, 0)) if i != 1))}
    assert got == want


def test_shared_passage_is_found(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    shared = [word() for _ in range(100)]
    near = list(shared)
    near[60] = "changed"
    rows = [(1, [word() for _ in range(80)] + shared), (2, shared + [word() for _ in range(90)]), (3, [word() for _ in range(30)] + near + [word() for _ in range(30)]), (4, [word() for _ in range(200)]), (5, shared[:40] + [word() for _ in range(100)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    _, links = passages.near_passages(docs)
    found = [(r["doc"], r["other"], r["start"], r["end"]) for r in links.collect()]
    assert (2, 1, 0, 100) in found and {d for d, *_ in found} == {2, 3}
    spans = [(start, end) for d, _, start, end in found if d == 3]
    assert all(30 <= start and end <= 130 for start, end in spans) and max(end - start for start, end in spans) >= passages.MIN_WORDS


def changed(words: list[int], places: list[int], how: str, new) -> list[int]:
    out = list(words)
    for at in sorted(places, reverse=True):
        out[at : at + (how != "insert")] = [] if how == "delete" else [new()]
    return out


def brute_alike(a: list[int], b: list[int]) -> float:
    """The highest Jaccard resemblance of a stretch of a to one of b, both of MIN_SHINGLES or more."""
    least, best = passages.MIN_SHINGLES, 0.0
    for i in range(len(a) - least + 1):
        for j in range(i + least, len(a) + 1):
            mine = set(a[i:j])
            held = np.concatenate([[0], np.cumsum([x in mine for x in b])])
            for low in range(len(b) - least + 1):
                both = held[low + least :] - held[low]
                best = max(best, float((both / (len(mine) + np.arange(least, len(b) - low + 1) - both)).max()))
    return best


def grams(words: list[int]) -> list[int]:
    return [xxhash.xxh64_intdigest(repr(words[i : i + passages.SHINGLE_WORDS])) for i in range(len(words) - passages.SHINGLE_WORDS + 1)]


def test_changed_passages_are_verified():
    """Copies of 50 to 200 words with words replaced, inserted or deleted, between other words."""
    rng = np.random.default_rng(9)
    new = lambda: int(rng.integers(1 << 60))
    cases = [(n, [n // 2], how) for n in (50, 56, 80, 89) for how in ("replace", "insert", "delete")] + [(100, [33, 66], "replace"), (200, [40, 80, 120, 160], "replace"), (50, [2], "replace"), (60, [4], "delete")]
    cases += [(n := int(rng.integers(50, 201)), sorted(rng.choice(n, int(rng.integers(1, 5)), replace=False).tolist()), str(rng.choice(["replace", "insert", "delete"]))) for _ in range(300)]
    alike = 0
    for n, places, how in cases:
        a = [new() for _ in range(n)]
        b = changed(a, places, how, new)
        x, y = set(grams(a)), set(grams(b))
        if min(len(x), len(y)) >= passages.MIN_SHINGLES and len(x & y) >= passages.SIMILARITY * len(x | y):
            alike += 1
            for one, two in ((a, b), (b, a)):
                one, two = ([new() for _ in range(16)] + w + [new() for _ in range(16)] for w in (one, two))
                found = passages.verified(*(np.array(grams(w), dtype=np.uint64) for w in (one, two)))
                assert found and all(last - first + 1 >= passages.MIN_SHINGLES for first, last in found), (n, places, how)
    assert alike > 100


def test_verification_equals_brute_force():
    rng = np.random.default_rng(10)
    new = lambda: int(rng.integers(1 << 60))
    results = []
    for _ in range(30):
        a = [new() for _ in range(int(rng.integers(48, 62)))]
        b = changed(a, rng.choice(len(a), int(rng.integers(1, 3)), replace=False).tolist(), str(rng.choice(["replace", "insert", "delete"])), new)
        a, b = grams(a + [new() for _ in range(4)]), grams([new() for _ in range(4)] + b)
        results.append(brute_alike(a, b) >= passages.SIMILARITY)
        assert bool(passages.verified(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))) == results[-1]
    assert {True, False} == set(results)


def test_recall_of_short_changed_passages(spark):
    """Passages near the minimum length with a change in the middle, each between other words."""
    rng, rows, pairs = np.random.default_rng(11), [], []
    new = lambda: int(rng.integers(1 << 40))
    for i in range(600):
        how = ("replace", "insert", "delete")[i % 3]
        n = 51 if how == "delete" else 50
        a = [new() for _ in range(n)]
        for j, w in enumerate((a, changed(a, [n // 2], how, new))):
            rows.append((2 * i + j, " ".join(f"w{x}" for x in [new() for _ in range(30)] + w + [new() for _ in range(30)])))
        pairs.append((2 * i + 1, 2 * i))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r["doc"], r["other"]) for r in passages.near_passages(docs)[1].collect()}
    by_change = [sum(x in found for x in pairs[k::3]) / 200 for k in range(3)]
    print("recall by change (replace, insert, delete):", by_change)
    assert found <= set(pairs) and min(by_change) >= 0.98


def test_passages_reach_beyond_the_nearest_document(spark):
    """Between two documents that share a passage there is one that holds too little of it; the class must not split."""
    rng, rows = np.random.default_rng(12), []
    new = lambda: int(rng.integers(1 << 40))
    for i in range(0, 120, 3):
        shared = [new() for _ in range(50)]
        for j, w in enumerate((shared, shared[4:46], shared)):
            rows.append((i + j, " ".join(f"w{x}" for x in [new() for _ in range(30)] + w + [new() for _ in range(30)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r["doc"], r["other"]) for r in passages.near_passages(docs)[1].collect()}
    assert found == {(i + 2, i) for i in range(0, 120, 3)}


def test_a_link_within_a_class_does_not_hide_another_class(spark):
    """A passage is like two others that are not like each other: all three are one class."""
    rng = np.random.default_rng(13)
    new = lambda: f"w{rng.integers(1 << 40)}"
    middle = [new() for _ in range(60)]
    one, two = list(middle), list(middle)
    one[20], two[40] = "one", "two"
    filler = lambda: [new() for _ in range(30)]
    rows = [(i, " ".join(filler() + w + filler())) for i, w in ((1, one), (2, two), (3, middle))]
    found = {(r["doc"], r["other"]) for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    assert found == {(3, 1), (3, 2)}


def test_windows_of_a_common_phrase_meet_by_their_surroundings(spark, monkeypatch):
    """A phrase of 30 words in 40 texts of which some go on alike, far from the nearest smaller one: the same links whether
    all windows of a key are compared or, as in keys of many, those with a rarer shingle in common."""
    rng = np.random.default_rng(21)
    new = lambda n: [f"w{rng.integers(1 << 40)}" for _ in range(n)]
    phrase, rows, tails = new(30), [], {}
    for i in range(40):
        group = i % 9 if i % 2 else None
        tail = tails.setdefault(group, new(45)) if group is not None else new(45)
        if group is not None:
            tail = [*tail[:20], f"x{i}", *tail[21:]]
        rows.append((i, " ".join(new(40) + phrase + tail + new(20))))
    docs, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    for most in (1000, 3):
        monkeypatch.setattr(passages, "PER_TASK", most)
        found.append({(r["doc"], r["other"]) for r in passages.near_passages(docs)[1].collect()})
    groups: dict[int, list[int]] = {}
    for i in range(1, 40, 2):
        groups.setdefault(i % 9, []).append(i)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    for links in found:
        name = {i: i for i in range(40)}
        for a, b in sorted(links):
            x, y = name[a], name[b]
            name = {k: min(x, y) if v in (x, y) else v for k, v in name.items()}
        classes: dict[int, set[int]] = {}
        for k, v in name.items():
            classes.setdefault(v, set()).add(k)
        assert {frozenset(c) for c in classes.values() if len(c) > 1} == want


def brute_base(text: str) -> list:
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns(texts):
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("a.@-_%+1 23é0("), rng.integers(1, 40))) for _ in range(20_000)]
    for t in [*texts.values(), *made]:
        assert pii.base_spans(t) == brute_base(t)


def test_terms_that_disclose(spark):
    rows = [(i, f"filler{i} note{i * 7} write to a.b@c.org about Zanzibar today item{i}") for i in range(6)]
    rows += [(100 + i, f"filler{i} the about today is common text write to all of item{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    t = rows[0][1]
    at = t.index("Zanzibar")
    assert spans[0].split(",")[-1] == f"term:{at}:{at + 8}" and spans[100] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "a.b@c.org" not in clean[0] and "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and clean[100] == rows[6][1]


def flagged_terms(spark, rows: list[tuple[int, str]]) -> dict[int, set[str]]:
    rows = rows + [(1000 + i, f"filler{i} the about today is common text write to all of item{i}") for i in range(60)]
    text = dict(rows)
    spans = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {r["doc_id"]: {text[r["doc_id"]][int(x.split(":")[1]) : int(x.split(":")[2])] for x in r["spans"].split(",") if x.startswith("term:")} for r in spans}


def test_one_long_document_discloses(spark):
    """An archive with an address and its owner's name in ten different sentences."""
    archive = " ".join(f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} Zanzibar a.b@c.org j{i} k{i} l{i} m{i} n{i} o{i} p{i} q{i} r{i}" for i in range(10))
    found = flagged_terms(spark, [(1, archive)])
    assert found.pop(1) == {"Zanzibar"} and not any(found.values())


def test_distant_terms_disclose_and_copies_do_not(spark):
    """Letters with the name at the head and the address at the foot; the other letter has five exact copies."""
    def letter(name: str, i: str, mail: str) -> str:
        return f"{name} " + " ".join(f"{i}word{j}" for j in range(30)) + f" please write to all of the people at this address {mail}"

    found = flagged_terms(spark, [(i, letter("Zanzibar", f"x{i}", "a.b@c.org")) for i in range(4)] + [(10 + i, letter("Quito", "same", "d.e@f.org")) for i in range(5)])
    assert all("Zanzibar" in found[i] for i in range(4)) and not any(found[10 + i] for i in range(5))


def test_recall_by_length_and_changes(spark):
    """Passages of 50 to 200 words with words replaced at random places, each between other words; only pairs that
    are alike enough count. Every line of the table must reach 0.95."""
    rng, rows, pairs = np.random.default_rng(14), [], {}
    new = lambda: int(rng.integers(1 << 40))
    for n, changes in ((50, 0), (60, 1), (80, 1), (100, 2), (150, 3), (200, 4)):
        for _ in range(120):
            a = [new() for _ in range(n)]
            b = changed(a, rng.choice(n, changes, replace=False).tolist(), "replace", new)
            x, y = set(grams(a)), set(grams(b))
            if len(x & y) >= passages.SIMILARITY * len(x | y):
                i = len(rows)
                rows += [(i + j, " ".join(f"w{v}" for v in [new() for _ in range(60)] + w + [new() for _ in range(60)])) for j, w in enumerate((a, b))]
                pairs.setdefault((n, changes), []).append((i + 1, i))
    found = {(r["doc"], r["other"]) for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))[1].collect()}
    recall = {k: sum(p in found for p in v) / len(v) for k, v in pairs.items()}
    print("recall by words and changes:", recall)
    assert min(recall.values()) >= 0.95 and found <= {p for v in pairs.values() for p in v}


def test_repeated_words_and_copies_are_one_class(spark):
    """Documents of one word over and over, copies of a text, and texts that differ in case only."""
    rng = np.random.default_rng(15)
    text = " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 80))
    rows = [(1, "spam " * 70), (2, f"head {'spam ' * 60} tail"), (3, text), (4, text.upper()), (5, text), (6, "too short"), (7, "too short"), (8, None), (9, "")]
    sizes, links = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc"], r["other"]) for r in links.collect()} == {(2, 1), (4, 3), (5, 3)}
    assert {r["doc"]: r["n_words"] for r in sizes.collect()} == {1: 70, 2: 62, 3: 80, 4: 80, 5: 80, 6: 2, 7: 2, 8: 0, 9: 0}


def test_records_in_shuffled_order(spark, docs, texts, tmp_path):
    path, folder = tokens.default_path(), f"file://{tmp_path}/s"
    manifest = records.write_records(docs, folder, 4, path)
    want = {i: x.tolist() for i, x in zip(sorted(texts), tokens.encoder(path).encode([texts[i] for i in sorted(texts)]))}
    orders = []
    for seed in (1, 2, 1):
        rows = sorted(records.read_shuffled(manifest, folder, seed, 3).collect(), key=lambda r: (r["task"], r["place"]))
        assert {r["doc_id"]: r["ids"] for r in rows} == want and len(rows) == len(want)
        orders.append([r["doc_id"] for r in rows])
    assert orders[0] == orders[2] != orders[1] and orders[0] != sorted(orders[0])


def test_raked_margins_meet_their_targets(spark, docs):
    from ladderlens.llm import mixing

    cells = mixing.with_cells(docs.select("doc_id", "source", "lang", "text")).groupBy(*mixing.DIMENSIONS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    targets = {x: mixing.tempered(cells, x) for x in mixing.DIMENSIONS}
    rows = mixing.margins(mixing.rake(cells, targets), targets).collect()
    assert len(rows) > 5 and max(abs(r["share"] - r["target"]) for r in rows) < 5e-3
