"""Media columns: FLAC streams of 8-bit mono samples, encoded and decoded many frames at a time.

The format is RFC 9639: STREAMINFO, a SEEKTABLE with a point for every frame, and frames of 576
samples. The encoder picks a constant, verbatim, fixed or linear predictor per frame; the decoder
reads any order of predictor, any number of Rice partitions and escaped ones, checks each frame's
header CRC-8 and CRC-16 and the stream's MD5, and steps through all frames of a block side by side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import documents, staged, text_blocks

BLOCK_SAMPLES = 576
SAMPLE_RATE = 8000
PAD = 255
# Fixed values of the format.
FIXED_PREDICTORS = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
CRC8_POLYNOMIAL, CRC16_POLYNOMIAL = 0x07, 0x8005
MAGIC = b"fLaC"


class CorruptMedia(ValueError):
    """A stream whose structure or checksums do not hold."""


class Crc:
    """A CRC without initial value, as the xor of what each byte contributes from its distance to the end."""

    def __init__(self, bits: int, polynomial: int, length: int):
        self.mask, self.kind, self.bits = (1 << bits) - 1, np.uint16 if bits > 8 else np.uint8, bits
        one = []
        for x in range(256):
            x <<= bits - 8
            for _ in range(8):
                x = ((x << 1) ^ polynomial if x >> (bits - 1) & 1 else x << 1) & self.mask
            one.append(x)
        self.one, rows = np.array(one, dtype=np.int64), [np.array(one, dtype=np.int64)]
        for _ in range(length - 1):
            rows.append(self._step(rows[-1]))
        self.table = np.array(rows, dtype=self.kind)

    def _step(self, x: np.ndarray) -> np.ndarray:
        return ((x << 8) & self.mask) ^ self.one[(x >> (self.bits - 8)) & 255]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        longest = int((ends - starts).max(initial=0))
        while longest > len(self.table):
            more = [self._step(self.table[-1].astype(np.int64))]
            for _ in range(len(self.table) - 1):
                more.append(self._step(more[-1]))
            self.table = np.concatenate([self.table, np.array(more, dtype=self.kind)])
        out = np.zeros(len(starts), dtype=self.kind)
        back = np.arange(1, longest + 1)
        for low in range(0, len(starts), 256):
            at = ends[low : low + 256, None] - back
            byte = np.where(at >= starts[low : low + 256, None], data[np.maximum(at, 0)], 0)
            out[low : low + 256] = np.bitwise_xor.reduce(self.table[back - 1, byte], axis=1)
        return out


CRC8, CRC16 = Crc(8, CRC8_POLYNOMIAL, 16), Crc(16, CRC16_POLYNOMIAL, 700)


def payload(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of the block size."""
    return text + bytes([PAD]) * (-len(text) % BLOCK_SAMPLES or (0 if text else BLOCK_SAMPLES))


def _coded_number(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    return bytes([(0xFF00 >> (more + 1) & 0xFF) | n >> 6 * more] + [0x80 | n >> 6 * i & 63 for i in range(more - 1, -1, -1)])


def _linear(s: np.ndarray) -> tuple[np.ndarray, int]:
    """Quantised coefficients of second-order linear prediction for each frame, and their shift."""
    x = s.astype(np.float64)
    r0, r1, r2 = (x * x).sum(1) + 1e-9, (x[:, 1:] * x[:, :-1]).sum(1), (x[:, 2:] * x[:, :-2]).sum(1)
    d = r0 * r0 - r1 * r1
    d = np.where(np.abs(d) < 1e-6, 1.0, d)
    a = np.stack([(r1 * r0 - r1 * r2) / d, (r2 * r0 - r1 * r1) / d], axis=1)
    return np.clip(np.rint(a * 32), -128, 127).astype(np.int64), 5


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of the block size."""
    counts = np.array([len(x) // BLOCK_SAMPLES for x in payloads], dtype=np.int64)
    s = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK_SAMPLES).astype(np.int32) - 128
    frames, n = len(s), BLOCK_SAMPLES
    order, k, best = np.zeros(frames, dtype=np.int64), np.zeros(frames, dtype=np.int64), np.full(frames, np.iinfo(np.int64).max)
    residual, linear = np.zeros((frames, n), dtype=np.int32), np.zeros(frames, dtype=bool)
    coefficients, shift = _linear(s)
    d1 = np.diff(s, axis=1)
    lpc = s[:, 2:] - ((coefficients[:, :1] * s[:, 1:-1] + coefficients[:, 1:] * s[:, :-2]) >> shift).astype(np.int32)
    for is_linear, p, r, extra in ((False, 0, s, 0), (False, 1, d1, 8), (False, 2, np.diff(d1, axis=1), 16), (True, 2, lpc, 16 + 9 + 16)):
        u = (r << 1) ^ (r >> 31)
        guess = np.maximum(np.floor(np.log2(u.mean(1) + 1e-9)), 0).astype(np.int64)
        for kk in (guess, np.maximum(guess - 1, 0)):
            size = extra + 10 + (n - p) * (1 + kk) + (u >> kk[:, None]).sum(1)
            better = size < best
            best[better], order[better], k[better], linear[better] = size[better], p, kk[better], is_linear
            residual[better, p:] = u[better]
    constant = (s == s[:, :1]).all(1)
    verbatim = ~constant & (best >= 8 * n)
    coded = ~constant & ~verbatim
    numbers = [_coded_number(i) for c in counts for i in range(c)]
    head = np.array([5 + len(x) for x in numbers], dtype=np.int64)
    bits_in = 8 * head + 8 + np.where(constant, 8, np.where(verbatim, 8 * n, best))
    size = (bits_in + 7) // 8 + 2
    ends = np.cumsum(size)
    starts = ends - size
    bits = np.zeros(8 * int(ends[-1]), dtype=np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = (value >> (width - 1 - j)) & 1

    raw = np.frombuffer(b"".join(b"\xff\xf8\x20\x02" + x + b"\0" for x in numbers), dtype=np.uint8).copy()
    head_end = np.cumsum(head)
    raw[head_end - 1] = CRC8(raw, head_end - head, head_end - 1)
    spread = np.arange(len(raw)) - np.repeat(head_end - head, head) + np.repeat(starts, head)
    for j in range(8):
        bits[8 * spread + j] = raw >> (7 - j) & 1
    at = 8 * (starts + head)
    # the type stands in bits 1 to 6 of the subframe's first byte, the last bit says that none are wasted
    put(at, np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 32 + order - 1, 8 + order))) << 1, 8)
    at = at + 8
    put(at[constant], s[constant, 0] & 255, 8)
    if verbatim.any():
        put((at[verbatim, None] + 8 * np.arange(n)).ravel(), (s[verbatim] & 255).ravel(), 8)
    for p in (1, 2):
        has = coded & (order == p)
        put((at[has, None] + 8 * np.arange(p)).ravel(), (s[has, :p] & 255).ravel(), 8)
    at = at + 8 * order
    has = coded & linear
    put(at[has], np.full(has.sum(), 7), 4)
    put(at[has] + 4, np.full(has.sum(), shift), 5)
    put(at[has] + 9, coefficients[has, 0] & 255, 8)
    put(at[has] + 17, coefficients[has, 1] & 255, 8)
    at = at + np.where(linear, 25, 0) + 6
    put(at[coded], k[coded], 4)
    at = at + 4
    for kk in np.unique(k[coded]).tolist():
        for p in (0, 1, 2):
            lanes = np.flatnonzero(coded & (k == kk) & (order == p))
            u = residual[lanes, p:].astype(np.int64)
            q = u >> kk
            length = q + 1 + kk
            one = at[lanes, None] + np.cumsum(length, axis=1) - length + q
            bits[one] = 1
            for j in range(kk):
                bits[one + 1 + j] = u >> (kk - 1 - j) & 1
    data = np.packbits(bits)
    crc = CRC16(data, starts, ends - 2)
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 255
    out, at = [], 0
    for raw_bytes, c in zip(payloads, counts.tolist()):
        sizes, first = size[at : at + c], int(starts[at])
        md5 = hashlib.md5((np.frombuffer(raw_bytes, dtype=np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", n, n) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (SAMPLE_RATE << 44 | 7 << 36 | c * n).to_bytes(8, "big") + md5
        points = np.empty(c, dtype=[("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        points["sample"], points["offset"], points["samples"] = np.arange(c) * n, starts[at : at + c] - first, n
        out.append(MAGIC + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + points.nbytes.to_bytes(3, "big") + points.tobytes() + data[first : int(ends[at + c - 1])].tobytes())
        at += c
    return out


def stream_info(media: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, MD5, seek points and where the frames start."""
    if media[:4] != MAGIC:
        raise CorruptMedia("not a FLAC stream")
    at, last, total, md5, points = 4, False, None, b"", None
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            about = int.from_bytes(body[10:18], "big")
            if about >> 41 & 7 or (about >> 36 & 31) != 7:
                raise CorruptMedia("only 8-bit mono is read")
            total, md5 = about & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = np.frombuffer(body, dtype=[("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        at += 4 + size
    if total is None or points is None:
        raise CorruptMedia("no stream information or no seek points")
    return total, md5, points[points["sample"] != (1 << 64) - 1], at


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, samples: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The signed samples of many frames of ``data`` (8 spare bytes at its end), one row for each; all
    must have the same number of samples."""
    n, frames = int(samples[0]), len(starts)
    first = data[starts + 4]
    extra = np.select([first < 0x80, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC, first < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = first & np.where(extra == 0, 127, 63 >> extra).astype(np.uint8)
    number = number.astype(np.int64)
    for j in range(1, int(extra.max(initial=0)) + 1):
        number = np.where(extra >= j, number << 6 | data[np.minimum(starts + 4 + j, len(data) - 1)] & 63, number)
    head_end = starts + 5 + extra
    if not ((data[starts] == 0xFF) & (data[starts + 1] == 0xF8) & (data[starts + 3] == 0x02)).all() or (number != numbers).any():
        raise CorruptMedia("a frame does not start where its seek point says")
    if (CRC8(data, starts, head_end) != data[head_end]).any():
        raise CorruptMedia("a frame header's checksum is wrong")
    if (CRC16(data, starts, ends) != 0).any():
        raise CorruptMedia("a frame's checksum is wrong")
    window = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    low = int(starts.min())
    ones = np.unpackbits(data[low:])
    following = np.where(ones, np.arange(len(ones)), len(ones))
    following = np.minimum.accumulate(following[::-1])[::-1] + 8 * low

    def take(at: np.ndarray, width) -> np.ndarray:
        """``width`` (at most 32) bits at each bit position."""
        width = np.asarray(width, dtype=np.uint64)
        w = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        return np.where(width > 0, w >> (np.uint64(64) - np.maximum(width, 1)), 0).astype(np.int64)

    def signed(x: np.ndarray, width) -> np.ndarray:
        return np.where(x >> np.maximum(np.asarray(width) - 1, 0) & 1, x - (1 << np.asarray(width, dtype=np.int64)), x)

    out = np.zeros((n, frames), dtype=np.int64)
    kind = data[head_end + 1] >> 1 & 63
    if (data[head_end + 1] & 0x81).any():
        raise CorruptMedia("wasted bits are not read")
    at = 8 * (head_end + 2)
    same, plain = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    out[:, same] = signed(data[head_end[same] + 2].astype(np.int64), 8)
    if len(plain):
        out[:, plain] = signed(data[head_end[plain] + 2 + np.arange(n)[:, None]].astype(np.int64), 8)
    lanes = np.flatnonzero(kind >= 8)
    if not len(lanes):
        return out.T
    at, kind = at[lanes], kind[lanes]
    order = np.where(kind >= 32, kind - 31, kind - 8).astype(np.int64)
    deepest = int(order.max())
    s = np.zeros((n + deepest, len(lanes)), dtype=np.int64)
    for i in range(deepest):
        has = order > i
        s[deepest + i, has] = signed(take(at[has] + 8 * i, 8), 8)
    at = at + 8 * order
    weight, shift = np.zeros((deepest, len(lanes)), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    for p in np.unique(order[kind < 32]).tolist():
        has = np.flatnonzero((kind < 32) & (order == p))
        weight[:p, has] = np.array(FIXED_PREDICTORS[p], dtype=np.int64)[:, None]
    has = np.flatnonzero(kind >= 32)
    if len(has):
        precision = take(at[has], 4) + 1
        shift[has] = signed(take(at[has] + 4, 5), 5)
        at[has] += 9
        for i in range(int(order[has].max())):
            more = order[has] > i
            weight[i, has[more]] = signed(take(at[has[more]], precision[more]), precision[more])
            at[has[more]] += precision[more]
    method, parts = take(at, 2), take(at + 2, 4)
    at, length = at + 6, n >> parts
    width, raw, any_raw = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), -1), False
    by_part, least = np.unique(length), int(order.min())
    spare = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    quad = spare[:-3] << np.uint32(24) | spare[1:-2] << np.uint32(16) | spare[2:-1] << np.uint32(8) | spare[3:]
    for i in range(least, n):
        on = order <= i
        if i <= deepest or np.any(i % by_part == 0):
            has = np.flatnonzero(on & ((i == order) | (i % length == 0)))
            bits = np.where(method[has] == 1, 5, 4)
            k = take(at[has], bits)
            at[has] += bits
            escaped = k == (1 << bits) - 1
            raw[has], width[has] = -1, k
            if escaped.any():
                some = has[escaped]
                raw[some], width[some] = take(at[some], 5), 0
                at[some] += 5
            any_raw, wide = bool((raw >= 0).any()), bool((width > 24).any())
            down = (31 - width).astype(np.uint32) if not wide else None
        one = following[at - 8 * low]
        after = one + 1
        if wide:
            rest = take(after, width)
        else:
            rest = quad[after >> 3] << (after & 7).astype(np.uint32)
            rest >>= np.uint32(1)
            rest >>= down
        u = (one - at) << width
        u += rest
        r, moved = (u >> 1) ^ -(u & 1), after + width
        if any_raw:
            r = np.where(raw >= 0, signed(take(at, np.maximum(raw, 0)), np.maximum(raw, 0)), r)
            moved = np.where(raw >= 0, at + raw, moved)
        row = deepest + i
        if deepest:
            predicted = weight[0] * s[row - 1]
            for j in range(1, deepest):
                predicted += weight[j] * s[row - 1 - j]
            predicted >>= shift
            r += predicted
        if i < deepest:
            s[row, on], at[on] = r[on], moved[on]
        else:
            s[row], at = r, moved
    out[:, lanes] = s[deepest:]
    return out.T


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of many streams, with every frame's checksums and each stream's MD5 verified."""
    infos = [stream_info(x) for x in streams]
    data = np.frombuffer(b"".join(streams) + bytes(8), dtype=np.uint8)
    base = np.cumsum([0] + [len(x) for x in streams])
    starts = np.concatenate([b + at + p["offset"].astype(np.int64) for b, (_, _, p, at) in zip(base, infos)])
    ends = np.concatenate([np.append(b + at + p["offset"][1:].astype(np.int64), stop) for b, stop, (_, _, p, at) in zip(base, base[1:], infos)])
    samples = np.concatenate([p["samples"].astype(np.int64) for _, _, p, _ in infos])
    numbers = np.concatenate([np.arange(len(p)) for _, _, p, _ in infos])
    pieces = np.empty(len(starts), dtype=object)
    for size in np.unique(samples):
        at = np.flatnonzero(samples == size)
        found = (decode_frames(data, starts[at], ends[at], samples[at], numbers[at]) & 255).astype(np.uint8)
        for i, x in zip(at, found):
            pieces[i] = x
    out, at = [], 0
    for total, md5, points, _ in infos:
        pcm = np.concatenate(pieces[at : at + len(points)])
        at += len(points)
        if len(pcm) != total or hashlib.md5(pcm.tobytes()).digest() != md5:
            raise CorruptMedia("the samples do not match the stream's MD5")
        out.append((pcm ^ 128).tobytes())
    return out


def decode_range(media: bytes, first: int, count: int) -> bytes:
    """``count`` bytes from sample ``first`` on, decoding only the frames that the seek points name."""
    total, _, points, at = stream_info(media)
    low = int(np.searchsorted(points["sample"].astype(np.int64), first, side="right")) - 1
    high = int(np.searchsorted(points["sample"].astype(np.int64), min(first + count, total), side="left"))
    if count <= 0 or first >= total:
        return b""
    ends = np.append(at + points["offset"][1:].astype(np.int64), len(media))[low:high]
    data = np.frombuffer(media + bytes(8), dtype=np.uint8)
    pcm = decode_frames(data, at + points["offset"][low:high].astype(np.int64), ends, points["samples"][low:high].astype(np.int64), np.arange(low, high))
    raw = ((pcm & 255).astype(np.uint8) ^ 128).ravel()
    skip = first - int(points["sample"][low])
    return raw[skip : skip + count].tobytes()


def feature(pcm: bytes) -> str:
    """Frames, mean, root mean square and sign changes of the samples."""
    x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"frames={len(x) // BLOCK_SAMPLES};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};sign_changes={changes}"


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) as a FLAC stream of its padded UTF-8 bytes. Equal
    texts have equal streams, repeated rows stay, a text of any length is one stream, and an empty table
    gives an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            media = encode([payload(x) for x in texts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def _media_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    return text_blocks(batches, "media")


def described(media: DataFrame) -> DataFrame:
    """What the stored streams hold, read back: payload length and digests, the stream's own, and a feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in _media_blocks(batches):
            pcm = decode(streams)
            columns = [pa.array([len(x) for x in pcm], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in pcm]), pa.array([zlib.crc32(x[-32:]) for x in pcm], pa.int64())]
            columns += [pa.array([len(x) for x in streams], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in streams]), pa.array([feature(x) for x in pcm])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame, samples: int = BLOCK_SAMPLES) -> DataFrame:
    """(doc_id, first_sample, pcm): the streams as blocks of ``samples`` samples that can be sought by offset."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in _media_blocks(batches):
            for i, pcm in zip(part.column("doc_id"), decode(streams)):
                first = list(range(0, len(pcm), samples))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(first), part.column("doc_id").type), pa.array(first, pa.int64()), pa.array([pcm[x : x + samples] for x in first], pa.binary())], names=["doc_id", "first_sample", "pcm"])

    return media.select("doc_id", "media").mapInArrow(blocks, f"doc_id {kind}, first_sample long, pcm binary")


def op7_flac_media(spark, sf_dir):
    """The streams are stored in the shared folder and read back from there."""
    return described(staged(with_media(documents(spark, sf_dir)), "media", compression="zstd"))
