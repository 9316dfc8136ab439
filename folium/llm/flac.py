"""FLAC streams of 8-bit mono samples, coded and decoded in numpy, many frames at a time.

A payload of bytes is one stream: STREAMINFO with the audio's MD5, a SEEKTABLE
with the sample number and byte offset of every eighth frame, then frames of 192
samples. A subframe is constant, verbatim, a fixed predictor (orders 0 to 2) or
a quantized linear predictor, whichever is smallest, with its residual in one
Rice partition. Frames of a whole batch of documents are worked on side by side:
step t handles sample t of every frame, so Python's cost is per step, not per
sample. Decoding seeks to the frames by the table, checks the CRC-8 of each header
and the CRC-16 of each frame, undoes Rice codes and predictors, and the MD5.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folium.llm.common import batch_columns, bounded_batches, materialize

BLOCK, RATE, LPC_ORDER, LPC_BITS, WARM_BITS = 192, 8000, 2, 12, 8
#: Frames from one seek point to the next.
POINT_EVERY = 8
#: Fixed values of the format: seek points a table may hold, frames coded at a time.
MOST_POINTS, FRAMES_AT_ONCE = 900_000, 8192
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table, top = [], 1 << (bits - 1)
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & ((1 << bits) - 1)
        table.append(c)
    return np.array(table, np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC of buffer[start:end] for every row side by side."""
    table, mask = (_CRC8, 0xFF) if bits == 8 else (_CRC16, 0xFFFF)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so those still running are a prefix
    at, left = starts[order], (ends - starts)[order]
    crc = np.zeros(len(order), np.uint32)
    running = len(order)
    for step in range(int(left.max(initial=0))):
        while running and left[running - 1] <= step:
            running -= 1
        byte = buffer[at[:running] + step]
        crc[:running] = (crc[:running] << np.uint32(8) & np.uint32(mask)) ^ table[(crc[:running] >> np.uint32(bits - 8)) ^ byte]
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


# --------------------------------------------------------------------- prediction


def _levinson(x: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients of every row of x by the autocorrelation method."""
    x = x.astype(np.float64)
    n = x.shape[1]
    r = np.stack([(x[:, lag:] * x[:, : n - lag]).sum(axis=1) for lag in range(order + 1)])
    a = np.zeros((order, len(x)))
    error = r[0] + 1e-9
    for i in range(order):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / error
        before = a.copy()
        a[i] = k
        for j in range(i):
            a[j] = before[j] - k * before[i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1e-9)
    return a.T


def _quantize(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shift): signed LPC_BITS-bit integers and the right shift that scales them."""
    largest = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(largest)).astype(np.int64), 0, 15)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _residuals(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(order, residual, coefficients, shift) of each candidate predictor; fixed ones have no coefficients."""
    found: list = []
    r = x
    for order in range(3):
        found.append((order, r, None, None))
        r = np.diff(r, axis=1)
    q, shift = _quantize(_levinson(x, LPC_ORDER))
    guess = sum(q[:, j, None] * x[:, LPC_ORDER - 1 - j : x.shape[1] - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    found.append((LPC_ORDER, x[:, LPC_ORDER:] - guess, q, shift))
    return found


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded residual, parameter, bits) with the better of the two parameters nearest the mean."""
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    n = folded.shape[1]
    low = np.clip(np.floor(np.log2(np.maximum(folded.mean(axis=1) * 0.7, 1.0))).astype(np.int64), 0, 13)
    cost = [n * (k + 1) + (folded >> k[:, None]).sum(axis=1) for k in (low, low + 1)]
    return folded, low + (cost[1] < cost[0]), np.minimum(*cost)


# --------------------------------------------------------------------- bit writing


class _Bits:
    """Bits of many frames, each from its own start."""

    def __init__(self, starts: np.ndarray, total: int):
        self.at, self.bits = starts.copy(), np.zeros(total, np.uint8)

    def put(self, rows: np.ndarray, values: np.ndarray | int, width: int) -> None:
        values = np.broadcast_to(np.asarray(values, np.int64), (len(rows),))
        places = self.at[rows][:, None] + np.arange(width)
        self.bits[places] = (values[:, None] >> np.arange(width - 1, -1, -1)) & 1
        self.at[rows] += width


def _number_bytes(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8-like code: (bytes right-aligned in 7 columns, count)."""
    count = np.ones(len(number), np.int64)
    for c, least in ((2, 1 << 7), (3, 1 << 11), (4, 1 << 16), (5, 1 << 21), (6, 1 << 26)):
        count[number >= least] = c
    out = np.zeros((len(number), 7), np.int64)
    rest = number.copy()
    for i in range(6):
        inner = i < count - 1
        out[:, 6 - i] = np.where(inner, 0x80 | (rest & 0x3F), out[:, 6 - i])
        lead = i == count - 1
        mark = np.where(count == 1, 0, (0xFF00 >> count) & 0xFF)
        out[:, 6 - i] = np.where(lead, mark | rest, out[:, 6 - i])
        rest = np.where(inner, rest >> 6, rest)
    return out, count


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): frames one after another, with the end of each; samples is (frames, BLOCK) of -128 to 127."""
    n = len(samples)
    x = samples.astype(np.int64)
    options = _residuals(x)
    coded = [_rice(r) for _, r, _, _ in options]
    extra = [WARM_BITS * o + 10 + (0 if q is None else 9 + LPC_BITS * o) for o, _, q, _ in options]
    cost = np.stack([bits + e for (_, _, bits), e in zip(coded, extra, strict=True)] + [np.full(n, BLOCK * 8)])
    choice = cost.argmin(axis=0)
    choice[(x == x[:, :1]).all(axis=1)] = 5
    number, width = _number_bytes(numbers)
    payload = np.where(choice == 5, 8, cost.min(axis=0))
    head = 4 + width + 1
    size = head + (8 + payload + 7) // 8 + 2
    ends = np.cumsum(size)
    w = _Bits(8 * (ends - size), 8 * int(ends[-1]))
    every = np.arange(n)
    w.put(every, 0xFFF8, 16)  # sync code, blocks of one size
    w.put(every, 0x14, 8)  # 192 samples, 8 kHz
    w.put(every, 0x02, 8)  # mono, 8 bits a sample
    for i in range(7):
        rows = np.flatnonzero(width >= 7 - i)
        w.put(rows, number[rows, i], 8)
    crc_at = w.at.copy()
    w.at += 8
    for kind in range(6):
        rows = np.flatnonzero(choice == kind)
        if not len(rows):
            continue
        if kind == 5:
            w.put(rows, 0, 8)
            w.put(rows, x[rows, 0] & 0xFF, 8)
            continue
        if kind == 4:
            w.put(rows, 0b000001 << 1, 8)
            _put_block(w, rows, x[rows] & 0xFF, 8)
            continue
        order, _, q, shift = options[kind]
        w.put(rows, ((0b001000 | order) if q is None else (0b100000 | (order - 1))) << 1, 8)
        for i in range(order):
            w.put(rows, x[rows, i] & 0xFF, WARM_BITS)
        if q is not None:
            w.put(rows, LPC_BITS - 1, 4)
            w.put(rows, shift[rows], 5)
            for j in range(order):
                w.put(rows, q[rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
        w.put(rows, 0, 6)  # Rice method 0, one partition
        folded, k = coded[kind][0][rows], coded[kind][1][rows]
        w.put(rows, k, 4)
        quotient = folded >> k[:, None]
        length = quotient + 1 + k[:, None]
        stop = w.at[rows][:, None] + np.cumsum(length, axis=1) - length + quotient
        w.bits[stop] = 1
        for parameter in np.unique(k).tolist():
            some = k == parameter
            for j in range(parameter):
                w.bits[stop[some] + 1 + j] = (folded[some] >> (parameter - 1 - j)) & 1
        w.at[rows] += length.sum(axis=1)
    out = np.packbits(w.bits)
    starts = ends - size
    out[crc_at // 8] = _crc(out, starts, starts + head - 1, 8)
    crc = _crc(out, starts, ends - 2, 16)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    return out, ends


def _put_block(w: _Bits, rows: np.ndarray, values: np.ndarray, width: int) -> None:
    places = w.at[rows][:, None] + np.arange(values.shape[1] * width)
    w.bits[places] = np.unpackbits(values.astype(np.uint8), axis=1)
    w.at[rows] += values.shape[1] * width


def _stream_head(n_samples: int, md5: bytes, sizes: np.ndarray) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE for frames of the given sizes."""
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | n_samples).to_bytes(8, "big") + md5
    step = max(POINT_EVERY, -(-len(sizes) // MOST_POINTS))
    points = np.zeros(-(-len(sizes) // step), _POINT)
    points["sample"] = np.arange(len(sizes), dtype=np.int64)[::step] * BLOCK
    points["offset"] = (np.cumsum(sizes) - sizes)[::step]
    points["n"] = BLOCK
    table = points.tobytes()
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose length is a positive multiple of 192."""
    counts = [len(p) // BLOCK for p in payloads]
    whole = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, BLOCK) - 128
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, np.int64)
    parts, sizes = [], []
    for at in range(0, len(whole), FRAMES_AT_ONCE):
        data, ends = encode_frames(whole[at : at + FRAMES_AT_ONCE], numbers[at : at + FRAMES_AT_ONCE])
        parts.append(data.tobytes())
        sizes.append(np.diff(ends, prepend=0))
    body = b"".join(parts)
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    out, frame, byte = [], 0, 0
    for payload, count in zip(payloads, counts, strict=True):
        own = size[frame : frame + count]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        to = byte + int(own.sum())
        out.append(_stream_head(len(payload), hashlib.md5(signed).digest(), own) + body[byte:to])
        frame, byte = frame + count, to
    return out


# --------------------------------------------------------------------- reading


class CorruptStream(ValueError):
    """A stream whose checksums or structure don't hold."""


class _Reader:
    """Bit positions of many frames in one buffer, read side by side."""

    def __init__(self, buffer: np.ndarray, at: np.ndarray):
        padded = np.concatenate([buffer, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        self.at, self.last = at.astype(np.int64), 8 * len(buffer)

    def window(self, rows: np.ndarray) -> np.ndarray:
        at = self.at[rows]
        if len(at) and int(at.max()) > self.last:
            raise CorruptStream("a frame ends early")
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, rows: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Up to 32 bits each."""
        width = np.broadcast_to(np.asarray(width, np.int64), (len(rows),))
        value = np.where(width > 0, self.window(rows) >> (64 - np.maximum(width, 1)).astype(np.uint64), 0)
        self.at[rows] += width
        return value.astype(np.int64)

    def unary(self, rows: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is passed over."""
        count, todo = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo):
            top = (self.window(rows[todo]) >> np.uint64(32)).astype(np.int64)
            zeros = 32 - np.frexp(top.astype(np.float64))[1]
            count[todo] += zeros
            self.at[rows[todo]] += zeros + (top > 0)
            todo = todo[top == 0]
        return count


def _signed(values: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    half = np.int64(1) << (np.asarray(bits, np.int64) - 1)
    return (values ^ half) - half


def decode_frames(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples, frame numbers, ends) of the frames that begin at `starts`; their checksums are verified."""
    n = len(starts)
    every = np.arange(n)
    r = _Reader(buffer, 8 * starts)
    if (r.take(every, 32) != 0xFFF81402).any():
        raise CorruptStream("no frame of this format at a seek point")
    lead = r.take(every, 8)
    more = np.zeros(n, np.int64)
    for count, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0), (4, 0xF8), (5, 0xFC)):
        more[lead >= least] = count
    number = np.where(more == 0, lead, lead & ((1 << (6 - more)) - 1))
    for i in range(5):
        rows = np.flatnonzero(more > i)
        number[rows] = (number[rows] << 6) | (r.take(rows, 8) & 0x3F)
    crc = r.take(every, 8)
    if (crc != _crc(buffer, starts, r.at // 8 - 1, 8)).any():
        raise CorruptStream("a frame header's checksum differs")
    kind = r.take(every, 8) >> 1
    x = np.zeros((n, BLOCK), np.int64)
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    x[constant] = _signed(r.take(constant, 8), 8)[:, None]
    for t in range(BLOCK if len(verbatim) else 0):
        x[verbatim, t] = _signed(r.take(verbatim, 8), 8)
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32) | (kind > 63)).any():
        raise CorruptStream("a reserved subframe type")
    fixed = np.flatnonzero((kind >= 8) & (kind <= 12))
    linear = np.flatnonzero(kind >= 32)
    order = np.where(kind >= 32, kind - 31, kind - 8)
    coded = np.concatenate([fixed, linear])
    deepest = int(order[coded].max(initial=0))
    for t in range(deepest):
        rows = coded[order[coded] > t]
        x[rows, t] = _signed(r.take(rows, 8), 8)
    q, shift = np.zeros((n, max(deepest, 1)), np.int64), np.zeros(n, np.int64)
    for o, row in enumerate(([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])):
        if row:
            q[np.ix_(fixed[order[fixed] == o], range(len(row)))] = row
    precision = r.take(linear, 4) + 1
    shift[linear] = r.take(linear, 5)
    for j in range(int(order[linear].max(initial=0))):
        has = order[linear] > j
        q[linear[has], j] = _signed(r.take(linear[has], precision[has]), precision[has])
    method = r.take(coded, 2)
    partitions = r.take(coded, 4)
    size = BLOCK >> partitions
    if (method > 1).any() or (size << partitions != BLOCK).any() or (size < order[coded]).any():
        raise CorruptStream("residuals in partitions that don't fit the block")
    parameter, raw_bits = np.zeros((2, len(coded)), np.int64)

    def enter(which: np.ndarray) -> None:
        """Read the Rice parameter of the next partition."""
        parameter[which] = r.take(coded[which], np.where(method[which] == 0, 4, 5))
        out = which[parameter[which] == np.where(method[which] == 0, 15, 31)]
        raw_bits[which] = 0
        raw_bits[out] = r.take(coded[out], 5)

    enter(np.arange(len(coded)))
    several = np.flatnonzero(partitions > 0)
    for t in range(BLOCK):
        if t and len(several):
            enter(several[t % size[several] == 0])
        escape = parameter == np.where(method == 0, 15, 31)
        plain = not escape.any()
        live = order[coded] <= t if t < deepest else slice(None)
        rows, k = coded[live], parameter[live]
        if plain:
            value = (r.unary(rows) << k) | r.take(rows, k)
            value = (value >> 1) ^ -(value & 1)
        else:
            out = escape[live]
            value = np.empty(len(rows), np.int64)
            folded = (r.unary(rows[~out]) << k[~out]) | r.take(rows[~out], k[~out])
            value[~out] = (folded >> 1) ^ -(folded & 1)
            bits = raw_bits[live][out]
            value[out] = np.where(bits > 0, _signed(r.take(rows[out], bits), np.maximum(bits, 1)), 0)
        guess = np.zeros(len(rows), np.int64)
        for j in range(min(t, deepest)):
            guess += q[rows, j] * x[rows, t - 1 - j]
        x[rows, t] = value + (guess >> shift[rows])
    ends = (r.at + 7) // 8
    if (_crc(buffer, starts, ends, 16) != ((buffer[ends].astype(np.uint32) << 8) | buffer[ends + 1])).any():
        raise CorruptStream("a frame's checksum differs")
    return x, number, ends + 2


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams; raises CorruptStream where a checksum doesn't hold.

    Frames are entered at the seek points, all at once, and followed from each to the next.
    """
    heads, lanes, base, total = [], [], 0, 0
    for s in streams:
        n_samples, md5, first, samples, offsets = _read_head(s)
        n = n_samples // BLOCK
        if n and (not len(samples) or samples[0]):
            raise CorruptStream("no seek point at the start")
        frames = samples // BLOCK
        lanes.append(np.stack([offsets + (base + first), frames, np.r_[frames[1:], n][: len(frames)], np.full(len(frames), total)]))
        heads.append((n, md5))
        base, total = base + len(s), total + n
    buffer = np.frombuffer(b"".join(streams), np.uint8)
    at, frame, until, before = np.concatenate(lanes, axis=1) if lanes else np.empty((4, 0), np.int64)
    signed = np.zeros((total, BLOCK), np.int8)
    while len(at):
        ends = []
        for i in range(0, len(at), FRAMES_AT_ONCE):
            part = slice(i, i + FRAMES_AT_ONCE)
            x, number, end = decode_frames(buffer, at[part])
            if (number != frame[part]).any():
                raise CorruptStream("a frame is out of place")
            signed[before[part] + number] = x
            ends.append(end)
        at, frame = np.concatenate(ends), frame + 1
        more = frame < until
        at, frame, until, before = at[more], frame[more], until[more], before[more]
    out, row = [], 0
    for n, md5 in heads:
        own = signed[row : row + n].tobytes()
        row += n
        if hashlib.md5(own).digest() != md5:
            raise CorruptStream("the audio's checksum differs")
        out.append((np.frombuffer(own, np.uint8) ^ 0x80).tobytes())
    return out


def read_samples(stream: bytes, first: int, count: int) -> bytes:
    """The payload's bytes of samples first to first + count, entered at the seek point before them; only the frames that hold them are read and verified."""
    n_samples, _, begin, points, offsets = _read_head(stream)
    last = min(first + count, n_samples)
    if first < 0 or first >= last:
        return b""
    if not len(points) or points[0]:
        raise CorruptStream("no seek point at the start")
    point = int(np.searchsorted(points, first, "right")) - 1
    buffer, at, sample, parts = np.frombuffer(stream, np.uint8), begin + int(offsets[point]), int(points[point]), []
    while sample < last:
        x, number, end = decode_frames(buffer, np.array([at]))
        if int(number[0]) * BLOCK != sample:
            raise CorruptStream("a frame is out of place")
        parts.append((x[0] + 128).astype(np.uint8))
        at, sample = int(end[0]), sample + BLOCK
    from_ = first - int(points[point])
    return np.concatenate(parts)[from_ : from_ + last - first].tobytes()


def _read_head(s: bytes) -> tuple[int, bytes, int, np.ndarray, np.ndarray]:
    """(samples, MD5, first frame, sample numbers of the seek points, their offsets)."""
    if s[:4] != b"fLaC":
        raise CorruptStream("not a FLAC stream")
    at, last, info, points = 4, False, b"", np.empty(0, _POINT)
    while not last:
        kind, size = s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4], "big")
        last, body = bool(s[at] & 0x80), s[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body, _POINT)
        at += 4 + size
    return int.from_bytes(info[10:18], "big") & ((1 << 36) - 1), info[18:34], at, points["sample"].astype(np.int64), points["offset"].astype(np.int64)


# --------------------------------------------------------------------- Spark


def payload_of(text: bytes | None) -> bytes:
    """The text's UTF-8 bytes and spaces up to a positive multiple of 192."""
    text = text or b""
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def _features(payload: bytes) -> str:
    """Mean, root mean square, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={int(x.sum()) / len(x):.4f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};crossings={crossings};peak={int(np.abs(x).max())}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a FLAC stream. Null texts are empty ones: one frame of spaces."""
    return _by_batch(docs, id_col, text_col, [], "doc_id long, n_bytes long, media binary", lambda texts: (
        pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(encode([payload_of(t) for t in texts]), pa.binary())))


def _by_batch(df: DataFrame, id_col: str, data_col: str, kept: list[str], schema: str, of) -> DataFrame:
    """A row for each row of df: its id, the columns kept, and what `of` makes of a batch of its data."""
    bounded_batches(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data,) = batch_columns(batch, "data")
            if data:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *of(data)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(data_col).cast("binary").alias("data")).mapInArrow(run, schema)


def pcm_samples(media: DataFrame, media_col: str = "media", column: str = "samples") -> DataFrame:
    """media with a column of a part of each stream's samples: those from its column `first` on, as many as its column `count` says, found by the seek points. Null in any of the three gives null."""
    bounded_batches(media.sparkSession)
    schema = StructType([*media.schema.fields, StructField(column, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*batch_columns(batch, media_col, "first", "count"), strict=True)
            found = [None if None in (s, a, n) else read_samples(s, a, n) for s, a, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, column])

    return media.mapInArrow(run, schema)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, block, first_sample, pcm): the decoded blocks of 192 samples with their sample offsets. Null streams give none."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, stream in zip(*batch_columns(batch, "doc_id", "data"), strict=True):
                pcm = decode([stream])[0]
                n = len(pcm) // BLOCK
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(range(0, n * BLOCK, BLOCK), pa.int64()), pa.array([pcm[i * BLOCK : (i + 1) * BLOCK] for i in range(n)], pa.binary())],
                    ["doc_id", "block", "first_sample", "pcm"])

    ready = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("data"))
    return ready.mapInArrow(run, "doc_id long, block long, first_sample long, pcm binary")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as FLAC, read it back, and describe both forms; one row per row of docs.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature). Null and empty texts are one frame of spaces. Equal
    texts have equal values; repeated rows and null ids stay as they are.
    """
    # copies of a text and what Rice codes leave of its repeats shrink again in the table that holds the streams
    stored = materialize(to_media(docs, id_col, text_col), "flac-media", compression="zstd", **{"parquet.compression.codec.zstd.level": "9"})
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def of(media: list[bytes]) -> list[pa.Array]:
        back = decode(media)
        longs = lambda values: pa.array(values, pa.int64())
        sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values])
        return [longs([len(p) for p in back]), sha(back), longs([zlib.crc32(p[-16:]) for p in back]), longs([len(m) for m in media]), sha(media), pa.array([_features(p) for p in back])]

    return _by_batch(stored, "doc_id", "media", ["n_bytes"], schema, of)
