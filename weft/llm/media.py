"""Media columns: AVI files of motion JPEG, and the shots in them.

A payload is stored as gray video. Each byte is the level of one 8 x 8 block of a baseline
JPEG frame of 8 x 8 blocks (quantiser 8 for the mean, so the level comes back exactly), 64
bytes a frame, 25 frames a second, each frame intra coded, with an ``idx1`` index. Reading goes
through the index, decodes the blocks' levels of each frame and compares histograms of
neighbouring frames; a difference far above those before it starts a new shot.

Frames of one header are coded together, ``FRAMES`` at a time: symbols of all frames as arrays on
the way in, all frames one block at a time on the way out. Other baseline JPEGs (colour,
subsampled, with texture, with restarts) go through a plain decoder, whose inverse cosine
transform gives the pixels of the first component. A file takes some 3.5 bytes for each byte of
text, so texts beyond some 500 MB exceed what a cell of Spark can hold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from weft.errors import need_columns
from weft.llm.common import field, schema_with, slices, texts_of

SAMPLES, SIDE, MICROSECONDS = 64, 64, 40_000
#: Huffman code lengths of the categories 0 to 8 of a level difference.
_LENGTHS = {5: 2, 3: 3, 4: 3, 7: 3, 1: 4, 2: 4, 0: 5, 6: 6, 8: 7}
BINS, PAST, FACTOR, LEAST = 16, 12, 3.0, 0.3
#: Frames that are coded or decoded at a time.
FRAMES = 1 << 14


def _codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes ``symbol: (code, length)`` from the counts by length (1 to 16) and the symbols in order."""
    out, code, at = {}, 0, 0
    for bits, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            out[symbol] = (code, bits)
            code += 1
        at += count
        code <<= 1
    return out


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    counts = [sum(n == bits for n in lengths.values()) for bits in range(1, 17)]
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return struct.pack(">HHB", 0xFFC4, 19 + len(symbols), kind) + bytes(counts) + bytes(symbols)


HEADER = b"".join(
    (
        b"\xff\xd8",
        struct.pack(">HHB", 0xFFDB, 67, 0) + bytes([8]) + bytes([1]) * 63,
        struct.pack(">HHBHHB3B", 0xFFC0, 11, 8, SIDE, SIDE, 1, 1, 0x11, 0),
        _table(0x00, _LENGTHS),
        _table(0x10, {0: 1}),
        struct.pack(">HHB2B3B", 0xFFDA, 8, 1, 1, 0x00, 0, 63, 0),
    )
)


@lru_cache(1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For differences from -255 to 255 the code, its bits and the end of the block, left in 16 bits, and the length."""
    order = sorted(_LENGTHS, key=lambda s: (_LENGTHS[s], s))
    codes = _codes([sum(n == b for n in _LENGTHS.values()) for b in range(1, 17)], order)
    words, sizes = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        n = bits + size + 1
        words[d + 255], sizes[d + 255] = (code << size | extra) << 1 << (16 - n), n
    return words, sizes


def encode_frames(levels: np.ndarray) -> list[bytes]:
    """A JPEG for each row of 64 levels."""
    return [frame for i in range(0, len(levels), FRAMES) for frame in _encode(levels[i : i + FRAMES])]


def _encode(levels: np.ndarray) -> list[bytes]:
    words, sizes = _symbols()
    diff = np.diff(levels.astype(np.int16) - 128, axis=1, prepend=np.int16(0)) + 255
    n = sizes[diff]
    fill = (-n.sum(axis=1, dtype=np.int64) % 8).astype(np.uint8)
    n = np.concatenate([n, fill[:, None]], axis=1)
    words = np.concatenate([words[diff], np.full((len(levels), 1), 0xFFFF, np.uint16)], axis=1)
    bits = np.unpackbits(words.astype(">u2").view(np.uint8)).reshape(*n.shape, 16)
    data = np.packbits(bits[np.arange(16, dtype=np.uint8) < n[:, :, None]]).tobytes()
    ends = np.cumsum(n.sum(axis=1, dtype=np.int64) // 8).tolist()
    return [HEADER + data[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip([0, *ends], ends, strict=False)]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) % 2)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, microseconds: int = MICROSECONDS) -> bytes:
    """An AVI file of these JPEG frames with an index of all of them as key frames."""
    most, n = max(map(len, frames), default=0), len(frames)
    avih = struct.pack("<14I", microseconds, 0, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, microseconds, 1_000_000, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.fromiter(map(len, frames), np.int64, n)
    index = np.zeros(n, "S4,<u4,<u4,<u4")
    index["f0"], index["f1"], index["f3"] = b"00dc", 0x10, sizes
    index["f2"] = 4 + np.concatenate([[0], np.cumsum(sizes + sizes % 2 + 8)])[:n]
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    return _chunk(b"RIFF", b"AVI " + header + movi + _chunk(b"idx1", index.tobytes()))


def _parts(data: bytes, at: int, end: int):
    """``(name, kind of list or b"", start, end)`` of the chunks from ``at`` on; the end is that of the content."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12] if name in (b"LIST", b"RIFF") else b""
        yield name, kind, at + 8 + len(kind), min(end, at + 8 + size)
        at += 8 + size + size % 2


def _frames_in(data: bytes, at: int, end: int, names: set[bytes]):
    """The frames of a ``movi`` list, those in its groups of records included."""
    for name, kind, start, stop in _parts(data, at, end):
        if name in names:
            yield data[start:stop]
        elif kind == b"rec ":
            yield from _frames_in(data, start, stop, names)


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds a frame, and the frames of the first video stream: by the index of a plain file, by the chunks of all parts of others."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    step, stream, lists, index, files = MICROSECONDS, None, [], None, 0
    for _, kind, at, end in _parts(data, 0, len(data)):
        files += kind in (b"AVI ", b"AVIX")
        for name, kind, start, stop in _parts(data, at, end):  # noqa: B020
            if kind == b"movi":
                lists.append((start, stop))
            elif name == b"idx1":
                index = np.frombuffer(data, "S4,<u4,<u4,<u4", (stop - start) // 16, start)
            elif kind == b"hdrl":
                heads = list(_parts(data, start, stop))
                step = next((struct.unpack_from("<I", data, a)[0] for n, _, a, _ in heads if n == b"avih"), step)
                streams = [data[a + 8 : a + 12] for _, k, a, _ in heads if k == b"strl"]
                stream = next((i for i, k in enumerate(streams) if k == b"vids"), None)
    if not lists:
        raise ValueError("an AVI file without frames")
    if stream is None:
        raise ValueError("an AVI file without a video stream")
    names = {b"%02ddc" % stream, b"%02ddb" % stream}
    if index is not None and files == len(lists) == 1:
        kept, (start, stop) = index[np.isin(index["f0"], list(names))], lists[0]
        offsets = kept["f2"].astype(np.int64)
        base = start - 4 if len(kept) and data[start - 4 + int(offsets[0]) :][:4] == kept["f0"][0] else 0
        at, ends = offsets + base + 8, offsets + base + 8 + kept["f3"]
        if not (ends <= stop).all():
            raise ValueError("an AVI index beyond its frames")
        return step, [data[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    return step, [frame for start, stop in lists for frame in _frames_in(data, start, stop, names)]


def _standard_tables() -> dict[int, dict[int, tuple[int, int]]]:
    """The Huffman tables that motion JPEG frames may leave out (JPEG standard, annex K)."""
    # fixed values: counts of codes by length, then symbols in order
    dc = ([0, 1, 5, 1, 1, 1, 1, 1, 1], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1])
    bright = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], "01020300041105122131410613516107227114328191A1082342B1C11552D1F02433627282")
    colour = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], "000102031104052131061241510761711322328108144291A1B1C109233352F0156272D10A162434E125F1")
    found = {k: _codes(counts + [0] * (16 - len(counts)), list(range(12))) for k, counts in enumerate(dc)}
    for k, (counts, symbols) in enumerate((bright, colour)):
        first = list(bytes.fromhex(symbols))
        rest = [run << 4 | size for run in range(16) for size in range(1, 11) if (run << 4 | size) not in first]
        found[16 + k] = _codes(counts, first + rest)
    return found


#: For each coefficient in coded order its place in a block of rows; the cosines of the inverse transform.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
_COSINES = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class Jpeg:
    """The tables of a baseline JPEG header (all before the coded data)."""

    def __init__(self, header: bytes):
        self.quant, self.tables, self.huff, self.restart = {}, {}, _standard_tables(), 0
        at = 2
        while at + 4 <= len(header):
            mark, size = struct.unpack_from(">HH", header, at)
            part = header[at + 4 : at + 2 + size]
            if mark == 0xFFDB:
                i = 0
                while i < len(part):
                    wide = part[i] >> 4
                    self.tables[part[i] & 15] = list(struct.unpack_from(">64H", part, i + 1)) if wide else list(part[i + 1 : i + 65])
                    self.quant[part[i] & 15] = self.tables[part[i] & 15][0]
                    i += 1 + 64 * (1 + wide)
            elif mark == 0xFFC4:
                i = 0
                while i < len(part):
                    counts = list(part[i + 1 : i + 17])
                    self.huff[part[i]] = _codes(counts, list(part[i + 17 : i + 17 + sum(counts)]))
                    i += 17 + sum(counts)
            elif mark in (0xFFC0, 0xFFC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", part)
                self.parts = {part[6 + 3 * k]: (part[7 + 3 * k] >> 4, part[7 + 3 * k] & 15, part[8 + 3 * k]) for k in range(n)}
            elif mark == 0xFFDD:
                self.restart = struct.unpack(">H", part[:2])[0]
            elif mark == 0xFFDA:
                self.scan = [(part[1 + 2 * k], part[2 + 2 * k] >> 4, part[2 + 2 * k] & 15) for k in range(part[0])]
            elif 0xFFC2 <= mark <= 0xFFCF and mark != 0xFFC8 and mark != 0xFFCC:
                raise ValueError("only baseline JPEG frames are read")
            at += 2 + size
        one = len(self.scan) == 1
        h, v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        self.across = -(-self.width // (8 if one else 8 * h))
        self.down = -(-self.height // (8 if one else 8 * v))
        self.units = [(c, dc, ac) for c, dc, ac in self.scan for _ in range(1 if one else self.parts[c][0] * self.parts[c][1])]
        self.plain = one and not self.restart

    @property
    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """For the next 16 bits: the difference and length of a block that has a mean only; length 0 if it has more."""
        if not hasattr(self, "_flat"):
            value, length = np.zeros(65536, np.int16), np.zeros(65536, np.uint8)
            _, dc, ac = self.scan[0]
            end, end_bits = self.huff[16 + ac].get(0, (0, 99))
            for size, (code, bits) in self.huff[dc].items():
                n = bits + size + end_bits
                for extra in range(1 << size) if n <= 16 else ():
                    first = ((code << size | extra) << end_bits | end) << (16 - n)
                    value[first : first + (1 << 16 - n)] = extra if not size or extra >> size - 1 else extra - (1 << size) + 1
                    length[first : first + (1 << 16 - n)] = n
            self._flat = value, length
        return self._flat

    def levels(self, coded: list[bytes]) -> np.ndarray:
        """The levels (0 to 255) of the first component, an array for each frame's coded data: of its blocks if they are all flat, else of its pixels."""
        if self.plain:
            value, length = self.flat
            data = [c.replace(b"\xff\x00", b"\xff") for c in coded]
            buffer = np.frombuffer(b"".join([*data, b"\x00" * 4096]), np.uint8)
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            ends = np.cumsum(sizes) * 8
            at = ends - sizes * 8
            mean = np.zeros(len(data), np.int64)
            out = np.empty((self.across * self.down, len(data)), np.int64)
            whole = True
            for k in range(len(out)):
                byte = np.minimum(at >> 3, len(buffer) - 3)
                word = (buffer[byte].astype(np.int32) << 16) | (buffer[byte + 1].astype(np.int32) << 8) | buffer[byte + 2]
                word = (word >> (8 - (at & 7))) & 0xFFFF
                step = length[word]
                whole = whole and bool(step.all())
                if not whole:
                    break
                mean += value[word]
                at += step
                out[k] = mean
            if whole and (at <= ends).all():
                return list(self._scaled(out.T))
        return [self._picture(np.array(self._one(c))) for c in coded]

    def _picture(self, blocks: np.ndarray) -> np.ndarray:
        """Blocks of coefficients (in zigzag order) as levels."""
        if not blocks[:, 1:].any():
            return self._scaled(blocks[:, 0])
        h, v, q = self.parts[self.scan[0][0]]
        wide = np.zeros((len(blocks), 64))
        wide[:, _ZIGZAG] = blocks * np.array(self.tables[q])
        pixels = np.einsum("ux,nuv,vy->nxy", _COSINES, wide.reshape(-1, 8, 8), _COSINES, optimize=True)
        h, v = (1, 1) if len(self.scan) == 1 else (h, v)
        rows = pixels.reshape(self.down, self.across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(self.down * v * 8, -1)
        most = [max(p[i] for p in self.parts.values()) for i in (0, 1)] if len(self.scan) > 1 else (1, 1)
        rows = rows[: -(-self.height * v // most[1]), : -(-self.width * h // most[0])]
        return np.clip(np.rint(rows) + 128, 0, 255).astype(np.uint8).ravel()

    def _scaled(self, means: np.ndarray) -> np.ndarray:
        return np.clip((means * self.quant[self.parts[self.scan[0][0]][2]] + 4) // 8 + 128, 0, 255).astype(np.uint8)

    def _one(self, coded: bytes) -> list[list[int]]:
        """The coefficients of all blocks of the first component of one frame, code by code."""
        lookup = {k: {(bits, code): s for s, (code, bits) in t.items()} for k, t in self.huff.items()}
        parts, at = [b""], 0
        while at < len(coded):  # restart marks cut the data
            mark = coded.find(b"\xff", at)
            mark = len(coded) if mark < 0 else mark
            parts[-1] += coded[at:mark]
            if coded[mark : mark + 2] == b"\xff\x00":
                parts[-1] += b"\xff"
            elif mark < len(coded):
                parts.append(b"")
            at = mark + 2
        first, out, done = self.scan[0][0], [], 0
        total = self.across * self.down
        for data in parts:
            number, left = int.from_bytes(data, "big"), len(data) * 8

            def take(n):
                nonlocal left
                left -= n
                if left < 0:
                    raise ValueError("a JPEG frame ends too early")
                return number >> left & ((1 << n) - 1)

            def symbol(table):
                code = 0
                for bits in range(1, 17):
                    code = code << 1 | take(1)
                    if (bits, code) in table:
                        return table[bits, code]
                raise ValueError("a code that no JPEG table has")

            def value(size):
                extra = take(size) if size else 0
                return extra if not size or extra >> size - 1 else extra - (1 << size) + 1

            mean = dict.fromkeys((c for c, _, _ in self.scan), 0)
            for _ in range(min(self.restart or total, total - done)):
                for c, dc, ac in self.units:
                    mean[c] += value(symbol(lookup[dc]))
                    block = [mean[c]] + [0] * 63
                    if c == first:
                        out.append(block)
                    k = 1
                    while k < 64:
                        rs = symbol(lookup[16 + ac])
                        if not rs:
                            break
                        k += rs >> 4
                        if k > 63:
                            raise ValueError("a JPEG block is too long")
                        block[k] = value(rs & 15)
                        k += 1
                done += 1
        if done < total:
            raise ValueError("a JPEG frame ends too early")
        return out


@lru_cache(64)
def _jpeg(header: bytes) -> Jpeg:
    return Jpeg(header)


def _split(frame: bytes) -> tuple[bytes, bytes]:
    """Header and coded data of a JPEG."""
    if frame.startswith(HEADER):
        return HEADER, frame[len(HEADER) : frame.rfind(b"\xff\xd9")]
    at = 2
    while at + 4 <= len(frame):
        mark, size = struct.unpack_from(">HH", frame, at)
        at += 2 + size
        if mark == 0xFFDA:
            end = frame.rfind(b"\xff\xd9")
            return frame[:at], frame[at : end if end > 0 else len(frame)]
    raise ValueError("a JPEG frame without data")


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The levels of each frame; frames of one header are decoded together."""
    by: dict[bytes, list[int]] = {}
    coded = []
    for i, f in enumerate(frames):
        head, data = _split(f)
        coded.append(data)
        by.setdefault(head, []).append(i)
    out: list = [None] * len(frames)
    for head, every in by.items():
        for k in range(0, len(every), FRAMES):
            at = every[k : k + FRAMES]
            for i, row in zip(at, _jpeg(head).levels([coded[i] for i in at]), strict=True):
                out[i] = row
    return out


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """The part of each frame's levels in each of ``BINS`` equal bins."""
    if not frames:
        return np.zeros((0, BINS))
    if len(frames) > FRAMES:
        return np.concatenate([histograms(frames[i : i + FRAMES]) for i in range(0, len(frames), FRAMES)])
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    row = np.repeat(np.arange(len(frames)), sizes)
    counts = np.bincount(row * BINS + np.concatenate(frames) // (256 // BINS), minlength=len(frames) * BINS)
    return counts.reshape(-1, BINS) / sizes[:, None]


def shots(hist: np.ndarray) -> list[int]:
    """First frames of the shots. A cut: half the sum of bin differences is over the mean of the last
    ``PAST`` differences by ``FACTOR`` deviations, and over ``LEAST``."""
    if len(hist) < 2:
        return [0][: len(hist)]
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    at = np.arange(len(d))
    low = np.maximum(0, at - PAST)
    n = np.maximum(1, at - low)
    mean = (s1[at] - s1[low]) / n
    spread = np.sqrt(np.maximum(0, (s2[at] - s2[low]) / n - mean * mean))
    return [0, *(np.nonzero((d > LEAST) & (d > mean + FACTOR * spread + 1e-9))[0] + 1).tolist()]


def payload_of(text: bytes | None) -> bytes:
    data = text or b""
    return data + b"\x00" * (max(SAMPLES, -(-len(data) // SAMPLES) * SAMPLES) - len(data))


def store(texts: list[bytes | None]) -> list[bytes]:
    """An AVI file for each text."""
    payloads = [payload_of(t) for t in texts]
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SAMPLES))
    ends = np.cumsum([len(p) // SAMPLES for p in payloads]).tolist()
    return [write_avi(frames[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _shots_of(files: list[bytes]):
    """``(microseconds a frame, levels by frame, first frames of shots)`` for each file."""
    read = [read_avi(f) for f in files]
    levels = decode_frames([f for _, frames in read for f in frames])
    hist, at = histograms(levels), 0
    for step, frames in read:
        n = len(frames)
        yield step, levels[at : at + n], shots(hist[at : at + n])
        at += n


def encode_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with an AVI file of each whole text; a null text is stored as an empty one. A column of that name is replaced."""
    need_columns("media", "text_col", docs, [text_col])
    docs = docs.drop(media_col)
    at = docs.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(docs.columns))), "media"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(store(texts_of(part.column(at))), pa.binary())], names=names)

    plain = docs.toDF(*names[:-1])
    return plain.mapInArrow(run, schema_with(plain, StructField("media", BinaryType()))).toDF(*docs.columns, media_col)


def _clips(step: int, levels: list[np.ndarray], starts: list[int]) -> list[tuple]:
    """``(clip, start_ms, end_ms, frames, level)`` of each shot."""
    ends = [*starts[1:], len(levels)]
    return [(k, a * step / 1000, b * step / 1000, b - a, float(np.mean([x.mean() for x in levels[a:b]]))) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


def clip_rows(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row for each shot: id, clip (from 0), start_ms, end_ms, frames, level (mean), error.

    A null, broken or unsupported file gives one row with its reason in ``error``; a file
    without frames gives none.
    """
    need_columns("media", "id_col/media_col", media, [id_col, media_col])
    schema = StructType([field(media, id_col, "id"), StructField("clip", IntegerType()), StructField("start_ms", DoubleType()), StructField("end_ms", DoubleType()), StructField("frames", IntegerType()), StructField("level", DoubleType()), StructField("error", StringType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for k, data in enumerate(texts_of(part.column(1))):
                    try:
                        if data is None:
                            raise ValueError("no file")
                        clips = _clips(*next(iter(_shots_of([data]))))
                    except (ValueError, KeyError, IndexError, AttributeError, struct.error) as e:
                        rows.append((k, None, None, None, None, None, str(e) or type(e).__name__))
                        continue
                    rows += [(k, *clip, None) for clip in clips]
                ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds))], names=schema.names)

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text, read the stored file back, and give figures of both.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (payload read back),
    media_bytes, media_sha256 (stored file), feature (the clips as in ``clip_rows``, each
    ``start_ms-end_ms``, comma-joined), clips (their number). Null is as empty. Equal texts give equal values.
    """
    need_columns("media", "id_col/text_col", docs, [id_col, text_col])
    longs = ["n_bytes", "payload_bytes", "tail_crc32", "media_bytes"]
    texts = ["payload_sha256", "media_sha256", "feature"]
    schema = StructType([field(docs, id_col, "id"), *(StructField(c, LongType()) for c in longs), *(StructField(c, StringType()) for c in texts), StructField("clips", IntegerType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                found = texts_of(part.column(1))
                files = store(found)
                back = list(_shots_of(files))
                payloads = [b"".join([x.tobytes() for x in levels]) for _, levels, _ in back]
                clips = [_clips(*x) for x in back]
                columns = [
                    pa.array([len(t or b"") for t in found], pa.int64()),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([",".join(f"{a:.0f}-{b:.0f}" for _, a, b, _, _ in c) for c in clips]),
                    pa.array([len(c) for c in clips], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
