r"""Secret scans through nested encodings.

Each text is the first layer of a worklist. A layer is scanned, then unwrapped: URL escapes
and Unicode escapes give the layer with all of them decoded; each base64 run gives a layer of
its own if it decodes to text, or to gzip, zlib, bzip2 or xz streams, one after the other, that
unpack to text. A run is in the standard or the URL-safe alphabet and may be wrapped over lines.
Streams that unpack to much are read piece by piece, cut where no pattern and no encoded run can
be, so a worker holds a piece of ``UNPACKED`` bytes or the longest run, whatever they unpack to.
A layer text is scanned and unwrapped once, so the list runs dry, but each place where it stands
is kept: spans found in it are mapped back to the characters of the original text that they were
decoded from, once for each place. A chain in which each escape only gives the start of the next
one (``%252525...``) is decoded to its end at once, so a text costs no more the deeper it nests.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from functools import partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from weft.errors import need_columns
from weft.llm.common import schema_with, slices, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}")
#: One line of a run, and a whole run: characters of both alphabets, with single line breaks (and the indentation after them) inside.
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=\r?\n))(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+")
#: The shortest match of any kind takes 12 characters, so 16 in base64.
SHORTEST = 16
#: The parts of a run that does not decode as it stands: in the standard alphabet, in the URL-safe one, in what both share.
_SPLITS = tuple(re.compile(f"[A-Za-z0-9{more}]{{{SHORTEST},}}") for more in ("+/", "_-", ""))
#: Bytes of a stream's content that are held at a time.
UNPACKED = 32 << 20
#: ASCII characters that are in no pattern, escape or run.
_OUTSIDE = re.compile(rb"[!#$&()*,;<>?@\[\]^`|~]")


def scan(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns; matches that are too short are dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Layer:
    """What a base64 run encodes: a text, or streams that unpack to it; and how its characters lie in the text above, of which it covers ``start`` to ``end``."""

    def __init__(self, text: str | bytes, start: int, end: int, place):
        self.text, self.start, self.end, self.place = text, start, end, place


class Decoded:
    """A text with its escapes decoded; ``first`` and ``last`` are where each character's code starts and ends in the text above."""

    def __init__(self, text: str, first: np.ndarray, last: np.ndarray):
        self.text, self.first, self.last = text, first, last


_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


#: What turns an open "%" or "\\" and the plain text behind it into the next open one, and many such steps that leave the same one open.
_CHAINS = {"%": re.compile(r"(?:25)+"), "\\": re.compile(r"(?:u005[cC]|x5[cC])+")}
_STEPS = {"%": re.compile(r"(?P<percent>25)|(?P<slash>5[cC])"), "\\": re.compile(r"(?P<percent>u0025|x25|u\{0{0,4}25\}|U00000025)|(?P<slash>u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}|U0000005[cC])")}


def _opened(text: str, at: int, opener: str) -> tuple[int, str]:
    """The end of a chain of escapes that goes on at ``at``, each giving the start of the next one, and the last such start."""
    while True:
        m = _CHAINS[opener].match(text, at)
        if m:
            at = m.end()
        m = _STEPS[opener].match(text, at)
        if not m:
            return at, opener
        at, opener = m.end(), "%" if m.lastgroup == "percent" else "\\"


def _closed(text: str, low: int, start: int, digit: str) -> tuple[int, str]:
    """The start of a chain to the left of ``start``, where each decoded digit completes the escape before it, and the last such digit."""
    while start - 4 >= low and text[start - 2] == "%" and text[start - 1] in "346" and text[start - 4] == "%" and text[start - 3] in _HEX_DIGITS:
        new = chr(int(text[start - 1] + digit, 16))
        if new not in _HEX_DIGITS:
            break
        start, digit = start - 2, new
    return start, digit


def _escapes(text: str, pattern: re.Pattern, decode) -> Decoded | None:
    """The layer with all escape runs decoded; a character of a run maps to its own escape where lengths tell, else to the run.

    Where an escape only gives the start of another one (``%2525...``), and that again, the layers in between hold nothing
    but shorter forms of this chain; they are skipped, so that a chain of any length is two layers. So are those of digits
    that complete the escape before them (``%3%3%35``).
    """
    pieces, sizes, starts, steps, widths = [], [], [], [], []  # of each piece: text, characters, where it starts above, characters above for one here, and how many it maps to

    def piece(got: str, start: int, end: int, plain: bool = False) -> None:
        step = 1 if plain else (end - start) // len(got) if got and (end - start) % len(got) == 0 else 0
        pieces.append(got)
        sizes.append(len(got))
        starts.append(start)
        steps.append(step)
        widths.append(step or end - start)

    at = whole = 0
    for m in pattern.finditer(text):
        run = m[0]
        got = decode(run)
        if got is None:
            continue
        start, end, whole = m.start(), m.end(), whole + 1
        unit = 3 if run[0] == "%" else 4 if run[1] == "x" else 6 if run[1] == "u" and run[2] != "{" else len(run)
        low, first = start, ""
        if unit == 3 and got and got[0] in _HEX_DIGITS:
            low, first = _closed(text, at, start, got[0])
        high, last = (end, "") if got[-1:] not in _STEPS else _opened(text, end, got[-1])
        if low < start and high > end and len(run) == unit:
            low, first = start, ""
        piece(text[at:low], at, low, True)
        if low < start:
            piece(first, low, start + unit)
            got, start = got[1:], start + unit
        if high > end:
            piece(got[:-1], start, end - unit)
            piece(last, end - unit, high)
        elif start < end:
            piece(got, start, end)
        at = high
    if not whole:
        return None
    piece(text[at:], at, len(text), True)
    count = np.array(sizes)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(starts, count) + within * np.repeat(steps, count)
    return Decoded("".join(pieces), first, first + np.repeat(widths, count))


def _url(run: str) -> str | None:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _unicode(run: str) -> str | None:
    if run.startswith("\\u{") or run.startswith("\\U"):
        code = int(run[2:].strip("{}"), 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    width = 4 if run[1] == "u" else 2
    codes = [int(run[i + 2 : i + 2 + width], 16) for i in range(0, len(run), width + 2)]
    if width == 2:
        return bytes(codes).decode("utf-8", "replace")
    return b"".join(c.to_bytes(2, "little") for c in codes).decode("utf-16-le", "replace")


def _tool(start: bytes):
    """What unpacks a stream that begins so, or None."""
    if start[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(start) > 2 and start[0] == 0x78 and (start[0] << 8 | start[1]) % 31 == 0:
        return zlib.decompressobj()
    if start[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if start[:6] == b"\xfd7zXZ\x00" else None


def _chunks(data: bytes):
    """``(content, 0)`` of the streams at the start of ``data``, then ``(b"", bytes taken)`` at the end of each; ends before a broken one."""
    at = 0
    while (tool := _tool(data[at : at + 6])) is not None:
        rest = data[at:]
        while not tool.eof:
            try:
                chunk = tool.decompress(rest, UNPACKED)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            rest = getattr(tool, "unconsumed_tail", b"")
            if not chunk and not rest and not tool.eof:
                return
            yield chunk, 0
        at = len(data) - len(tool.unused_data)
        yield b"", at


def _unpack(data: bytes) -> tuple[bytes | None, int] | None:
    """The content of the streams at the start of ``data``, None if it is longer than ``UNPACKED``, and the bytes that they take; None without a whole stream."""
    held, size, whole, used = [], 0, 0, 0
    for chunk, end in _chunks(data):
        size += len(chunk)
        held = [*held, chunk] if size <= UNPACKED else []
        if end:
            whole, used = size, end
    if not used:
        return None
    return (b"".join(held)[:whole] if size <= UNPACKED else None), used


def _last(data: bytes, start: int) -> int:
    """The end of the last character outside of all patterns, from ``start`` on; 0 without one."""
    return max((m.end() for m in _OUTSIDE.finditer(data, start)), default=0)


def _pieces(data: bytes):
    """The readable texts of the streams at the start of ``data``, cut outside of patterns and runs; a stream in a stream is held whole."""
    chunks = (chunk for chunk, _ in _chunks(data))
    held = next(chunks, b"")
    if _tool(held[:6]) is not None:
        yield from _pieces(held + b"".join(chunks))
        return
    over = b""
    for chunk in chain([held], chunks):
        over += chunk
        cut = _last(over, max(0, len(over) - (1 << 16))) or _last(over, 0)
        if cut and (piece := _readable(over[:cut])) is not None:
            yield piece
        over = over[cut:]
    if over and (piece := _readable(over)) is not None:
        yield piece


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text.isprintable() or sum(c.isprintable() or c in "\t\n\r" for c in text) == len(text) else None


def _readings(text: str):
    """Lists of ``(start, end)`` of lines that may be one encoding: of each run all lines, lines wrapped at one width with a shorter last one or without, and single lines."""
    for m in _RUN.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        yield lines
        if len(lines) == 1:
            continue
        widths = [b - a for a, b in lines]
        for i, width in enumerate(widths):
            if i and widths[i - 1] == width:
                continue
            j = i + 1
            while j < len(lines) and widths[j] == width:
                j += 1
            if j < len(lines) and widths[j] < width:
                yield lines[i : j + 1]
            if j > i + 1:
                yield lines[i:j]
        yield from ([line] for line in lines)


def _decoded(run: str) -> tuple[str | bytes, int] | None:
    """The text that a run encodes, and 0; or what its streams unpack to, as they are if that is long, and the characters that they take."""
    if len(run) % 4 == 1:
        run = run[:-1]
    try:
        data = base64.b64decode(run.translate(_URLSAFE) + "=" * (-len(run) % 4), validate=True)
    except ValueError:
        return None
    if (text := _readable(data)) is not None:
        return text, 0
    first = more = _unpack(data)
    if first is None:
        return None
    while more is not None:
        inner, more = more[0], more[0] is not None and _unpack(more[0]) or None
    text = data[: first[1]] if inner is None else _readable(inner)
    return None if text is None else (text, -(-first[1] * 8 // 6))


def _base64(text: str):
    """A layer for each base64 run that decodes to text, or to a stream that unpacks to text or to another stream.

    A run that does not decode to text as a whole is also read in parts, and from the end of a stream on.
    """
    tried = set()
    for lines in _readings(text):
        run = "".join(text[a:b] for a, b in lines)
        ends = list(accumulate(b - a for a, b in lines))
        at = lambda i, lines=lines, ends=ends: lines[k := bisect_right(ends, i)][1] - ends[k] + i
        todo = [(0, len(run))]
        for a, b in todo:  # grows
            if b - a < SHORTEST or (place := (at(a), at(b - 1), b - a)) in tried:
                continue
            tried.add(place)
            got, used = _decoded(run[a:b]) or (None, 0)
            if got is not None and not used:
                yield Layer(got, at(a), at(b - 1) + 1, _in_run(a, b, got, at))
                continue
            if got is not None:
                start, end = at(a), at(a + used - 1) + 1
                yield Layer(got, start, end, lambda x, y, s=start, e=end: (s, e))
                todo.append((a + used, b))
            if (a, b) == (0, len(run)):
                todo += [m.span() for split in _SPLITS for m in split.finditer(run)]


_URLSAFE = str.maketrans("-_", "+/")


def _in_run(start: int, end: int, text: str, at):
    ascii_only = text.isascii()

    def place(a: int, b: int) -> tuple[int, int]:
        if not ascii_only:
            a, b = len(text[:a].encode()), len(text[:b].encode())
        return at(start + a // 3 * 4), at(min(end, start + -(-b // 3) * 4) - 1) + 1

    return place


def _piece(of: Layer, text: str) -> Layer:
    return Layer(text, of.start, of.end, of.place)


def _key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def unwrap(text: str, base: list[tuple[int, int, str]]) -> tuple[set[tuple[int, int, str]], set[tuple[int, int, bytes]]]:
    """``(start, end, kind)`` of all spans and ``(start, end, digest)`` of all layers below the text, in its characters; ``base`` are its own spans.

    A text that base64 runs encode is a node, the whole text is the first. A node's escapes are decoded layer by layer, with
    the place of each character in the node carried along, and each distinct layer is scanned once. Runs of a layer are
    nodes of their own, each distinct text once, the newest first, so that few are held. What is found in a node rises
    through the nodes that hold it, once for each place, until nothing is new; nodes are a quarter shorter from level to
    level, so what rises does not grow with the depth of escapes.
    """
    keys, holders, found, families, work = {_key(text): 0}, [[]], [set(base)], [set()], [(0, text)]
    while work:
        at, here = work.pop()
        if isinstance(here, str):
            more = _family(here, families[at], found[at])
        elif (new := next(here, None)) is not None:
            more = [(new, None)]
            work.append((at, here))
        else:
            continue
        for new, place in more:
            if isinstance(new.text, bytes):
                work.append((at, map(partial(_piece, new), _pieces(new.text)) if place is None else _placed(new, place)))
                continue
            number = keys.setdefault(key := _key(new.text), len(found))
            if number == len(found):
                found.append(set(scan(new.text)))
                holders.append([])
                families.append({key})
                work.append((number, new.text))
            start, end = (new.start, new.end) if place is None else place(new.start, new.end)
            if (start, end, number) in found[at]:  # seen in another layer of the node
                continue
            found[at].add((start, end, number))
            holders[number].append((at, new.place if place is None else lambda a, b, inner=new.place, outer=place: outer(*inner(a, b))))
    if len(found) > 1:
        rising = [(i, found[i]) for i in range(len(found))]
        while rising:
            i, new = rising.pop()
            for above, place in holders[i]:
                more = {(*place(a, b), what) for a, b, what in new} - found[above]
                if more:
                    found[above] |= more
                    rising.append((above, more))
    layers = {(a, b, key) for a, b, what in found[0] if isinstance(what, int) for key in families[what]}
    return {x for x in found[0] if isinstance(x[2], str)}, layers | {(0, len(text), key) for key in families[0]}


def _placed(of: Layer, place):
    """The pieces of a layer's streams, placed in the node that holds it."""
    start, end = place(of.start, of.end)
    return (Layer(t, start, end, lambda a, b: (start, end)) for t in _pieces(of.text))


def _family(text: str, seen: set[bytes], spans: set):
    """``(layer, place)`` of each base64 run in a node and in the layers of its escapes; ``place`` maps to the node, None in the node itself.

    Adds the digests of the layers to ``seen``, and what they hold to ``spans``.
    """
    own, todo = _key(text), [(text, None, None)]
    while todo:
        here, start_of, end_of = todo.pop()
        for sign, pattern, decode in (("%", _URL, _url), ("\\", _UNICODE, _unicode)):
            new = _escapes(here, pattern, decode) if sign in here else None
            if new is None or (key := _key(new.text)) in seen or key == own:
                continue
            seen.add(key)
            start = new.first if start_of is None else start_of[new.first]
            end = new.last if end_of is None else end_of[new.last - 1]
            spans |= {(int(start[a]), int(end[b - 1]), kind) for a, b, kind in scan(new.text)}
            todo.append((new.text, start, end))
        place = None if start_of is None else partial(_through, start_of, end_of)
        for layer in _base64(here):
            yield layer, place


def _through(start_of: np.ndarray, end_of: np.ndarray, start: int, end: int) -> tuple[int, int]:
    return int(start_of[start]), int(end_of[end - 1])


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """Spans of the text itself; all spans, decoded layers included; the number of layers below the text."""
    base = scan(text)
    every, layers = unwrap(text, base)
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=order), sorted(every, key=order), len(layers)


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans, spans and layers; columns of these names are replaced.

    base_spans and spans are ``kind:start:end``, comma-joined, in code points with the end
    exclusive, by start and then kind. The counts are of the text itself; ``layers`` counts the
    decoded layers, each text once for each place of the original that it was decoded from. A null
    text is as an empty one. A decoded span covers the whole characters that encode it: the
    escapes, the base64 groups of four, or a compressed run, with the line breaks in between.
    """
    need_columns("secrets", "text_col", docs, [text_col])
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "layers"]
    docs = docs.drop(*new)
    at = docs.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(docs.columns))), *new]

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                rows = [find((t or b"").decode("utf-8", "replace")) for t in texts_of(part.column(at))]
                counts = [pa.array([sum(s[2] == k for s in base) for base, _, _ in rows], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([*part.columns, *counts, pa.array([joined(b) for b, _, _ in rows], pa.string()), pa.array([joined(s) for _, s, _ in rows], pa.string()), pa.array([n for _, _, n in rows], pa.int32())], names=names)

    plain = docs.toDF(*names[:-6])
    fields = [StructField(n, LongType()) for n in new[:3]] + [StructField(n, StringType()) for n in new[3:5]] + [StructField("layers", IntegerType())]
    return plain.mapInArrow(run, schema_with(plain, *fields)).toDF(*docs.columns, *new)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by ``mark`` in the text; null stays null."""
    need_columns("secrets", "text_col", docs, [text_col])
    at = docs.columns.index(text_col)

    def clean(raw):
        if raw is None:
            return None
        text = raw.decode("utf-8", "replace")
        out, done = [], 0
        for a, b, _ in find(text)[1]:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                columns = list(part.columns)
                columns[at] = pa.array([clean(t) for t in texts_of(part.column(at))], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, StructType(plain.schema.fields)).toDF(*docs.columns)
