"""Lossless WebP as a media column: a decoder to pixel arrays, an encoder, and payload storage.

The decoder reads the whole lossless format (RFC 9649): prefix codes, simple and
coded by lengths; several prefix groups; back-references with the short distance
codes; the colour cache; and the predictor, cross-colour, subtract-green and
palette transforms, undone in reverse order. Where an image's codes all have one
length, its pixels are read by array operations, else symbol by symbol.

`store` keeps bytes as pixels, in rows of 64 bytes. Text-like payloads (a byte
holds less than `TEXT_BITS` by its frequency, and groups of four bytes seldom come
again) are grey, a sample a pixel: there
back-references find words and phrases at any place, subtract-green leaves one
channel, and the predictor above or a palette come in where symbols then take
fewer bits. Other payloads have four samples a pixel and the transforms
(subtract-green, predictor above, cross-colour), palette or colour cache with
which their symbols take fewest bits by their counts (`_best`). Codes are always
by frequency. Matches, cache hits and codes are found and put down by array
operations. A payload above `IMAGE` bytes becomes several images behind one
another; each says its size, and its width says which of the two forms it has.

Null is the empty text: its payload is 64 zero bytes. Very long texts are many
images of bounded size. Rows are independent of each other; equal texts give
equal values. An empty table gives no rows. Columns beside doc_id and text are not
read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm.arrays import as_bytes, mix, small, starts_of, tidy

ROW, IMAGE, TEXT_BITS = 64, 1 << 18, 6.5
#: Fixed values of the format: the order of the code length code's lengths, and the colour cache's multiplier.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_MULTIPLIER = 0x1E35A7BD
#: Distances 1 to 120 name near pixels: (columns left, rows up), nearest first.
NEAR = sorted([(0, y) for y in range(1, 8)] + [(s * x, y) for x in range(1, 8) for y in range(8) for s in (1, -1) if s > 0 or y] + [(8, y) for y in range(8)], key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


#: Bytes of a file from which a reader takes any 57 bits at once; less at its beginning.
_CHUNK, _FIRST = 1 << 16, 1 << 8
#: The 15 bits of a number in reverse order.
_REVERSED = [int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)]


class _Reader:
    """Bits of a file; `windows` are the 64 bits from each byte of a stretch that begins at byte `base`."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(32), 0
        self.load(_FIRST)

    def load(self, most: int = _CHUNK) -> None:
        self.base = self.at >> 3
        n = min(most, len(self.data) - 7 - self.base)
        self.windows: list[int] = np.ndarray((n,), "<u8", self.data, self.base, (1,)).tolist()

    def peek(self, n: int) -> int:
        i = (self.at >> 3) - self.base
        if not 0 <= i < len(self.windows):
            self.load()
            i = 0
        return (self.windows[i] >> (self.at & 7)) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.at += n
        return out


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code with its first bit lowest, length) of each symbol: shorter codes first, then by symbol."""
    out, code, last = {}, 0, 0
    for both in sorted([n << 16 | s for s, n in lengths.items()]):
        n = both >> 16
        code <<= n - last
        out[both & 0xFFFF] = (_REVERSED[code] >> (15 - n), n)
        code, last = code + 1, n
    return out


class _Code:
    """A canonical prefix code: `table` maps the next `most` bits to (symbol, length)."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = {s: n for s, n in lengths.items() if n}
        self.single = next(iter(lengths)) if len(lengths) == 1 else None
        if self.single is None and len(self.lengths) == 1:
            self.single = next(iter(self.lengths))
        self.most = 0 if self.single is not None else max(self.lengths.values())
        self.table: list[tuple[int, int]] = []
        self.flat: np.ndarray | None = None
        self.arrays: tuple[np.ndarray, int] | None = None
        if self.single is not None:
            self.flat = np.array([self.single])
        elif len(self.lengths) == 1 << self.most and min(self.lengths.values()) == self.most:
            self.flat = np.array(sorted(self.lengths))
        self.identity = self.flat is not None and len(self.flat) == 256 and np.array_equal(self.flat, np.arange(256))

    def codes(self) -> dict[int, tuple[int, int]]:
        """(code with its first bit lowest, length) of each symbol."""
        return _canonical(self.lengths)

    def lookup(self) -> list[tuple[int, int]]:
        if not self.table:
            self.table = [(0, self.most)] * (1 << self.most) if self.single is None else [(self.single, 0)]
            if self.single is None:
                for s, (code, n) in self.codes().items():
                    self.table[code :: 1 << n] = [(s, n)] * (1 << self.most - n)
        return self.table

    def read(self, r: _Reader) -> int:
        s, n = self.lookup()[r.peek(self.most)]
        r.at += n
        return s


@lru_cache(64)
def _inner_code(lengths: int) -> _Code:
    """From lengths of three bits each, in the order of `LENGTH_ORDER`."""
    return _Code({s: lengths >> 3 * k & 7 for k, s in enumerate(LENGTH_ORDER) if lengths >> 3 * k & 7})


def _read_code(r: _Reader, symbols: int) -> _Code:
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        first = r.bits(8 if wide else 1)
        return _Code({first: 1, r.bits(8): 1} if two else {first: 0})
    count = 4 + r.bits(4)
    inner = _inner_code(r.bits(3 * count))
    most = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else symbols
    lengths, at, last = {}, 0, 8
    table, mask, windows, p, base = inner.lookup(), (1 << inner.most) - 1, r.windows, r.at, r.base
    while at < symbols and most:
        most -= 1
        i = (p >> 3) - base
        if i >= len(windows):
            r.at = p
            r.load()
            windows, base, i = r.windows, r.base, 0
        v = windows[i] >> (p & 7)
        s, n = table[v & mask]
        p += n
        if s == 0:
            at += 1
        elif s < 16:
            lengths[at] = last = s
            at += 1
        elif s == 16:
            run = 3 + (v >> n & 3)
            p += 2
            for k in range(at, min(at + run, symbols)):
                lengths[k] = last
            at += run
        elif s == 17:
            at += 3 + (v >> n & 7)
            p += 3
        else:
            at += 11 + (v >> n & 127)
            p += 7
    r.at = p
    return _Code(lengths or {0: 0})


#: Least value and extra bits of each length or distance code.
_PREFIX = [(c + 1, 0) if c < 4 else ((2 + (c & 1) << (c - 2 >> 1)) + 1, c - 2 >> 1) for c in range(40)]


_PREFIX_ARRAY, _NEAR_ARRAY = np.array(_PREFIX).T.copy(), np.array(NEAR)


def _prefix_value(r: _Reader, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + r.bits(extra) + 1


def _read_image(r: _Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (height * width, 4) as alpha, red, green, blue."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    which, block, across = None, 0, 0
    if main and r.bits(1):
        block = r.bits(3) + 2
        across = -(-width >> block)
        image = _read_image(r, across, -(-height >> block), False)
        which = (image[:, 1].astype(int) * 256 + image[:, 2]).tolist()
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(r, n) for n in sizes] for _ in range(max(which) + 1 if which else 1)]
    n = width * height
    if len(groups) == 1 and not cache_bits:
        four = groups[0][:4]
        if all(c.flat is not None for c in four) and four[0].flat[-1] < 256:
            return _read_uniform(r, four, n)
    if main and n >= _ALL_AT_ONCE and len(groups) == 1 and not cache_bits and all(c.single is not None for c in groups[0][1:4]):
        return _read_green(r, groups[0], width, n)
    pixels = array("I", bytes(4 * n))
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, cached, at = 32 - cache_bits, 0, 0
    tables = [[c.lookup() for c in g[:4]] + [(1 << c.most) - 1 for c in g[:4]] + [g[4]] for g in groups]
    green, red, blue, alpha, green_bits, red_bits, blue_bits, alpha_bits, distance = tables[0]
    windows, base, p = r.windows, r.base, r.at
    while at < n:
        if which:
            y, x = divmod(at, width)
            green, red, blue, alpha, green_bits, red_bits, blue_bits, alpha_bits, distance = tables[which[(y >> block) * across + (x >> block)]]
        i = (p >> 3) - base
        if i + 12 > len(windows):
            r.at = p
            r.load()
            windows, base, i = r.windows, r.base, 0
        v = windows[i] >> (p & 7)
        s, k = green[v & green_bits]
        if s < 256:
            high, j = red[(v >> k) & red_bits]
            p += k + j
            v = windows[(p >> 3) - base] >> (p & 7)
            low, k = blue[v & blue_bits]
            first, j = alpha[(v >> k) & alpha_bits]
            p += k + j
            pixels[at] = first << 24 | high << 16 | s << 8 | low
            at += 1
        elif s < 280:
            r.at = p + k
            length, d = _prefix_value(r, s - 256), _prefix_value(r, distance.read(r))
            windows, base, p = r.windows, r.base, r.at
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            length = min(length, n - at)
            if d > at:
                raise ValueError("a distance reaches before the image")
            again = pixels[at - d : at - d + min(d, length)]
            pixels[at : at + length] = again if d >= length else (again * -(-length // d))[:length]
            at += length
        else:
            p += k
            while cached < at:
                cache[(CACHE_MULTIPLIER * pixels[cached] & 0xFFFFFFFF) >> shift] = pixels[cached]
                cached += 1
            pixels[at] = cache[s - 280]
            at += 1
        if cache_bits and at - cached > 4096:
            while cached < at:
                cache[(CACHE_MULTIPLIER * pixels[cached] & 0xFFFFFFFF) >> shift] = pixels[cached]
                cached += 1
    r.at = p
    return np.frombuffer(pixels, np.uint32).astype(">u4").view(np.uint8).reshape(n, 4)


#: Bytes of a file whose tokens are looked up at every bit at once, and pixels of an image from which that is done.
_STRETCH, _ALL_AT_ONCE = 1 << 15, 256


@lru_cache(16)
def _turned(bits: int) -> np.ndarray:
    """The numbers of so many bits, each with its bits in reverse order."""
    return np.array(_REVERSED[: 1 << bits]) >> (15 - bits)


def _tables(code: _Code, extra: np.ndarray) -> tuple[np.ndarray, int]:
    """By the next bits, 64 times the symbol plus the bits it takes with its `extra` ones; and the mask for the next bits."""
    if code.arrays is None:
        if code.single is not None:
            order = np.array([code.single << 6 | int(extra[code.single])])
        else:
            # First bit highest, the places of a code are neighbours; the rest of an incomplete code is its first symbol.
            both = np.array(sorted([n << 16 | s for s, n in code.lengths.items()]))
            symbol, length = both & 0xFFFF, both >> 16
            both = (symbol << 6) + length + extra.take(symbol)
            order = both.repeat(1 << (code.most - length))
            if len(order) < 1 << code.most:
                order = np.append(order, np.full((1 << code.most) - len(order), both[0]))
            order = order.take(_turned(code.most))
        code.arrays = (order, (1 << code.most) - 1)
    return code.arrays


def _walk(after: np.ndarray, p: int, end: int) -> np.ndarray:
    """The places below `end` met from p on, where `after` tells each place's next; in strides of eight, which arrays then fill in. Places from `end` on are their own next."""
    two = after.take(after)
    four = two.take(two)
    step, met = memoryview(four.take(four)), []
    while p < end:
        met.append(p)
        p = step[p]
    places = np.empty((len(met), 8), np.int64)
    places[:, 0] = met
    places[:, 4] = four.take(places[:, 0])
    places[:, 2::4] = two.take(places[:, ::4])
    places[:, 1::2] = after.take(places[:, ::2])
    places = places.ravel()
    return places[: places.searchsorted(end)]


@lru_cache(4096)
def _near_distances(width: int) -> np.ndarray:
    """The distances that the codes 1 to 120 stand for, behind one that is not used."""
    return np.array([0] + [max(1, dx + dy * width) for dx, dy in NEAR])


#: The extra bits of length symbols (other green symbols have none) and of distance symbols; the first copy in a table of `_tables`.
_GREEN_EXTRA, _FAR_EXTRA, _FIRST_COPY = np.append(np.zeros(256, np.int64), _PREFIX_ARRAY[1, :24]), _PREFIX_ARRAY[1], 256 << 6


def _shifts(size: int) -> np.ndarray:
    """0 to 7, `size` times."""
    global _SHIFTS
    if len(_SHIFTS) < 8 * size:
        _SHIFTS = np.tile(np.arange(8), size)
    return _SHIFTS[: 8 * size]


_SHIFTS = np.tile(np.arange(8), 1 << 10)


def _read_green(r: _Reader, codes: list[_Code], width: int, n: int) -> np.ndarray:
    """Pixels that differ in green only: no other channel takes bits.

    Which bit a token would end at is looked up for every bit of a stretch by array
    operations; the tokens that are there are those that a walk from the first
    one meets, and only their lengths and distances are worked out.
    """
    pixels, at = bytearray(n), 0
    shown = np.frombuffer(pixels, np.uint8)
    (green, green_mask), (far, far_mask) = _tables(codes[0], _GREEN_EXTRA), _tables(codes[4], _FAR_EXTRA)
    least, extras = _PREFIX_ARRAY
    while at < n:
        base = r.at >> 3
        size = min(_STRETCH, len(r.data) - 14 - base)
        end = 8 * size
        wide = np.ndarray((size + 6,), "<i8", r.data, base, (1,)).copy()
        v = wide[:size].repeat(8) >> _shifts(size)
        entry = green.take(v & green_mask)
        after = np.arange(end + 64)
        after[:end] += entry & 63
        copy = (entry >= _FIRST_COPY).nonzero()[0]
        if len(copy):
            p = after.take(copy)
            after[copy] = p + (far.take(wide.take(p >> 3) >> (p & 7) & far_mask) & 63)
        p = r.at & 7
        if p == after[p]:  # one symbol without bits
            shown[at:] = entry[p] >> 6
            break
        tokens = _walk(after, p, end)
        entry, count = entry.take(tokens), np.ones(len(tokens), np.int64)
        copy = (entry >= _FIRST_COPY).nonzero()[0]
        if len(copy):
            place, own = tokens.take(copy), entry.take(copy)
            kind, bits = (own >> 6) - 256, own & 63
            extra = extras.take(kind)
            count[copy] = least.take(kind) + (v.take(place) >> bits - extra & (1 << extra) - 1)
            place += bits
            v = wide.take(place >> 3) >> (place & 7)
            own = far.take(v & far_mask)
            kind = own >> 6
            extra = extras.take(kind)
            back = least.take(kind) + (v >> (own & 63) - extra & (1 << extra) - 1)
            back = np.where(back > 120, back - 120, _near_distances(width).take(np.minimum(back, 120)))
        stop = count.cumsum()
        stop += at
        begin = stop - count
        r.at, at = 8 * base + int(after[tokens[-1]]), int(stop[-1])
        if at > n:  # what is behind the image was looked up too
            begin = begin[: begin.searchsorted(n)]
            copy = copy[: copy.searchsorted(len(begin))]
        shown[begin] = entry[: len(begin)] >> 6  # where a copy begins, it comes over this
        if len(copy):
            to, stop, back = begin.take(copy), np.minimum(stop.take(copy), n), back[: len(copy)]
            source = to - back
            if source.min() < 0:
                raise ValueError("a distance reaches before the image")
            for a, b, c, d in zip(to.tolist(), stop.tolist(), source.tolist(), (source + stop - to).tolist(), strict=True):
                pixels[a:b] = pixels[c:d] if d <= a else (pixels[c:a] * -((a - b) // (a - c)))[: b - a]
    out = np.full(n, codes[3].single | codes[1].single << 8 | codes[2].single << 24, np.uint32).view(np.uint8).reshape(n, 4)
    out[:, 2] = shown
    return out


def _read_uniform(r: _Reader, codes: list[_Code], n: int) -> np.ndarray:
    """Pixels by codes that each have one length (`flat`: the symbols in code order)."""
    out = np.empty((n, 4), np.uint8)
    widths = [len(c.flat).bit_length() - 1 for c in codes]
    each = sum(widths)
    begin, end = r.at, r.at + n * each
    raw = np.frombuffer(r.data, np.uint8)[begin // 8 : -(-end // 8)]
    bits = np.unpackbits(raw, bitorder="little")[begin % 8 : begin % 8 + n * each].reshape(n, each)
    r.at, at = end, 0
    if all(c.identity for c in codes):
        out[:, [2, 1, 3, 0]] = np.packbits(bits, axis=1)
        return out
    for channel, f, w in zip((2, 1, 3, 0), [c.flat for c in codes], widths, strict=True):
        index = bits[:, at : at + w].astype(np.int64) @ (1 << np.arange(w)[::-1]) if w else 0
        out[:, channel] = f[index]
        at += w
    return out


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predicted(mode: int, left, top, corner, right):
    """The prediction from int arrays of four channels."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _average(left, top)
    return np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255)


#: Predictors that only look at the row above.
_ABOVE = frozenset((0, 2, 3, 4, 8, 9))


def predict(pixels: np.ndarray, modes: np.ndarray, block: int, width: int, undo: bool) -> np.ndarray:
    """Undo (or apply) the predictor transform over pixels (n, 4); modes per block of 1 << block pixels."""
    rows = pixels.reshape(-1, width, 4)
    height = len(rows)
    if (modes == 2).all():  # each pixel from the one above: running sums down the columns
        if not undo:
            out = rows.copy()
            out[1:] -= rows[:-1]
            out[0, 1:] -= rows[0, :-1]
            out[0, 0, :1] -= 255
            return out.reshape(-1, 4)
        out = rows.copy()
        out[0, 0, :1] += 255
        np.cumsum(out[0], axis=0, dtype=np.uint8, out=out[0])
        return np.cumsum(out, axis=0, dtype=np.uint8).reshape(-1, 4)
    across = -(-width >> block)
    known = rows.astype(int).reshape(-1, 4)  # what predictions are taken from: the true pixels
    out = known.copy()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if y == 0:
                guess = known[i - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = known[i - width]
            else:
                mode = int(modes[(y >> block) * across + (x >> block)])
                if undo and mode in _ABOVE and x < width - 1:
                    stop = min(width - 1, (x | (1 << block) - 1) + 1)
                    if stop > x + 1 and (x & (1 << block) - 1 == 0 or x == 1):
                        j = np.arange(i, y * width + stop)
                        known[j] = (out[j] + _predicted(mode, None, known[j - width], known[j - width - 1], known[j - width + 1])) & 255
                        continue
                    if stop > x + 1 or x & (1 << block) - 1 and x != 1:
                        continue  # done with its stretch
                guess = _predicted(mode, known[i - 1], known[i - width], known[i - width - 1], known[i - width + 1])
            if undo:
                known[i] = (out[i] + guess) & 255
            else:
                out[i] = (known[i] - guess) & 255
    return (known if undo else out).astype(np.uint8)


def cross_colour(pixels: np.ndarray, elements: np.ndarray, block: int, width: int, undo: bool) -> np.ndarray:
    """Undo (or apply) the cross-colour transform; elements (blocks, 4) hold red-to-blue, green-to-blue, green-to-red in red, green, blue."""
    y, x = np.divmod(np.arange(len(pixels)), width)
    e = elements[(y >> block) * -(-width >> block) + (x >> block)].view(np.int8).astype(int)
    out, sign = pixels.astype(int), 1 if undo else -1
    green = pixels[:, 2].view(np.int8).astype(int) if pixels.flags.c_contiguous is False else np.ascontiguousarray(pixels[:, 2]).view(np.int8).astype(int)
    out[:, 1] += sign * (e[:, 3] * green >> 5)
    red = ((out[:, 1] if undo else pixels[:, 1].astype(int)) + 128) % 256 - 128
    out[:, 3] += sign * ((e[:, 2] * green >> 5) + (e[:, 1] * red >> 5))
    return (out & 255).astype(np.uint8)


def _palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels (height, width, 4) as alpha, red, green, blue) of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    r = _Reader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(4)
    steps, wide = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind < 2:
            block = r.bits(3) + 2
            steps.append((kind, block, wide, _read_image(r, -(-wide >> block), -(-height >> block), False)))
        elif kind == 2:
            steps.append((kind, 0, wide, None))
        else:
            colours = np.cumsum(_read_image(r, r.bits(8) + 1, 1, False), axis=0, dtype=np.uint8)
            pack = _palette_bits(len(colours))
            steps.append((kind, pack, wide, colours))
            wide = -(-wide >> pack)
    pixels = _read_image(r, wide, height, True)
    for kind, block, wide, image in reversed(steps):
        if kind == 0:
            pixels = predict(pixels, image[:, 2], block, wide, True)
        elif kind == 1:
            pixels = cross_colour(pixels, image, block, wide, True)
        elif kind == 2:
            pixels = pixels.copy()
            for k in (1, 3):
                pixels[:, k] += pixels[:, 2]
        else:
            index = pixels[:, 2].reshape(height, -1)
            if block:
                each = 8 >> block
                index = (index[:, :, None] >> (each * np.arange(1 << block)) & (1 << each) - 1).reshape(height, -1)[:, :wide]
            padded = np.zeros((256, 4), np.uint8)
            padded[: len(image)] = image
            pixels = padded[index.ravel()]
    return width, height, pixels.reshape(height, width, 4)


class _Writer:
    """Numbers with their widths, put behind one another, lowest bits first."""

    def __init__(self):
        self.values: list[int] = []
        self.widths: list[int] = []
        self.done: list[tuple[np.ndarray, np.ndarray]] = []

    def bits(self, value: int, n: int) -> None:
        self.values.append(value)
        self.widths.append(n)

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._rest()
        self.done.append((values, widths))

    def _rest(self) -> None:
        self.done.append((np.array(self.values, np.int64), np.array(self.widths, np.int64)))
        self.values, self.widths = [], []

    def packed(self) -> bytes:
        """All bits, the last byte filled up with zeros. Numbers have at most 31 bits, so that each touches two words of 32; no bit is in two numbers, so sums put them together."""
        self._rest()
        values, widths = (np.concatenate(x) for x in zip(*self.done, strict=True))
        at = np.cumsum(widths) - widths
        total, word = int(widths.sum()), at >> 5
        wide = values << (at & 31)
        words = np.bincount(word, weights=wide & 0xFFFFFFFF, minlength=(total >> 5) + 2)
        words[1:] += np.bincount(word, weights=wide >> 32, minlength=len(words))[:-1]
        return words.astype("<u4").tobytes()[: -(-total // 8)]


def _huffman(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Code lengths of at most `most` by frequency; {symbol: 0} for a single one."""
    if len(counts) < 2:
        return dict.fromkeys(counts or {0: 1}, 0)
    while True:
        leaves = sorted(counts, key=counts.__getitem__)
        m = len(leaves)
        weight, parent, i, j = [counts[s] for s in leaves], [0] * (2 * m - 1), 0, m
        never = sum(weight) + 1
        weight += [never] * m  # inner nodes still to come weigh more than any
        for k in range(m, 2 * m - 1):  # leaves and inner nodes both come in order of weight
            if i < m and weight[i] <= weight[j]:
                x, i = i, i + 1
            else:
                x, j = j, j + 1
            if i < m and weight[i] <= weight[j]:
                y, i = i, i + 1
            else:
                y, j = j, j + 1
            weight[k], parent[x], parent[y] = weight[x] + weight[y], k, k
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= most:
            return dict(zip(leaves, depth[:m], strict=True))
        counts = {s: c // 2 + 1 for s, c in counts.items()}


def _write_code(w: _Writer, lengths: dict[int, int], symbols: int) -> dict[int, tuple[int, int]]:
    """Write the code and return each symbol's (bits, length)."""
    if len(lengths) == 1 and next(iter(lengths)) < 256:
        w.bits(1, 1)
        w.bits(0, 1)
        w.bits(1, 1)
        w.bits(next(iter(lengths)), 8)
        return {next(iter(lengths)): (0, 0)}
    lengths = {s: max(1, n) for s, n in lengths.items()}
    if len(lengths) == 1:  # a single symbol that the simple form cannot name gets an unused neighbour
        lengths[0] = 1
    w.bits(0, 1)
    w.bits(15, 4)
    w.values += _INNER_LENGTHS
    w.widths += [3] * 19
    w.bits(0, 1)
    # What the code lengths are put down as: (a code of `_INNER` and its extra bits in one number, their widths).
    out, at = [], 0
    for s in sorted(lengths):
        if s > at:
            out += _zeros(s - at)
        out.append(_INNER[lengths[s]])
        at = s + 1
    if at < symbols:
        out += _zeros(symbols - at)
    w.values += [x[0] for x in out]
    w.widths += [x[1] for x in out]
    return _canonical(lengths)


#: The code in which this writer puts down code lengths: five bits for the rarest of them, else four.
_INNER_OF = {k: 5 if k in (0, 1, 2, 14, 15, 12) else 4 for k in range(19)}
_INNER, _INNER_LENGTHS = _canonical(_INNER_OF), [_INNER_OF[k] for k in LENGTH_ORDER]


@lru_cache(4096)
def _zeros(run: int) -> tuple[tuple[int, int], ...]:
    """So many symbols that are not there, in runs of up to 138."""
    out = []
    while run:
        if run >= 11:
            k = min(run, 138)
            code, n = _INNER[18]
            out.append((code | k - 11 << n, n + 7))
        elif run >= 3:
            k = run
            code, n = _INNER[17]
            out.append((code | k - 3 << n, n + 3))
        else:
            k = 1
            out.append(_INNER[0])
        run -= k
    return tuple(out)


def _prefix_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, extra and extra bits of lengths or distances."""
    global _PREFIX_OF
    if len(values) and (top := int(values.max())) >= len(_PREFIX_OF):
        v = np.arange(-1, 2 * top)
        high = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
        _PREFIX_OF = np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)).astype(np.int8)
    codes = _PREFIX_OF.take(values).astype(np.int64)
    least, extras = _PREFIX_ARRAY
    return codes, values - least.take(codes), extras.take(codes)


#: The codes of all values up to the highest seen, which is at most the number of pixels of an image.
_PREFIX_OF = np.zeros(0, np.int8)


@lru_cache(4096)
def _near_codes(width: int) -> np.ndarray:
    """The short code of each distance that has one, else 0."""
    out = np.zeros(8 * width + 16, np.int64)
    for k, (dx, dy) in reversed(list(enumerate(NEAR))):
        if dx + dy * width > 0:
            out[dx + dy * width] = k + 1
    return out


def _before(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key, or -1."""
    n = len(keys)
    out = np.full(n, -1)
    if keys.dtype == np.uint16 and n <= 1 << 16:  # key and place in one number are sorted faster than places by key
        both = keys.astype(np.uint32)
        both <<= 16
        both |= np.arange(n, dtype=np.uint32)
        both.sort()
        same = ((both[1:] ^ both[:-1]) < 1 << 16).nonzero()[0]
        order = both & 0xFFFF
    else:
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys.take(order)
        same = (sorted_keys[1:] == sorted_keys[:-1]).nonzero()[0]
    out[order.take(same + 1)] = order.take(same)
    return out


def _copies(argb: np.ndarray, least: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of what is `least` or more pixels long and was there before; exact: only green varies."""
    none = (np.zeros(0, np.int64),) * 3
    if len(argb) < least + 1:
        return none
    n = len(argb) - least + 1
    exact = exact and least < 8
    if exact:  # the samples are the key
        samples = np.zeros(len(argb) + 8, np.uint8)
        samples[: len(argb)] = argb >> 8
        keys = np.ndarray((n,), ">u8", samples, 0, (1,)).astype(np.uint64)
        keys >>= np.uint64(64 - 8 * least)
    else:
        keys = argb[:n].astype(np.uint64)
        for k in range(1, least):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + argb[k : k + n]
    short = n < 1 << 14  # short keys are sorted faster, and few meet by chance
    back = _before((keys * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)).astype(np.uint16) if short else keys)
    if not short:  # among many places the last one is seldom that of the longest copy
        a = (argb >> 8 & 255 if exact else argb).astype(np.uint64)
        wide = np.zeros(n - LONG, np.uint64)
        for k in range(LONG):
            wide = wide * np.uint64(0x9E3779B97F4A7C15) + a[k : k + n - LONG]
        last = _before(mix(wide))
        back[: n - LONG] = np.where(last >= 0, last, back[: n - LONG])
    i = (back >= 0).nonzero()[0]
    back = back.take(i)
    alike = keys.take(back) == keys.take(i)
    for k in range(0 if exact else least):
        alike &= argb.take(i + k) == argb.take(back + k)
    i, back = i[alike], back[alike]
    if not len(i):
        return none
    # Stretches: both places go on by one.
    cut = ((i[1:] - i[:-1] != 1) | (back[1:] - back[:-1] != 1)).nonzero()[0]
    first, last = np.empty(len(cut) + 1, np.int64), np.empty(len(cut) + 1, np.int64)
    first[0], last[-1] = 0, len(i) - 1
    first[1:], last[:-1] = cut + 1, cut
    begin, end = i.take(first), i.take(last) + least
    far = begin - back.take(first)
    # Each stretch goes on where those before it end, if enough of it is left; then those that had lost that room to unused ones.
    at = begin.copy()
    np.maximum(begin[1:], np.maximum.accumulate(end)[:-1], out=at[1:])
    use = end - at >= least
    for _ in range(2):
        rest = (~use).nonzero()[0]
        if not len(rest):
            break
        after, more = np.maximum.accumulate(end * use), rest[int(rest[0] == 0) :]
        at[more] = np.maximum(begin.take(more), after.take(more - 1))
        ends = end.take(rest)
        at[rest[1:]] = np.maximum(at.take(rest[1:]), np.maximum.accumulate(ends)[:-1])
        now = ends - at.take(rest) >= least
        if not now.any():
            break
        use[rest] = now
    begin, length, far = at[use], (end - at)[use], far[use]
    if len(length) and int(length.max()) > 4096:  # a copy has at most 4096 pixels
        parts = -(-length // 4096)
        inside = 4096 * (np.arange(int(parts.sum())) - np.repeat(starts_of(parts), parts))
        begin, length, far = np.repeat(begin, parts) + inside, np.minimum(4096, np.repeat(length, parts) - inside), np.repeat(far, parts)
    return begin, length, far


def _slots(argb: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether it is there when its turn comes."""
    slots = ((argb.astype(np.int64) * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)).astype(np.int64)
    last = _before(slots)
    return slots, (last >= 0) & (argb[last] == argb)


def _write_image(w: _Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: int = 0, groups: int = 0) -> None:
    """Pixels, (n, 4) or n numbers, by prefix codes of their frequencies; copies of `references` pixels or more, if any; groups > 0 gives every block of 1 << groups pixels a code set by turns of two."""
    argb = np.ascontiguousarray(pixels, np.uint8).view(">u4").ravel().astype(np.uint32) if pixels.ndim > 1 else pixels
    n = len(argb)
    w.bits(int(cache_bits > 0), 1)
    w.bits(cache_bits, 4 if cache_bits else 0)
    if main:
        w.bits(int(groups > 0), 1)
    varies, shifts = int(np.bitwise_or.reduce(argb ^ argb[0])), (8, 16, 0, 24)
    begin, length, back = _copies(argb, references, varies & 0xFFFF00FF == 0) if references else (np.zeros(0, np.int64),) * 3
    tokens, rest, far = None, argb, begin
    if len(begin):
        inside = np.zeros(n + 1, np.int8)
        inside[begin + 1] = 1
        inside[begin + length] -= 1
        tokens = (inside[:n].cumsum(dtype=np.int8) == 0).nonzero()[0]
        rest, far = argb.take(tokens), tokens.searchsorted(begin)
        if varies & 0xFFFF00FF:
            varies = int(np.bitwise_or.reduce(rest ^ rest[0]))
    # What each token puts down: symbols of the five codes, and bits behind them; -1 for none. One-valued channels need no bits.
    symbols = [(rest >> k & 255).astype(np.int64) if k == 8 or varies >> k & 255 else None for k in shifts]
    if cache_bits or groups:
        tokens = np.arange(n) if tokens is None else tokens
    if cache_bits:
        slots, there = _slots(argb, cache_bits)
        there = there[tokens]
        symbols[0][there] = 280 + slots[tokens[there]]
        for x in symbols[1:]:
            if x is not None:
                x[there] = -1
    code, extra, bits = _prefix_codes(length)
    symbols[0][far] = 256 + code
    for x in symbols[1:]:
        if x is not None:
            x[far] = -1
    near = _near_codes(width)
    close = near.take(np.minimum(back, len(near) - 1))  # the last one is 0
    distances, far_extra, far_bits = _prefix_codes(np.where(close > 0, close, back + 120))
    group = None
    if groups:
        across = -(-width >> groups)
        y, x = np.divmod(tokens, width)
        group = ((y >> groups) * across + (x >> groups)) % 2
        blocks = across * -(-(n // width) >> groups)
        image = np.zeros((blocks, 4), np.uint8)
        image[:, 2] = np.arange(blocks) % 2
        w.bits(groups - 2, 3)
        _write_image(w, image, across, False)
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256)
    most = 10 if len(rest) < 1 << 14 else 15
    # Numbers and widths of the tokens' green, red, blue and alpha symbols, and of the copies' distances.
    shown, own = {}, np.zeros((2, len(far)), np.int64)
    for g in range(2 if groups else 1):
        for which, size in enumerate(sizes):
            if symbols[which] is None:
                _write_code(w, {int(rest[0]) >> shifts[which] & 255: 0}, size)
            elif which == 0 and group is None:
                shown[0] = _put(w, symbols[0], size, most)
            else:
                here = np.flatnonzero(symbols[which] >= 0 if group is None else (symbols[which] >= 0) & (group == g))
                shown.setdefault(which, np.zeros((2, len(rest)), np.int64))[:, here] = _put(w, symbols[which][here], size, most)
        if group is None:
            own = _put(w, distances, 40, most)
        else:
            own[:, group[far] == g] = _put(w, distances[group[far] == g], 40, most)
    columns = [shown[k] for k in sorted(shown)]
    if len(far):
        values, widths = columns[0]
        at = widths.take(far)
        values[far] |= extra << at
        at += bits
        widths[far] = at
        if int((at + own[1] + far_bits).max()) <= 31:  # a copy's bits fit one number
            values[far] |= (own[0] | far_extra << own[1]) << at
            widths[far] = at + own[1] + far_bits
        else:
            more = np.zeros((2, 2, len(rest)), np.int64)
            more[:, :, far] = [own, [far_extra, far_bits]]
            columns[1:1] = more
    columns = columns[0] if len(columns) == 1 else np.stack(columns, axis=2).reshape(2, -1)
    w.many(columns[0], columns[1])


def _put(w: _Writer, symbols: np.ndarray, size: int, most: int) -> np.ndarray:
    """Write the code of some symbols; their codes and the codes' lengths."""
    counts = np.bincount(symbols, minlength=size)
    used = counts.nonzero()[0]
    codes = _write_code(w, _huffman(dict(zip(used.tolist(), counts.take(used).tolist(), strict=True)), most if len(used) <= 256 else 15), size)
    table = [0] * size
    for s, (code, n) in codes.items():
        table[s] = code << 4 | n
    both = np.array(table).take(symbols)
    return np.stack([both >> 4, both & 15])


def _file(bits: bytes) -> bytes:
    body = b"\x2f" + bits
    padded = body + b"\0" * (len(body) % 2)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def _begin(width: int, height: int) -> _Writer:
    w = _Writer()
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)
    w.bits(0, 3)
    return w


def _less_green(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    for k in (1, 3):
        out[:, k] -= pixels[:, 2]
    return out


def encode(pixels: np.ndarray, modes: np.ndarray | None = None, colour: np.ndarray | None = None, block: int = 2, green: bool = False, palette: bool = False, cache_bits: int = 0, references: int = 3, groups: int = 0) -> bytes:
    """One lossless file of pixels (height, width, 4), or of grey samples (height, width), with the transforms that are given: predictor modes and cross-colour elements per block."""
    height, width = pixels.shape[:2]
    w, wide = _begin(width, height), width
    if pixels.ndim == 2 and green and not palette and modes is None and colour is None:  # green is all that is left
        w.bits(1, 1)
        w.bits(2, 2)
        w.bits(0, 1)
        _write_image(w, pixels.ravel().astype(np.uint32) << 8 | 0xFF000000, width, True, cache_bits, references, groups)
        return _file(w.packed())
    if pixels.ndim == 2:
        pixels = (np.uint32(0xFF) + pixels.astype(np.uint32) * np.uint32(0x01010100)).view(np.uint8)
    rest = pixels.reshape(-1, 4)
    if palette:
        colours, index = np.unique(np.ascontiguousarray(rest).view(">u4").ravel(), return_inverse=True)
        w.bits(1, 1)
        w.bits(3, 2)
        w.bits(len(colours) - 1, 8)
        table = colours.view(np.uint8).reshape(-1, 4)
        _write_image(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)), len(colours), False)
        pack = _palette_bits(len(colours))
        wide = -(-width >> pack)
        full = np.zeros((height, wide << pack), np.int64)
        full[:, :width] = index.reshape(height, width)
        rest = np.zeros((height * wide, 4), np.uint8)
        rest[:, 0] = 255
        rest[:, 2] = (full.reshape(height, wide, -1) << ((8 >> pack) * np.arange(1 << pack))).sum(axis=2).ravel()
    if green:
        w.bits(1, 1)
        w.bits(2, 2)
        rest = _less_green(rest)
    for kind, image in ((0, modes), (1, colour)):
        if image is not None:
            w.bits(1, 1)
            w.bits(kind, 2)
            w.bits(block - 2, 3)
            if kind == 0:
                shown = np.zeros((len(image), 4), np.uint8)
                shown[:, 2] = image
                rest = predict(rest, image, block, wide, False)
            else:
                shown = image
                rest = cross_colour(rest, image, block, wide, False)
            _write_image(w, shown, -(-wide >> block), False)
    w.bits(0, 1)
    _write_image(w, rest, wide, True, cache_bits, references, groups)
    return _file(w.packed())


def _bits(counts: np.ndarray) -> np.ndarray:
    """About how many bits the symbols counted in each row take, with their code."""
    total = counts.sum(axis=-1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=-1) + 5 * (counts > 0).sum(axis=-1)


def _elements(pixels: np.ndarray) -> np.ndarray:
    """The cross-colour element that takes most of green (and red) out of red and blue, by least squares."""
    red, green, blue = (np.ascontiguousarray(pixels[:, k]).view(np.int8).astype(float) for k in (1, 2, 3))

    def factor(x: np.ndarray, y: np.ndarray) -> float:
        return float(np.clip(np.rint(32 * (x @ y) / max(1.0, x @ x)), -128, 127))

    to_red, to_blue = factor(green, red), factor(green, blue)
    across = factor(red, blue - green * (to_blue / 32))
    return np.array([255, *(int(k) & 255 for k in (across, to_blue, to_red))], np.uint8)


def _best(pixels: np.ndarray) -> dict:
    """What to encode an image (height, width, 4) with: the transforms, palette and cache under which its symbols take fewest bits."""
    height, width, _ = pixels.shape
    flat = pixels.reshape(-1, 4)
    n, blocks = len(flat), -(-width >> 9) * -(-height >> 9)
    green = _less_green(flat)
    modes, colour = np.full(blocks, 2), np.tile(_elements(flat), (blocks, 1))
    shown = [flat, green, predict(flat, modes, 9, width, False), predict(green, modes, 9, width, False), cross_colour(flat, colour, 9, width, False)]
    how = [{}, {"green": True}, {"modes": modes}, {"green": True, "modes": modes}, {"colour": colour}]
    at = np.stack(shown) + 256 * np.arange(20).reshape(5, 1, 4)
    costs = _bits(np.bincount(at.ravel(), minlength=5120).reshape(5, 4, 256)).sum(axis=1) + np.array([0, 3, 60, 63, 90])
    k = int(costs.argmin())
    best, out, argb = float(costs[k]), dict(how[k], block=9), np.ascontiguousarray(shown[k]).view(">u4").ravel().astype(np.uint32)
    bits = min(10, max(1, n.bit_length() - 2))
    slots, there = _slots(argb, bits)
    if there.any():
        rest = _bits(np.bincount((shown[k][~there] + 256 * np.arange(4)).ravel(), minlength=1024).reshape(4, 256)[[0, 1, 3]]).sum()
        cost = float(rest + _bits(np.bincount(np.where(there, 256 + slots, shown[k][:, 2]))))
        if cost < best:
            best, out["cache_bits"] = cost, bits
    colours, counts = np.unique(np.ascontiguousarray(flat).view(">u4").ravel(), return_counts=True)
    if len(colours) <= 256 and float(_bits(counts)) + 32 * len(colours) < best:
        out = {"palette": True}
    return out


def _best_grey(samples: np.ndarray, own: np.ndarray, own_bits: float) -> dict:
    """What to encode a grey image with: palette, subtract-green alone, or the predictor above after it, by the bits of its symbols; own: how often each sample is there, and its bits."""
    above = np.bincount((samples[1:] - samples[:-1]).ravel(), minlength=256)
    above_bits, colours = float(_bits(above)), int(np.count_nonzero(own))
    if colours <= 16 and (own_bits + 32 * colours) / (1 << _palette_bits(colours)) < min(own_bits, above_bits):
        return {"palette": True}
    return {"green": True, "modes": np.full(-(-len(samples) >> 9), 2), "block": 9} if above_bits + 60 < own_bits else {"green": True}


#: Pixels from which a copy takes fewer bits than what it stands for: in grey images, and where pixels have four samples.
GREY_COPY, COPY = 5, 3
#: Pixels over which longer copies are looked for in large images.
LONG = 24


def _different(rows: np.ndarray) -> int:
    """About how many different groups of four bytes there are, up to a few hundred."""
    places = rows.view(np.uint32).ravel() * np.uint32(0x9E3779B1) >> np.uint32(20)
    return int(np.count_nonzero(np.bincount(places, minlength=1)))


def store(payload: bytes) -> bytes:
    """Images that hold the payload, whose length is a multiple of 64."""
    out = []
    for at in range(0, len(payload), IMAGE):
        rows = np.frombuffer(payload[at : at + IMAGE], np.uint8).reshape(-1, ROW)
        counts = np.bincount(rows.ravel(), minlength=256)
        bits = float(_bits(counts))
        if bits < TEXT_BITS * rows.size and _different(rows) > min(256, rows.size // 16):
            out.append(encode(rows, references=GREY_COPY, **_best_grey(rows, counts, bits)))
        else:
            pixels = rows.reshape(len(rows), ROW // 4, 4)
            out.append(encode(pixels, references=COPY, **_best(pixels)))
    return b"".join(out)


def load(media: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The payload and the images' sizes (width, height)."""
    out, sizes, at = [], [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        width, height, pixels = decode(media[at : at + size])
        out.append((pixels[:, :, 2] if width == ROW else pixels).tobytes())
        sizes.append((width, height))
        at += size
    return b"".join(out), sizes


def feature(payload: bytes) -> str:
    """Average hash of the 64 columns: bit i tells whether column i's mean is above the mean of all; as 16 hexadecimal digits."""
    sums = np.frombuffer(payload, np.uint8).reshape(-1, ROW).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * ROW > sums.sum()).tobytes().hex()


def pixel_arrays(media: DataFrame) -> DataFrame:
    """(id, width, height, pixels) of media(id, media): the decoded image, four bytes a pixel (alpha, red, green, blue); null media give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(m) if m is not None else (None, None, None) for m in b.column("media").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([None if f[2] is None else f[2].tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", "width", "height", "pixels"])

    return media.select("id", "media").mapInArrow(run, f"id {dict(media.dtypes)['id']}, width int, height int, pixels binary")


def stored(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Payload digests of every row of docs(doc_id, text), read back from its image; with_media adds the image itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows, kept = [], []
            for t in as_bytes(b.column("text")):
                media = store(t.ljust(max(1, -(-len(t) // ROW)) * ROW, b"\0"))
                back, _ = load(media)
                rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
                if with_media:
                    kept.append(media)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [b.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]] + [pa.array(kept, pa.binary())] * with_media
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media)
