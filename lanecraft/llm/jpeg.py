"""Baseline JPEG as a media column: bytes stored as DCT coefficients, decoded again, and thumbnails of the DC terms.

A payload of 64-byte blocks becomes a greyscale baseline JPEG in which each byte, less 128, is one quantised
coefficient of an 8x8 block; the first of a block is its DC term. Coefficients are coded without loss, so the decoder
gives back the bytes exactly. Each block is a restart interval, which lets numpy code and decode one coefficient of
very many blocks (of very many files) per step. The decoder reads what the markers of a file say, of other encoders'
baseline files too: sizes, components and their sampling, Huffman and quantisation tables, and restart intervals of any
length or none, whose DC terms it sums up. Of a picture in colour the luminance makes the thumbnail. A file without
restarts is decoded one coefficient at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, fresh, text

SIDE = 8
BLOCK = SIDE * SIDE
#: Blocks in a row of a picture, unless it would get higher than a picture can be.
WIDTH = 64
#: Blocks that are coded or decoded at once.
AT_ONCE = 1 << 15
MAGIC = b"payload\0"

# --- Huffman tables: lengths by rule. The sizes 1 to 10 without a run, and the end of a block, get 4 bits, all other
# symbols of a baseline AC table 9; the 12 DC sizes get 4.
AC_LENGTHS = {run << 4 | size: 9 for run in range(16) for size in range(1, 11)} | {0xF0: 9} | {size: 4 for size in range(1, 11)} | {0: 4}
DC_LENGTHS = dict.fromkeys(range(12), 4)


class Table(NamedTuple):
    """A Huffman table: code and length by symbol, and by the next 16 bits symbol and length (0: no such code)."""

    code: np.ndarray
    length: np.ndarray
    ahead: np.ndarray


def canonical(counts: list[int], symbols: bytes) -> Table:
    """The table that a DHT marker describes by the number of codes of each length and the symbols in their order."""
    code_of, length_of, ahead = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            code_of[symbol], length_of[symbol] = code, length
            ahead[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
            code += 1
        at += count
        code <<= 1
    return Table(code_of, length_of, ahead)


def described(lengths: dict[int, int]) -> tuple[list[int], bytes]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(n == length for n in lengths.values()) for length in range(1, 17)], bytes(symbols)


DC, AC = described(DC_LENGTHS), described(AC_LENGTHS)
DC_TABLE, AC_TABLE = canonical(*DC), canonical(*AC)
#: Bits of an absolute value, which is its JPEG size.
SIZE = np.array([int(v).bit_length() for v in range(512)], np.int64)


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def header(blocks: int, payload: int) -> tuple[bytes, int]:
    """All up to the scan's data, and the number of blocks of the picture."""
    wide = max(min(blocks, WIDTH), -(-blocks // 8191))
    high = -(-blocks // wide)
    parts = [b"\xff\xd8", marker(0xFE, MAGIC + struct.pack(">Q", payload)), marker(0xDB, b"\0" + b"\1" * BLOCK)]
    parts.append(marker(0xC0, struct.pack(">BHHBBBB", 8, high * SIDE, wide * SIDE, 1, 1, 0x11, 0)))
    parts += [marker(0xC4, bytes([kind]) + bytes(t[0]) + t[1]) for kind, t in ((0x00, DC), (0x10, AC))]
    parts += [marker(0xDD, struct.pack(">H", 1)), marker(0xDA, bytes([1, 1, 0, 0, BLOCK - 1, 0]))]
    return b"".join(parts), wide * high


def coded(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of each block (rows of int64 coefficients), stuffed and ended by a restart marker of
    number 0, one after another; and where each block begins."""
    n = len(blocks)
    out = np.zeros((n, 3 * BLOCK + 8), np.uint8)
    held, bits, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)

    def put(who: np.ndarray, value: np.ndarray, length: np.ndarray) -> None:
        held[who] = held[who] << length | value
        bits[who] += length
        while len(full := who[bits[who] >= 8]):
            bits[full] -= 8
            out[full, at[full]] = held[full] >> bits[full] & 0xFF
            at[full] += 1
        held[who] &= (1 << bits[who]) - 1

    def symbol(who: np.ndarray, table: Table, run: np.ndarray | int, value: np.ndarray) -> None:
        size = SIZE[np.abs(value)]
        name = run << 4 | size
        extra = np.where(value < 0, value + (1 << size) - 1, value)
        put(who, table.code[name] << size | extra, table.length[name] + size)

    symbol(rows, DC_TABLE, 0, blocks[:, 0])
    runs = np.zeros(n, np.int64)
    for k in range(1, BLOCK):
        value = blocks[:, k]
        some = np.flatnonzero(value)
        if len(some) < n:
            while len(long := some[runs[some] > 15]):
                put(long, AC_TABLE.code[np.full(len(long), 0xF0)], AC_TABLE.length[np.full(len(long), 0xF0)])
                runs[long] -= 16
            symbol(some, AC_TABLE, runs[some], value[some])
            runs += 1
            runs[some] = 0
        elif runs.any():
            while len(long := some[runs[some] > 15]):
                put(long, AC_TABLE.code[np.full(len(long), 0xF0)], AC_TABLE.length[np.full(len(long), 0xF0)])
                runs[long] -= 16
            symbol(some, AC_TABLE, runs, value)
            runs[:] = 0
        else:
            symbol(some, AC_TABLE, 0, value)
    ending = np.flatnonzero(runs)
    put(ending, AC_TABLE.code[np.zeros(len(ending), np.int64)], AC_TABLE.length[np.zeros(len(ending), np.int64)])
    padded = np.flatnonzero(bits)
    out[padded, at[padded]] = held[padded] << (8 - bits[padded]) | (1 << (8 - bits[padded])) - 1
    at[padded] += 1
    used = np.arange(out.shape[1]) < at[:, None]
    flat = out[used]
    stuffed = flat == 0xFF
    grown = np.zeros(len(flat) + int(stuffed.sum()) + 2 * n, np.uint8)
    ends = np.cumsum(at)
    more = np.concatenate([[0], np.cumsum(stuffed)])
    place = np.arange(len(flat)) + more[:-1] + 2 * np.repeat(rows, at)
    grown[place] = flat
    begins = np.concatenate([[0], ends + more[ends] + 2 * (rows + 1)])
    grown[begins[1:] - 2], grown[begins[1:] - 1] = 0xFF, 0xD0
    return grown, begins


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, whose length is a positive multiple of 64."""
    heads = [header(len(p) // BLOCK, len(p)) for p in payloads]
    rows = b"".join(p + bytes([128]) * (blocks * BLOCK - len(p)) for p, (_, blocks) in zip(payloads, heads, strict=True))
    values = np.frombuffer(rows, np.uint8).reshape(-1, BLOCK)
    scans, begins = [], [np.zeros(1, np.int64)]
    for at in range(0, len(values), AT_ONCE):
        scan, ends = coded(values[at : at + AT_ONCE].astype(np.int64) - 128)
        scans.append(scan)
        begins.append(ends[1:] + begins[-1][-1])
    scan, begin = np.concatenate(scans), np.concatenate(begins)
    files, first = [], 0
    for head, blocks in heads:
        own = scan[begin[first] : begin[first + blocks]].copy()
        own[begin[first + 1 : first + blocks + 1] - begin[first] - 1] += (np.arange(blocks) & 7).astype(np.uint8)
        files.append(head + own[:-2].tobytes() + b"\xff\xd9")
        first += blocks
    return files


class Part(NamedTuple):
    """A component of a scan: its number, sampling factors, first quantiser and tables."""

    number: int
    wide: int
    high: int
    quantiser: int
    dc: Table
    ac: Table


class Picture(NamedTuple):
    """What the markers say up to the end of the scan that holds the luminance; ``interval`` 0 is a scan without restarts."""

    width: int
    height: int
    payload: int
    parts: tuple[Part, ...]
    most_wide: int
    most_high: int
    interval: int
    scan: tuple[int, int]

    def grid(self) -> tuple[int, int]:
        """Units of the scan in a row and in a column; a scan of one component has units of one block."""
        if len(self.parts) > 1:
            return -(-self.width // (SIDE * self.most_wide)), -(-self.height // (SIDE * self.most_high))
        own = self.parts[0]
        return -(-(-(-self.width * own.wide // self.most_wide)) // SIDE), -(-(-(-self.height * own.high // self.most_high)) // SIDE)

    def layout(self) -> tuple[int, ...]:
        """The part of each block of a unit."""
        if len(self.parts) == 1:
            return (0,)
        return tuple(i for i, p in enumerate(self.parts) for _ in range(p.wide * p.high))


def scan_end(file: bytes, at: int) -> int:
    """Where the next marker is that belongs to no scan's data."""
    while (at := file.find(b"\xff", at)) >= 0 and at + 1 < len(file):
        if file[at + 1] and not 0xD0 <= file[at + 1] <= 0xD7:
            return at
        at += 2 if not file[at + 1] or file[at + 1] != 0xFF else 1
    return len(file)


def parsed(file: bytes) -> Picture:
    """What the markers of a baseline file say."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, payload, tables, quantisers, shape, interval = 2, -1, {}, {}, None, 0
    while True:
        while file[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if file[at : at + 1] != b"\xff" or file[at + 1] == 0xD9:
            raise ValueError(f"no marker at {at}, or no scan of the luminance")
        code, length = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + length], at + 2 + length
        if code == 0xFE and body.startswith(MAGIC):
            payload = struct.unpack(">Q", body[len(MAGIC) :])[0]
        elif code == 0xC0:
            precision, high, wide, components = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8 bits a sample")
            shape = wide, high, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(components)}
        elif code in range(0xC1, 0xD0) and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif code == 0xDB:
            while body:
                size = 2 if body[0] >> 4 else 1
                quantisers[body[0] & 15] = int.from_bytes(body[1 : 1 + size], "big")
                body = body[1 + BLOCK * size :]
        elif code == 0xC4:
            while body:
                counts = list(body[1:17])
                end = 17 + sum(counts)
                tables[body[0]] = table(bytes(counts), body[17:end])
                body = body[end:]
        elif code == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            if shape is None:
                raise ValueError("a scan before the frame")
            end, (wide, high, frames) = scan_end(file, at), shape
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            if next(iter(frames)) in dict(chosen):
                parts = tuple(Part(c, *frames[c][:2], quantisers.get(frames[c][2], 1), tables[t >> 4], tables[0x10 | t & 15]) for c, t in chosen)
                most = (max(f[i] for f in frames.values()) for i in (0, 1))
                return Picture(wide, high, payload, parts, *most, interval, (at, end))
            at = end


_tables: dict[tuple[bytes, bytes], Table] = {}


def table(counts: bytes, symbols: bytes) -> Table:
    """``canonical``, for the same marker built once; a worker keeps a few."""
    found = _tables.get((counts, symbols))
    if found is None:
        if len(_tables) > 16:
            _tables.clear()
        found = _tables[counts, symbols] = canonical(list(counts), symbols)
    return found


def decoded(data: np.ndarray, begins: np.ndarray, units: np.ndarray, layout: tuple[int, ...], tables: tuple[tuple[Table, Table], ...]) -> np.ndarray:
    """The coefficients of the blocks of the intervals whose unstuffed bytes begin at ``begins``: by interval, unit and block of ``layout``.

    ``units`` says how many units an interval has. A step decodes one coefficient of all intervals; DC terms are
    differences from those before in their interval and part. ``data`` has 8 bytes more at its end.
    """
    wide = np.zeros(len(data) - 7, np.int64)
    for i in range(5):
        wide = wide << 8 | data[i : len(data) - 7 + i]
    n = len(begins)
    first = np.concatenate([[0], np.cumsum(units)]) * len(layout)
    out = np.zeros((int(first[-1]), BLOCK), np.int64)
    bit = begins.astype(np.int64) * 8
    before = np.zeros((len(tables), n), np.int64)

    def value(who: np.ndarray, huffman: Table) -> tuple[np.ndarray, np.ndarray]:
        place = bit[who]
        if len(place) and place.max() >> 3 >= len(wide):
            raise ValueError("the data ends within a block")
        ahead = wide[place >> 3] >> (8 - (place & 7)) & 0xFFFFFFFF
        found = huffman.ahead[ahead >> 16]
        length, name = found & 0xFF, found >> 8
        if not length.all():
            raise ValueError("no such code")
        size = name & 15
        extra = ahead >> (32 - length - size) & (1 << size) - 1
        bit[who] = place + length + size
        return name, np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)

    for unit in range(int(units.max(initial=0))):
        live = np.flatnonzero(units > unit)
        for b, part in enumerate(layout):
            dc, ac = tables[part]
            at = first[live] + unit * len(layout) + b
            _, step = value(live, dc)
            before[part, live] += step
            out[at, 0] = before[part, live]
            rows, k = live, np.ones(len(live), np.int64)
            while len(rows):
                name, found = value(rows, ac)
                k += name >> 4
                if k.max() > BLOCK:
                    raise ValueError("a block with too many coefficients")
                some = (name & 15) > 0
                if some.all():
                    out[at, np.minimum(k, BLOCK - 1)] = found
                    k += 1
                    keep = k < BLOCK
                else:
                    out[at[some], np.minimum(k[some], BLOCK - 1)] = found[some]
                    k += 1
                    keep = (k < BLOCK) & (name != 0)
                if not keep.all():
                    rows, k, at = rows[keep], k[keep], at[keep]
    if (bit > 8 * np.concatenate([begins[1:], [len(data) - 8]])).any():
        raise ValueError("the data ends within a block")
    return out


def decode(files: list[bytes]) -> list[tuple[Picture, np.ndarray]]:
    """For each file what it says of itself and the coefficients of its scan, a row per block in the order of the scan.

    Intervals of files with equal tables and layouts are decoded together.
    """
    pictures = [parsed(f) for f in files]
    out: list[list[np.ndarray]] = [[] for _ in files]
    pending: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    of = lambda p: (p.layout(), tuple((x.dc, x.ac) for x in p.parts))
    alike = lambda p, q: p.layout() == q.layout() and all(a.dc is b.dc and a.ac is b.ac for a, b in zip(p.parts, q.parts, strict=True))

    def flush() -> None:
        if pending:
            sizes = np.cumsum([0] + [len(d) for _, d, _, _ in pending])
            data = np.concatenate([d for _, d, _, _ in pending] + [np.zeros(8, np.uint8)])
            begins = np.concatenate([b + s for (_, _, b, _), s in zip(pending, sizes, strict=False)])
            layout, tables = of(pictures[pending[0][0]])
            found, first = decoded(data, begins, np.concatenate([u for *_, u in pending]), layout, tables), 0
            for i, _, _, units in pending:
                many = int(units.sum()) * len(layout)
                out[i].append(found[first : first + many])
                first += many
            pending.clear()

    for i, (file, picture) in enumerate(zip(files, pictures, strict=True)):
        raw = np.frombuffer(file, np.uint8)[slice(*picture.scan)]
        after = np.concatenate([raw[1:], [0xD9]])
        stuffing = np.concatenate([[False], (raw[:-1] == 0xFF) & (raw[1:] == 0)])
        restart = (raw == 0xFF) & (after >= 0xD0) & (after <= 0xD7)
        data = raw[~stuffing]
        begins = np.concatenate([[0], np.flatnonzero(restart[~stuffing]) + 2])
        across, down = picture.grid()
        interval = picture.interval or across * down
        units = np.full(-(-across * down // interval), interval, np.int64)
        units[-1] = across * down - interval * (len(units) - 1)
        if len(begins) != len(units):
            raise ValueError("the restart markers don't fit the picture")
        if pending and not alike(pictures[pending[0][0]], picture):
            flush()
        for at in range(0, len(begins), AT_ONCE):
            part = begins[at : at + AT_ONCE]
            end = begins[at + AT_ONCE] if at + AT_ONCE < len(begins) else len(data)
            pending.append((i, data[part[0] : end], part - part[0], units[at : at + AT_ONCE]))
            if sum(len(b) for _, _, b, _ in pending) >= AT_ONCE:
                flush()
    flush()
    return [(p, np.concatenate(o)) for p, o in zip(pictures, out, strict=True)]


def thumbnail(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """The luminance at an eighth of its size: the mean of each block, which is its DC term alone."""
    across, down = picture.grid()
    own = picture.parts[0]
    levels = np.clip((coefficients[:, 0] * own.quantiser) // SIDE + 128, 0, 255).astype(np.uint8)
    if len(picture.parts) == 1:
        return levels.reshape(down, across)
    levels = levels.reshape(down, across, len(picture.layout()))[:, :, : own.wide * own.high]
    image = levels.reshape(down, across, own.high, own.wide).swapaxes(1, 2).reshape(down * own.high, across * own.wide)
    wide, high = -(-picture.width * own.wide // picture.most_wide), -(-picture.height * own.high // picture.most_high)
    return image[: -(-high // SIDE), : -(-wide // SIDE)]


def average_hash(image: np.ndarray) -> str:
    """64 bits of an 8x8 grid over ``image``: whether a cell is brighter than their mean."""
    at = [np.minimum(np.arange(SIDE) * n // SIDE, n - 1) for n in image.shape]
    ends = [np.maximum((np.arange(SIDE) + 1) * n // SIDE, a + 1) for n, a in zip(image.shape, at, strict=True)]
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    sums[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    (a, b), (c, d) = (at[0], ends[0]), (at[1], ends[1])
    totals = sums[b][:, d] - sums[a][:, d] - sums[b][:, c] + sums[a][:, c]
    means = totals / ((b - a)[:, None] * (d - c)[None, :])
    return np.packbits((means > means.mean()).ravel()).tobytes().hex()


MEDIA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
#: Bytes of text that a task codes together, unless one text alone has more.
BYTES_AT_ONCE = 4 << 20


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def stored(docs: DataFrame, column: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the JPEG file (binary) of each text; null counts as empty. A column named like ``media`` is replaced, others stay."""
    kept = docs.drop(media)
    names = [*kept.columns, media]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in portions(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(encode(list(map(padded, texts))), pa.binary())], names=names)

    return kept.withColumn(fresh(kept, "_text"), text(column).cast("binary")).mapInArrow(run, f"{fields}, `{media}` binary")


def portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts, of about BYTES_AT_ONCE each."""
    texts, first, size = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        size += len(texts[-1])
        if size >= BYTES_AT_ONCE:
            yield batch.slice(first, i + 1 - first), texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield batch.slice(first), texts


def features(docs: DataFrame) -> DataFrame:
    """The columns of ``MEDIA`` for every row of ``docs``: its text stored as a JPEG file and read back; no shuffle.

    ``feature`` is width x height in pixels and the average hash of the DC thumbnail. Null texts count as empty, which
    is a payload of one block of zeros. Equal texts give equal values, repeated rows a row each, an empty table none; other
    columns don't matter. A text of any length is one file, coded in portions of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in portions(batch, 1):
                files = encode(list(map(padded, texts)))
                found = []
                for file, (picture, coefficients) in zip(files, decode(files), strict=True):
                    payload = (coefficients + 128).astype(np.uint8).tobytes()[: picture.payload]
                    feature = f"{picture.width}x{picture.height}:{average_hash(thumbnail(picture, coefficients))}"
                    found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                yield frame(MEDIA, [rows.column(0), list(map(len, texts)), *map(list, zip(*found, strict=True))])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", text().cast("binary").alias("text")).mapInArrow(run, schema)
