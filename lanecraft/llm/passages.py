"""Removal of repeated passages by longest-previous-factor arrays in suffix order.

A byte goes if a string of ``LEAST`` bytes that covers it also starts in a document with a smaller id. So every suffix
of every document needs to know whether its longest factor that an earlier document has too is that long.

Suffixes are dealt by content: the key of a suffix is the smallest hash of the ``GRAM``-byte strings within its first
LEAST bytes, so suffixes that agree on those have the same key, and neighbours mostly share one; a run of neighbours
with one key travels as one string. Two rounds keep the volume down. In the first, only the keys of each slice of
documents are dealt out, to learn which occur in several documents. In the second, the strings under such keys meet.

Where strings meet, their suffixes are put in order. Neighbours in that order have their longest common prefix; the
longest previous factor of a suffix is the longer of those with the previous and with the next suffix of a smaller
document, each the least common prefix on the way there. It is found for the first suffixes of all strings: where it is
as long as the string, the string's other suffixes have theirs there too. The suffixes of all other strings follow, with
lengths capped at LEAST, beyond which nothing changes.

Documents are worked on in slices of neighbouring rows, bounded by rows and bytes. A slice settles by its own suffix
order what its smaller documents have, and sends on the rest: so a passage that a third of all documents share counts
once a slice and not once a document.

A run's string holds what stands beside the bytes that gave its key, so a short line that many documents share, each
between other texts, gives one key as many strings as documents. The first round therefore also tells how many strings a
slice has under a key. The suffixes under a crowded key are dealt one by one, by a hash of all their LEAST bytes.

A text is read whole, and in memory at once with those of its slice; where texts of tens of megabytes are common, bound
Spark's Arrow batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, text, with_row

LEAST = 50
GRAM = 20
#: Rows and bytes of a slice, unless one text alone has more; bytes that are hashed at once; bytes of all texts for each bucket of keys.
SLICE_ROWS, SLICE_BYTES = 256, 16 << 20
AT_ONCE = 1 << 20
BUCKET_BYTES = 4 << 20
#: Strings under one key, about, above which its suffixes are dealt one by one.
CROWD = 1024
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def over(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each ``width`` neighbours, by doubling; ``join(a, b, n)`` joins what covers n with what follows."""
    done, out = 0, None
    power, part = 1, values
    while True:
        if width & power:
            out = part if out is None else join(out[: len(out) - power], part[done:][: len(out) - power], power)
            done += power
        if done == width:
            return out
        part = join(part[:-power], part[power:], power)
        power *= 2


def keys(data: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The key of the suffix at each place of ``data`` that has ``least`` bytes after it; and running sums of all grams' hashes."""
    if len(data) < least:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    powers = [np.uint64(pow(int(ODD[0]), 1 << i, 1 << 64)) for i in range(8)]

    def hashed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        return a * powers[n.bit_length() - 1] + b

    with np.errstate(over="ignore"):
        grams = mixed(over(data.astype(np.uint64) + np.uint64(1), gram, hashed))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams)])
        return mixed(over(grams, least - gram + 1, lambda a, b, n: np.minimum(a, b)) + ODD[0]), sums


def runs(documents: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of neighbouring suffixes with one key: document, first and last place, key, hash of the string. In portions."""
    pieces, size = [], 0

    def portion() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        found, sums = keys(data)
        lengths = np.array([len(p) for _, _, p in pieces])
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        piece = np.repeat(np.arange(len(pieces)), lengths)[: len(found)]
        place = np.arange(len(found)) - begins[piece]
        good = np.flatnonzero(place + LEAST <= lengths[piece])
        found, piece, place = found[good], piece[good], place[good]
        first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (piece[1:] != piece[:-1])])) if len(found) else np.zeros(0, int)
        last = np.concatenate([first[1:], [len(found)]])[: len(first)] - 1
        document, offset = (np.array([p[i] for p in pieces], np.int64)[piece[first]] for i in (0, 1))
        with np.errstate(over="ignore"):
            prints = mixed(sums[good[last] + LEAST - GRAM + 1] - sums[good[first]])
        return document, place[first] + offset, place[last] + offset, found[first], prints

    for i, document in enumerate(documents):
        for at in range(0, max(len(document) - LEAST + 1, 0), AT_ONCE):
            pieces.append((i, at, document[at : at + AT_ONCE + LEAST - 1]))
            size += len(pieces[-1][2])
            if size >= AT_ONCE:
                yield portion()
                pieces, size = [], 0
    if pieces:
        yield portion()


def dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's bucket and its name there, 32 bits. Names are only a filter: keys that share one cost work, not results."""
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets, (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)][: len(starts)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


INT32S, INT64S = pa.list_(pa.int32()), pa.list_(pa.int64())
KEYS = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("once", INT32S), ("often", INT32S), ("once_marks", pa.binary()), ("often_marks", pa.binary())])
SHARED = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("names", INT32S), ("crowded", INT32S)])
STRINGS = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("keys", INT64S), ("ids", INT64S), ("rows", INT64S), ("starts", INT32S), ("lengths", INT32S), ("data", pa.binary())])
PACKED = pa.schema([("slice", pa.int64()), ("rows", INT64S), ("doc_ids", INT64S), ("lengths", INT64S), ("data", pa.binary())])
SPANS = pa.schema([("slice", pa.int64()), ("_row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", INT32S: "array<int>", INT64S: "array<long>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int | None], list[bytes]]]:
    """_row, doc_id and bytes of the documents of each slice. Where slices end depends on the rows alone, not on how they are batched."""
    rows: list[int] = []
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for row, doc_id, value in zip(*batch.columns, strict=True):
            value = value.as_py()
            if rows and (len(rows) == SLICE_ROWS or size + len(value) > SLICE_BYTES):
                yield rows, ids, texts
                rows, ids, texts, size = [], [], [], 0
            rows.append(row.as_py())
            ids.append(doc_id.as_py())
            texts.append(value)
            size += len(value)
    if rows:
        yield rows, ids, texts


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a slice, which is named by its first row, as one row, compressed: they go through two shuffles."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for rows, ids, texts in slices(batches):
        line = [[rows[0]], [rows], [ids], [list(map(len, texts))], [squeeze(b"".join(texts))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(line, PACKED.types, strict=True)], schema=PACKED)


def unpacked(table: pa.Table) -> list[tuple[int, int | None, bytes]]:
    """_row, doc_id and bytes of a slice's documents."""
    out, expand = [], zstandard.ZstdDecompressor().decompress
    for line in table.to_pylist():
        data, at = expand(line["data"], max_output_size=sum(line["lengths"])) if sum(line["lengths"]) else b"", 0
        for row, doc_id, n in zip(line["rows"], line["doc_ids"], line["lengths"], strict=True):
            out.append((row, doc_id, data[at : at + n]))
            at += n
    return sorted(out, key=lambda x: x[0])


def said(buckets: int):
    """First round, in a slice: which keys it has in one document and which in more.

    The mark of a key is the logarithm of its number of strings here, rounded up, and four bits of the hash of one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, documents in slices(batches):
            parts = [(d, k, h) for d, _, _, k, h in runs(documents)]
            document, key, prints = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.uint64)] * 3
            if not len(key):
                continue
            bucket, name = dealt(key, buckets)
            code = bucket.astype(np.uint64) << np.uint64(32) | name.view(np.uint32)
            order = np.lexsort((prints, code))
            code, document, prints = code[order], document[order], prints[order]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            other = new | np.concatenate([[True], prints[1:] != prints[:-1]])
            first = np.flatnonzero(new)
            many = np.minimum.reduceat(document, first) != np.maximum.reduceat(document, first)
            power = np.minimum(np.ceil(np.log2(np.add.reduceat(other.astype(np.int64), first))), 15).astype(np.uint8)
            mark = power << np.uint8(4) | (prints[first] & np.uint64(15)).astype(np.uint8)
            code = code[first]
            at, names = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            rows = [(k, own[0], *(names[j] for j in (i[~many[i]], i[many[i]])), *(mark[j].tobytes() for j in (i[~many[i]], i[many[i]]))) for k, i in grouped(at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KEYS.types, strict=True)], schema=KEYS)

    return run


def met(crowd: int):
    """First round, in a bucket: for each slice, which of its keys other documents have too, and which of these are crowded."""

    def run(table: pa.Table) -> pa.Table:
        flat, owner, often = [], [], []
        mark = np.frombuffer(b"".join(v.as_py() for c in ("once_marks", "often_marks") for v in table.column(c)), np.uint8)
        for column, many in ((table.column("once"), False), (table.column("often"), True)):
            column = column.combine_chunks()
            flat.append(column.flatten().to_numpy())
            owner.append(np.repeat(np.arange(len(table)), column.value_lengths().to_numpy()))
            often.append(np.full(len(flat[-1]), many))
        name, owner, often = map(np.concatenate, (flat, owner, often))
        order = np.argsort(name, kind="stable")
        name, owner, often, mark = name[order], owner[order], often[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(name) != 0])) if len(name) else np.zeros(0, int)
        sizes = np.diff(np.concatenate([first, [len(name)]]))
        shared = np.repeat((sizes > 1) | (np.logical_or.reduceat(often, first) if len(name) else often), sizes)
        crowded = np.zeros(len(name), bool)
        if len(name):
            # A few strings that all slices have are no crowd: they are sent once a slice.
            strings = np.add.reduceat(1 << (mark >> 4).astype(np.int64), first)
            kinds = np.bitwise_count(np.bitwise_or.reduceat(1 << (mark & 15).astype(np.int64), first))
            crowded = np.repeat((strings > crowd) & ((kinds > 3) | (np.maximum.reduceat(mark, first) >> 4 > 2)), sizes)
        name, owner, crowded = name[shared], owner[shared], crowded[shared]
        slices, bucket = table.column("slice").to_numpy(), table.column("bucket")[0].as_py()
        rows = [(int(slices[k]), bucket, name[i], name[i[crowded[i]]]) for k, i in grouped(owner)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, SHARED.types, strict=True)], schema=SHARED)

    return run


def told(buckets: int):
    """Second round, in a slice: the strings under shared keys, with their smallest document; and, with bucket -1, the
    spans of the slice's later documents. Under a crowded key each suffix is a string, with a key of its own."""

    def codes(shared: pa.Table, column: str) -> np.ndarray:
        parts = zip(shared.column("bucket").to_numpy(), (x.values for x in shared.column(column)), strict=True)
        return np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | v.to_numpy().view(np.uint32) for b, v in parts]))

    def run(documents: pa.Table, shared: pa.Table) -> pa.Table:
        none = pa.Table.from_arrays([pa.array([], t) for t in STRINGS.types], schema=STRINGS)
        if not len(shared) or not len(documents):
            return none
        wanted, crowded = codes(shared, "names"), codes(shared, "crowded")
        own_slice = documents.column("slice")[0].as_py()
        rows, ids, texts = zip(*unpacked(documents), strict=True)
        ids = [LAST_ID if i is None else i for i in ids]
        held: list[tuple[int, int, int, int, bytes]] = []  # of each string: key, document, row, place and itself
        apart: list[tuple[int, int, int]] = []
        for document, start, stop, key, _ in runs(texts):
            bucket, name = dealt(key, buckets)
            code = bucket.astype(np.uint64) << np.uint64(32) | name.view(np.uint32)
            at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            full = np.isin(code, crowded)
            keep = np.flatnonzero((wanted[at] == code) & ~full)
            apart += zip(document[full].tolist(), start[full].tolist(), stop[full].tolist(), strict=True)
            for d, a, b, k in zip(document[keep].tolist(), start[keep].tolist(), (stop[keep] + LEAST).tolist(), key[keep].view(np.int64).tolist(), strict=True):
                held.append((k, ids[d], rows[d], a, texts[d][a:b]))
        out, later = defaultdict(list), []
        settled_here = covered([h[4] for h in held], np.array([h[1] for h in held], np.int64))
        for (k, i, row, a, string), here in zip(held, settled_here.tolist(), strict=True):
            if here:
                later.append((0, i, row, a, len(string), b""))
            else:
                out[(k & 0xFFFFFFFF) % buckets].append((k, i, row, a, len(string), string))
        for d, a, b, own in single(apart, texts, ids):
            begin = None  # of a stretch of suffixes that the slice settles itself
            for p, here in enumerate(own, a):
                if here:
                    begin = p if begin is None else begin
                    continue
                if begin is not None:
                    later.append((0, ids[d], rows[d], begin, p - 1 + LEAST - begin, b""))
                    begin = None
                string = texts[d][p : p + LEAST]
                key = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                out[(key & 0xFFFFFFFF) % buckets].append((key, ids[d], rows[d], p, LEAST, string))
            if begin is not None:
                later.append((0, ids[d], rows[d], begin, b + LEAST - begin, b""))
        if later:
            out[-1] = later
        lines = []
        for to, entries in out.items():
            *numbers, data = zip(*entries, strict=True)
            lines.append((to, own_slice, *map(list, numbers), b"".join(data)))
        if not lines:
            return none
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), STRINGS.types, strict=True)], schema=STRINGS)

    return run


def longest_previous(common: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in suffix order: ``common[i]`` is what i has in common with the one before it.

    The previous smaller document is found by following, round by round, where the one before points to; what is common
    on the way is the least of its parts. The next smaller one is the same from the other end.
    """
    best = np.zeros(len(ids), np.int64)
    for back in (False, True) if len(ids) else ():
        of = ids[::-1] if back else ids
        shared = np.concatenate([[0], common[1:][::-1] if back else common[1:]]).astype(np.int64)
        to = np.arange(-1, len(of) - 1)
        open_ = np.flatnonzero((to >= 0) & (shared > 0))
        while len(open_ := open_[(of[to[open_]] >= of[open_]) & (shared[open_] > 0)]):
            through = to[open_]
            shared[open_] = np.minimum(shared[open_], shared[through])
            to[open_] = to[through]
            open_ = open_[to[open_] >= 0]
        shared[to < 0] = 0
        best = np.maximum(best, shared[::-1] if back else shared)
    return best


def covered(strings: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each string's first suffix is as long as the string."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    common = np.zeros(len(order), np.int64)
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        n = min(len(a), len(b))
        if a[:LEAST] == b[:LEAST]:  # shorter than LEAST is as good as nothing
            differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
            common[i] = n - (differ.bit_length() + 7) // 8
    out = np.zeros(len(order), bool)
    out[order] = longest_previous(common, ids[order]) >= np.array([len(strings[i]) for i in order], np.int64)
    return out


def previous_factors(windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The longest previous factors of suffixes that are given by their first LEAST bytes (rows of ``windows``): LEAST, or 0 for less."""
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel(), kind="stable")
    in_order = windows[order]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where((in_order[1:] == in_order[:-1]).all(axis=1), windows.shape[1], 0)
    out = np.zeros(len(ids), np.int64)
    out[order] = longest_previous(common, ids[order])
    return out


def repeated(windows: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the suffixes ``windows[begin]`` have a longest previous factor of LEAST.

    Only those that share a hash of all their LEAST bytes need to be put in order.
    """
    with np.errstate(over="ignore"):
        weights = ODD[1] ** np.arange(1, LEAST + 1, dtype=np.uint64)
        sums = np.concatenate([windows[begin[i : i + 65536]].astype(np.uint64) @ weights for i in range(0, len(begin), 65536)])
    _, back, seen = np.unique(sums, return_inverse=True, return_counts=True)
    some = np.flatnonzero(seen[back] > 1)
    out = np.zeros(len(begin), bool)
    if len(some):
        out[some] = previous_factors(windows[begin[some]], ids[some]) >= LEAST
    return out


def single(apart: list[tuple[int, int, int]], texts: list[bytes], ids: list[int]) -> Iterator[tuple[int, int, int, list[bool]]]:
    """``apart`` (document, first and last place of a stretch of suffixes), with which of them the slice settles itself."""
    if not apart:
        return
    documents = sorted({d for d, _, _ in apart})
    base = dict(zip(documents, np.concatenate([[0], np.cumsum([len(texts[d]) for d in documents])]).tolist(), strict=False))
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts[d] for d in documents), np.uint8), LEAST)
    many = np.array([b - a + 1 for _, a, b in apart], np.int64)
    begin = np.repeat([base[d] + a for d, a, _ in apart], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    found = repeated(windows, begin, np.repeat(np.array([ids[d] for d, _, _ in apart], np.int64), many))
    for (d, a, b), own in zip(apart, np.split(found, np.cumsum(many)[:-1]), strict=True):
        yield d, a, b, own.tolist()


def settled(table: pa.Table) -> pa.Table:
    """Second round, in a bucket: the spans of the suffixes whose longest previous factor is LEAST or more."""
    columns = {n: np.concatenate([v.values.to_numpy() for v in table.column(n)]) for n in ("keys", "ids", "rows", "starts", "lengths")}
    key, ids, rows, starts, lengths = (c.astype(np.int64) for c in columns.values())
    own = np.repeat(table.column("slice").to_numpy(), [len(v.values) for v in table.column("keys")])
    spans: list[np.ndarray] = []
    if table.column("bucket")[0].as_py() < 0:
        spans.append(np.stack([own, rows, starts, starts + lengths]))
    else:
        data = b"".join(v.as_py() for v in table.column("data"))
        ends = np.cumsum(lengths)
        strings = [data[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        whole = covered(strings, ids)
        spans.append(np.stack([own, rows, starts, starts + lengths])[:, whole])
        # Different strings under one key may share suffixes in part; the covered ones have nothing that others lack.
        _, of, count = np.unique(key[~whole], return_inverse=True, return_counts=True)
        left = np.flatnonzero(~whole)[count[of] > 1]
        if len(left):
            many = lengths[left] - LEAST + 1
            begin = np.repeat(ends[left] - lengths[left], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LEAST)
            found = repeated(view, begin, np.repeat(ids[left], many))
            for e, flags in zip(left.tolist(), np.split(found, np.cumsum(many)[:-1]), strict=True):
                if flags.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    n = len(edges) // 2
                    spans.append(np.stack([np.full(n, own[e]), np.full(n, rows[e]), starts[e] + edges[::2], starts[e] + edges[1::2] - 1 + LEAST]))
    of_slice, row, start, stop = np.concatenate(spans, axis=1)
    return pa.Table.from_arrays([pa.array(c) for c in (of_slice, row, start, stop)], schema=SPANS)


KEPT = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def removed(documents: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of a slice's documents."""
    row = spans.column("_row").to_numpy()
    order = np.argsort(row, kind="stable")
    row, start, stop = row[order], spans.column("start").to_numpy()[order], spans.column("stop").to_numpy()[order]
    out = []
    for own, doc_id, value in unpacked(documents):
        data = np.frombuffer(value, np.uint8)
        a, b = np.searchsorted(row, [own, own + 1])
        depth = np.zeros(len(data) + 1, np.int64)
        np.add.at(depth, start[a:b], 1)
        np.add.at(depth, stop[a:b], -1)
        gone = np.cumsum(depth[:-1]) > 0
        left = data[~gone].tobytes()
        n = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)) if len(gone) else 0
        out.append((own, doc_id, len(data), int(gone.sum()), n, hashlib.sha256(left).hexdigest(), left))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, KEPT.types, strict=True)], schema=KEPT)


def without_repeats(docs: DataFrame, kept_bytes: bool = True) -> DataFrame:
    """For every row of ``docs``: _row, doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``kept_bytes`` what is left (binary).

    Null texts are empty; texts below LEAST bytes never change. A document without id counts as later than all others;
    rows with the same id never remove each other's bytes. Other columns don't matter; an empty table gives none. ``docs`` must come straight from files or a checkpoint.
    """
    rows = with_row(docs).select("_row", "doc_id", text().cast("binary").alias("bytes"))
    size = docs.agg(F.sum(F.octet_length(text()))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    keyed = rows.mapInArrow(said(buckets), ddl(KEYS))
    shared = keyed.groupBy("bucket").applyInArrow(met(CROWD), ddl(SHARED))
    own = rows.mapInArrow(packed, ddl(PACKED))
    strings = own.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(told(buckets), ddl(STRINGS))
    # What a slice has settled itself needs no meeting, so those rows may stay where they are.
    apart = strings.withColumn("part", F.when(F.col("bucket") < 0, F.xxhash64("rows") % 1024).otherwise(0))
    spans = apart.groupBy("bucket", "part").applyInArrow(lambda t: settled(t), ddl(SPANS))
    left = own.groupBy("slice").cogroup(spans.groupBy("slice"))
    wanted = KEPT if kept_bytes else pa.schema(list(KEPT)[:-1])
    return left.applyInArrow(lambda d, s: removed(d, s).select(wanted.names), ddl(wanted))
