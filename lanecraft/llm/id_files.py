"""Token ids as binary files, with an index that leads from a document's key to its ids in constant time.

A folder of such files holds

- ``shards``: raw little-endian ids, 2 bytes each if the vocabulary allows it, else 4, after a header of 8 bytes. The
  shards in order of their numbers, and the documents in them, are in ascending order of doc_id;
- ``index``: minimal perfect hashes. A key is dealt to one of the parts by its hash. A part's hash places each of its
  keys in a slot of its own, with no slot left over, and the slot holds the key's fingerprint, shard, offset, number of ids
  and the number of ids before it in all shards. A key that isn't in the folder meets another's fingerprint, and isn't found
  (but for one in 2^64);
- ``documents``: Parquet with the same for each document, which the index is made of;
- ``manifest.json``: the numbers that a reader needs first.

Spark ranges the documents by id, encodes and writes them in tasks, and adds up where each shard begins; the parts of the
index are built in tasks as well, one task a part. Readers deal keys to the parts, and what the index tells to the shards,
so each task opens the files that its keys need. Files are written under a task's own name and then renamed, so an attempt
that is repeated, or runs twice, leaves the same files.

A key is a doc_id and the number of the copy, for rows whose ids are repeated.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import cut, gather, text, with_row
from .exact import heavy_above

MAGIC = b"lcids\0"
#: A shard is closed when it holds so many bytes; a document is never split.
SHARD = 32 << 20
#: Keys in a part of the index, on average.
KEYS = 1 << 16
#: Characters of the texts that are worked on at once; a longer text is cut at blanks.
AT_ONCE = 1 << 24
#: Ids that are read at once, unless one document has more.
READ = 1 << 20
BLANK = re.compile(r"[\x20\x09-\x0D]")
#: A run of letters that stay one character each when they are lowered and composed, between other ASCII characters than
#: digits and those of contractions and special tokens.
PLAIN = r"^(?P<before>[!-&(-/:;=?@\[-`{}~]*)(?P<letters>[A-Za-zÀ-ÖØ-öø-įı-ɏЀ-ҁҊ-ԯ]+)(?P<after>[!-&(-/:;=?@\[-`{}~]*)$"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def put(path: str, content: bytes) -> None:
    system, at = store(path)
    own = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(content)
    settle(system, own, at)


def settle(system: fs.FileSystem, own: str, at: str) -> None:
    """Another attempt may have put the same file there already."""
    if system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_file(at)
    system.move(own, at)


def get(path: str) -> bytes:
    system, at = store(path)
    with system.open_input_stream(at) as content:
        return content.read()


# --- encoding


class Words:
    """Ids of texts by a tokenizer that splits at blanks, lowers letters and gives each run of letters tokens of its own.

    Arrow splits a batch of texts into words and tells the different ones apart, and takes the letters of a word from the
    characters around them. Only different parts come to Python; the library encodes those that are new to the worker,
    runs of letters by thousands in one call. A worker remembers parts for two generations of up to ``most`` bytes: what
    isn't met in one is forgotten in the next. That the tokenizer is of this kind is tried when it is loaded.
    """

    def __init__(self, path: str, most: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.lowered = (tokenizers.Tokenizer.from_file(path) for _ in range(2))
        self.model.no_padding()
        self.model.no_truncation()
        # Runs of letters are lowered and split already.
        self.lowered.normalizer = None
        self.lowered.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = self.model.model.end_of_word_suffix
        self.ends = np.array([bool(suffix) and (self.model.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.most, self.bytes = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        tried = ["don't", "\u0301e", "AÅ", "'s", "12", "(Ab-Éß),", "ЁжĲ!?"]
        parts = ["don't", "\u0301e", "aÅ", "'s", "12", "(", "ab", "-", "éß", "),", "ёжĳ", "!?"]
        for blank in " \t\n\x0b\x0c\r":
            if self.ids([(blank * 2).join(tried)])[0] != sum(self.ids(parts), []):
                raise ValueError(f"the tokenizer of {path} reaches over blanks, or joins letters with other characters, or doesn't lower them")
        if self.runs(["ab", "éß", "ёжĳ"]) != [self.packed(i) for i in self.ids(["ab", "éß", "ёжĳ"])]:
            raise ValueError(f"tokens of {path} don't tell where a word ends")

    @property
    def width(self) -> int:
        return self.kind.itemsize

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def others(self, texts: list[str]) -> list[bytes]:
        return [self.packed(ids) for ids in self.ids(texts)]

    def runs(self, letters: list[str]) -> list[bytes]:
        """The ids of many runs of letters by one call: one ends where a token does that ends a word."""
        if not letters:
            return []
        ids = np.array(self.lowered.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(letters):
            raise ValueError("tokens don't tell where a word ends")
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def remembered(self, parts: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        out = list(map(self.young.get, parts))
        missing = [k for k, ids in enumerate(out) if ids is None]
        again = [self.old.get(parts[k]) for k in missing]
        new = [k for k, ids in zip(missing, again, strict=True) if ids is None]
        for k, ids in zip(missing, again, strict=True):
            out[k] = ids
        for k, ids in zip(new, make([parts[k] for k in new]), strict=True):
            out[k] = ids
        for k in missing:
            self.young[parts[k]] = out[k]
            self.bytes += 160 + 2 * len(parts[k]) + len(out[k])
        return out

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one after another, and where each begins (with the end of the last)."""
        split = pc.extract_regex(words, PLAIN)
        around, plain = [split.field(k) for k in (0, 2)], np.asarray(split.is_valid())
        letters = pc.utf8_lower(split.field(1)).filter(pa.array(plain)).dictionary_encode()
        rest = pa.concat_arrays([words.filter(pa.array(~plain)), *(a.filter(pa.array(plain)) for a in around)]).dictionary_encode()
        held = [*self.remembered(letters.dictionary.to_pylist(), self.runs), *self.remembered(rest.dictionary.to_pylist(), self.others)]
        values = np.frombuffer(b"".join(held), self.kind)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) // self.width)])
        # Each word is what is before its letters, the letters, and what is after; another word is one part between two without ids.
        bounds = np.append(bounds, bounds[-1])
        parts = np.full((len(words), 3), len(held), np.int64)
        at, many = np.asarray(rest.indices, np.int64) + len(letters.dictionary), int(plain.sum())
        parts[~plain, 1] = at[: len(words) - many]
        parts[plain, 0], parts[plain, 2] = at[len(words) - many :].reshape(2, many)
        parts[plain, 1] = np.asarray(letters.indices, np.int64)
        ids, begins = gather(values, bounds, parts.ravel())
        return ids, begins[::3]

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        spelled = split.flatten().dictionary_encode()
        values, bounds = self.of_words(spelled.dictionary)
        ids, begins = gather(values, bounds, np.asarray(spelled.indices, np.int64))
        ends = begins[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]
        if self.bytes > self.most:
            self.old, self.young, self.bytes = self.young, {}, 0
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def pieces(whole: str) -> Iterator[str]:
    """A text in pieces of about AT_ONCE characters, cut at blanks; at least one."""
    first = 0
    while True:
        blank = BLANK.search(whole, first + AT_ONCE)
        last = blank.start() if blank else len(whole)
        yield whole[first:last]
        if last == len(whole):
            return
        first = last


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


# --- shards


def shard_path(path: str, shard: int) -> str:
    return f"{path}/shards/{shard:016d}.ids"


class Shard:
    """A shard that is being written."""

    def __init__(self, path: str, number: int, width: int):
        self.number, self.width, self.documents, self.bytes, self.begun = number, width, 0, 0, 0
        self.system, self.at = store(shard_path(path, number))
        self.own = f"{self.at}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.own)
        self.out.write(MAGIC + struct.pack("<H", width))

    def write(self, ids: bytes) -> None:
        self.out.write(ids)
        self.bytes += len(ids)

    def finish(self) -> tuple[int, int, int, int]:
        """shard, place, at and n of the document that ends here."""
        first, self.begun = self.begun, self.bytes
        self.documents += 1
        return self.number, self.documents - 1, first // self.width, (self.bytes - first) // self.width

    def close(self) -> None:
        self.out.close()
        settle(self.system, self.own, self.at)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, bool]]]:
    """Pieces of documents, in order, of about AT_ONCE characters together: doc_id, piece and whether it is the document's last."""
    held, size = [], 0
    for batch in batches:
        for doc_id, whole in zip(batch.column(0), batch.column(1), strict=True):
            parts = list(pieces(whole.as_py()))
            for k, piece in enumerate(parts, 1):
                held.append((doc_id.as_py(), piece, k == len(parts)))
                size += len(piece)
                if size >= AT_ONCE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


PLACES = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("place", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


def written(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the shards when it runs: doc_id, shard, its place in the shard, and of its ids the offset ``at`` and number ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(tokenizer)
        end, shard = own.packed([end_id]), None
        numbers = count(TaskContext.get().partitionId() << 20)
        for held in together(batches):
            rows = []
            for (doc_id, _, last), ids in zip(held, own.encode(pa.array([piece for _, piece, _ in held], pa.string())), strict=True):
                shard = shard or Shard(path, next(numbers), own.width)
                shard.write(ids.tobytes())
                if last:
                    shard.write(end)
                    rows.append((doc_id, *shard.finish()))
                    if shard.bytes >= SHARD:
                        shard.close()
                        shard = None
            columns = zip(*rows, strict=True) if rows else [()] * len(PLACES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PLACES.types, strict=True)], schema=PLACES)
        if shard:
            shard.close()

    rows = with_row(docs.select("doc_id", text().alias("text")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "text").mapInArrow(run, "doc_id long, shard long, place long, at long, n long")


def begun(places: DataFrame) -> DataFrame:
    """Of each shard the ids and documents in the shards before it: sums within blocks of shards, and over the blocks."""
    block = F.shiftright("shard", 30)
    shards = cut(places.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("docs")).withColumn("block", block))
    before = lambda w, c: F.coalesce(F.sum(c).over(w), F.lit(0))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shards.groupBy("block").agg(F.sum("ids").alias("ids"), F.sum("docs").alias("docs"))
    blocks = blocks.select("block", before(over, "ids").alias("ids0"), before(over, "docs").alias("docs0"))
    within = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.withColumns({"ids": before(within, "ids"), "docs": before(within, "docs")})
    return sums.join(blocks, "block").select("shard", (F.col("ids") + F.col("ids0")).alias("ids_before"), (F.col("docs") + F.col("docs0")).alias("docs_before"))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, ordinal)`` with the number of ``copy`` among the rows of its id, which follow one another."""
    groups = cut(rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("ordinal").alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    # Fewer than HEAVY ids are heavy; their rows stay where they are.
    same, most = F.col("doc_id").eqNullSafe(F.col("_id")), heavy_above(rows.count())
    large = F.broadcast(groups.where(F.col("_n") > most))
    rest = rows.join(large, same, "left_anti").join(groups.where(F.col("_n") <= most), same, "left")
    every = rows.join(large, same).unionByName(rest)
    return every.withColumn("copy", F.coalesce(F.col("ordinal") - F.col("_first"), F.lit(0))).drop("_id", "_first", "_n")


# --- minimal perfect hashes


def mixed(ids: np.ndarray, tags: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each key under a seed: rounds of multiplying and folding, so that seeds draw apart."""
    x = ids ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)
    for more in (tags, np.array([seed], np.uint64)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) + more * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


FINGERPRINT = 1 << 20  # a seed that no level has


class Perfect:
    """A minimal perfect hash of distinct keys.

    A level is an array of bits, twice as many as it has keys. A key that alone falls to a bit sets it and is placed; the
    others go on to the next level. A key's slot is the number of bits set before its own. A lookup tries the levels in turn,
    1.6 of them on average whatever the number of keys.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def of(cls, ids: np.ndarray, tags: np.ndarray) -> Perfect:
        sizes, levels = [], []
        while len(ids):
            size = -(-2 * len(ids) // 64) * 64
            at = (mixed(ids, tags, len(sizes)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            ids, tags = ids[hits[at] > 1], tags[hits[at] > 1]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def slots(self, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The slot of each key; of one that isn't in the set any slot, or -1."""
        out, left, base = np.full(len(ids), -1), np.arange(len(ids)), 0
        for level, size in enumerate(self.sizes):
            at = (mixed(ids[left], tags[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            there = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[there]] = (self.ranks[word] + np.bitwise_count(below))[there]
            left, base = left[~there], base + size // 64
        return out


def keys(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and copy as two words of 64 bits; a null id is 0 with the first bit of the other set."""
    ids, copies = (batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c) for c in ("doc_id", "copy"))
    null = np.asarray(ids.is_null()).astype(np.uint64) << np.uint64(63)
    return ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64), copies.to_numpy().astype(np.int64).view(np.uint64) | null


#: What a slot holds beside the fingerprint.
HELD = ("shard", "at", "n", "start")


def index_path(path: str, part: int) -> str:
    return f"{path}/index/{part:08d}.mph"


def built(table: pa.Table) -> bytes:
    ids, tags = keys(table)
    perfect = Perfect.of(ids, tags)
    order = np.argsort(perfect.slots(ids, tags))
    held = [mixed(ids, tags, FINGERPRINT)[order], *(table.column(c).to_numpy()[order].astype("<i8") for c in HELD)]
    head = struct.pack("<QQ", len(ids), len(perfect.sizes)) + np.array(perfect.sizes, "<u8").tobytes()
    return b"".join([head, perfect.bits.astype("<u8").tobytes(), *(h.tobytes() for h in held)])


class Index:
    """A part of the index as it is in its file."""

    def __init__(self, content: bytes):
        n, levels = struct.unpack_from("<QQ", content)
        sizes = np.frombuffer(content, "<u8", levels, 16).tolist()
        at = 16 + 8 * levels
        self.perfect = Perfect(sizes, np.frombuffer(content, "<u8", sum(sizes) // 64, at))
        at += sum(sizes) // 8
        self.prints = np.frombuffer(content, "<u8", n, at)
        self.held = [np.frombuffer(content, "<i8", n, at + 8 * n * k) for k in range(1, len(HELD) + 1)]

    def find(self, ids: np.ndarray, tags: np.ndarray) -> list[pa.Array]:
        """shard, at, n and start of each key, null where there is no such key."""
        slots = self.perfect.slots(ids, tags)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == mixed(ids, tags, FINGERPRINT)[known]
        return [pa.array(np.where(known, h[np.where(known, slots, 0)] if len(h) else 0, 0), mask=~known) for h in self.held]


# --- the folder


def part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of ``docs(doc_id, text)``, each with ``end_id`` after it, as a new folder at ``path``, which all executors share.

    ``docs`` must come straight from files or a checkpoint. Ids are in ascending order, null last; rows with the same id
    follow one another in the order of the file splits, and each is a document. Null and empty texts have the end id
    alone. A text of any length is encoded whole, some words at a time. An empty table gives a folder without shards. Other
    columns are of no account.
    """
    spark = docs.sparkSession
    for folder in ("shards", "index"):
        system, at = store(f"{path}/{folder}")
        system.create_dir(at, recursive=True)
    written(docs, path, tokenizer, end_id).write.parquet(f"{path}/documents")
    places = spark.read.parquet(f"{path}/documents")
    located = places.join(begun(places), "shard")
    keyed = with_copies(located.select("doc_id", (F.col("docs_before") + F.col("place")).alias("ordinal"), "shard", "at", "n", (F.col("ids_before") + F.col("at")).alias("start")))
    total = places.count()
    parts = max(1, -(-total // KEYS))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        content = built(table)
        put(index_path(path, key[0].as_py()), content)
        return pa.table({"part": [key[0].as_py()], "keys": [table.num_rows], "bytes": [len(content)]})

    made = keyed.select("doc_id", "copy", *HELD, part(parts).alias("part")).groupBy("part").applyInArrow(build, "part long, keys long, bytes long")
    keys_made = made.agg(F.sum("keys")).first()[0] or 0
    if keys_made != total:
        raise RuntimeError(f"the index has {keys_made} keys for {total} documents")
    put(f"{path}/manifest.json", json.dumps({"documents": total, "parts": parts, "end_id": end_id, "width": words(tokenizer).width}).encode())


def looked_up(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """``asked(doc_id, copy)`` with shard, at, n and start of the document, null if there is none. One exchange, of the keys."""
    manifest = json.loads(get(f"{path}/manifest.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for first, last in runs(batch.column(2).to_numpy()):
                own = batch.slice(first, last - first)
                if held != (held := own.column(2)[0].as_py()):
                    index = Index(get(index_path(path, held))) if manifest["documents"] and exists(index_path(path, held)) else Index(struct.pack("<QQ", 0, 0))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *index.find(*keys(own))], names=["doc_id", "copy", *HELD])

    dealt = asked.select("doc_id", F.col("copy").cast("long").alias("copy")).withColumn("part", part(manifest["parts"]))
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(run, "doc_id long, copy long, shard long, at long, n long, start long")


def exists(path: str) -> bool:
    system, at = store(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    ends = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(values)], strict=True)) if len(values) else []


def fetched(spark: SparkSession, path: str, asked: DataFrame, packed: bool = False) -> DataFrame:
    """``asked(doc_id, copy)`` with start, n and ``ids`` from the files; all null for a key that isn't there.

    ``ids`` is an array, or with ``packed`` the ids as unsigned 32-bit integers, little end first. A key may be asked for
    more than once. The keys' exchanges are small; a task opens the shards of its keys and reads what lies together at once.
    """
    width = json.loads(get(f"{path}/manifest.json"))["width"]
    kind = pa.binary() if packed else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in runs(batch.column(2).to_numpy()):
                own = batch.slice(first, last - first)
                at, n = own.column(3).to_numpy(), own.column(4).to_numpy()
                system, place = store(shard_path(path, own.column(2)[0].as_py()))
                with system.open_input_file(place) as shard:
                    if shard.read(8) != MAGIC + struct.pack("<H", width):
                        raise ValueError(f"{place} is no shard of ids of {width} bytes")
                    for a, b in near(at, n, READ):
                        shard.seek(8 + width * int(at[a]))
                        ids = np.frombuffer(shard.read(width * int((at + n)[a:b].max() - at[a])), f"<u{width}").astype("<u4")
                        found = [ids[i : i + k] for i, k in zip(at[a:b] - at[a], n[a:b], strict=True)]
                        column = pa.array([f.tobytes() if packed else f for f in found], kind)
                        some = own.slice(a, b - a)
                        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(5), some.column(4), column], names=["doc_id", "copy", "start", "n", "ids"])

    located = cut(looked_up(spark, path, asked))
    dealt = located.where("shard IS NOT NULL").repartition("shard").sortWithinPartitions("shard", "at")
    found = dealt.mapInArrow(run, f"doc_id long, copy long, start long, n long, ids {'binary' if packed else 'array<long>'}")
    none = located.where("shard IS NULL").select("doc_id", "copy", "start", "n", F.lit(None).cast("binary" if packed else "array<long>").alias("ids"))
    return found.unionByName(none)


def near(at: np.ndarray, n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows in the order of their places that are read at once: about ``most`` ids together, without gaps beyond that."""
    first = 0
    while first < len(at):
        last = first + 1
        while last < len(at) and at[last] + n[last] - at[first] <= most:
            last += 1
        yield first, last
        first = last


def digests(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` at ``path`` and reads every document back by its key: doc_id, start, n_tokens and ids_crc32 of each row.

    Rows with one id are its copies, each found by its number. Odd rows: see ``write``.
    """
    write(docs, path, tokenizer, end_id)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))
    asked = docs.groupBy("doc_id").count().select("doc_id", copies.alias("copy"))
    found = fetched(docs.sparkSession, path, asked, packed=True)
    return found.select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
