"""Vector codes, texts cut for filling in, and id files against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanecraft.llm import codebooks, fill_middle, id_files

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (3, "one two  three"), (1, ""), (2, None), (None, "no id \n"), (None, "no id \n"), (3, "same id"), (3, "one two  three"), (5, " "), (6, "has <M> in it"), (7, "Don't I'LL 12 x\x0b\x0cy "),
    (8, "日本語 テキスト 😀😀 é Å"), (9, "<|endoftext|>a <|startoftext|>"), (10, "word " * 60_000), (11, "x" * 50_000), (-4, "a\x1cb a\xa0b a b"), (12, "<<S <P>"), (13, "a<" * 30 + " <" * 30),
]


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "odd")
    rows = [(i, t, k, "x", k) for k, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, _row int, _doc string, n int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- vector codes


def brute_codes(rows, parts=4, size=256, rounds=4):
    kept = sorted(((i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * c) for c in v] for _, v, _ in kept], object)
    side = x.shape[1] // parts
    cubes = [x[:, p * side : (p + 1) * side] for p in range(parts)]
    books = [c[:size].copy() for c in cubes]

    def assigned(q, book):
        far = ((q[:, None] - book[None]) ** 2).sum(-1)
        best = [min(range(len(book)), key=lambda e: (row[e], e)) for row in far]
        return best, [row[e] for row, e in zip(far, best, strict=True)]

    for _ in range(rounds):
        for q, book in zip(cubes, books, strict=True):
            best, _ = assigned(q, book)
            for e in set(best):
                own = q[[b == e for b in best]]
                book[e] = [s // len(own) for s in own.sum(0)]
    found = [assigned(q, b) for q, b in zip(cubes, books, strict=True)]
    errors = [sum(f[1][k] for f in found) for k in range(len(kept))]
    labels = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] += e
    digest = sha(",".join(str(c) for b in books for row in b.tolist() for c in row))
    return Counter((i, "".join(f"{f[0][k]:02x}" for f in found), errors[k], labels[lab], digest) for k, (i, _, lab) in enumerate(kept))


def test_codes_equal_brute_force_with_ties_and_odd_rows(spark):
    draw = random.Random(5)
    grid = lambda: [draw.choice([-0.25, 0.0, 0.125, 0.3]) for _ in range(8)]
    rows = [(i, grid(), draw.choice([None, 1, 2])) for i in range(700)]
    rows += [(None, grid(), None), (5, grid(), 1), (5, rows[5][1], 1), (900, None, 1), (901, [0.1] * 7 + [None], 2), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, None)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("error", F.lit("x"))
    wide = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    assert Counter(map(tuple, codebooks.compressed(df).collect())) == brute_codes(wide)


def test_codes_of_few_none_and_bad_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    few = [(i, [i / 7] * 4, 0) for i in range(3)]
    assert Counter(map(tuple, codebooks.compressed(make(few)).collect())) == brute_codes(few)
    assert codebooks.compressed(make([(1, None, 1)])).collect() == [] == codebooks.compressed(make([])).collect()
    assert codebooks.compressed(make([(1, [], 1)])).select("code", "error").collect() == [("00000000", 0)]
    for bad in ([(1, [1.0] * 6, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception, match="components"):
            codebooks.compressed(make(bad)).collect()


@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
def test_nearest_finds_the_lowest_of_equally_near_entries(spread):
    draw = np.random.default_rng(spread)
    entries, points = draw.integers(-spread, spread, (256, 5)), draw.integers(-spread, spread, (3000, 5))
    index, far = codebooks.nearest(codebooks.tree(entries), points)
    every = ((points[:, None] - entries[None]) ** 2).sum(-1)
    assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_codes_decode_to_their_entries(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = codebooks.train(vectors, rounds=1)
    rows = codebooks.decode(codebooks.encode(vectors, books, ["vec_id", "embedding", "label"]), books).collect()
    for r in rows[:50]:
        entries = [books.entries[p][c] for p, c in enumerate(r["code"])]
        assert r["decoded"] == pytest.approx(np.concatenate(entries) / 1024)
        assert ((np.floor(np.array(r["embedding"]) * 1024) - np.concatenate(entries)) ** 2).sum() == r["error"]


# --- filling in


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_cut(i, t):
    t = t or ""
    units, digits = UNITS.findall(t), sha(f"42:{'' if i is None else i}")
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(h[k] % (len(units) + 1) for k in (0, 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("which", ["docs", "real"])
def test_cuts(which, request):
    df = request.getfixturevalue(which)
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = Counter((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in ((brute_cut(i, t), (i, t)) for i, t in texts))
    found = fill_middle.digests(df).collect()
    assert Counter(map(tuple, found)) == want
    assert {r["form"] for r in found} == {"plain", "spm", "psm"} or which == "docs"


def test_cut_texts_keep_their_columns_and_come_back(docs):
    out = fill_middle.transformed(docs, share=100, spm_share=50)
    assert out.columns == [*docs.columns, "fim"]
    rows = out.withColumn("back", fill_middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == len(TEXTS) and all(r["back"] == (r["text"] or "") for r in rows)
    assert all(r["fim"]["form"] == "plain" for r in rows if not r["text"] or "<M>" in r["text"] or "<P>" in r["text"])
    assert {r["fim"]["form"] for r in rows} == {"plain", "spm", "psm"}


def test_units_are_not_shuffled(real, spark):
    """Units are made after their exchange: the plan deals rows by _row only below posexplode and beside it."""
    plan = fill_middle.digests(real)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.index("posexplode") < plan.index("RepartitionByExpression")


def test_cuts_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    assert fill_middle.digests(none).collect() == []
    assert id_files.digests(none, str(tmp_path / "files"), WORDS).collect() == []


# --- id files


def brute_ids(texts):
    """Rows with their ids in the order of the files but for copies, whose order is the table's."""
    model = Tokenizer.from_file(WORDS)
    return {k: [*model.encode(t or "", add_special_tokens=False).ids, 2] for k, (_, t) in enumerate(texts)}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("which", ["docs", "real"])
def test_files(which, small, request, tmp_path, monkeypatch):
    if small:  # many shards and parts
        monkeypatch.setattr(id_files, "SHARD", 1 << 12)
        monkeypatch.setattr(id_files, "KEYS", 7)
    df = request.getfixturevalue(which)
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    ids = brute_ids(texts)
    found = id_files.digests(df, str(tmp_path / "files"), WORDS).collect()
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0))
    crc = lambda k: zlib.crc32(np.array(ids[k], "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((texts[k][0], len(ids[k]), crc(k)) for k in order)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    by_start = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert by_start == [texts[k][0] for k in order]


def test_keyed_access_and_keys_that_are_not_there(spark, docs, tmp_path):
    path = str(tmp_path / "files")
    id_files.write(docs, path, WORDS)
    asked = spark.createDataFrame([(8, 0), (8, 1), (99, 0), (None, 1), (3, 2), (8, 0)], "doc_id long, copy long")
    found = id_files.fetched(spark, path, asked).collect()
    model = Tokenizer.from_file(WORDS)
    want = [*model.encode(TEXTS[10][1], add_special_tokens=False).ids, 2]
    assert [r["ids"] for r in found if r["doc_id"] == 8 and r["copy"] == 0] == [want, want]
    assert {(r["doc_id"], r["copy"]) for r in found if r["ids"] is None} == {(8, 1), (99, 0)}
    assert sum(r["ids"] is not None for r in found) == 4 and all(r["ids"][-1] == 2 for r in found if r["ids"])


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_hashes_are_perfect_and_minimal(n):
    draw = np.random.default_rng(n)
    ids = draw.choice(1 << 40, n, replace=False).astype(np.uint64)
    tags = np.zeros(n, np.uint64)
    perfect = id_files.Perfect.of(ids, tags)
    assert sorted(perfect.slots(ids, tags).tolist()) == list(range(n))
    table = pa.table({"doc_id": ids.astype(np.int64), "copy": tags.astype(np.int64), **{c: np.arange(n) + k for k, c in enumerate(id_files.HELD)}})
    index = id_files.Index(id_files.built(table))
    assert [c.to_pylist() for c in index.find(ids, tags)] == [table.column(c).to_pylist() for c in id_files.HELD]
    assert index.find(ids + np.uint64(1 << 41), tags)[0].null_count == n
