"""Toxicity by compression distance.

zstandard dictionaries are trained on windows of labelled text, toxic ones and ordinary ones of the same size. A window
is compressed with each; how many bytes fewer it takes with the toxic dictionary is its margin. Two pairs of
dictionaries of different make are averaged. A text is described by its largest margins and by how many windows reach
each of a few thresholds, and a logistic curve over these gives its score. It is calibrated on labelled texts of whose
windows the dictionaries that describe them have seen none.

Most windows of a toxic text are ordinary. So dictionaries are trained in rounds: those of a round, trained on all folds
of the sample but one, give margins to the windows of that fold, and the toxic dictionary of the next round learns only
from windows of toxic texts whose margins, over the rounds so far, exceed those of nearly all ordinary windows, as they
are or by length. No grams are counted and no words listed: windows are chosen by compressed lengths alone.

A window is a word, or at most ``WINDOW`` characters of a longer one: wider windows were measured and let neighbours
drown a telling word. zstandard stores blocks that hardly shrink as they are, so a window is compressed between two
copies of a lead that all dictionaries hold, which lets the length of even a short window show.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, frame, fresh, portions, text, with_row

#: Bound of the sample of labelled texts of each class, which are read whole. Scoring has no bound.
SAMPLE = {1: 2000, 0: 4000}
SAMPLE_PARTS = 24
#: Labels of rows with remainder 0 of so many are never learnt from. The sample's own folds.
HELD_OUT, FOLDS = 5, 4
WINDOW = 64
LEAD = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of the dictionaries of each round, and bytes and segment length of the pairs that stay.
ROUNDS = (32768, 16384, 8192, 8192)
PAIRS = ((16384, 16), (8192, 32))
SEGMENT = 16
#: Windows that a dictionary is trained on at most, by a hash from all of the sample.
TRAINING_WINDOWS = 60_000
#: A window of a toxic text is learnt from if its margin, or its margin by its length and the blanks around it, exceeds
#: that of this share of ordinary windows.
RARE = 0.998
#: What the margins of earlier rounds still weigh in the next one.
MEMORY = 0.5
COUNTED, RATED, LARGEST = (1, 2, 3, 4, 5, 6), (2, 3, 4, 5), 3
#: Windows of the texts that a task describes at once, unless one text alone has more.
AT_ONCE = 1 << 19


class Model(NamedTuple):
    """Pairs of an ordinary and a toxic dictionary, and the weights of the features."""

    pairs: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; no id counts as an empty text. Labels of fold 0 are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT


def windows(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(rf"[^\x20\x09-\x0D]{{1,{WINDOW}}}"), F.lit(0))


def framed(word: str) -> bytes:
    """A window as it is trained on and compressed: where words begin and end tells much."""
    return b" " + word.encode() + b" "


def dictionary(samples: list[bytes], size: int, segment: int = SEGMENT) -> bytes:
    """Trained on ``samples``; where they are too few to train on, as many of them as have room."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Margins:
    """How many bytes a window takes more with the ordinary dictionary than with the toxic one, by all pairs."""

    def __init__(self, pairs: tuple[tuple[bytes, bytes], ...]):
        shape = {"window_log": 17, "chain_log": 14, "hash_log": 15, "search_log": 4, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY2}
        params = zstandard.ZstdCompressionParameters(**shape, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            held = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress

        self.compressors = [(compressor(plain), compressor(bad)) for plain, bad in pairs]

    def of(self, words: list[str]) -> np.ndarray:
        """The mean of all pairs where the first finds a window telling, else what the first says."""
        margins, rest = np.zeros(len(words)), np.arange(len(words))
        told = [LEAD + framed(w) + LEAD for w in words]
        for n, (plain, bad) in enumerate(self.compressors, 1):
            margins[rest] += [a - b for a, b in zip(map(len, map(plain, told)), map(len, map(bad, told)), strict=True)]
            some = np.flatnonzero(margins[rest] > 0)
            if n < len(self.compressors):
                rest, told = rest[some], [told[i] for i in some.tolist()]
        margins[rest] /= len(self.compressors)
        return margins


@lru_cache(maxsize=1)
def margins(pairs: tuple[tuple[bytes, bytes], ...]) -> Margins:
    return Margins(pairs)


def described(model: Margins, words: pa.ListArray) -> np.ndarray:
    """A row of features for each text: 1, its length, the largest margins, and how many windows reach a threshold, in all and of a thousand."""
    spelled = words.flatten().dictionary_encode()
    found = model.of(spelled.dictionary.to_pylist())[np.asarray(spelled.indices, np.int64)]
    sizes = words.value_lengths().to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((len(words), 2 + LARGEST + len(COUNTED) + len(RATED)))
    out[:, 0], out[:, 1] = 1, np.log(sizes + 10)
    for i in np.flatnonzero(sizes).tolist():
        own = found[ends[i] : ends[i + 1]]
        top = np.sort(np.partition(own, -LARGEST)[-LARGEST:] if len(own) > LARGEST else own)[::-1]
        out[i, 2 : 2 + len(top)] = np.clip(top, 0, 12)
    reach = {}
    for least in set(COUNTED) | set(RATED):
        sums = np.concatenate([[0], np.cumsum(found >= least)])
        reach[least] = sums[ends[1:]] - sums[ends[:-1]]
    for k, least in enumerate(COUNTED, 2 + LARGEST):
        out[:, k] = np.log1p(reach[least])
    for k, least in enumerate(RATED, 2 + LARGEST + len(COUNTED)):
        out[:, k] = np.log1p(1000 * reach[least] / np.maximum(sizes, 10))
    return out


def calibrated(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of the logistic curve with the greatest penalised likelihood, by Newton steps."""
    w = np.zeros(features.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (labels - p) - penalty @ w
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + penalty, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(x) for x in w)


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """At most SAMPLE labelled texts outside fold 0: toxic, part (their own fold) and all windows; and how many texts there are of each label.

    Chosen by a hash of the id, so reruns agree. A document with several labels counts as toxic if one says so, and one
    that is there several times by its smallest text.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("draw", F.xxhash64("doc_id"))
    chosen = None
    for label, bound in SAMPLE.items():
        part = known.where(F.col("toxic") == label).orderBy("draw", "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", text().alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "draw", "toxic").agg(F.min("text").alias("text"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = F.pmod(F.col("draw"), F.lit(FOLDS)).cast("int").alias("part")
    return cut(rows.repartition(SAMPLE_PARTS, "draw").select("toxic", part, windows(F.col("text")).alias("words"))), totals


Windows = dict[int, list[bytes]]


def _without(of: Windows, left: int | None) -> list[bytes]:
    return [w for k in range(FOLDS) if k != left for w in of[k]]


def _by_fold(rows: DataFrame, count: str) -> Windows:
    """Windows of each fold, each as often as texts hold it; at most TRAINING_WINDOWS of all, by a hash."""
    each = rows.where(F.col(count) > 0).select("part", "word", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("i"))
    out: Windows = {k: [] for k in range(FOLDS)}
    for r in each.orderBy(F.xxhash64("part", "word", "i"), "part", "word", "i").limit(TRAINING_WINDOWS).collect():
        out[r["part"]].append(framed(r["word"]))
    return out


def telling(rows: DataFrame) -> tuple[Windows, Windows]:
    """For each fold of the sample the windows that toxic dictionaries learn from after all rounds, and ordinary windows."""
    each = rows.select("part", "toxic", F.explode(F.array_distinct("words")).alias("word"))
    holds = lambda k: F.count_if(F.col("toxic") == k)
    now = cut(each.groupBy("part", "word").agg(holds(1).alias("bad"), holds(0).alias("plain"), F.lit(0.0).alias("margin")).repartition(SAMPLE_PARTS))
    ordinary, toxic = _by_fold(now, "plain"), _by_fold(now, "bad")
    plain = {size: [dictionary(_without(ordinary, k), size) for k in range(FOLDS)] for size in set(ROUNDS)}
    for n, size in enumerate(ROUNDS):
        pairs = [((plain[size][k], dictionary(_without(toxic, k), size)),) for k in range(FOLDS)]
        held = MEMORY if n else 0.0

        def run(batches: Iterator[pa.RecordBatch], pairs=pairs, held=held) -> Iterator[pa.RecordBatch]:
            models = [Margins(p) for p in pairs]
            for batch in batches:
                found = held * batch.column(4).to_numpy()
                part = batch.column(0).to_numpy()
                for k in set(part.tolist()):
                    own = np.flatnonzero(part == k)
                    found[own] += models[k].of(batch.column(1).take(pa.array(own)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found)], names=batch.schema.names)

        now = cut(now.mapInArrow(run, "part int, word string, bad long, plain long, margin double"))
        share = F.col("margin") / (F.octet_length("word") + 2)
        edges = (F.percentile(of, F.lit(RARE), F.col("plain")).alias(name) for of, name in ((F.col("margin"), "edge"), (share, "share")))
        edges = F.broadcast(now.where("plain > 0").groupBy("part").agg(*edges))
        chosen = _by_fold(now.join(edges, "part").where((F.col("margin") > F.col("edge")) | (share > F.col("share"))), "bad")
        toxic = {k: chosen[k] or toxic[k] for k in range(FOLDS)}
    return toxic, ordinary


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of ``labels(doc_id, toxic)``; without labels of both classes, one that finds nothing toxic."""
    rows, totals = sampled(docs, labels)
    texts: Counter[int] = Counter({r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()})
    if not texts[0] or not texts[1]:
        return Model(((b" ", b" "),), (-4.0, *[0.0] * (1 + LARGEST + len(COUNTED) + len(RATED))))
    toxic, ordinary = telling(rows)
    pairs = lambda left: tuple(tuple(dictionary(_without(of, left), *shape) for of in (ordinary, toxic)) for shape in PAIRS)
    apart = [pairs(k) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Margins(p) for p in apart]
        for batch in batches:
            for part in portions(batch, 2, AT_ONCE):
                of = part.column(1).to_numpy()
                features = np.zeros((part.num_rows, 2 + LARGEST + len(COUNTED) + len(RATED)))
                for k in set(of.tolist()):
                    own = np.flatnonzero(of == k)
                    features[own] = described(models[k], part.column(2).take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(features.tolist(), pa.list_(pa.float64()))], names=["toxic", "features"])

    told = rows.select("toxic", "part", "words").mapInArrow(run, "toxic int, features array<double>").collect()
    weights = calibrated(np.array([r["features"] for r in told]), np.array([r["toxic"] for r in told], float))
    # The sample may hold more toxic texts than there are; the odds of all labelled ones count.
    prior = np.log(totals[1] / totals[0]) - np.log(texts[1] / texts[0])
    return Model(pairs(None), (weights[0] + float(prior), *weights[1:]))


SCORES = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """_row, doc_id and score of every row: 0 to 1, higher is likelier toxic. Nothing but the text counts.

    Null texts are empty, and empty ones have a score like any other. One row per row of ``docs``, repeated or without id
    alike; other columns don't matter; texts of any length are read whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = margins(model.pairs)
        for batch in batches:
            for part in portions(batch, 2, AT_ONCE):
                linear = described(own, part.column(2)) @ np.array(model.weights)
                yield frame(SCORES, [part.column(0), part.column(1), 1 / (1 + np.exp(-np.clip(linear, -30, 30)))])

    return with_row(docs).select("_row", "doc_id", windows(text()).alias("words")).mapInArrow(run, "_row long, doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is 0.5 or more) of every row of ``docs``; of an empty table none."""
    found = scored(docs, model or trained(docs, labels))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't found toxic, with their columns as they are. ``docs`` must come straight from files or a checkpoint."""
    row = fresh(docs, "_row")
    stay = scored(docs, trained(docs, labels)).where("score < 0.5").select(F.col("_row").alias(row))
    return with_row(docs, row).join(stay, row, "left_semi").drop(row)
