"""Token counts of a piece vocabulary with a shortcut for pre-tokens that are one token.

In the vocabulary the mark for a blank stands only at the front of a piece, so no merge reaches over a blank that
follows something else, and a text falls apart into pre-tokens of blanks with what follows them. That is proved when
the vocabulary is loaded, together with the list of pre-tokens that come back as one token. Counting a text then is a
dictionary lookup a pre-token; only pre-tokens that aren't in it are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, frame, portions, text

MARK = "▁"
#: Pre-tokens of the texts that are worked on at once, unless one text alone has more.
AT_ONCE = 1 << 18


class Counter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.pieces = [self.model.id_to_piece(i) for i in ids]
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)) for i in ids]
        crossing = [p for p, ok in zip(self.pieces, plain, strict=True) if ok and re.search(f"[^{MARK}]{MARK}", p)]
        if crossing or self.model.encode("a  b") != self.model.encode("a") + self.model.encode(" b"):
            raise ValueError(f"pieces of {path} reach over blanks: {crossing[:3]}")
        self.whole = self.prove([p for p, ok in zip(self.pieces, plain, strict=True) if ok and p[0] == MARK])
        self.known: Memo[int] = Memo()

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """Of the pieces with one blank in front, those that the merges give back as one token."""
        words = [p[1:] for p in pieces if MARK not in p[1:] and len(p) > 1]
        whole = {f" {w}": 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        return whole | {" ": 1}

    def merged(self, pre_tokens: list[str]) -> Iterator[int]:
        """The model puts one blank in front itself."""
        return map(len, self.model.encode([p[1:] for p in pre_tokens], num_threads=1))

    def count(self, words: pa.ListArray) -> np.ndarray:
        """Tokens of each row of pre-tokens."""
        spelled = words.flatten().dictionary_encode()
        distinct = spelled.dictionary.to_pylist()
        whole, known = self.whole, self.known
        counts = np.array([1 if p in whole else known.held.get(p, 0) for p in distinct], np.int64)
        rest = np.flatnonzero(counts == 0)
        for i, n in zip(rest.tolist(), self.merged([distinct[i] for i in rest.tolist()]), strict=True):
            counts[i] = n
            known.put(distinct[i], n)
        sums = np.concatenate([[0], np.cumsum(counts[np.asarray(spelled.indices, np.int64)])])
        return np.diff(sums[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they exceed ``limit``; a null or empty text has no tokens.

    One row per row of ``docs`` whatever its doc_id and other columns; an empty table gives none; no shuffle. A text of any
    length is counted whole; its pre-tokens pass through a worker at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in portions(batch, 2, AT_ONCE):
                counts = own.count(part.column(2))
                yield frame(COUNTS, [part.column(0), part.column(1), counts, counts > limit])

    marked = F.when(text() != "", F.concat(F.lit(" "), F.replace(text(), F.lit(MARK), F.lit(" ")))).otherwise("")
    words = F.regexp_extract_all(marked, F.lit(" +[^ ]*"), F.lit(0))
    columns = docs.select("doc_id", F.octet_length(text()).cast("long").alias("n_bytes"), words.alias("words"))
    return columns.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
