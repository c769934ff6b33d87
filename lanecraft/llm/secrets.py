"""Secret scans with multipart credential linking.

Three base patterns find what is a secret by its form. Other strings are secrets only in company: an identifier in
capitals, a token of mixed characters. Such weak candidates, the base finds and endpoints (addresses and hosts) are the
parts; an interval join within scopes links a weak candidate to a complementary part, and only linked ones are reported.
A scope is a stretch of text without an empty line, and parts of it link across at most ``REACH`` code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, strings, with_row

KINDS = ("assign", "access", "hex", "linked")
REACH = 200
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Parts that say nothing alone.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])")
NAMED = re.compile(r"""(?ai:access_?key(?:_?id)?|client_?id|account|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:(?<![a-z])[a-z]+://[^\s"'<>]+)|(?ai:\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:/_-]{4,}))""")
GAP = re.compile(r"\n[ \t\r]*\n")
ROLES = ("identifier", "secret", "endpoint")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind and end of the base patterns' matches, by start and kind; leftmost and non-overlapping for each kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    # Runs are maximal, so asking for the length in the pattern drops the same matches as counting afterwards.
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def parts(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """role, weak, scope, start and end of all parts; none if the text holds no weak candidate."""
    begins, ends = [], []  # of the stretches that base spans cover; those of different kinds may overlap
    for start, _, end in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(start)
            ends.append(end)

    def free(m: re.Match) -> bool:
        at = bisect_left(begins, m.end())
        return not at or ends[at - 1] <= m.start()

    weak = [(0, m.start(), m.end()) for m in IDENTIFIER.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and free(m)]
    weak += [(1, m.start(), m.end()) for m in TOKEN.finditer(text) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")) and free(m)]
    if not weak:
        return []
    strong = [(0 if kind == 1 else 1, s, e) for s, kind, e in base]
    strong += [(0, m.start(1), m.end(1)) for m in NAMED.finditer(text)] + [(2, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    gaps = [m.start() for m in GAP.finditer(text)]
    out, scope = [], 0
    for start, end, role, is_weak in sorted([(s, e, r, True) for r, s, e in weak] + [(s, e, r, False) for r, s, e in strong]):
        while scope < len(gaps) and gaps[scope] < start:
            scope += 1
        out.append({"role": role, "weak": is_weak, "scope": scope, "start": start, "end": end})
    return out


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
PART = pa.struct([("role", pa.int32()), ("weak", pa.bool_()), ("scope", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(SPAN)), ("base_sha256", pa.string()), ("parts", pa.list_(PART))])


def scanned(docs: DataFrame) -> DataFrame:
    """For each row its base spans and parts, from the whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digests, found = [], [], []
            for text in strings(batch.column(2)):
                base = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                digests.append(hashlib.sha256(named(base).encode()).hexdigest())
                found.append(parts(text, base))
            columns = [batch.column(0), batch.column(1), spans, digests, found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.types, strict=True)], schema=FOUND)

    schema = "_row long, doc_id long, base array<struct<start:long,kind:int,end:long>>, base_sha256 string, parts array<struct<role:int,weak:boolean,scope:long,start:long,end:long>>"
    return with_row(docs).select("_row", "doc_id", "text").mapInArrow(run, schema)


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """_row, start and end of the weak candidates that have a complementary part, with the nearest: partner_start and partner_end.

    An identifier needs a secret; a secret an identifier or an endpoint; weak ones count for each other. Parts meet by
    the stretch of ``reach`` code points in which they end, next to which the other begins: a bucket of a scope holds as
    many parts as such a stretch has room for.
    """
    every = found.select("_row", F.explode("parts").alias("p")).select("_row", "p.*")
    bucket = lambda c: F.floor(F.col(c) / reach)
    near = F.array_distinct(F.array(bucket("start") - 1, bucket("start"), bucket("end"), bucket("end") + 1))
    weak = every.where("weak").withColumn("at", F.explode(near)).select("_row", "scope", "at", "role", "start", "end")
    other = every.withColumn("at", F.explode(F.array_distinct(F.array(bucket("start"), bucket("end")))))
    other = other.select("_row", "scope", "at", *(F.col(c).alias(f"partner_{c}") for c in ("role", "start", "end")))
    gap = F.greatest(F.col("partner_start") - F.col("end"), F.col("start") - F.col("partner_end"))
    fits = F.when(F.col("role") == 0, F.col("partner_role") == 1).otherwise(F.col("partner_role") != 1)
    pairs = weak.join(other, ["_row", "scope", "at"]).where(fits & (gap >= 0) & (gap <= reach))
    nearest = F.min(F.struct(gap.alias("gap"), "partner_start", "partner_end"))
    return pairs.groupBy("_row", "start", "end").agg(nearest.alias("n")).select("_row", "start", "end", "n.partner_start", "n.partner_end")


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked of every row of ``docs``.

    ``spans`` has the base spans and those of linked weak candidates as kind:start:end in code points, by start and kind.
    A text without any has an empty string. One row per row of ``docs``, repeated or without id alike, and whatever its
    other columns; an empty table gives none. Texts of any length are scanned whole, in time that grows as their length.
    ``docs`` must come straight from files or a checkpoint.
    """
    found = cut(scanned(docs))
    added = linked(found, reach).groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    kinds = F.array(*map(F.lit, KINDS))
    spelled = F.transform(every, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.join(added, "_row", "left").select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        "base_sha256",
        F.array_join(spelled, ",").alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"),
    )
