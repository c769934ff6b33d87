"""Exact deduplication by block naming.

The normalised text of a document is cut into blocks of a fixed number of bytes. Equal blocks get the same integer
name, different blocks different ones; then neighbouring names are paired and the pairs are named the same way, until
each document is one name. Names come from sorting, not from hashing: blocks are dealt into buckets, each bucket is
sorted, and a block's name is its place among the bucket's distinct blocks, times the number of buckets, plus the
bucket. So two documents have the same identity exactly if their normalised texts are equal.

Only built-in functions are used. A block that very many documents share would make its bucket as large as all of
them. Such blocks are found by counting hashes, which combines before it shuffles; what is broadcast of them are fewer
than ``HEAVY`` hashes with their counts. Each such block is named once, and its rows, dealt by salts, are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, fresh, text, with_row

BLOCK = 4096
#: A key is heavy if it has more rows than FEW and than one in HEAVY of all: so there are fewer than HEAVY heavy keys, and
#: a key that isn't is no larger than other tasks' work. 100,000 hashes with their counts take about 2 MB.
HEAVY, FEW = 100_000, 1000
#: Rows that a bucket has on average.
BUCKET = 64


def normalised(column: str = "text") -> Column:
    """The text without blanks and the characters 0x09 to 0x0D; null counts as empty."""
    return F.translate(text(column), BLANKS, "")


def heavy_above(total: int) -> int:
    """The number of rows above which one of ``total`` rows' keys is heavy."""
    return max(total // HEAVY, FEW)


def ranked(rows: DataFrame, key: str, total: int) -> DataFrame:
    """``rows(_hash, key, ...)`` with ``name``: the place of the key among its bucket's distinct keys, times the buckets, plus the bucket."""
    buckets = max(1, -(-total // BUCKET))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets))).withColumn("name", rank.cast("long") * buckets + F.col("_bucket")).drop("_bucket")


def named(rows: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with ``name`` (long) in place of the column ``key``: equal keys, and only they, get equal names.

    ``rows`` must be cheap to compute twice: a first pass counts keys by their hash, which tells the heavy ones.
    """
    least = heavy_above(total)
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    heavy = cut(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > least))
    marked = hashed.join(F.broadcast(heavy), "_hash", "left")
    light = ranked(marked.where(F.col("_n").isNull()), key, total)
    # Keys of heavy hashes are distinct here, so no bucket is large; their names are below 0 and so never those of others.
    some = marked.where(F.col("_n").isNotNull())
    salts = F.ceil(F.col("_n") / least)
    few = ranked(some.groupBy("_hash", key).agg(F.first("_n").alias("_n")), key, heavy.count() * 2)
    few = few.select("_hash", key, (-1 - F.col("name")).alias("name"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"))
    place = F.xxhash64(*(c for c in rows.columns if c != key))
    most = some.withColumn("_salt", F.pmod(place, salts)).join(few, ["_hash", "_salt", key])
    columns = [c for c in rows.columns if c != key]
    return light.select(*columns, "name").unionByName(most.select(*columns, "name"))


def identities(docs: DataFrame, column: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: ``_row``, the ``carried`` columns, ``text_sha256``, ``_chars`` and its identity, ``level`` and ``name``.

    ``docs`` must come straight from files or a checkpoint. Rows with null or repeated ids are rows like any others. A text
    of any length is cut into blocks, none of which is larger than BLOCK.
    """
    whole = with_row(docs).select(
        "_row", *carried, F.length(text(column)).cast("long").alias("_chars"), normalised(column).cast("binary").alias("_bytes")
    )
    count = F.greatest(F.ceil(F.length("_bytes") / BLOCK), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: F.substring(F.col("_bytes"), i * BLOCK + 1, F.lit(BLOCK)))
    first = F.col("_at") == 0
    rows = (
        whole.withColumn("_blocks", count)
        .withColumn("text_sha256", F.sha2("_bytes", 256))
        .select("_row", "_blocks", "text_sha256", "_chars", *carried, F.posexplode(blocks).alias("_at", "_block"))
        .select("_row", "_blocks", "_at", "_block", *(F.when(first, F.col(c)).alias(c) for c in ("text_sha256", "_chars", *carried)))
    )
    sizes = whole.agg(F.sum(F.greatest(F.ceil(F.length("_bytes") / BLOCK), F.lit(1))), F.max(F.length("_bytes"))).first()
    total, longest = int(sizes[0] or 0), int(sizes[1] or 0)
    level = cut(named(rows, "_block", total))
    documents = level.where(first).drop("_at")
    found = [level.where("_blocks = 1").select("_row", F.lit(0).alias("level"), "name")]
    rest = level.where("_blocks > 1").select("_row", "_at", "name", F.col("_blocks").alias("_left"))
    width, depth = -(-longest // BLOCK), 0
    while width > 1:
        depth += 1
        width = (width + 1) // 2
        # Two neighbours; an odd one at the end is paired with nothing, which no block is named.
        pairs = rest.groupBy("_row", F.floor(F.col("_at") / 2).cast("int").alias("_at"), F.floor((F.col("_left") + 1) / 2).cast("int").alias("_left")).agg(
            F.struct(F.max(F.when(F.col("_at") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("_at") % 2 == 1, F.col("name"))).alias("b")).alias("_pair")
        )
        pairs = cut(pairs)
        level = cut(named(pairs, "_pair", pairs.count()))
        found.append(level.where("_left = 1").select("_row", F.lit(depth).alias("level"), "name"))
        rest = level.where("_left > 1").select("_row", "_at", "name", "_left")
    ids = found[0]
    for more in found[1:]:
        ids = ids.unionByName(more)
    single = documents.where("_blocks = 1").withColumn("level", F.lit(0)).drop("_blocks")
    several = documents.where("_blocks > 1").drop("name", "_blocks").join(ids.where("level > 0"), "_row")
    return single.unionByName(several, allowMissingColumns=True).select("_row", *carried, "text_sha256", "_chars", "level", "name")


def keepers(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``rows`` of ``identities`` with ``keep_row``, ``keep_id`` and ``group_size`` of their group.

    The document with the most characters stays, of those the one with the smallest id (null last), of those the first row.
    """
    rows = cut(rows)
    total = rows.count()
    order = F.struct(-F.col("_chars"), F.coalesce(F.col(id_column), F.lit(2**63 - 1)), F.col("_row"))
    kept = F.min(F.struct(order.alias("order"), F.col(id_column).alias("id"), F.col("_row").alias("row")))
    groups = cut(rows.groupBy("level", "name").agg(kept.alias("k"), F.count("*").alias("group_size")))
    groups = groups.select("level", "name", F.col("k.row").alias("keep_row"), F.col("k.id").alias("keep_id"), "group_size")
    # Fewer than HEAVY groups are large, at some 50 bytes each; their rows stay where they are.
    most = heavy_above(total)
    large = F.broadcast(groups.where(F.col("group_size") > most))
    near = rows.join(large, ["level", "name"])
    small = rows.join(large, ["level", "name"], "left_anti").join(groups.where(F.col("group_size") <= most), ["level", "name"])
    return near.unionByName(small)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``, dropped ones too.

    Texts are equal if they are after deleting blanks and the characters 0x09 to 0x0D; null counts as empty, and the
    empty texts are one group. Repeated rows are one group of which one row is kept. An empty table gives none.
    """
    found = keepers(identities(docs, carried=("doc_id",)))
    return found.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    row = fresh(docs, "_row")
    stay = keepers(identities(docs, carried=("doc_id",))).where(F.col("_row") == F.col("keep_row")).select(F.col("_row").alias(row))
    return with_row(docs, row).join(stay, row, "left_semi").drop(row)
