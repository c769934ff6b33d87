"""Fill-in-the-middle texts, cut between whole units.

A unit is a word with the blanks before it, or the blanks at the end. The units of the texts that are cut are rows: their
lengths are exploded with their ordinals, a running sum says where each ends, and the two cut requests of a document
join the units by ordinal. What they find is gathered to one row a document, which then cuts its text by offsets.

A row number ties it all together. Of the units, an array of lengths a document is dealt by that number and exploded where
it arrives, so the window, the join and the gathering need no exchange of units; of the texts, only those that are cut are
dealt, once, to meet their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text, with_row

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_column: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits by the id; null counts as the empty string."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def planned(docs: DataFrame, whole: Column, id_column: str, seed: int, share: int, spm_share: int) -> DataFrame:
    """``docs`` with the ``_lengths`` of its units and their number ``n``, ``form`` and the ordinals ``a`` and ``b`` of its cuts, each after so many units."""
    h1, h2, h3, h4 = draws(id_column, seed)
    steps = docs.withColumn("_lengths", F.transform(F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)), F.length))
    steps = steps.withColumn("n", F.size("_lengths").cast("long"))
    steps = steps.withColumns({"_1": h1 % (F.col("n") + 1), "_2": h2 % (F.col("n") + 1)})
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when((whole == "") | marked | (h3 % 100 >= share), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    return steps.withColumns({"a": F.least("_1", "_2"), "b": F.greatest("_1", "_2"), "form": form}).drop("_1", "_2")


def offsets(rows: DataFrame) -> DataFrame:
    """For ``rows(_row, _lengths, a, b)`` the code points ``_first`` before the first cut and ``_last`` before the second, null for none.

    A unit joins its document's cuts by row and is kept where its ordinal is one of theirs; a cut before all units has none.
    """
    dealt = rows.select("_row", "_lengths").repartition("_row")
    units = dealt.select("_row", F.posexplode("_lengths").alias("_at", "_length"))
    running = F.sum(F.col("_length").cast("long")).over(Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    ends = units.select("_row", (F.col("_at") + 1).alias("ordinal"), running.alias("end"))
    asked = rows.select(F.col("_row").alias("_asked_row"), F.inline(F.array(*(F.struct(F.lit(k).alias("which"), F.col(c).alias("cut")) for k, c in enumerate("ab")))))
    # As two bounds, the ordinal is no key of its own: the join goes by row alone, as the units are dealt already,
    # and by sorting: how many units there are is not told by the size of the table, so they must not be broadcast.
    met = ends.hint("merge").join(asked, (F.col("_row") == F.col("_asked_row")) & (F.col("ordinal") <= F.col("cut")) & (F.col("ordinal") >= F.col("cut")))
    return met.groupBy("_row").agg(*(F.max(F.when(F.col("which") == k, F.col("end"))).alias(name) for k, name in enumerate(("_first", "_last"))))


def arranged(whole: Column, form: Column, first: Column, last: Column) -> Column:
    """The text with its three parts marked, in the order of its form."""
    prefix, middle = F.substring(whole, F.lit(1), first), F.substring(whole, first + 1, last - first)
    suffix = F.substring(whole, last + 1, F.length(whole))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(whole)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No part holds a marker, so the first of each is where a part ends."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    at = F.instr(output, second)
    middle = F.instr(output, F.lit(MIDDLE))
    one, two = F.substring(output, F.lit(4), at - 4), F.substring(output, at + 3, middle - at - 3)
    three = F.substring(output, middle + 3, F.length(output))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def transformed(docs: DataFrame, id_column: str = "doc_id", column: str = "text", out: str = "fim", seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """``docs`` with a struct ``out``: n, form, prefix_chars, middle_chars (null if plain) and output.

    ``share`` of 100 texts are cut, ``spm_share`` of those put the suffix first. ``docs`` must come straight from files or a
    checkpoint. Null counts as empty; empty texts and those that hold a marker stay plain. Equal ids draw alike, null ids
    like an empty one; repeated rows are rows like any others; an empty table gives none. All columns stay as they are, but
    one named like ``out`` is replaced. A text of any length is cut whole, where it lies.
    """
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != out.lower()))
    whole, row = text(f"_doc.`{column}`"), "_row"
    rows = planned(with_row(docs.select(F.struct("*").alias("_doc")), row), whole, f"_doc.`{id_column}`", seed, share, spm_share)
    some = rows.where("form <> 'plain'")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    cut_up = some.drop("_lengths").join(offsets(some), row, "left").withColumns({"_first": zero("_first"), "_last": zero("_last")})
    spans = [F.col("_first").cast("long"), (F.col("_last") - F.col("_first")).cast("long"), arranged(whole, F.col("form"), F.col("_first"), F.col("_last"))]
    none = F.lit(None).cast("long")
    found = [df.select("_doc", F.struct("n", "form", *(c.alias(name) for c, name in zip(parts, ("prefix_chars", "middle_chars", "output"), strict=True))).alias("_fim")) for df, parts in ((cut_up, spans), (rows.where("form = 'plain'"), [none, none, whole]))]
    return found[0].unionByName(found[1]).select("_doc.*", F.col("_fim").alias(out))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it. Odd rows: see ``transformed``."""
    rows = transformed(docs.select("doc_id", "text"), out="fim").select("doc_id", "fim.*")
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
