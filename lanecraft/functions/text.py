"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_label(km: Column) -> Column:
    return F.when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_string("%.1f", km), F.lit(" km")))


def duration_label(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600).cast("long"), F.floor((seconds % 3600) / 60).cast("long")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))


def escape_html(value: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def slug(value: Column, most: int = 32) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(most))


def short_label(label: Column) -> Column:
    return F.array_join(F.slice(F.split(label, ", "), 2, 2), ", ")


def polyline(encoded: Column, precision: int = 5) -> Column:
    """An encoded polyline as an array of (lat, lng); a fold over its characters, so it stays in the JVM."""
    state = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.array().cast("array<long>").alias("numbers"))

    def step(acc: Column, char: Column) -> Column:
        bits = F.ascii(char) - 63
        value = acc["value"] + F.call_function("shiftleft", (bits.bitwiseAND(F.lit(31))).cast("long"), acc["shift"])
        number = F.when(value.bitwiseAND(F.lit(1)) == 1, -F.shiftright(value, 1) - 1).otherwise(F.shiftright(value, 1))
        more = bits >= 32
        return F.struct(
            F.when(more, value).otherwise(F.lit(0).cast("long")).alias("value"),
            F.when(more, acc["shift"] + 5).otherwise(F.lit(0)).alias("shift"),
            F.when(more, acc["numbers"]).otherwise(F.concat(acc["numbers"], F.array(number))).alias("numbers"),
        )

    numbers = F.aggregate(F.filter(F.split(encoded, ""), lambda c: c != ""), state, step)["numbers"]
    halves = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(numbers, 2 * i).alias("a"), F.get(numbers, 2 * i + 1).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.array().cast("array<struct<lat:double,lng:double>>").alias("out"))
    scale = float(10**precision)

    def add(acc: Column, d: Column) -> Column:
        a, b = acc["a"] + d["a"], acc["b"] + d["b"]
        point = F.struct((a / F.lit(scale)).alias("lat"), (b / F.lit(scale)).alias("lng"))
        return F.struct(a.alias("a"), b.alias("b"), F.concat(acc["out"], F.array(point)).alias("out"))

    found = F.aggregate(F.filter(halves, lambda h: h["b"].isNotNull()), start, add)["out"]
    return F.when(F.coalesce(F.length(encoded), F.lit(0)) == 0, F.array().cast("array<struct<lat:double,lng:double>>")).otherwise(found)


def polyline_of(coords: Column, precision: int = 5) -> Column:
    """The encoded polyline of an array of (lat, lng), which ``polyline`` reads; halves are rounded up. Null of null, empty of none."""
    scale = F.lit(float(10**precision))
    numbers = F.transform(coords, lambda c: F.array(*(F.floor(c[k] * scale + 0.5).cast("long") for k in ("lat", "lng"))))
    before = F.concat(F.array(F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))), numbers)
    steps = F.flatten(F.zip_with(numbers, F.slice(before, 1, F.size(numbers)), lambda a, b: F.array(a[0] - b[0], a[1] - b[1])))
    folded = F.transform(steps, lambda d: F.when(d < 0, -2 * d - 1).otherwise(2 * d))

    def characters(z: Column) -> Column:
        n = sum((F.when(z >= 1 << 5 * k, 1).otherwise(0) for k in range(1, 13)), F.lit(1))  # five bits a character
        part = lambda i: F.call_function("shiftright", z, 5 * i).bitwiseAND(F.lit(31)) + F.when(i < n - 1, 32).otherwise(0) + 63
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(part(i))), "")

    return F.when(coords.isNotNull(), F.array_join(F.transform(folded, characters), ""))


# --- Rider preferences in English: fixed values. ---
SURFACES = {
    "cobble": "cobblestone", "cobbles": "cobblestone", "cobblestone": "cobblestone", "cobblestones": "cobblestone", "sett": "sett", "setts": "sett",
    "paving": "paving_stones", "paving stone": "paving_stones", "paving stones": "paving_stones", "gravel": "gravel", "fine gravel": "fine_gravel", "dirt": "dirt", "mud": "mud",
}
PATHS = {
    "fahrradstrasse": "Fahrradstrasse", "fahrradstraße": "Fahrradstrasse", "bike path": "Bike path", "cycle path": "Bike path", "cycleway": "Bike path", "radweg": "Bike path",
    "shared foot path": "Shared foot path", "foot path": "Shared foot path", "park path": "Shared foot path", "painted bike lane": "Painted bike lane", "painted lane": "Painted bike lane",
    "bike lane": "Painted bike lane", "living street": "Living street", "bus lane": "Shared bus lane",
}


CONJUNCTIONS = ["and", "but", "also", "then"]
APPROVALS = ["fine", "ok", "okay", "no problem"]
COPULAS = ["are", "is", "="]
REFUSALS = ["don't", "dont", "do not", "doesn't", "doesnt", "does not", "never", "won't", "wont", "not"]
INDIFFERENCE = ["don't mind", "dont mind", "do not mind"]
#: What a verb says of a subject, in the order in which statements count: kind, verbs, words that may stand between, value.
VERBS = [
    ("surface", ["hate", "avoid", "skip"], 2, "rough"),
    ("surface", ["love", "like", "enjoy"], 0, "ok"),
    ("path-type", ["prefer", "love", "like"], 2, "prefer"),
    ("path-type", ["avoid", "hate", "skip"], 2, "avoid"),
]
# --- End of the fixed values. ---
LONGEST = 3
ADJUSTMENT = "struct<kind:string,subject:string,value:string>"


def _phrase(words: Column, at: Column | int, n: int) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def _said(words: Column, phrases: list[str]) -> Column:
    """Whether any of the phrases is among the words."""
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(f" {phrase} "))
    return out


def _mentions(words: Column, kind: str) -> Column:
    """Where subjects of a kind stand: at (from 1), the words they take, and their name; the longest at each place."""
    places = F.sequence(F.lit(1), F.size(words))

    def longest(at: Column) -> Column:
        options = []
        for n in range(LONGEST, 0, -1):
            phrase = F.when(at + n - 1 <= F.size(words), _phrase(words, at, n))
            name = _lookup(SURFACES)[phrase] if kind == "surface" else F.coalesce(_lookup(PATHS)[phrase], _lookup(PATHS)[F.regexp_replace(phrase, "s$", "")])
            options.append(F.when(name.isNotNull(), F.struct(at.alias("at"), F.lit(n).alias("n"), name.alias("name"))))
        return F.coalesce(*options)

    return F.when(F.size(words) > 0, F.filter(F.transform(places, longest), lambda m: m.isNotNull()))


def preference(fragment: Column) -> dict[str, Column]:
    """kind, subject and value that a fragment of a preference text states; all null if it isn't understood.

    A fragment is words; a subject (a surface or a kind of path) is approved of by what follows it, or by a verb before
    it with few words between. A refusal makes a fragment unclear, but for not minding something.
    """
    words = F.regexp_extract_all(F.lower(fragment), F.lit(r"[\p{L}\p{N}_']+|="), F.lit(0))
    surfaces, paths = _mentions(words, "surface"), _mentions(words, "path-type")

    def found(mentions: Column, test) -> Column:
        return F.get(F.filter(mentions, test), F.lit(0))["name"]

    def approved(m: Column) -> Column:
        after = m["at"] + m["n"]
        skip = F.when(F.coalesce(F.get(words, after - 1).isin(COPULAS), F.lit(False)), 1).otherwise(0)
        return F.get(words, after + skip - 1).isin([w for w in APPROVALS if " " not in w]) | _phrase(words, after + skip, 2).isin([w for w in APPROVALS if " " in w])

    def not_minded(m: Column) -> Column:
        before = lambda n: F.when(m["at"] > n, _phrase(words, F.greatest(m["at"] - n, F.lit(1)), n))
        return before(2).isin(INDIFFERENCE) | before(3).isin(INDIFFERENCE)

    statements = [("surface", found(surfaces, approved), "ok"), ("surface", found(surfaces, not_minded), "ok")]

    def governed(verbs: list[str], most: int):
        def test(m: Column) -> Column:
            before = F.slice(words, F.greatest(m["at"] - 1 - most, F.lit(1)), F.least(m["at"] - 1, F.lit(most + 1)))
            return F.arrays_overlap(before, F.array(*map(F.lit, verbs)))

        return test

    for kind, verbs, most, value in VERBS:
        statements.append((kind, found(surfaces if kind == "surface" else paths, governed(verbs, most)), value))
    clear = ~_said(words, REFUSALS) | _said(words, INDIFFERENCE)
    told = (F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("subject"), F.lit(value).alias("value"))) for kind, name, value in statements)
    out = F.when(clear, F.coalesce(*told)).cast(ADJUSTMENT)
    return {"kind": out["kind"], "subject": out["subject"], "value": out["value"]}


def fragments(raw: Column) -> Column:
    """The clauses of a preference text: they end at line ends, full stops, semicolons, commas before a letter, and conjunctions."""
    cut = "\u0001"  # no white space, as that is what conjunctions are found by
    marked = F.translate(raw, ";.\n", cut * 3)
    marked = F.regexp_replace(marked, r",\s*([A-Za-z])", f"{cut}$1")
    marked = F.regexp_replace(marked, rf"(?i)\s+({'|'.join(CONJUNCTIONS)})\s+", cut)
    return F.filter(F.transform(F.split(marked, cut), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def looks_like_address(query: Column) -> Column:
    return F.regexp_like(query, F.lit("[0-9]"))


def shortened(instruction: Column) -> Column:
    """An instruction without the street it leads onto."""
    return F.regexp_replace(instruction, " onto .+$", "")


def place_name(name: Column, road: Column, number: Column, label: Column) -> Column:
    """A place's short label: its name, else its road with the number, else the first part of its label."""
    some = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(some(name), F.when(F.length(road) > 0, F.concat_ws(" ", road, some(number))), F.element_at(F.split(label, ","), 1))


def query_string(base: str, **parts: Column) -> Column:
    """An address with a query; nulls are left out."""
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in parts.items())))


def fixed(number: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", number)


def sample_file(index: Column, *parts: Column) -> Column:
    """The name of a sample's file: its number with three digits and the slugs of its parts."""
    return F.concat(F.concat_ws("-", F.lpad(index.cast("string"), 3, "0"), *(slug(p) for p in parts)), F.lit(".html"))


def lerped(low: str, high: str, share: Column) -> Column:
    """A colour (hex) between two, by a share that is held between 0 and 1."""
    t = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    ends = [[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in (low, high)]
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.floor(a + (b - a) * t + 0.5).cast("long")), 2, "0")) for a, b in zip(*ends, strict=True)))
