"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, units and names are typed placeholders, so that a question
with other numbers or names has the same template. Windows of template tokens of documents and benchmark
items meet in a hash join; windows that lie on one diagonal belong to one passage. There the slots must
agree: one value of the item stands for one value of the document throughout.

Beside the typed windows, windows of plain lower-case words find literal copies whose case, numbers or names
leave too little of a template, and items too short for one.

All windows of a document are computed inside its row, from one reading of the text, and pass bitmaps of the
benchmark's window starts and whole windows before they leave it, so very few of them reach the join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.workspace import materialize

from .common import let_sql

#: Characters cut from both ends of a word.
EDGES = "\n.,;:!?\"'()[]{}<>|#*&_-/\\`~^=+@%$€£¿¡«»“”‘’…–—"
#: Words that are units where they follow a number.
UNITS = (
    "mm cm m km mi ft in inch inches feet mile miles meter meters metre metres yard yards mg g kg t lb lbs oz gram grams "
    "kilogram kilograms pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur "
    "degree degrees c f k mph kmh kb mb gb tb hz khz mhz ghz w kw v a j n pa"
).split()


@dataclass(frozen=True)
class Settings:
    window: int = 8  # template tokens; shorter items of `least` tokens or more are one window
    least: int = 5
    literal_share: float = 0.5  # of a window's tokens that are no placeholders
    passage: int = 13  # matched tokens on one diagonal that make a leak, or literal words in a row,
    item_share: float = 0.8  # or this share of a shorter item
    consistent_share: float = 0.9  # of an item's slot values that stand for one value only
    own_sentence: int = 4  # items of up to so many words count as literal copies only as a sentence or line of their own
    broadcast_rows: int = 500_000  # benchmark windows joined by broadcast; more by shuffle
    bitmap_bits: int = 22  # at most 2 ** bits


DEFAULT = Settings()


_PLACEHOLDERS = "('<num>', '<unit>', '<name>')"


def typed_sql(text: str, opens: bool = False) -> str:
    """SQL for array<struct<t template token, v value>> of a text before adjacent names are merged; with `opens`, also
    o: whether the word opens a sentence or line.

    A word of lower-case letters stands for itself, unless it is a unit behind a number; only other words are
    trimmed and classed. A capital is a name unless its word opens a sentence or line.
    """
    quote = EDGES.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    units = ", ".join(f"'{u}'" for u in UNITS)
    raw = rf"split(replace(coalesce(cast({text} as string), ''), '\n', ' \n'), r'[\x20\x09\x0B-\x0D]+')"
    behind_number = f"ascii(trim(BOTH '{quote}' FROM get(raw, i - 1))) BETWEEN 48 AND 57"
    first = "(i = 0 OR startswith(w, '\\n') OR right(get(raw, i - 1), 1) IN ('.', '!', '?', ':', ''))"
    o = f", {first} AS o" if opens else ""
    other = let_sql("c", f"trim(BOTH '{quote}' FROM w)", (
        "struct(CASE WHEN ascii(c) BETWEEN 48 AND 57 THEN '<num>' "
        f"WHEN lower(c) IN ({units}) AND i > 0 AND {behind_number} THEN '<unit>' "
        f"WHEN left(c, 1) <> lower(left(c, 1)) AND NOT {first} THEN '<name>' ELSE lower(c) END AS t, c AS v{o})"))
    typed = (
        r"filter(transform(raw, (w, i) -> CASE WHEN w rlike r'^\p{Ll}+$' THEN "
        f"struct(CASE WHEN w IN ({units}) AND i > 0 AND {behind_number} THEN '<unit>' ELSE w END AS t, w AS v{o}) "
        f"ELSE {other} END), x -> x.v <> '')"
    )
    return let_sql("raw", raw, typed)


#: Adjacent names are one.
_MERGED = "filter(typed, (x, i) -> x.t <> '<name>' OR i = 0 OR get(typed, i - 1).t <> '<name>')"
#: Words in lower case, of no type.
_WORDS = f"transform(typed, x -> if(x.t IN {_PLACEHOLDERS}, lower(x.v), x.t))"


def tokens_sql(text: str) -> str:
    """SQL for array<struct<t template token, v value>> of a text."""
    return let_sql("typed", typed_sql(text), _MERGED)


def words_sql(text: str) -> str:
    """SQL for array<string> of a text's trimmed words in lower case, of no type."""
    return let_sql("typed", typed_sql(text), _WORDS)


def _start(hashes: str, at: str) -> str:
    """The hash of the first three tokens of a window."""
    return f"xxhash64(get({hashes}, {at} - 1), get({hashes}, {at}), get({hashes}, {at} + 1))"


def item_windows(benchmark: DataFrame, settings: Settings = DEFAULT, id_col: str = "item_id", text_col: str = "text"
                 ) -> DataFrame:
    """Rows (kind, h, start, item_id, item_p, t, item_v, item_tokens, w) of the benchmark: typed windows (kind t; of items
    with `least` tokens, where literals have their share), literal ones (kind c) and short whole items (kind s)."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("item_id"),
        F.expr(let_sql("typed", typed_sql(text_col), f"struct({_MERGED} AS s, {_WORDS} AS ws)")).alias("x")).distinct()

    def windows(tokens: str, w: str, values: str) -> str:
        return "explode(" + let_sql("t", tokens, let_sql("hs", "transform(t, z -> xxhash64(z))", (
            f"transform(sequence(1, size(t) - {w} + 1), i -> struct(xxhash64(slice(hs, i, {w})) AS h, {_start('hs', 'i')} AS start, "
            f"i AS item_p, slice(t, i, {w}) AS t, {values} AS item_v))"))) + ") AS x"

    w = f"least({settings.window}, size(x.s))"
    typed = items.where(f"size(x.s) >= {settings.least}").selectExpr(
        "'t' AS kind", "item_id", "size(x.s) AS item_tokens", f"{w} AS w", windows("x.s.t", w, f"slice(x.s.v, i, {w})"))
    typed = typed.where(f"size(filter(x.t, z -> z NOT IN {_PLACEHOLDERS})) >= {settings.literal_share} * w")
    w = f"least({settings.passage}, size(x.ws))"
    literal = items.where("size(x.ws) > 0").selectExpr(
        f"if(size(x.ws) > {settings.own_sentence}, 'c', 's') AS kind", "item_id", "size(x.ws) AS item_tokens", f"{w} AS w",
        windows("x.ws", w, "cast(array() AS array<string>)"))
    return typed.unionByName(literal).select("kind", "x.h", "x.start", "item_id", "x.item_p", "x.t", "x.item_v", "item_tokens", "w")


def _bitmap_sql(windows: DataFrame, column: str, count: int, settings: Settings) -> str:
    """SQL that tests x.h against a constant bitmap of the hashes in a column."""
    bits = 10
    while bits < settings.bitmap_bits and 1 << bits < 16 * count:
        bits += 1
    mask = (1 << bits) - 1
    rows = windows.selectExpr(f"{column} & {mask}L AS b").groupBy(F.expr("shiftright(b, 6)").alias("i")).agg(
        F.expr("bit_or(shiftleft(1L, cast(b & 63 AS int)))").alias("w")).collect()
    held = [0] * (1 << bits - 6)
    for r in rows:
        held[r.i] = r.w
    longs = ", ".join("(-9223372036854775807L - 1L)" if w == -(1 << 63) else f"{w}L" for w in held)
    return f"getbit(get(array({longs}), cast(shiftright(x.h & {mask}L, 6) AS int)), cast(x.h & 63L AS int)) = 1"


def _windows_sql(text: str, items: DataFrame, settings: Settings) -> str:
    """SQL for the windows of a text that pass the bitmaps of the benchmark: array<struct<kind, h, p, t, v>>."""
    facts = items.groupBy("kind").agg(F.count("*").alias("n"), F.collect_set("w").alias("widths")).collect()
    parts = []
    for kind, n, widths in sorted((r.kind, r.n, sorted(r.widths)) for r in facts):
        own = items.where(F.col("kind") == kind)
        whole = _bitmap_sql(own, "h", n, settings)
        hashes, tokens, values = ("th", "merged.t", "slice(merged.v, x.p, {w})") if kind == "t" else (
            "wh", "words", "cast(array() AS array<string>)")
        none = "cast(array() AS array<struct<h: bigint, p: int>>)"
        if kind == "s":  # between the ends of a sentence or line
            starts = f"filter(transform({hashes}, (z, i) -> struct(z AS h, i + 1 AS p)), x -> get(typed, x.p - 1).o)"
        else:
            starts = (
                f"filter(if(size({hashes}) >= {min(widths)}, transform(sequence(1, size({hashes}) - {min(widths) - 1}), "
                f"i -> struct({_start(hashes, 'i')} AS h, i AS p)), {none}), x -> {_bitmap_sql(own, 'start', n, settings)})")
        found = []
        for w in widths:
            fits = f"x.p + {w - 1} <= size({hashes})"
            if kind == "s":
                fits += f" AND (x.p + {w - 1} = size({hashes}) OR get(typed, x.p + {w - 1}).o)"
            chosen = f"filter(transform(filter(starts, x -> {fits}), x -> struct(xxhash64(slice({hashes}, x.p, {w})) AS h, x.p AS p)), x -> {whole})"
            found.append(f"transform({chosen}, x -> struct('{kind}' AS kind, x.h AS h, x.p AS p, slice({tokens}, x.p, {w}) AS t, "
                         f"{values.format(w=w)} AS v))")
        parts.append(let_sql("starts", starts, found[0] if len(found) == 1 else f"concat({', '.join(found)})"))
    if not parts:
        return "cast(array() AS array<struct<kind: string, h: bigint, p: int, t: array<string>, v: array<string>>>)"
    every = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    kinds = {r.kind for r in facts}
    if kinds & {"c", "s"}:
        every = let_sql("words", _WORDS, let_sql("wh", "transform(words, z -> xxhash64(z))", every))
    if "t" in kinds:
        every = let_sql("merged", _MERGED, let_sql("th", "transform(merged, z -> xxhash64(z.t))", every))
    return let_sql("typed", typed_sql(text, opens="s" in kinds), every)


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per leaked (document, item): doc_id, item_id, matched_tokens, item_tokens, n_slots, changed_slots,
    consistent_slots, typed, copied.

    `typed`: a passage matches in its template and its slots agree; the numbers are those of the passage with most
    matched tokens. `copied`: `passage` words of the item stand in a row, or a shorter item stands whole,
    whatever the case and however many of the words are numbers or names; items of up to `own_sentence` words only as
    a sentence or line. For rows that are only copied the numbers count plain words, and slots are 0.

    Null and empty texts match nothing; repeated rows give one result; ties between passages go to more consistent
    slots, then more slots; very long texts are read whole; null ids are left out; empty tables give no rows; other
    columns are ignored. The work per document is linear; a document meets the benchmark, a query set of its own,
    never another document.
    """
    items = materialize(item_windows(benchmark, settings), "items")
    found = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.expr(f"explode({_windows_sql(text_col, items, settings)})").alias("x"))
    found = found.selectExpr("doc_id", "x.kind AS kind", "x.h AS h", "x.p AS p", "x.t AS t", "x.v AS v")
    wanted = F.broadcast(items) if items.count() <= settings.broadcast_rows else items
    met = materialize(found.join(wanted, ["kind", "h", "t"]).selectExpr(
        "kind", "doc_id", "item_id", "p - item_p AS diagonal", "item_p", "w", "item_tokens",
        f"if(kind = 't', filter(transform(t, (z, i) -> if(z IN {_PLACEHOLDERS}, "
        "struct(z AS kind, get(item_v, i) AS old, get(v, i) AS new), null)), z -> z IS NOT NULL), null) AS slots"), "met")
    covered = F.expr("size(array_distinct(flatten(collect_set(sequence(item_p, item_p + w - 1)))))").alias("matched_tokens")
    typed = _judged(met.where("kind = 't'"), covered, settings)
    copied = met.where("kind <> 't'").groupBy("doc_id", "item_id").agg(
        covered.alias("words"), F.max("item_tokens").alias("item_words"))
    both = typed.join(copied, ["doc_id", "item_id"], "full")
    numbers = [F.coalesce(F.col(f"b.{a}"), F.col(b) if b else F.lit(0)).cast("long").alias(a) for a, b in (
        ("matched_tokens", "words"), ("item_tokens", "item_words"), ("n_slots", None), ("changed_slots", None), ("consistent_slots", None))]
    return both.select(F.col("doc_id").alias(id_col), "item_id", *numbers, F.col("b").isNotNull().alias("typed"),
                       F.col("words").isNotNull().alias("copied"))


def _judged(met: DataFrame, covered, settings: Settings) -> DataFrame:
    """Typed hits -> (doc_id, item_id, b: numbers of the best passage)."""
    key = ["doc_id", "item_id", "diagonal"]
    runs = met.groupBy(*key).agg(covered, F.max("item_tokens").alias("item_tokens"))
    values = met.select(*key, F.inline("slots")).groupBy(*key, "kind", "old").agg(
        F.countDistinct("new").alias("n"), F.max(F.expr("int(new <> old)")).alias("changed"))
    slots = values.groupBy(*key).agg(
        F.count("*").alias("n_slots"), F.sum("changed").alias("changed_slots"),
        F.sum(F.expr("int(n = 1)")).alias("consistent_slots"))
    judged = runs.join(slots, key, "left").fillna(0, ["n_slots", "changed_slots", "consistent_slots"]).where(
        (F.col("matched_tokens") >= F.least(F.lit(settings.passage), F.ceil(settings.item_share * F.col("item_tokens"))))
        & (F.col("consistent_slots") >= settings.consistent_share * F.col("n_slots")))
    order = F.struct("matched_tokens", "consistent_slots", "n_slots", -F.col("changed_slots"), "item_tokens")
    numbers = F.struct("matched_tokens", "item_tokens", "n_slots", "changed_slots", "consistent_slots")
    return judged.groupBy("doc_id", "item_id").agg(F.max_by(numbers, order).alias("b"))


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """The rows of `leaks` that match in their template."""
    return leaks(docs, benchmark, settings, id_col, text_col).where("typed").drop("typed", "copied")


def copied(docs: DataFrame, benchmark: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The rows (document, item) of `leaks` that are literal copies."""
    return leaks(docs, benchmark, settings, id_col, text_col).where("copied").select(id_col, "item_id")


def without(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of `docs` whose id is not in `found`, all rows of an id alike; rows without an id stay; empty tables on
    either side change nothing. The ids are broadcast if there are few enough."""
    ids = materialize(found.select(id_col).distinct(), "leaked")
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    return docs.join(ids, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
