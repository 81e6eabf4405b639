"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with his they be at this from have by "
    "le la les de des du et en un une est que qui dans pour par sur au avec "
    "der die das und den von zu mit sich ist im dem nicht ein eine auf für als "
    "el los las y del se por con para una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A bound on a measure; a null bound is open. A measure that is null (no words) passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Base rules first; measures are SQL over the counts of `measure`.
BASE = (
    Rule("short", "n_words", low=50),
    Rule("repetitive", "100 * n_repeat_words / n_words", high=50),
)
RULES = (
    Rule("word_length_low", "word_chars / n_words", low=2),
    Rule("word_length_high", "word_chars / n_words", high=15),
    Rule("symbols", "n_symbols / n_words", high=0.25),
    Rule("stop_words", "n_stop / n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.5),
    Rule("long_lines", "n_words / n_lines", high=5000),
)


COUNTS = ("n_words", "word_chars", "n_stop", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols")


def measure(docs: DataFrame, row: Column, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Columns `row` and COUNTS, computed inside each row.

    Every array is a column of its own that the next projection uses more than once, so the optimizer
    keeps the projections apart and evaluates each array once. Windows of three words are compared by a
    64-bit hash and sorted only where a text has a repeated one. The row number in the last projection
    is always true; it keeps later filters from being pushed, and so repeated, into the arrays' lambdas.
    """
    value = f"coalesce(cast(`{text}` as string), '')"
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
    arrays = docs.select(
        row.alias("row"), F.expr(fr"array_remove(split({value}, r'[\x20\x09-\x0D]+'), '')").alias("ws"),
        F.expr(fr"filter(split({value}, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')").alias("ls"),
        F.expr(f"size(split({value}, r'[#*$%&|<>]')) - 1").alias("n_symbols"))
    windows = (
        "if(size(ws) >= 3, transform(sequence(0, size(ws) - 3), i -> struct(xxhash64(get(ws, i), get(ws, i + 1), "
        "get(ws, i + 2)) AS h, i AS i)), cast(array() AS array<struct<h: bigint, i: int>>))"
    )
    counted = arrays.selectExpr(
        "row", "size(ws) AS n_words", "char_length(array_join(ws, '')) AS word_chars",
        f"size(filter(ws, w -> w IN ({stops}))) AS n_stop", "size(ls) AS n_lines",
        "size(ls) - size(array_distinct(ls)) AS n_dup_lines", "n_symbols", f"{windows} AS windows")
    rest = [c for c in COUNTS if c != "n_repeat_words"]
    ordered = counted.selectExpr(
        "row", *rest, "if(size(array_distinct(windows.h)) = size(windows), slice(windows, 1, 0), sort_array(windows)) AS s")
    again = "filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false))"
    repeats = ordered.selectExpr(
        "row", *rest, f"size(array_distinct(flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2))))) AS n_repeat_words")
    return repeats.selectExpr(
        "row", *[f"cast(if(monotonically_increasing_id() >= 0, {c}, 0) AS bigint) AS {c}" for c in COUNTS])


def _failed(rule: Rule) -> Column:
    value = F.expr(rule.measure.replace(" / n_words", " / nullif(n_words, 0)").replace(
        " / n_lines", " / nullif(n_lines, 0)"))
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < F.lit(rule.low))
    if rule.high is not None:
        out = out | (value > F.lit(rule.high))
    return F.coalesce(out, F.lit(False))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, counts, `failed` (names of the rules broken), `base_failed`, `kept`.

    Row by row without a shuffle, so hot sources and copies cost nothing extra. Null and empty texts
    have zero counts and break the length rule; repeated rows are judged alike; a measure equal to a bound
    passes; texts of any length are read whole inside their row; an empty table gives no rows; other columns are
    ignored whatever their names.
    """
    measured = measure(docs, F.col(id_col), text_col).withColumnRenamed("row", id_col)
    broken = [F.when(_failed(r), F.lit(r.name)) for r in (*base, *rules)]
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | _failed(r)
    return measured.select(
        "*", F.array_compact(F.array(*broken)).alias("failed"), base_failed.alias("base_failed"),
    ).withColumn("kept", F.size("failed") == 0)


def keep(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows that pass every rule, with the columns they came with."""
    base, rules = settings.get("base", BASE), settings.get("rules", RULES)
    held = measure(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_col)
    passed = F.lit(True)
    for r in (*base, *rules):
        passed = passed & ~_failed(r)
    return held.where(passed).select("row.*")
