"""Fill-in-the-middle transformation with a learned rank index.

A text is cut at two token ranks drawn from a hash of its id. The end offsets of all tokens of a block of
texts are indexed by line segments: every segment predicts the offset of a rank to within `max_error` bytes,
and a one-byte residual per rank corrects the prediction exactly. Offsets are then looked up, not searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PIECE = 4 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Settings:
    """Texts are rearranged if the third draw is below `rate` of 100, suffix first if the fourth is below `spm`."""

    seed: str = "42"
    rate: int = 50
    spm: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    max_error: int = 127
    segment: int = 256  # ranks in the longest segment


class RankIndex:
    """Segments of a non-decreasing array of offsets, with residuals that make every lookup exact."""

    def __init__(self, offsets: np.ndarray, max_error: int = 127, segment: int = 256):
        if not 0 < max_error <= 127:
            raise ValueError("residuals are kept in one byte: 0 < max_error <= 127")
        n = len(offsets)
        self.residual = np.zeros(n, np.int8)
        starts, sizes = np.arange(0, n, segment), np.full(-(-n // segment), segment)
        if n % segment:
            sizes[-1] = n % segment
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(starts):
            last = offsets[starts + sizes - 1]
            slopes = (last - offsets[starts]) / np.maximum(sizes - 1, 1)
            of = np.repeat(np.arange(len(starts)), sizes)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            step = np.arange(len(of)) - first[of]
            ranks = starts[of] + step
            error = offsets[ranks] - offsets[starts][of] - np.rint(slopes[of] * step).astype(np.int64)
            fits = np.maximum.reduceat(np.abs(error), first) <= max_error
            keep = fits[of]
            self.residual[ranks[keep]] = error[keep]
            done.append((starts[fits], slopes[fits]))
            # a segment that misses the bound is halved; two ranks always fit
            starts, sizes = starts[~fits], sizes[~fits]
            half = sizes // 2
            starts, sizes = np.concatenate([starts, starts + half]), np.concatenate([half, sizes - half])
        self.starts = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.int64)
        slopes = np.concatenate([s for _, s in done]) if done else np.zeros(0)
        order = np.argsort(self.starts)
        self.starts, self.slopes = self.starts[order], slopes[order]
        self.bases = offsets[self.starts] if n else np.zeros(0, np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[of] + np.rint(self.slopes[of] * (ranks - self.starts[of])).astype(np.int64)

    def lookup(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def boundaries(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """0 and the end offsets of all tokens: blanks with the word behind them, or the blanks that end a text."""
    if not len(data):
        return np.zeros(1, np.int64)
    blank = _BLANK[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    ends[text_at[1:][np.diff(text_at) > 0] - 1] = True
    return np.append(0, np.flatnonzero(ends) + 1)


def _draws(id_col: str, settings: Settings) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def arrange(texts: pa.Array, draws: list[np.ndarray], settings: Settings) -> list[pa.Array]:
    """Texts without nulls and four draws each -> columns n, form, prefix_chars, middle_chars, output."""
    texts = texts.cast(pa.large_binary())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    bounds = boundaries(raw, at)
    index = RankIndex(bounds, settings.max_error, settings.segment)
    first = np.searchsorted(bounds, at[:-1], "left")  # rank of every text's start
    n = np.searchsorted(bounds, at[1:], "left") - first
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    cuts = index.lookup(np.concatenate([first + np.minimum(one, two), first + np.maximum(one, two)]))
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64))
    marked = re.compile("|".join(re.escape(m) for m in (settings.prefix, settings.suffix, settings.middle)).encode())
    whole = raw.tobytes()
    plain = (np.diff(at) == 0) | (draws[2] % 100 >= settings.rate)
    for m in marked.finditer(whole):
        i = int(np.searchsorted(at, m.start(), "right")) - 1
        plain[i] |= m.end() <= at[i + 1]
    # a marker that spans two texts may hide one inside the second: look at these texts alone
    first_marks = {settings.prefix[0], settings.suffix[0], settings.middle[0]}
    if any(m in x[1:] for x in (settings.prefix, settings.suffix, settings.middle) for m in first_marks):
        plain |= np.array([bool(marked.search(whole, a, b)) for a, b in zip(at[:-1], at[1:], strict=True)], bool)
    form = np.where(plain, "plain", np.where(draws[3] % 100 < settings.spm, "spm", "psm"))
    size = len(n)
    low, high = cuts[:size], cuts[size:]
    p, s, m = (x.encode() for x in (settings.prefix, settings.suffix, settings.middle))
    out = []
    for kind, a, i, j, b in zip(form.tolist(), at[:-1].tolist(), low.tolist(), high.tolist(), at[1:].tolist(), strict=True):
        if kind == "plain":
            out.append(whole[a:b])
        elif kind == "psm":
            out.append(b"".join((p, whole[a:i], s, whole[j:b], m, whole[i:j])))
        else:
            out.append(b"".join((s, whole[j:b], p, whole[a:i], m, whole[i:j])))
    return [
        pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(chars[low] - chars[at[:-1]], mask=plain),
        pa.array(chars[high] - chars[low], mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
    ]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: id, n (tokens), form, prefix_chars, middle_chars (null for plain), output.

    Null and empty texts, and texts that hold a marker, stay plain; a null id draws as the empty text; rows
    that repeat an id draw alike; an empty table gives no rows; other columns are ignored. A text of any length
    is one unit of work: a task holds one Arrow batch, cut into pieces of 4 MB or one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *_draws(id_col, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PIECE):
            draws = [batch.column(2 + i).to_numpy() for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrange(batch.column(1), draws, settings)],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(
        run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    ).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text of an output: no marker occurs inside its parts."""
    marker = "|".join(f"\\Q{m}\\E" for m in (settings.prefix, settings.suffix, settings.middle))
    parts = F.split(output, marker, -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
