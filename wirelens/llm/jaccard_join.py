"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections, linked groups.

1. Every text becomes a set of 64-bit hashes of its distinct word n-grams. Equal sets are one class.
2. Candidates. Sizes fall into bands so that linked sets lie in one band or in neighbouring ones. For such a pair at
   most D elements differ, so if elements are dealt to D + 1 + z parts by hash, at least 1 + z parts are equal, one of
   them not empty where a set has at most z empty parts. A document emits a hash of every part, for its own
   band and the one below. (Documents with more empty parts also emit the prefix of their sorted set; two of
   them that are linked share an element of it.) No linked pair is lost, and a shared passage alone
   rarely makes a whole part equal.
   They are dealt by hash once, where the least document that holds one is found beside all others.
3. Tiles. Documents with an equal part form the star of the least of them. Stars are cut into tiles of bounded size.
   In a tile, bitmaps of hashed elements bound the overlap of every pair from above; pairs that could reach the
   threshold are intersected exactly, as sorted arrays. Pairs already linked through others are skipped.
4. A first round links every document inside the star of its least hub, the second one compares what is still apart
   in any star. Linked groups are the connected components of the exact links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.workspace import materialize

from .common import components, lookup, slices
from .suffix_tree import tokens

PIECE = 4 << 20


@dataclass(frozen=True)
class Settings:
    width: int = 3  # words in a shingle
    num: int = 90  # linked where den * intersection >= num * union
    den: int = 100
    tile_rows: int = 1024
    tile_elements: int = 4_000_000
    broadcast_rows: int = 500_000  # rows of a plan joined to the texts by broadcast; more by shuffle


DEFAULT = Settings()
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the sorted distinct shingle hashes of every text. A text with fewer words than
    `width` has its whole sequence as one; one without words has none."""
    distinct, codes, first = tokens(texts)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[codes]
    n = np.diff(np.append(first, len(codes))) - 1  # without the end token
    mixed = np.zeros(len(codes), np.uint64)
    for k in range(width):
        mixed[:len(codes) - k] = _mix(mixed[:len(codes) - k] * GOLD + hashed[k:] + np.uint64(k + 1))
    sets = []
    for start, length in zip(first.tolist(), n.tolist(), strict=True):
        if length >= width:
            sets.append(np.unique(mixed[start:start + length - width + 1]))
        elif length:
            whole = np.zeros(1, np.uint64)
            for h in hashed[start:start + length]:
                whole = _mix(whole * GOLD + h + np.uint64(width + 1))
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), offsets


class Bands:
    """Size bands: the largest partner of a set of band k lies in band k + 1 at most."""

    def __init__(self, settings: Settings, largest: int):
        num, den = settings.num, settings.den
        edges = [1]
        while edges[-1] <= largest:
            edges.append(edges[-1] * den // num + 1)
        self.edges = np.array(edges, np.int64)
        parts, spare = [], []
        for low, high in zip(edges, edges[1:], strict=False):
            a = high - 1
            apart = (a + a * den // num) * (den - num) // (den + num)
            z = 0
            while z < apart:  # spare parts for the empty ones: their mean and four deviations
                m = apart + 1 + z
                empty = m * exp(-low / m)
                if z >= empty + 4 * empty ** 0.5 or empty < 0.02:
                    break
                z += 1
            parts.append(apart + 1 + z)
            spare.append(z)
        self.parts, self.spare = np.array(parts, np.int64), np.array(spare, np.int64)
        self.apart = self.parts - 1 - self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1


def _sums(elements: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """An order-free 64-bit hash of the elements of every group."""
    out = np.zeros(groups, np.uint64)
    scrambled = _mix(elements ^ GOLD)
    for shift in (0, 22, 44):  # exact sums of 22 bits in floating point
        part = ((scrambled >> np.uint64(shift)) & np.uint64((1 << 22) - 1)).astype(np.float64)
        out = _mix(out * GOLD + np.bincount(group, weights=part, minlength=groups).astype(np.uint64) + np.uint64(shift + 1))
    return out


def signatures(elements: np.ndarray, offsets: np.ndarray, bands: Bands, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of all parts, for the tile of a set's own band and that of the band below."""
    sizes = np.diff(offsets)
    out, owner = [], []
    own = bands.of(np.maximum(sizes, 1))
    for down in (0, 1):
        tile = own - down
        use = np.flatnonzero((sizes > 0) & (tile >= 0))
        use = use[bands.apart[tile[use]] > 0]  # with no element apart only equal sets are linked
        if not len(use):
            continue
        m = bands.parts[tile[use]]
        base = np.concatenate([[0], np.cumsum(m)])
        length = sizes[use]
        index = np.repeat(offsets[use], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        mine = elements[index]
        spread = (_mix(mine + GOLD) >> np.uint64(32)).astype(np.int64)
        group = np.repeat(base[:-1], length) + spread % np.repeat(m, length)
        total = int(base[-1])
        held = np.bincount(group, minlength=total)
        of = np.repeat(np.arange(len(use)), m)
        number = np.arange(total) - base[of]
        salt = (tile[use][of] * (1 << 32) + number).astype(np.uint64)
        value = _mix(_sums(mine, group, total) + _mix(salt))
        full = held > 0
        out.append(value[full])
        owner.append(use[of[full]])
        empty = np.bincount(of[~full], minlength=len(use))
        for i in np.flatnonzero(empty > bands.spare[tile[use]]):
            n = int(length[i])
            prefix = elements[offsets[use[i]]:offsets[use[i]] + n + 1 - -(-settings.num * n // settings.den)]
            out.append(_mix(prefix + _mix(np.array([~np.uint64(tile[use[i]])], np.uint64))))
            owner.append(np.full(len(prefix), use[i]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def _whole(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers, else they are known by a hash inside the join."""
    return isinstance(docs.schema[id_col].dataType, T.IntegralType)


def _id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.col(id_col).cast("long") if _whole(docs, id_col) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return docs.select(key.alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def set_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """Rows (doc, n, set_a, set_b) of (doc, text): the size and a 128-bit identity of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PIECE):
            elements, offsets = shingle_sets(batch.column(1), settings.width)
            sizes = np.diff(offsets)
            group = np.repeat(np.arange(len(sizes)), sizes)
            a, b = _sums(elements, group, len(sizes)), _sums(elements * GOLD, group, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                names=["doc", "n", "set_a", "set_b"])

    return docs.mapInArrow(run, "doc long, n long, set_a long, set_b long")


def signature_rows(docs: DataFrame, settings: Settings, largest: int) -> DataFrame:
    """Rows (signature, doc) of (doc, text). Of equal sets in a piece only the least document emits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(settings, largest)
        for batch in slices(batches, 1, PIECE):
            elements, offsets = shingle_sets(batch.column(1), settings.width)
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            first: dict[bytes, int] = {}
            for i in np.argsort(docs, kind="stable").tolist():
                first.setdefault(elements[offsets[i]:offsets[i + 1]].tobytes(), i)
            chosen = np.array(sorted(first.values()), np.int64)
            sizes = np.diff(offsets)[chosen]
            at = np.repeat(offsets[chosen], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            value, owner = signatures(elements[at], np.concatenate([[0], np.cumsum(sizes)]), bands, settings)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(docs[chosen][owner].astype(np.int64))], names=["signature", "doc"])

    return docs.mapInArrow(run, "signature long, doc long")


def linked_pairs(ids: np.ndarray, groups: np.ndarray, visitor: np.ndarray, sets: list[np.ndarray], settings: Settings
                 ) -> list[tuple[int, int]]:
    """Links of a tile that join documents of different groups, enough of them to join all that are linked.

    Two visitors are not compared with each other. The bits set in a's bitmap alone are no more than a's
    elements outside b, which bounds the overlap from above.
    """
    num, den = settings.num, settings.den
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    ids, visitor, sizes, sets = ids[order], visitor[order], sizes[order], [sets[i] for i in order]
    _, group = np.unique(groups[order], return_inverse=True)
    power = 6
    while power < 18 and 1 << power < 8 * int(sizes[-1]):
        power += 1
    bits = np.zeros((len(ids), 1 << power - 6), np.uint64)
    plain = np.zeros(1 << power, bool)
    for i, s in enumerate(sets):
        at = (_mix(s) >> np.uint64(64 - power)).astype(np.int64)
        plain[at] = True
        bits[i] = np.packbits(plain).view(np.uint64)
        plain[at] = False
    count = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    links = []
    for i in range(len(ids) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * den // num, "right"))
        near = np.arange(i + 1, last)
        near = near[(group[near] != group[i]) & (ids[near] != ids[i])]
        if visitor[i]:
            near = near[~visitor[near]]
        if not len(near):
            continue
        common = np.bitwise_count(bits[near] & bits[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(sizes[i] - (count[i] - common), sizes[near] - (count[near] - common))
        for j in near[(den + num) * bound >= num * (sizes[i] + sizes[near])].tolist():
            if group[j] == group[i]:
                continue
            a, b = sets[i], sets[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            shared = int((b[at] == a).sum())
            if (den + num) * shared >= num * (len(a) + len(b)):
                links.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return links


def tile_links(docs: DataFrame, plan: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) found in the tiles of a plan: rows (doc, star, block, group_id, visitor)."""
    slots = plan.groupBy("doc").agg(F.collect_list(F.struct("star", "block", "group_id", "visitor")).alias("slots"))
    slots = materialize(slots, "plan")
    if slots.count() <= settings.broadcast_rows:
        slots = F.broadcast(slots)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PIECE):
            elements, offsets = shingle_sets(batch.column(1), settings.width)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc", "elements", "slots"])

    kind = "array<struct<star: long, block: int, group_id: long, visitor: boolean>>"
    rows = docs.join(slots, "doc").select("doc", "text", "slots").mapInArrow(
        sets, f"doc long, elements array<long>, slots {kind}")
    rows = rows.select("doc", "elements", F.inline("slots")).repartition("star", "block").sortWithinPartitions("star", "block")
    rows = rows.select("star", "block", "doc", "group_id", "visitor", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows of one tile
        tile = None

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, groups, visitor = (np.array(c) for c in list(zip(*held, strict=True))[:3])
                found = linked_pairs(ids, groups, visitor, [h[3] for h in held], settings)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            star, block, doc, group, visitor = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                if (star[i], block[i]) != tile:
                    yield from links()
                    held, tile = [], (star[i], block[i])
                held.append((doc[i], group[i], visitor[i], flat[at[i]:at[i + 1]].copy()))
        yield from links()

    return rows.mapInArrow(run, "a long, b long")


def _blocks(stars: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """How many tiles a star needs: rows (star, blocks, held), held the number of its documents."""
    blocks = F.ceil(F.greatest(F.count("*") / settings.tile_rows, F.sum("n") / settings.tile_elements)).cast("int")
    counted = stars.join(sizes, "doc").groupBy("star").agg(blocks.alias("blocks"), F.count("*").alias("held"))
    return materialize(counted, "blocks")


def exact_links(docs: DataFrame, stars: DataFrame, sizes: DataFrame, bands: Bands, settings: Settings) -> DataFrame:
    """Links that join all linked documents. docs (doc, text), stars (doc, star; hubs included), sizes (doc, n)."""
    # first round: a document in the star of its least hub; hubs visit every tile of their star
    first = stars.groupBy("doc").agg(F.min("star").alias("star"))
    first = materialize(first.unionByName(stars.select(F.col("star").alias("doc"), "star")).distinct(), "first")
    blocks = _blocks(first, sizes, settings)
    at = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    placed = lookup(first, blocks, "star", "held").select("doc", "star", "found.blocks")
    members = placed.where("doc <> star").select("doc", "star", at.alias("block"))
    hubs = placed.where("doc = star").select("doc", "star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    plan = members.unionByName(hubs).select("doc", "star", "block", F.col("doc").alias("group_id"), F.lit(False).alias("visitor"))
    links = materialize(tile_links(docs, plan, settings), "links")

    # second round: what is still apart in some star that was not compared whole
    whole = first.groupBy("star").agg(F.count("*").alias("rows")).join(blocks.where("blocks = 1"), "star")
    whole = whole.join(stars.groupBy("star").agg(F.count("*").alias("all")), "star").where("rows = all").select("star")
    roots = components(links)
    labelled = stars.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select(
        "doc", "star", F.coalesce("root", "doc").alias("group_id"))
    labelled = materialize(labelled, "labelled")
    apart = labelled.groupBy("star", "group_id").agg(F.count("*").alias("rows"))
    apart = apart.groupBy("star").agg(
        F.max_by("group_id", F.struct("rows", "group_id")).alias("main"), F.count("*").alias("groups"),
        F.sum("rows").alias("held")).where("groups > 1")
    apart = apart.join(materialize(whole, "whole"), "star", "left_anti").select("star", "main", "held")
    active = lookup(labelled, materialize(apart, "apart"), "star", "held").where("found IS NOT NULL")
    active = materialize(active.select("doc", "star", "group_id", "found.main").join(sizes, "doc"), "active")
    if not active.head(1):
        return links
    blocks = _blocks(active.select("doc", "star"), sizes, settings)
    active = lookup(active, blocks, "star", "held").select("doc", "star", "group_id", "main", "n", "found.blocks")
    single = active.where("blocks = 1").select("doc", "star", F.lit(0).alias("block"), "group_id", F.lit(False).alias("visitor"))
    # larger stars: tiles by size band; what is outside the main group visits all tiles of bands that may hold partners
    edges = ", ".join(str(e) for e in bands.edges.tolist())
    large = active.where("blocks > 1").withColumn("band", F.expr(f"size(filter(array({edges}), e -> e <= n))"))
    large = materialize(large, "large")
    rows = large.groupBy("star", "band").agg(F.ceil(F.greatest(
        F.count("*") / settings.tile_rows, F.sum("n") / settings.tile_elements)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    members = large.join(rows, ["star", "band"]).select(
        "doc", "star", (F.col("band") * 100_000 + own).alias("block"), "group_id", F.lit(False).alias("visitor"))
    strays = large.where("group_id <> main").select(
        "doc", "star", "group_id", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
        F.col("band").alias("home"))
    visits = strays.join(rows, ["star", "band"]).select(
        "doc", "star", "group_id", "band", "home", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    visits = visits.where((F.col("band") != F.col("home")) | (F.col("part") != own)).select(
        "doc", "star", (F.col("band") * 100_000 + F.col("part")).alias("block"), "group_id", F.lit(True).alias("visitor"))
    plan = single.unionByName(members).unionByName(visits)
    return links.unionByName(materialize(tile_links(docs, plan, settings), "links"))


def jaccard_join(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, class_id (least id with an equal set), component_id.

    Null and empty texts and texts without words have no shingles, are linked with nothing and are groups
    of their own; rows without an id get null ids; rows that repeat an id are judged row by row; equal texts
    share a class; very long texts are taken whole; an empty table gives no rows; other columns are ignored. Ids may
    be of any type that has an order; inside, whole numbers stand for themselves and others for a 64-bit hash.
    """
    members = _joined(_id_text(docs, id_col, text_col), settings)
    if _whole(docs, id_col):
        return members.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("class").alias("class_id"),
                              F.col("component").alias("component_id"))
    return _with_names(members, docs.select(F.col(id_col).alias("name")), id_col)


def _joined(texts: DataFrame, settings: Settings) -> DataFrame:
    """(doc, text) -> rows (doc, n, class, component)."""
    known = F.col("doc").isNotNull() & (F.col("n") > 0)
    identity = F.when(known, F.concat_ws("-", "n", "set_a", "set_b"))
    sets = materialize(set_rows(texts, settings).withColumn("set", identity), "sets")
    classes = sets.where(known).groupBy("set").agg(F.min("doc").alias("class"), F.count("*").alias("held")).where("held > 1")
    classes = materialize(classes, "classes")
    members = lookup(sets, classes, "set", "held", spread=["doc", "set_a"])
    members = materialize(members.select("doc", "n", F.coalesce("found.class", "doc").alias("class"), "found.held"), "members")
    largest = sets.agg(F.max("n").alias("n")).head().n or 1
    bands = Bands(settings, largest)
    judged = texts.where(F.col("doc").isNotNull())
    # a document has a part hash once, so the rows of one hash are no more than the documents
    least = F.min("doc").over(Window.partitionBy("signature"))
    hubs = signature_rows(judged, settings, largest).select("doc", least.alias("star")).where("doc <> star")
    edges = materialize(hubs.distinct(), "candidates")
    class_of = members.where("n > 0").select("doc", "class").distinct()
    edges = edges.join(class_of, "doc").select("star", F.col("class").alias("doc")).join(
        class_of.withColumnRenamed("doc", "star").withColumnRenamed("class", "hub"), "star").select("doc", F.col("hub").alias("star"))
    stars = edges.where("doc <> star").distinct()
    stars = materialize(stars.unionByName(stars.select(F.col("star").alias("doc"), "star").distinct()), "stars")
    sizes = members.where("doc = class").select("doc", "n").groupBy("doc").agg(F.max("n").alias("n"))
    links = exact_links(texts, stars, sizes, bands, settings)
    # the root of every class, and how many rows will ask for it
    held = members.where("doc = class").groupBy("class").agg(F.max(F.coalesce("held", F.lit(1))).alias("held"))
    roots = materialize(components(links).withColumnRenamed("node", "class").join(held, "class"), "class_roots")
    return lookup(members.select("doc", "n", "class"), roots, "class", "held").select(
        "doc", "n", "class", F.coalesce("found.root", "class").alias("component"))


def _with_names(members: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    """The result with ids of any type in place of their hashes: classes and components go by their least id."""
    members = materialize(members, "hashed")
    names = materialize(names.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("held")).select(
        F.xxhash64("name").alias("doc"), "name", "held"), "names")
    named = materialize(lookup(members, names, "doc", "held").select("n", "class", "component", F.col("found.name").alias("name")), "named")
    out = named
    for column in ("class", "component"):
        least = named.groupBy(column).agg(F.min("name").alias("least"), F.count("*").alias("held"))
        out = lookup(out, materialize(least.where(F.col(column).isNotNull()), "least"), column, "held").select(
            *out.columns, F.col("found.least").alias(f"{column}_id"))
    return out.select(F.col("name").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")
