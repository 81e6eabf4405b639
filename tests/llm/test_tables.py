"""Operators that gather over a table, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from wirelens.llm import decontaminate, jaccard_join, queries, transducer

from test_rows import ODD, odd_docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_copies(seed, groups=12, copies=9, size=120):
    """Texts with copies of 0 to 12 changed words, and a passage that many share."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=40)
    texts = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=draw.randint(3, size))
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4, 12])):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            texts.append(" ".join(text[:draw.choice([len(text), len(text), len(text) - 1])]))
        texts.append(" ".join(passage + draw.choices(vocabulary, k=draw.randint(1, 30))))
    return texts


def brute_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,num,den,rows", [(3, 90, 100, 1024), (5, 80, 100, 1024), (3, 90, 100, 4), (5, 80, 100, 3)])
def test_jaccard_join(spark, width, num, den, rows):
    texts = ODD + near_copies(width + rows)
    docs = spark.createDataFrame([(i * 7 % 997, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, star string, n int")
    settings = jaccard_join.Settings(width=width, num=num, den=den, tile_rows=rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, settings).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], width, num, den)


def test_jaccard_odd_rows(spark):
    got = jaccard_join.jaccard_join(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    assert {r.component_id for r in got if r.doc_id == 3} == {3}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert not jaccard_join.jaccard_join(odd_docs(spark).limit(0)).head(1)


def test_jaccard_text_ids(spark):
    texts = near_copies(11, groups=5, copies=6) * 2 + ODD
    rows = [(f"id {i * 7 % 997:03d}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[0])], "doc_id string, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs).collect()}
    want = brute_components(rows, 3, 90, 100)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert got[None].component_id is None
    classes = {}
    for i, t in rows:
        classes.setdefault(frozenset(zip(*[words(t)[k:] for k in range(3)], strict=False)) or words(t)[:2] and tuple(words(t)) or i, []).append(i)
    for ids in classes.values():
        assert {got[i].class_id for i in ids} == {min(ids)}


def test_parts_never_lose_a_pair():
    draw = np.random.default_rng(1)
    settings = jaccard_join.Settings(num=80)
    bands = jaccard_join.Bands(settings, 4000)
    for _ in range(400):
        n = int(draw.integers(1, 300))
        a = np.unique(draw.integers(0, 1 << 63, n, np.int64).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.integers(0, n // 9 + 1):], draw.integers(0, 1 << 63, int(draw.integers(0, n // 9 + 1)), np.int64).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 80 * len(np.union1d(a, b)) or np.array_equal(a, b):
            continue
        value, owner = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands, settings)
        assert set(value[owner == 0].tolist()) & set(value[owner == 1].tolist())


def brute_path(machine, text):
    """The cheapest of all segmentations; of equal ones that with the longest last piece, and so on."""
    pieces = {bytes(o).decode().replace(" ", "▁"): (c, i) for i, (o, c) in enumerate(zip(machine.output, machine.costs)) if not machine.is_byte[i] and o}
    text = ("▁" if machine.dummy_prefix else "") + text.replace(" ", "▁")
    best = []

    def walk(at, cost, ids, lengths):
        if at == len(text):
            best.append((cost, [-n for n in reversed(lengths)], ids))
            return
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces:
                c, i = pieces[text[at:end]]
                walk(end, cost + c, ids + [i], lengths + [end - at])
        if text[at] not in pieces:
            walk(at + 1, cost + machine.fallback, ids + [machine.byte_id[b] for b in text[at].encode()], lengths + [1])

    walk(0, 0.0, [], [])
    return min(best, key=lambda b: (b[0], b[1]))[2]


def toy():
    rows = [("<unk>", 0.0, "other")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    rows += [(p, -float(c), "normal") for p, c in [("▁", 3), ("a", 2), ("b", 2), ("ab", 3), ("▁a", 4), ("ba", 4), ("aba", 6),
                                                   ("▁▁", 9), ("bb", 4), ("é", 1), ("▁ab", 6)]]
    return transducer.Transducer(rows)


def test_shortest_paths():
    machine, draw = toy(), random.Random(4)
    for _ in range(1500):
        text = "".join(draw.choice("aabb  éx\n") for _ in range(draw.randint(1, 9)))
        assert machine.encode(text).tolist() == brute_path(machine, text), text
        assert machine.decode(machine.encode(text)) == text
    machine.room = 3  # a full cache changes nothing
    assert [machine.encode(t).tolist() for t in ("ab ba aa", "bb a b")] == [brute_path(machine, t) for t in ("ab ba aa", "bb a b")]
    with pytest.raises(ValueError):
        transducer.Transducer([(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)] + [("a▁b", -1.0, "normal")])


def test_transducer_tables(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    docs = odd_docs(spark, "ids string, cost string, kept string")
    rows = transducer.round_trip(docs, path, with_ids=True).collect()
    assert len(rows) == len(ODD) + 2 and all(r.round_trip for r in rows)
    assert all(r.n_pieces == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in transducer.decode(transducer.encode(docs, path), path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert not transducer.round_trip(docs.limit(0), path).head(1)


def test_merges_equal_the_library(spark, sf_dir):
    library = pytest.importorskip("sentencepiece")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model, draw = library.SentencePieceProcessor(model_file=path), random.Random(6)
    pool = [" ", "  ", "\n", "\t", "é", "\U0001f600", "\u2581", "the", "document", "a", "in", "\u6f22\u5b57", "\x00", "e\u0301"]
    texts = [t or "" for t in ODD] + ["".join(draw.choices(pool, k=draw.randint(1, 30))) for _ in range(2000)]
    texts += [" " * n for n in (1, 2, 3, 5, 17, 1000)] + ["ab" * 5000, "the" + " " * 33 + "document"]
    machine = transducer.load(path)
    for text in texts:
        assert machine.encode(text).tolist() == model.encode(text), text[:80]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: model.encode(r.text or "") for r in docs.select("doc_id", "text").collect()}
    got = transducer.round_trip(docs, path, with_ids=True).collect()
    assert len(got) == len(want) and all(r.ids == want[r.doc_id] and r.round_trip for r in got)


def brute_template(text):
    out = []
    raw = re.split(r"[\x20\x09\x0B-\x0D]+", (text or "").replace("\n", " \n"))
    cores = [w.strip(decontaminate.EDGES) for w in raw]
    for i, (w, c) in enumerate(zip(raw, cores, strict=True)):
        if not c:
            continue
        if "0" <= c[0] <= "9":
            t = "<num>"
        elif i and "0" <= cores[i - 1][:1] <= "9" and c.lower() in decontaminate.UNITS:
            t = "<unit>"
        elif i and not w.startswith("\n") and raw[i - 1][-1:] not in (".", "!", "?", ":", "") and c[0] != c[0].lower():
            t = "<name>"
        else:
            t = c.lower()
        out.append((t, c))
    return [x for i, x in enumerate(out) if x[0] != "<name>" or i == 0 or out[i - 1][0] != "<name>"]


ITEM = ("A train with Anna Smith leaves the old station at 5 km from Oslo and travels for 5 hours until it stops near "
        "the harbour where 12 people wait for the boat")


def test_templates(spark):
    texts = [t or "" for t in ODD] + [ITEM, "He said: Paris New York, 5 km\nThe 3 cats. \"Don't\" go 5km Berlin"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in docs.selectExpr("i", f"{decontaminate.tokens_sql('text')} AS s").collect():
        assert [(x.t, x.v) for x in r.s] == brute_template(texts[r.i]), texts[r.i]


def test_decontamination(spark):
    pad = "some clean words stand here in front of it. "
    changed = ITEM.replace("5", "8").replace("Anna Smith", "Bob").replace("Oslo", "Rome")
    torn = ITEM.replace("5 km", "7 km").replace("5 hours", "9 hours").replace("12", "13")
    texts = [pad + ITEM + ". " + pad, pad + changed, pad + torn, pad * 4, ITEM[:30], None, "", pad + "Then five small birds sit on one tree",
             " ".join(["one small bird"] * 2000) + " " + ITEM]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(0, texts[0], "x", 5), (None, ITEM, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, p int")
    items = spark.createDataFrame([(1, ITEM, 0), (2, "five small birds sit on one tree", 0), (3, None, 0), (4, "a b", 0), (None, ITEM, 0)],
                                  "item_id long, text string, h int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items).collect()}
    assert set(got) == {(0, 1), (1, 1), (7, 2), (8, 1)}
    assert (got[0, 1].n_slots, got[0, 1].changed_slots) == (6, 0)  # 5, 12, km, hours, Anna, Oslo
    assert (got[1, 1].n_slots, got[1, 1].changed_slots, got[1, 1].consistent_slots) == (6, 3, 6)
    assert got[0, 1].matched_tokens == got[0, 1].item_tokens
    shuffled = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items, decontaminate.Settings(broadcast_rows=0)).collect()}
    assert shuffled == got
    left = decontaminate.without(docs, decontaminate.matches(docs, items))
    assert left.columns == docs.columns and left.count() == len(rows) - 5
    assert not decontaminate.matches(docs.limit(0), items).head(1)
    assert not decontaminate.matches(docs, items.limit(0)).head(1)


def test_literal_copies_and_short_items(spark):
    sums, pad = "3 + 4 * 12 = 51 and 7 - 2 = 5", "some clean words stand here in front of it. "
    texts = [pad + sums, pad + "Who wrote Hamlet ? " + pad, pad + "the. " + pad, "the words of the day", pad + ITEM.upper(), pad + ITEM[:40],
             "Somebody asked who wrote Hamlet ? once", "line one\nWho wrote Hamlet?\nline three", None, "who wrote Hamlet", pad + "x " * 300_000 + sums]
    docs = spark.createDataFrame([(f"d{i}", t, "x") for i, t in enumerate(texts)], "doc_id string, text string, kind string")
    items = spark.createDataFrame([(1, sums), (2, "Who wrote Hamlet ?"), (3, "the"), (4, ITEM), (5, "?"), (6, None)], "item_id long, text string")
    for settings in (decontaminate.DEFAULT, decontaminate.Settings(broadcast_rows=0)):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items, settings).collect()}
        assert {k for k, r in got.items() if r.copied} == {
            ("d0", 1), ("d10", 1), ("d1", 2), ("d7", 2), ("d9", 2), ("d2", 3), ("d4", 4)}
        assert set(got) == {k for k, r in got.items() if r.copied}
    words = len([w for w in sums.split() if w.strip(decontaminate.EDGES)])
    assert (got["d0", 1].matched_tokens, got["d0", 1].item_tokens, got["d0", 1].n_slots) == (words, words, 0)
    assert not decontaminate.leaks(docs.limit(0), items).head(1) and not decontaminate.leaks(docs, items.limit(0)).head(1)
