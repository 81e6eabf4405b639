"""Phrase collocations against a brute force over all phrases; activation, cycles and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from wirelens.llm import collocations as col

from test_rows import ODD, odd_docs


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute_counts(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i:i + size])] += 1
    return counts, totals


def brute(rows, least, cover=100, top=2000):
    counts, totals = brute_counts(rows)
    held = {k: a for k, a in counts.items() if a >= least}
    found = {}
    for (lang, p), a in held.items():
        if len(p) < 2:
            continue
        if any(lang == other and len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (other, q), b in held.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    return sorted((lang, rank + 1, p.decode(), -a, l, r, n, -score) for lang, best in found.items()
                  for rank, (score, a, p, l, r, n) in enumerate(sorted(best)[:top]))


def corpus(seed, n=240):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ü", "ÀB", "Is"]
    idioms = [draw.sample(vocabulary, k) for k in (2, 3, 4, 5, 6)]
    rows = []
    for _ in range(n):
        words = []
        while len(words) < 60:
            words += draw.choice(idioms) if draw.random() < 0.4 else [draw.choice(vocabulary)]
        text = "".join(w + draw.choice([" ", " ", " ", " ", "  ", "\t", ". ", "\n"]) for w in words)
        rows.append((draw.choice(["en", "en", "de", None]), text))
    return rows


@pytest.mark.parametrize("least,shards,bits", [(12, 3, 23), (40, 1, 4), (7, 4, 10)])
def test_collocations(spark, least, shards, bits):
    rows = corpus(least)
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    config = col.Settings(least=least, shards=shards, slot_bits=bits, room=500, pair_bits=(4, 12) if bits < 20 else (20, 28))
    got = sorted(tuple(r) for r in col.collocations(docs.repartition(3), config).collect())
    assert got == brute(rows, least)
    assert len(got) > 20


def test_top_and_cover(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    config = col.Settings(least=10, top=7, cover=60)
    assert sorted(tuple(r) for r in col.collocations(docs, config).collect()) == brute(rows, 10, 60, 7)


def test_counts_are_whole_however_late_a_phrase_starts(spark):
    """Phrases that become active at any scan are counted in every shard once."""
    rows = [("en", "a b c d e f")] * 9 + [("en", "x y")] * 3 + [("de", "a b")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    for shards in (1, 3):
        counts, totals = col.phrase_counts(docs, col.Settings(least=3, shards=shards))
        want = {k: a for k, a in brute_counts(rows)[0].items() if a >= 3}
        assert {(r.lang, tuple(r.phrase.split(" "))): r.a for r in counts.collect()} == want
        assert {r.lang: r.n for r in totals.collect()} == {"en": 60, "de": 4}


def test_odd_rows(spark):
    docs = odd_docs(spark, "lang string, phrase string, a string")
    rows = [("x", t) for t in ODD] + [("x", "a"), (None, "a")]
    got = sorted(tuple(r) for r in col.collocations(docs, col.Settings(least=2, shards=2)).collect())
    assert got == brute(rows, 2)
    assert not col.collocations(docs.limit(0)).head(1)


def test_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 14
    counts = spark.createDataFrame([(1, "en", "a", big), (1, "en", "b", big + 1), (2, "en", "a b", big - 7)], "len int, lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", 10 ** 17 + 3)], "lang string, n long")
    assert col.scored(counts, totals).head().score == 1000 * (big - 7) * (10 ** 17 + 3) // (big * (big + 1))


def test_words_of_a_block():
    texts = ["Ab  c,d", "", "e", "f\tG. h\x0bi"]
    block = col.Words(pa.array(["x"] * 4), pa.array(texts))
    words = block.flat.to_pylist()
    assert words == ["ab", "c", "d", "e", "f", "g", "h", "i"]
    starts = {n: [" ".join(words[i:i + n]) for i in block.inside(n)] for n in (2, 3)}
    assert starts == {2: ["ab c", "f g"], 3: []}
    assert block.phrases(np.array([0, 4]), 2).to_pylist() == ["ab c", "f g"]


def test_keys_tell_phrases_apart():
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abé", k=draw.choice([1, 2, 3, 70, 140]))) for _ in range(300)) for _ in range(4)]
    block = col.Words(pa.array(["en", "de", "en", "und"]), pa.array(texts))
    words, langs = block.flat.to_pylist(), [block.langs[i].as_py() for i in block.lang]
    for half in (0, 1):
        names = {}
        for length, keys in enumerate(block.keys(3), 1):
            for i in block.inside(length).tolist():
                phrase = (langs[i], *words[i:i + length])
                assert names.setdefault(int(keys[half][i]), phrase) == phrase
        assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("bits,room", [(20, 40), (6, 10), (20, 10 ** 6)])
def test_likely_pairs(spark, bits, room):
    rows = [("en" if lang is None else lang, text) for lang, text in corpus(9, 80)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    marked = col.likely_pairs(docs, bits, col.Settings(least=9, room=room))
    block = col.Words(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]))
    at = block.inside(2)
    keys = block.keys(2)[1][0][at]
    slots, n = np.unique(keys >> np.uint64(64 - bits), return_counts=True)
    want = dict(zip(slots.tolist(), (n >= 9).tolist(), strict=True))
    got = np.unpackbits(marked, bitorder="little")
    assert len(got) == 1 << bits and got.sum() == sum(want.values()) > 0
    assert all(got[k] == v for k, v in want.items())
