"""The suffix tree against dictionaries that repeat counts, divergence test, smoothing and scores from scratch."""

import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from wirelens.llm import common, slot_counts, suffix_tree

from test_rows import ODD, odd_docs
from test_tables import words


def test_tokens_are_words_and_ends():
    texts = ["A bÉ c", "", " \t", "x\x0by\u00a0Z", "ÀB"]
    distinct, codes, first = suffix_tree.tokens(pa.array(texts))
    want = [x for t in texts for x in [*words(t), "\n"]]
    assert distinct.take(pa.array(codes)).to_pylist() == want
    assert first.tolist() == [0, 4, 5, 6, 9]


def test_keys_are_those_of_spark(spark):
    rows = [("é", "b"), ("x" * 40, "x" * 200), ("\n", "the"), ("\r", "a")]
    df = spark.createDataFrame([(*r, *map(suffix_tree.word_key, r)) for r in rows], "a string, b string, ka long, kb long")
    for r in df.withColumn("pair", F.xxhash64("ka", "kb")).collect():
        pair = suffix_tree.chained(np.array([r.ka]).view(np.uint64), np.array([r.kb]).view(np.uint64))
        assert pair.view(np.int64)[0] == r.pair
    texts = spark.createDataFrame([("A bé b",), ("",), ("x" * 130 + " a",)], "text string")
    for r in suffix_tree.word_counts(texts).collect():
        assert r.key == suffix_tree.word_key(r.word)


def test_words_have_keys_of_their_own():
    draw = random.Random(1)
    names = {"".join(draw.choices("abé", k=draw.choice([1, 2, 3, 8, 63, 64, 65, 130]))) for _ in range(20000)}
    assert len({suffix_tree.word_key(w) for w in names}) == len(names)


def test_contexts_of_a_block():
    b = suffix_tree.block(pa.array(["a b c d", "", "e"]), 3)
    names = {}

    def key(*sequence):
        keys = [np.array([suffix_tree.word_key(w)]).view(np.uint64) for w in sequence]
        out = keys[0]
        for k in keys[1:]:
            out = suffix_tree.chained(out, k)
        return names.setdefault(int(out[0]), sequence)

    sequences = [["\r", "a", "b", "c", "d", "\n"], ["\r", "\n"], ["\r", "e", "\n"]]
    i = 0
    for q in sequences:
        for at in range(1, len(q)):
            for k in (1, 2, 3):
                if b.place[i] < k - 1:
                    continue
                key(*q[at - k:at]), key(*q[at - k:at + 1])
                assert names[int(b.context[k - 1][i])] == tuple(q[at - k:at])
                assert names[int(b.following[k - 1][i])] == tuple(q[at - k:at + 1])
            i += 1
    assert i == len(b.word)


def training(spark, n=400):
    draw = random.Random(2)
    chain = {w: draw.choices("abcdefgh", k=3) for w in "abcdefgh"}
    pair = {(v, w): draw.choice("abcdefgh") for v in "abcdefgh" for w in "abcdefgh"}
    rows = []
    for i in range(n):
        text = [draw.choice("abcdefgh")]
        while draw.random() < 0.96:
            if len(text) > 1 and (text[-2], text[-1]) in pair and draw.random() < 0.4:
                text.append(pair[text[-2], text[-1]])
            else:
                text.append(draw.choice(chain[text[-1]]) if draw.random() < 0.9 else f"r{draw.randrange(3000)}")
            if text[-1] not in chain:
                text.append(draw.choice("abcdefgh"))
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text), 0))
    rows += [(n + i, t, 0) for i, t in enumerate(ODD)] + [(None, "a b", 0), (3, "a b", 0), (3, "a b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), rows


class Brute:
    def __init__(self, texts, s):
        self.s, self.n = s, Counter()
        for t in texts:
            q = ["^", *words(t), "\n"]
            for k in range(1, s.depth + 2):
                self.n.update(tuple(q[i:i + k]) for i in range(len(q) - k + 1))
        self.words = Counter({w[0]: n for w, n in self.n.items() if len(w) == 1 and w != ("^",)})
        self.total = sum(self.words.values())
        self.after = defaultdict(dict)
        for q, n in self.n.items():
            if len(q) > 1 and n >= s.least_next and self.n[q[:-1]] >= s.least_context:
                self.after[q[:-1]][q[-1]] = n
        self.kept = set()
        for c in list(self.after):
            if c in self.after and self.diverges(c):
                self.kept |= {c[i:] for i in range(len(c))}

    def root(self, w):
        return (self.words[w] + self.s.added) / (self.total + self.s.added * (len(self.words) + 1))

    def p(self, c, w):
        """In a candidate, retained or not, all of whose suffixes are candidates too."""
        if not c:
            return self.root(w)
        count, found = self.n[c], self.after[c]
        rest = max(1e-12, 1 - sum(n - self.s.discount for n in found.values()) / count)
        return ((found[w] - self.s.discount) / count if w in found else 0) + rest * self.p(c[1:], w)

    def diverges(self, c):
        count, found = self.n[c], self.after[c]
        share = {w: n / count for w, n in found.items()}
        parent = {w: self.p(c[1:], w) for w in found}
        rest = max(1e-12, 1 - sum(share.values()))
        gain = sum(x * math.log(x / parent[w]) for w, x in share.items())
        gain += rest * math.log(rest / max(1e-12, 1 - sum(parent.values())))
        return gain >= self.s.least_divergence and 2 * count * gain >= len(found) + 3 * math.sqrt(2 * len(found))

    def scored(self, history, w):
        for k in range(min(self.s.depth, len(history)), 0, -1):
            if tuple(history[-k:]) in self.kept:
                return self.p(tuple(history[-k:]), w)
        return self.root(w)


SMALL = suffix_tree.Settings(least_context=6, least_next=2, bits=18, room=50)


@pytest.mark.parametrize("settings", [
    SMALL, replace(SMALL, shared_words=3, shared_contexts=2, shared_next=5), replace(SMALL, shared_words=0, shared_contexts=0, shared_next=0, bits=16),
    replace(SMALL, shared_contexts=0, depth=2, least_context=12, least_next=3), replace(SMALL, shared_next=40, shared_contexts=12)])
def test_suffix_tree(spark, settings):
    docs, rows = training(spark)
    got = suffix_tree.fit_and_score(docs, settings=settings).collect()
    assert len(got) == len(rows)
    out = {i for i, _, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0}
    brute = Brute([t for i, t, _ in rows if i not in out], settings)
    assert {len(c) for c in brute.kept} == set(range(1, settings.depth + 1)) and ("^",) in brute.kept
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        if r.doc_id == 3:
            continue
        text = [*words(texts[r.doc_id][0]), "\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in out, len(text), brute.total)
        assert r.n_known == sum(brute.words[w] > 0 for w in text)
        assert math.isclose(r.base_score, sum(math.log10(brute.root(w)) for w in text), rel_tol=1e-9, abs_tol=1e-9)
        history = ["^", *text]
        want = sum(math.log10(brute.scored(history[:k + 1], w)) for k, w in enumerate(text))
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_retained_contexts(spark):
    docs, rows = training(spark, 200)
    tree = suffix_tree.fit(docs.selectExpr("coalesce(text, '') AS text"), SMALL)
    brute = Brute([t for _, t, _ in rows], SMALL)

    def key(sequence):
        out = np.array([suffix_tree.word_key("\r" if sequence[0] == "^" else sequence[0])]).view(np.uint64)
        for w in sequence[1:]:
            out = suffix_tree.chained(out, np.array([suffix_tree.word_key(w)]).view(np.uint64))
        return int(out.view(np.int64)[0])

    assert sorted(r.key for r in tree.contexts.collect()) == sorted(key(c) for c in brute.kept)
    # next words of a context, and what is left over, add up to one
    vocabulary = [*brute.words, "never seen"]
    for c in [(), *sorted(brute.kept)[:40]]:
        assert math.isclose(sum(brute.p(c, w) for w in vocabulary), 1, rel_tol=1e-9)


def test_rare_contexts_stay_in_large_corpora(spark):
    """A passage seen 20 times keeps its contexts, however much other text there is."""
    passage, kept = "quite rare words that stand here in a row", []
    for size in (200, 6000):
        draw = random.Random(3)
        texts = [" ".join(draw.choices("abcdefghijklmnop", k=30)) for _ in range(size)] + [passage] * 20
        tree = suffix_tree.fit(spark.createDataFrame([(t,) for t in texts], "text string"))  # as in the query
        kept.append({r.key for r in tree.contexts.collect()})
    keys = [np.array([suffix_tree.word_key(w)]).view(np.uint64) for w in passage.split()]
    for i in range(len(keys) - 3):
        three = suffix_tree.chained(suffix_tree.chained(keys[i], keys[i + 1]), keys[i + 2])
        for key in (keys[i], three):
            assert all(int(key.view(np.int64)[0]) in k for k in kept) == all(int(key.view(np.int64)[0]) in k for k in kept[:1])
    assert int(keys[0].view(np.int64)[0]) in kept[0] & kept[1]


def test_suffix_tree_empty(spark):
    docs = odd_docs(spark)
    assert not suffix_tree.fit_and_score(docs.limit(0)).head(1)
    r = suffix_tree.fit_and_score(docs.where("doc_id = 0")).head()
    assert (r.n_tokens, r.held_out) == (1, zlib.crc32(b"0") % 10 == 0)


def test_very_long_text(spark):
    text = "one long text that says the same again and again " * 60_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.fit_and_score(docs).collect()}
    assert got[1].n_tokens == 600_001 and got[1].score > got[1].base_score and got[3].n_tokens == 1


def test_lookups_are_shuffled_once(spark):
    """What tasks cannot tell is shuffled to the tables and back as sums, without a copy of it beside."""
    docs, _ = training(spark, 60)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = suffix_tree.fit_and_score(docs, settings=replace(SMALL, shared_words=0, shared_contexts=0, shared_next=0))
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert plan.count("hashpartitioning(") == 4  # lookups, tables, sums per text, texts


def test_slot_pieces_keep_their_numbers():
    draw = np.random.default_rng(4)
    numbers = draw.geometric(1 / 300, 50_000).astype(np.uint32)
    numbers[:3] = 0, 1 << 31, (1 << 32) - 1
    packed = slot_counts._packed(numbers)
    assert (slot_counts._unpacked(packed, len(numbers)) == numbers).all()
    assert len(slot_counts._unpacked(slot_counts._packed(numbers[:0]), 0)) == 0
    assert len(packed) < 1.4 * len(numbers)  # 1.68 with the bytes of a number side by side


def test_bitmaps_and_lookups(spark):
    draw = np.random.default_rng(1)
    keys = draw.integers(-(1 << 63), 1 << 63, 3000, np.int64)
    rows = spark.createDataFrame([(int(k),) for k in keys[:1500]], "key long")
    bits = common.bitmap(rows, 20)
    found = common.in_bitmap(bits, keys.view(np.uint64), 20)
    assert found[:1500].all() and found[1500:].mean() < 0.02 and len(bits) == 1 << 17
    left = spark.createDataFrame([(int(k), i) for i, k in enumerate(np.append(keys[:200], [keys[0]] * 300))] + [(None, -1)], "key long, i long")
    right = spark.createDataFrame([(int(k), 301 if i == 0 else 1, i) for i, k in enumerate(keys[:150])], "key long, n long, v long")
    got = {r.i: r.found.v if r.found else None for r in common.lookup(left, right, "key", "n", most=20).collect()}
    assert got == {**{i: i if i < 150 else None for i in range(200)}, **{i: 0 for i in range(200, 500)}, -1: None}
