"""Fill-in-the-middle against a brute force with regular expressions; the rank index by its properties."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wirelens.llm import fill_middle as fim

from test_rows import ODD, odd_docs

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = TOKEN.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, texts):
    made = fim.fill_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, texts(r)), r.doc_id
        assert r.back == (texts(r) or "")
    return made


def test_fill_middle(spark):
    texts = ODD + ["a <P> b", "x<", "P> y", "<S><M>", " lead and trail ", "  é\x0bü ", "\n\n"] * 12
    texts += [" ".join(["word", "longer-word", "é\U0001f600"][(i * i) % 3] * (1 + i % 7) for i in range(k)) for k in range(0, 900, 13)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, form string, n int")
    made = check(docs, lambda r: texts[r.doc_id])
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    made = check(odd_docs(spark, "n string, form string, output string"), lambda r: "a" if r.doc_id is None else ODD[r.doc_id])
    assert len(made) == len(ODD) + 2
    assert not fim.fill_middle(odd_docs(spark).limit(0)).head(1)
    named = spark.createDataFrame([("k", "a b c d")], "doc_id string, text string")
    check(named, lambda r: "a b c d")


def test_very_long_text(spark):
    text = ("some é words  and\nlines " * 250_000)[:-1]  # about 6 MB
    ids = [i for i in range(40) if brute(i, "a b")[1] != "plain"][:3]
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    check(docs, lambda r: text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100_000), max_size=400), st.integers(1, 127), st.integers(1, 64))
def test_rank_index(gaps, max_error, segment):
    offsets = np.cumsum(np.array([0, *gaps], np.int64))
    index = fim.RankIndex(offsets, max_error, segment)
    ranks = np.arange(len(offsets))
    assert np.abs(index.predict(ranks) - offsets).max() <= max_error
    assert (index.lookup(ranks) == offsets).all()


def test_rank_index_is_small():
    gaps = np.random.default_rng(1).integers(2, 12, 100_000)
    index = fim.RankIndex(np.cumsum(gaps))
    assert len(index.starts) < 1000
    with pytest.raises(ValueError):
        fim.RankIndex(np.arange(3), 200)
