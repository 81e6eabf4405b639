"""The pipeline against brute force, and its stages on odd tables."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from wirelens.llm import decontaminate, quality, queries, transducer

from test_rows import brute_quality, brute_spans
from test_tables import ITEM, brute_components, brute_template

STOPS = set(quality.STOP_WORDS)


def corpus():
    draw = random.Random(8)
    pool = [f"w{i}x" for i in range(300)] + ["the", "of", "and", "to"] * 40
    rows = []
    for i in range(40):
        base = draw.choices(pool, k=draw.randint(60, 120))
        if i % 9 == 0:
            base += ITEM.split()
        if i % 7 == 0:
            base += ["mail", "bob@x.example.com", "+1 (456) 555-2186"]
        for _ in range(draw.randint(1, 4)):
            text = list(base)
            for _ in range(draw.choice([0, 1, 3])):
                text[draw.randrange(len(text))] = draw.choice(pool)
            rows.append(" ".join(text))
    rows += [None, "", "short text", " ".join(["the same line"] * 40), "%%% the and of to " * 60]
    draw.shuffle(rows)
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]
    return out + [out[5], (None, rows[0], None, None, None)]


def passes(text):
    n, chars, symbols, dup, repeat = brute_quality(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n >= 50 and 100 * repeat <= 50 * n and 2 <= chars / n <= 15 and symbols / n <= 0.25
            and sum(w in STOPS for w in words) / n >= 0.02 and dup / len(lines) <= 0.5 and n / len(lines) <= 5000)


def leaked(text):
    """Whether 13 template tokens in a row, or the whole item, stand in the text."""
    a, b = [t for t, _ in brute_template(text)], [t for t, _ in brute_template(ITEM)]
    windows = {tuple(b[i:i + 13]) for i in range(len(b) - 12)}
    return any(tuple(a[i:i + 13]) in windows for i in range(len(a) - 12))


@pytest.fixture()
def sf_dir_of(spark, tmp_path):
    def write(rows, items):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
            f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_pipeline(spark, sf_dir_of):
    rows = corpus()
    got = corpus_pipeline.run(spark, sf_dir_of(rows, [(0, ITEM), (1, None)])).collect()
    kept = [(i, t) for i, t, *_ in rows if passes(t)]
    # every row is a document of its own; of a group that with the least id stays, a null id last
    groups = brute_components([(k, t) for k, (_, t) in enumerate(kept)], 5, 80, 100)
    least = {}
    for k, (i, _) in enumerate(kept):
        best = (i is None, i or 0, k)
        least[groups[k][1]] = min(best, least.get(groups[k][1], best))
    kept = dict(kept[k] for _, _, k in least.values())
    kept = {i: t for i, t in kept.items() if not leaked(t)}
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in got)
    machine = transducer.load(queries.tokenizer_path("piece_bpe_32k.model"))
    for r in got:
        text, end, out = kept[r.doc_id], 0, ""
        for a, b, kind in brute_spans(text):
            out, end = out + text[end:a] + f"[{kind.upper()}]", b
        ids = machine.encode(out + text[end:])
        assert r.round_trip and r.ids == ids.tolist()
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def test_copies_in_other_case_go(spark, sf_dir_of):
    pad, sums = "some clean words stand here. ", "3 4 5 6 7 8 9 10 11 12 13 14 15 16 17"
    texts = [pad + ITEM.upper(), pad + ITEM.lower() + " " + pad, pad + ITEM.title(), pad + sums + " " + pad, pad + "Two small Birds!", pad,
             pad + " ".join(ITEM.split()[:12]).upper(), None, ""]
    path = sf_dir_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)],
                     [(0, ITEM), (1, sums), (2, "two small birds"), (3, None), (4, "?!"), (None, pad)])
    docs, items = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "benchmark"))
    want = {(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)}
    for settings in (decontaminate.DEFAULT, decontaminate.Settings(broadcast_rows=0)):
        assert {tuple(r) for r in decontaminate.copied(docs, items, settings).collect()} == want
    assert not decontaminate.copied(docs, items.limit(0)).head(1)
    assert {r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, path).collect()} == {5, 6, 7, 8}


def test_stages_on_odd_tables(spark, sf_dir_of):
    path = sf_dir_of([(0, None, None, None, None), (None, None, None, None, None), (1, "", "x", "y", 0)], [(0, None)])
    odd = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS n_words", "'x' AS row", "0 AS star")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count()
    assert decontaminate.DEFAULT.window == 8


def test_rows_that_share_an_id_or_have_none(spark, sf_dir_of):
    """Rows are judged one by one: what shares an id but not its text stays, copies and leaks go whatever their id."""
    draw = random.Random(4)
    pool = [f"w{i}x" for i in range(400)]
    one, two, three = (" ".join(draw.choices(pool, k=60)) for _ in range(3))
    rows = [(1, one), (1, two), (2, one), (None, one), (None, three), (None, three), (3, three + " " + ITEM), (None, two + " " + ITEM), (5, None), (5, "")]
    path = sf_dir_of([(i, t, "en", "s", 0) for i, t in rows], [(0, ITEM), (1, "the")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    near = corpus_pipeline.near_duplicates(spark, docs, path)
    assert near.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    kept = [(1, one), (1, two), (None, three), (3, three + " " + ITEM), (None, two + " " + ITEM), (5, None), (5, "")]
    assert got == sorted(kept, key=str)
    clean = corpus_pipeline.decontaminated(spark, docs, path)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(
        [x for x in rows if not (x[1] or "").endswith(ITEM)], key=str)


def test_one_word_items_do_not_empty_the_corpus(spark, sf_dir_of):
    texts = ["the day of the year and the words of it", "a clean text", "and then: the. The end"]
    path = sf_dir_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)], [(0, "the"), (1, "of")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, path).collect()} == {0, 1}
