"""Row-by-row operators against brute force, with nulls, empty texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import pytest
from wirelens.llm import chat_format, host_reputation, pii, quality, queries, token_counts, weighted_tree

ODD = [None, "", " \n\t", "a", "a b", "a b c a b c", "#*$ % x|y", "é\U0001f600 ß \u00a0 x", "w " * 3000, "x\n\nx\n x\nx",
       "the of and to " * 20]


def odd_docs(spark, extra="n_words string, kept string, shard string"):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(3, "a", "x", "y", "z"), (None, "a", None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_quality_counts(spark):
    got = quality.judge(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "a" if r.doc_id is None else ODD[r.doc_id]
        want = brute_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert not quality.judge(odd_docs(spark).limit(0)).head(1)
    assert quality.keep(odd_docs(spark)).columns == ["doc_id", "text", "n_words", "kept", "shard"]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_patterns():
    draw = random.Random(5)
    for _ in range(20000):
        text = "".join(draw.choice("0123456789....@@++ -()a_%é") for _ in range(draw.randint(0, 40)))
        assert [s for s in pii.spans(text) if s[2] in pii.BASE_KINDS] == brute_spans(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1111x 4111111111111111", "é 10.0.0.255.1.2.3.4", "+1 (456) 555-2186"):
        assert brute_spans(text)
        assert [s for s in pii.spans(text) if s[2] in pii.BASE_KINDS] == brute_spans(text)


def test_added_spans():
    found = {text[a:b]: k for text in (
        "see https://bob:pw12@host.example.com/x now", "IBAN: DE89370400440532013000 ok", "account no. 12345678 and",
        'token = "ab12cd34ef" x') for a, b, k in pii.spans(text) if k not in pii.BASE_KINDS}
    assert found == {"https://bob:pw12@host.example.com": "url", "DE89370400440532013000": "account",
                     "12345678": "account", "ab12cd34ef": "secret"}
    assert pii.spans("the account was open and the token is a word") == []
    assert pii.redact("a bob@x.example.com b") == "a [EMAIL] b"
    assert pii.redact("") == ""


def test_added_spans_are_whole():
    long = "eyJhbGciOiJIUzI1NiJ9." + "a1B2_c3-" * 50
    for text, kind, value in (
            (f"token={long} x", "secret", long), (f"token: '{long}' x", "secret", long), (f'password = "{long}"', "secret", long),
            ("aPi_KeY=QUJDRE5GRzE= x", "secret", "QUJDRE5GRzE="), ("tOkEn=ab12cd34ef", "secret", "ab12cd34ef"),
            ("IBAN DE89370400440532013000", "account", "DE89370400440532013000"),
            ("iBan is DE89 3704 0044 0532 0130 00 was used", "account", "DE89 3704 0044 0532 0130 00"),
            ("SSN 123-45-6789 x", "account", "123-45-6789"), ("account number is 12345678", "account", "12345678"),
            ("\u0130 Account No. 12345678 \u0130", "account", "12345678"), ("passport  C01X00T478", "account", "C01X00T478"),
            ("password=abcdefg1!secretTAIL x", "secret", "abcdefg1!secretTAIL"), ("password=Ab!23defgh1, and", "secret", "Ab!23defgh1"),
            ('password: "my pass phrase 7" x', "secret", "my pass phrase 7"), ("token='a 1 b \" c' x", "secret", 'a 1 b " c'),
            ('token="open1234 x', "secret", "open1234"), ("(secret: abc#12345).", "secret", "abc#12345"),
            ("x://" + "u" * 300 + ":pw@host.example.com/a", "url", "x://" + "u" * 300 + ":pw@host.example.com"),
            ("account: " + "1234 5678 " * 9 + "and on", "account", ("1234 5678 " * 9).strip()),
            ("account: " + "7" * 90, "account", "7" * 90), ("account no. AB 123456 was", "account", "AB 123456"),
            ("iban: GB29 NWBK 6016 1331 9268 19 and 5", "account", "GB29 NWBK 6016 1331 9268 19"),
            ("account: see 12345678", "account", "12345678")):
        assert [text[a:b] for a, b, k in pii.spans(text) if k == kind] == [value], text
        assert value not in pii.redact(text)
    for text in ("account has 3 items and 12345678", "account is open", "IBAN of the account", "account 2024", "account is 12345"):
        assert [s for s in pii.spans(text) if s[2] == "account"] == [], text


def test_many_cues_in_a_long_text():
    text = "account: none token = abc password: 'x " * 20_000 + "token=" + "k9" * 300_000
    assert [(b - a, k) for a, b, k in pii.spans(text)] == [(600_000, "secret")]
    assert pii.redact(text).endswith("token=[SECRET]")


def test_pii_tables(spark):
    docs = odd_docs(spark)
    assert pii.find(docs).count() == len(ODD) + 2
    same = pii.redacted(docs)
    assert same.columns == docs.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert not pii.find(docs.limit(0)).head(1)


def test_url_rules(spark):
    urls = [("http://A.Example.ORG/es/1", "example.org/es/", "block"), ("x://example.org/en/12", "example.org/en/1", "block"),
            ("x://example.org/en/2", "org/", "allow"), ("x://example.org", None, None), ("x://a.com/fr/", "com/fr/", "allow"),
            ("x://a.com/de/x?y", "com/de/", "block"), (None, None, None), ("no scheme", None, None)]
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, n string")
    bad = spark.createDataFrame([(0, 1), (0, 1), (1, None), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in host_reputation.judge(pages, bad, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, (_, rule, verdict) in enumerate(urls):
        assert got[i].rule == rule
        assert got[i].verdict == verdict or verdict is None
    assert not host_reputation.judge(pages.limit(0), bad.limit(0), queries.URL_RULES).head(1)


def test_outcomes_of_pages(spark):
    words = "the quick words of a page that says something new in every line " * 8
    plain = " ".join(f"{w}{i}" for i, w in enumerate(words.split()))
    html = [f"<html><script>var x = '{plain}';</script><p>{plain}</p><!-- # # -->", "<p>short</p>", None, "",
            f"<p>{plain.replace(' ', ' &amp;&amp; ')}</p>", f"<style>##</style><b>{'one two three four ' * 40}</b>",
            f"<p>{plain}</p>" * 1 + "<br>" * 200_000]
    rows = [(i, f"http://h{i}.net/", h, "x", 1) for i, h in enumerate(html)] + [(1, "http://h1.net/", f"<p>{plain}</p>", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_words int")
    got = sorted((r.page_id, r.bad) for r in host_reputation.outcomes(pages).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 0)]
    assert not host_reputation.outcomes(pages.limit(0)).head(1)
    # a repeated page and its outcomes count once, as bad if one outcome is
    hosts = {r.host: (r.n, r.bad) for r in host_reputation.host_counts(pages, host_reputation.outcomes(pages)).collect()}
    assert hosts["h1.net"] == (1, 1) and hosts["h0.net"] == (1, 0)


def test_the_method_blocks_on_given_pages(spark):
    judged = queries.op5_host_reputation(spark, "/root/testdata/sf0.1")
    got = judged.where("rule IS NULL").groupBy("verdict").agg({"host": "count"}).collect()
    counts = {r.verdict: r[1] for r in got}
    assert counts["block"] > 0 and counts["allow"] > 20 * counts["block"]


def test_bad_hosts_are_blocked(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h', id % 8, '.d', id % 2, '.net/p') AS url")
    bad = spark.range(300).selectExpr("id AS page_id", "int(id % 8 = 3) AS bad")
    got = host_reputation.judge(pages, bad, []).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"h3.d1.net"}


def test_one_more_shard_only_takes(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', int(id % 7)) AS text", "1 AS shard", "2 AS size")
    rows = weighted_tree.assign(docs, 40, rows_per_task=5).collect()
    assert len(rows) == 20000
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(40))
    for shard, held in by.items():
        assert abs(len(held) - 500) < 120
        ordered = sorted(held, key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
        assert [r.slot for r in ordered] == list(range(len(held))), shard
    r = rows[5]
    assert r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7)) and r.size == 16 + r.doc_id % 7


def test_sharding_odd_rows(spark):
    rows = weighted_tree.assign(odd_docs(spark), 40).collect()
    assert len(rows) == len(ODD) + 2
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert not weighted_tree.assign(odd_docs(spark).limit(0), 40).head(1)


def brute_shard(key, tree):
    """The smallest of -ln(u) / weight among regions, then racks, then shards, u from the md5 of key and name."""
    def draw(name, weight):
        u = (int(hashlib.md5((key + name).encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -math.log(u) / weight

    leaves = [leaf for leaf in tree if leaf.weight > 0]
    for name in (lambda x: f"/{x.region}", lambda x: f"/{x.region}/{x.rack}", lambda x: f"/{x.region}/{x.rack}/{x.shard}"):
        weights = {}
        for leaf in leaves:
            weights[name(leaf)] = weights.get(name(leaf), 0.0) + leaf.weight
        best = min(weights, key=lambda n: draw(n, weights[n]))
        leaves = [leaf for leaf in leaves if name(leaf) == best]
    return leaves[0].shard


def test_shards_by_brute_force(spark):
    docs = spark.range(600).selectExpr("if(id = 0, null, concat('k\u00e9', id)) AS doc_id", "'t' AS text")
    for r in weighted_tree.assign(docs, 40).collect():
        key = r.doc_id or ""
        assert (r.shard, r.grown_shard) == (brute_shard(key, weighted_tree.topology(40)), brute_shard(key, weighted_tree.topology(41)))


def test_rows_of_a_hot_key_are_numbered_by_task(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS doc_id", "repeat('x', int(id % 5)) AS text").repartition(6)
    rows = weighted_tree.assign(docs, 40, rows_per_task=100).collect()
    assert len(rows) == 3000
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in rows if r.doc_id == 7}) == len({r.shard for r in rows if r.doc_id is None}) == 1


def test_weights(spark):
    tree = [weighted_tree.Leaf(0, 0, 0, 1.0), weighted_tree.Leaf(0, 1, 1, 3.0), weighted_tree.Leaf(1, 0, 2, 4.0),
            weighted_tree.Leaf(1, 0, 3, 0.0)]
    got = dict(spark.range(16000).selectExpr(f"{weighted_tree.shard_sql('cast(id as string)', tree)} AS s")
               .groupBy("s").count().collect())
    assert set(got) == {0, 1, 2} and abs(got[0] - 2000) < 200 and abs(got[1] - 6000) < 300


def test_chats_with_text_ids(spark):
    rows = [("b", 1, "assistant", "two"), ("b", 0, "user", "one"), (None, 0, "user", "x"), ("a", 0, "assistant", "y"), (None, 1, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.chat_format(turns)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {"a": (1, 1), "b": (2, 3), None: (2, 1)}
    assert got["b"].turns_sha256 == hashlib.sha256(b"user\none\nassistant\ntwo\n").hexdigest()


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "", None, "\\", "\\\\</s>", "<s>\n<<SYS>>x<</SYS>>", "é\U0001f600[INST]" * 50, "[\\INST]"]
    rows = [(c, t, r, odd[(c + t) % len(odd)], "x") for c in range(12) for t, r in enumerate(["system", "user", "assistant", None, "a\nb\\"])]
    rows += [(None, None, "assistant", "x", "y"), (None, 1, "user", None, "y"), (3, 1, "user", odd[4], "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    by = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for buffer in (1, 1 << 20):
        got = chat_format.chat_format(turns, buffer=buffer).collect()
        assert len(got) == 13
        for r in got:
            assert chat_format.parse(r.formatted) == by[r.conv_id]
            want = "".join(x for role, x in by[r.conv_id] if role == "assistant")
            assert chat_format.loss_text(r.formatted, r.loss_start, r.loss_end) == want
            bare = r.formatted.replace("<s>", "", 0)
            assert bare.count("</s>") == len(by[r.conv_id]) and "[INST]" not in bare
    assert not chat_format.chat_format(turns.limit(0)).head(1)


def test_frequent_pieces_cover_all_texts(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = [" ".join(f"only{i}x{k}" for k in range(30)) + " common words" for i in range(400)] + ["x" * 500_000, None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    table = token_counts.frequent_pieces(docs, "text", path, table_size=50)
    assert {" common", " words"} <= set(table) and len(table) <= 50
    got = token_counts.count_batch([t or "" for t in texts], table, path)
    assert got == token_counts._lengths(path, [t or "" for t in texts])
    assert all(len(p) <= token_counts.WorkerCache.longest for p in token_counts._CACHES[path])


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    draw = random.Random(3)
    pool = ["a", "the", " ", "  ", "\n", "\t ", "\r\n", "\u00a0", "\u2003", "\x1c", "é", "don't", "12", "<|endoftext|>", "...", "\u3000", "\x85"]
    texts = [t or "" for t in ODD] + ["".join(draw.choices(pool, k=draw.randint(1, 30))) for _ in range(3000)]
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_batch(texts, {" the": 1}, path) == want
    got = token_counts.token_counts(odd_docs(spark), path).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "a" if r.doc_id is None else ODD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(whole.encode(text, add_special_tokens=False).ids))
    assert not token_counts.token_counts(odd_docs(spark).limit(0), path).head(1)
