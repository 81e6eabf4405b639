"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.workspace import scratch_path

from . import (
    chat_format,
    collocations,
    decontaminate,
    fill_middle,
    host_reputation,
    jaccard_join,
    pii,
    quality,
    suffix_tree,
    token_counts,
    transducer,
    warc,
    weighted_tree,
)
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Fixed values of the query on URLs: (action, host/path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]
#: Fixed values of the query on chats: an extra conversation full of control strings.
ODD_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
SHARDS = 40


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = f"filter(spans, s -> s.kind IN ({', '.join(repr(k) for k in pii.BASE_KINDS)}))"
    count = "cast(size(filter(spans, s -> s.kind = '{0}')) AS bigint) AS n_{0}"
    return found.selectExpr(
        "doc_id", *[count.format(k) for k in pii.BASE_KINDS],
        f"sha2({joined.format(base)}, 256) AS base_sha256", f"{joined.format('spans')} AS spans",
        *[count.format(k) for k in ("url", "account", "secret")],
    )


def _templates_sql(name: str, key: str, source: str) -> str:
    """CTEs ending in `name` (k, pos, t, v, n) and `name`_w (k, pos, tw, literals): template tokens and windows of 8."""
    edges = "'" + decontaminate.EDGES.replace("'", "''").replace("\n", "") + "' || chr(10)"
    units = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
    return f"""{name}_r AS (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT DISTINCT {key} AS k,
        string_split_regex(replace(coalesce(text, ''), chr(10), ' ' || chr(10)), '[\\x20\\x09\\x0B-\\x0D]+') AS ws
        FROM {source} WHERE {key} IS NOT NULL)),
{name}_c AS (SELECT k, i, w, trim(w, {edges}) AS c, lag(w) OVER (PARTITION BY k ORDER BY i) AS p FROM {name}_r),
{name}_t AS (SELECT k, i, c AS v, CASE WHEN c[1] BETWEEN '0' AND '9' THEN '<num>'
        WHEN lower(c) IN ({units}) AND trim(p, {edges})[1] BETWEEN '0' AND '9' THEN '<unit>'
        WHEN c[1] <> lower(c[1]) AND NOT (i = 0 OR starts_with(w, chr(10)) OR right(p, 1) IN ('.', '!', '?', ':', ''))
            THEN '<name>' ELSE lower(c) END AS t FROM {name}_c WHERE c <> ''),
{name}_m AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY i) AS q FROM {name}_t),
{name} AS (SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY i) AS pos, count(*) OVER (PARTITION BY k) AS n
    FROM {name}_m WHERE NOT coalesce(t = '<name>' AND q = '<name>', false)),
{name}_w AS (SELECT k, pos, n, array_to_string(ts, ' ') AS tw,
        len(list_filter(ts, lambda z: z NOT IN ('<num>', '<unit>', '<name>'))) AS literals
    FROM (SELECT k, pos, n, list(t) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ts
        FROM {name}) WHERE len(ts) = 8)"""


def _literals_sql(name: str) -> str:
    """CTEs ending in `name`_l (k, pos, lw, n): windows of 13 plain words."""
    wide = f"""{name}_o AS (SELECT k, lower(c) AS c, row_number() OVER (PARTITION BY k ORDER BY i) AS pos,
    count(*) OVER (PARTITION BY k) AS n FROM {name}_c WHERE c <> '')"""
    return f"""{wide},
{name}_l AS (SELECT k, pos, n, array_to_string(ws, ' ') AS lw FROM (SELECT k, pos, n,
    list(c) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ws FROM {name}_o)
    WHERE len(ws) = 13)"""


# no item of the given benchmark has fewer than 8 template tokens or 13 words, so each has whole windows
@query(f"""WITH {_templates_sql('d', 'doc_id', 'documents')}, {_templates_sql('b', 'item_id', 'benchmark')},
met AS (SELECT d_w.k AS doc_id, b_w.k AS item_id, d_w.pos - b_w.pos AS diagonal, b_w.pos AS item_p, b_w.n AS item_tokens
    FROM d_w JOIN b_w USING (tw) WHERE b_w.literals >= 4),
hit AS (SELECT DISTINCT doc_id, item_id, diagonal, item_tokens, unnest(range(item_p, item_p + 8)) AS pos FROM met),
runs AS (SELECT doc_id, item_id, diagonal, item_tokens, count(*) AS matched_tokens FROM hit GROUP BY ALL),
pairs AS (SELECT doc_id, item_id, diagonal, b.t AS kind, b.v AS old, count(DISTINCT d.v) AS n, max((d.v <> b.v)::INT) AS changed
    FROM hit JOIN b ON b.k = item_id AND b.pos = hit.pos JOIN d ON d.k = doc_id AND d.pos = hit.pos + diagonal
    WHERE b.t IN ('<num>', '<unit>', '<name>') GROUP BY ALL),
slots AS (SELECT doc_id, item_id, diagonal, count(*) AS n_slots, sum(changed) AS changed_slots,
    count(*) FILTER (n = 1) AS consistent_slots FROM pairs GROUP BY ALL),
judged AS (SELECT doc_id, item_id, matched_tokens, item_tokens, coalesce(n_slots, 0) AS n_slots,
    coalesce(changed_slots, 0) AS changed_slots, coalesce(consistent_slots, 0) AS consistent_slots
    FROM runs LEFT JOIN slots USING (doc_id, item_id, diagonal)
    WHERE matched_tokens >= least(13, ceil(0.8 * item_tokens)) AND coalesce(consistent_slots >= 0.9 * n_slots, true)),
best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY doc_id, item_id
    ORDER BY matched_tokens DESC, consistent_slots DESC, n_slots DESC, changed_slots, item_tokens DESC) = 1),
{_literals_sql('d')}, {_literals_sql('b')},
same AS (SELECT d_l.k AS doc_id, b_l.k AS item_id, b_l.n AS words, unnest(range(b_l.pos, b_l.pos + 13)) AS pos
    FROM d_l JOIN b_l USING (lw)),
copies AS (SELECT doc_id, item_id, words, count(DISTINCT pos) AS matched FROM same GROUP BY ALL)
SELECT doc_id, item_id, coalesce(matched_tokens, matched)::BIGINT AS matched_tokens, coalesce(item_tokens, words)::BIGINT AS item_tokens,
    coalesce(n_slots, 0)::BIGINT AS n_slots, coalesce(changed_slots, 0)::BIGINT AS changed_slots,
    coalesce(consistent_slots, 0)::BIGINT AS consistent_slots, matched_tokens IS NOT NULL AS typed, matched IS NOT NULL AS copied
FROM best FULL JOIN copies USING (doc_id, item_id)""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_MEASURES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
    SELECT r, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d)),
wc AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (w IN ({stops})) AS n_stop FROM w GROUP BY r),
g AS (SELECT r, i, w || ' ' || w1 || ' ' || w2 AS g FROM (
    SELECT r, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE w2 IS NOT NULL),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT r, i AS p FROM again UNION ALL SELECT r, i + 1 FROM again UNION ALL SELECT r, i + 2 FROM again) GROUP BY r),
ls AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ls
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0)::BIGINT AS n_stop,
    coalesce(n_lines, 0)::BIGINT AS n_lines
    FROM d LEFT JOIN wc USING (r) LEFT JOIN rw USING (r) LEFT JOIN lc USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(word_chars / n_words < 2 OR word_chars / n_words > 15 OR n_symbols / n_words > 0.25
        OR n_stop / n_words < 0.02, false)
        OR coalesce(n_dup_lines / n_lines > 0.5 OR n_words / n_lines > 5000, false) AS other_failed FROM m)
""".replace("{stops}", ", ".join(f"'{w}'" for w in quality.STOP_WORDS))


@query(_MEASURES + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT other_failed AS kept, n_stop, n_lines FROM j""")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "n_stop", "n_lines")


@query()
def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree.fit_and_score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _rules_sql() -> str:
    fits = []
    for _, rule in URL_RULES:
        host, _, rest = rule.partition("/")
        fits.append(f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')")
    longest = sorted(range(len(URL_RULES)), key=lambda i: -len(URL_RULES[i][1]))
    rule = " ".join(f"WHEN {fits[i]} THEN '{URL_RULES[i][1]}'" for i in longest)
    act = " ".join(f"WHEN {fits[i]} THEN '{URL_RULES[i][0]}'" for i in longest)
    return f"CASE {rule} END AS rule, CASE {act} END AS act"


def _strength_sql(rows: str, parent: str) -> str:
    return f"""(SELECT 1 / least(greatest(coalesce(CASE WHEN below > 0 THEN (between_ - within_) / below ELSE 0 END, 0), 0.02), 0.5) - 1 AS s
    FROM (SELECT *, between_ + (typical - 1) * within_ AS below FROM (SELECT
        sum(n * (bad / n - {parent}_bad / {parent}_n) ** 2) / greatest(count(*) - 1, 1) AS between_,
        sum(n * (bad / n) * (1 - bad / n)) / greatest(sum(n) - count(*), 1) AS within_,
        (sum(n) - sum(n * n) / sum(n)) / greatest(count(*) - 1, 1) AS typical FROM {rows})))"""


_PAGE_TEXTS = r"""SELECT page_id AS doc_id, replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM pages"""


@query(_MEASURES.replace("WITH ", f"WITH documents AS ({_PAGE_TEXTS}),", 1) + rf""",
o AS (SELECT doc_id AS page_id, max((n_words < 50 OR n_symbols / n_words > 0.1 OR 100 * n_repeat_words / n_words > 50)::INT) AS bad
    FROM j GROUP BY doc_id),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
    FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN o USING (page_id) GROUP BY host),
b AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare,
        regexp_matches(regexp_replace(host, ':[0-9]*$', ''), '[.](co|com|org|net|ac|gov|edu|or|ne)[.][a-z]{{2}}$') AS two FROM h),
c AS (SELECT host, n, bad, CASE WHEN two THEN regexp_extract(bare, '([^.]*[.][^.]*)$', 1)
        ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix,
        CASE WHEN two THEN regexp_extract(bare, '([^.]*[.]?[^.]*[.][^.]*)$', 1)
        ELSE regexp_extract(bare, '([^.]*[.]?[^.]*)$', 1) END AS domain FROM b),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY ALL),
sf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dm GROUP BY ALL),
al AS (SELECT sum(n) AS n, sum(bad) AS bad, (sum(bad) + 1) / (sum(n) + 2) AS mean FROM sf),
l0 AS (SELECT sf.n, sf.bad, al.n AS all_n, al.bad AS all_bad FROM sf, al WHERE sf.n > 0),
l1 AS (SELECT dm.n, dm.bad, sf.n AS suffix_n, sf.bad AS suffix_bad FROM dm JOIN sf USING (suffix) WHERE dm.n > 0),
l2 AS (SELECT c.n, c.bad, dm.n AS domain_n, dm.bad AS domain_bad FROM c JOIN dm USING (domain, suffix) WHERE c.n > 0),
st AS (SELECT {_strength_sql('l0', 'all')} AS s0, {_strength_sql('l1', 'suffix')} AS s1, {_strength_sql('l2', 'domain')} AS s2),
ms AS (SELECT suffix, (sf.bad + mean * s0) / (sf.n + s0) AS m FROM sf, al, st),
md AS (SELECT domain, suffix, (dm.bad + m * s1) / (dm.n + s1) AS m FROM dm JOIN ms USING (suffix), st),
po AS (SELECT host, n, bad, bad + m * s2 AS a, n + s2 AS ab FROM c JOIN md USING (domain, suffix), st),
bo AS (SELECT host, n, bad, a / ab - 1.282 * sqrt(a / ab * (1 - a / ab) / (ab + 1)) AS bound, (SELECT mean FROM al) AS bad_limit FROM po)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN bound > bad_limit THEN 'block' ELSE 'allow' END) AS verdict,
    n::BIGINT AS host_n, bad::BIGINT AS host_bad, round(bound, 6) AS bound
FROM (SELECT *, {_rules_sql()} FROM p) LEFT JOIN bo USING (host)""")
def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = host_reputation.judge(pages, host_reputation.outcomes(pages), URL_RULES)
    return judged.withColumn("bound", F.round("bound", 6))


@query()
def op6_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s WHERE len(ws) >= 3),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w
        WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM s WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(g) AS n FROM s LEFT JOIN g USING (doc_id) GROUP BY doc_id),
z AS (SELECT doc_id, g, n FROM g JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS m, any_value(a.n) AS ni, any_value(b.n) AS nj
    FROM z a JOIN z b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
e AS (SELECT i, j FROM p WHERE 100 * m >= 90 * (ni + nj - m)),
reach AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT e.j, reach.m FROM reach JOIN e ON e.i = reach.d),
c AS (SELECT d AS doc_id, min(m) AS component_id FROM reach GROUP BY d),
same AS (SELECT i AS doc_id, min(j) AS other FROM p WHERE m = ni AND m = nj GROUP BY i)
SELECT doc_id, n AS n_shingles, component_id, least(doc_id, coalesce(other, doc_id)) AS class_id
FROM n JOIN c USING (doc_id) LEFT JOIN same USING (doc_id)""")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id", "class_id")


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\\\|</?s>|\\[/?INST\\]|<</?SYS>>'))
    + length(role) + len(regexp_extract_all(role, '\\\\|\\n|</?s>|\\[/?INST\\]|<</?SYS>>')) + 8 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.chat_format(turns.unionByName(odd)))


@query()
def op9_weighted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = weighted_tree.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, strlen(p)::BIGINT AS payload_bytes, sha256(p) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM f""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write(pages, path)
    back = warc.read(spark, path, pages.schema["page_id"].dataType.simpleString(), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""
WITH p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, len, array_to_string(ws[i:i + len - 1], ' ') AS phrase, count(*) AS a
    FROM i, (SELECT unnest(range(1, 6)) AS len) WHERE i + len - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM g WHERE len = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE a >= 100),
k AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, len)) AS k FROM f WHERE len >= 2),
s AS (SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * k.a * n) // (l.a::HUGEINT * r.a) AS score
    FROM k JOIN n USING (lang) JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ')
    JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
c AS (SELECT DISTINCT f.lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, f.a AS longer FROM (
    SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE len >= 3) f, (SELECT unnest(range(2, 5)) AS size),
    (SELECT unnest(range(1, 5)) AS i) WHERE size < f.len AND i + size - 1 <= f.len),
d AS (SELECT * FROM b WHERE NOT EXISTS (FROM c WHERE c.lang = b.lang AND c.phrase = b.phrase AND 100 * longer >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a,
    l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM d QUALIFY rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_CUTS = "'[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'"


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, {_CUTS}) AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
    ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
    array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
