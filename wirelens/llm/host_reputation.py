"""URL filters: rules of a list, else a host's reputation by empirical Bayes.

Labelled outcomes of pages are counted per host. Rates are shrunk level by level: all pages -> suffix ->
registered domain -> host. Each level's beta prior has the posterior mean of the level above; its
strength comes from the spread of the rates at that level (analysis of variance). A page is blocked
where the lower posterior bound of its host's bad rate passes a limit relative to the rate of all pages.

Outcomes may come from anywhere; `outcomes` makes them from the pages themselves, by rules on the text of
their html.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.workspace import materialize

from . import quality
from .common import lower_ascii, text_of

#: Second levels under which names are registered.
SECOND_LEVELS = ("co", "com", "org", "net", "ac", "gov", "edu", "or", "ne")


#: A page whose text breaks one of these rules counts as bad.
PAGE_RULES = (
    quality.Rule("short", "n_words", low=50),
    quality.Rule("symbols", "n_symbols / n_words", high=0.1),
    quality.Rule("repetitive", "100 * n_repeat_words / n_words", high=50),
)


@dataclass(frozen=True)
class Settings:
    lift: float = 1.0  # block where the lower bound is above this many times the rate of all pages
    z: float = 1.282  # one-sided 90 %
    least_correlation: float = 0.02  # prior strength at most 49 pages
    most_correlation: float = 0.5  # and at least 1


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags are blanks, three entities are read."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def outcomes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Rows (page_id, bad 0/1), one per page row, by PAGE_RULES; a page without html is bad, as it is short."""
    texts = pages.select("page_id", page_text(text_of(html_col)).alias("text"))
    judged = quality.judge(texts, "page_id", "text", base=PAGE_RULES, rules=())
    return judged.select("page_id", (~F.col("kept")).cast("int").alias("bad"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def domain_sql(host: str) -> tuple[str, str]:
    """(registered domain, suffix) of a host; ports are cut, a country's second level counts as suffix."""
    bare = f"regexp_replace({host}, ':[0-9]*$', '')"
    second = "|".join(SECOND_LEVELS)
    suffix = (
        f"CASE WHEN regexp_like({bare}, '[.]({second})[.][a-z]{{2}}$') "
        f"THEN regexp_extract({bare}, '([^.]*[.][^.]*)$', 1) ELSE regexp_extract({bare}, '([^.]*)$', 1) END"
    )
    domain = (
        f"CASE WHEN regexp_like({bare}, '[.]({second})[.][a-z]{{2}}$') "
        f"THEN regexp_extract({bare}, '([^.]*[.]?[^.]*[.][^.]*)$', 1) "
        f"ELSE regexp_extract({bare}, '([^.]*[.]?[^.]*)$', 1) END"
    )
    return domain, suffix


def matched_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule "host/path" that fits; nulls where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def host_counts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pages (page_id, url), outcomes (page_id, bad 0/1) -> every host: (host, domain, suffix, n, bad).

    A page counts once for a host however often its row or its outcome is repeated, as bad if any outcome says so."""
    known = outcomes.groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    labelled = pages.select("page_id", host_of(F.col("url")).alias("host")).distinct().join(known, "page_id", "left")
    counted = labelled.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = domain_sql("host")
    return counted.select("host", F.expr(domain).alias("domain"), F.expr(suffix).alias("suffix"), "n", "bad")


def _strength(parent: str, s: Settings) -> Column:
    """The prior strength of a level as an aggregate over rows (n, bad, parent's n and bad)."""
    rate, mean = F.col("bad") / F.col("n"), F.col(f"{parent}_bad") / F.col(f"{parent}_n")
    total, groups = F.sum("n"), F.count("*")
    free = F.greatest(groups - 1, F.lit(1))
    between = F.sum(F.col("n") * (rate - mean) * (rate - mean)) / free
    within = F.sum(F.col("n") * rate * (1 - rate)) / F.greatest(total - groups, F.lit(1))
    typical = (total - F.sum(F.col("n") * F.col("n")) / total) / free
    below = between + (typical - 1) * within
    rho = F.when(below > 0, (between - within) / below).otherwise(F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(s.least_correlation)), F.lit(s.most_correlation))
    return (1 / rho - 1).alias("strength")


def reputation(counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (host, n, bad, mean, bound, bad_limit): posterior mean and lower bound of the bad rate, and the bound above
    which a host is blocked. Grouping and joins of small rows; the totals and three strengths come to the driver."""
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).head()
    mean = (whole.bad + 1) / (whole.n + 2)

    def up(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnsRenamed({"n": f"{name}_n", "bad": f"{name}_bad"})

    def seen(df: DataFrame) -> DataFrame:
        return df.where("n > 0")

    top = seen(suffixes).withColumns({"all_n": F.lit(whole.n), "all_bad": F.lit(whole.bad)})
    middle = seen(domains).join(up(suffixes, "suffix"), "suffix")
    low = seen(counts).join(up(domains, "domain"), ["domain", "suffix"])
    s0 = top.agg(_strength("all", settings)).head().strength
    s1 = middle.agg(_strength("suffix", settings)).head().strength
    s2 = low.agg(_strength("domain", settings)).head().strength
    of_suffix = suffixes.select(
        "suffix", ((F.col("bad") + F.lit(mean * s0)) / (F.col("n") + F.lit(s0))).alias("suffix_mean"))
    of_domain = domains.join(of_suffix, "suffix").select(
        "domain", "suffix", ((F.col("bad") + F.col("suffix_mean") * s1) / (F.col("n") + F.lit(s1))).alias("domain_mean"))
    a = F.col("bad") + F.col("domain_mean") * s2
    b = F.col("n") + F.lit(s2)
    return counts.join(of_domain, ["domain", "suffix"]).select(
        "host", "n", "bad", (a / b).alias("mean"),
        (a / b - settings.z * F.sqrt(a / b * (1 - a / b) / (b + 1))).alias("bound"), F.lit(settings.lift * mean).alias("bad_limit"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]],
          settings: Settings = Settings()) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, host_n, host_bad, bound.

    Null urls, and those without "://", share an empty host with an empty path; a host without
    outcomes takes the rate of its domain, suffix or all pages; a repeated page, and several outcomes of a page, count
    once; null outcomes do not count; of rules of equal length the later in byte order wins; urls of any length are read
    whole; an empty table gives no rows; other columns are ignored. A host of very many pages is summed before its
    shuffle; the join back is on small rows and left to adaptive execution (broadcast if small, else split).
    """
    counts = materialize(host_counts(pages, outcomes), "hosts")
    hosts = reputation(counts, settings).withColumnsRenamed({"n": "host_n", "bad": "host_bad"})
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = matched_rule(rules, F.col("host"), F.col("path"))
    by_host = F.when(F.col("bound") > F.col("bad_limit"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(hosts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_host).alias("verdict"),
        "host_n", "host_bad", "bound",
    )
