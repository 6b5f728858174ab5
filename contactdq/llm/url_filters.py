"""URL filters with redirect equivalence.

Rules name a host (with all its subdomains) and a path prefix; the longest fitting rule decides a url. A url without a
rule takes the decision of its aliases: addresses that differ only in scheme, ``www.``, fragment, tracking parameters
or a trailing slash are one node, and redirect and canonical-link edges join nodes into components. A component with a
blocked member blocks its members, except those that a rule allows: an explicit allow always wins for its own url.

Edges come from the pages (``<link rel=canonical>``, ``<meta http-equiv=refresh>``) and from an optional table of
observed redirects. Components are found by distributed star contraction; only nodes with an edge take part. All of it
is DataFrame operations.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule, has no aliases and is allowed.
Of rules of one length that fit, the first in order of their strings decides, and of one string with two verdicts, allow.
A null page or an unusable link gives no edge; a very long page is searched whole, once. Repeated rows are judged alike, a null page id is carried
through, an empty table gives an empty result, and columns other than the three named are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import ascii_lower, written
from contactdq.llm.components import components


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is host and path prefix in one string, such as ``example.org/en/``; ``verdict`` is allow or block."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


#: More rules than this are joined by host suffix in place of a chain of conditions.
MAX_INLINE_RULES = 200


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.when(F.coalesce(url, F.lit("")).contains("://"), ascii_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def canonical_key(url: Column, host: Column, path: Column) -> Column:
    """One string for all spellings of an address: host without ``www.``, path without closing slashes, query without tracking parts."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def with_rule(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``; null where no rule fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern, r.verdict != "allow"))
    if len(ordered) > MAX_INLINE_RULES:
        return _with_joined_rule(urls, ordered)
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.pattern)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _with_joined_rule(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """The same by joins: distinct (host, path) pairs meet the rules of every suffix of their host."""
    listed = urls.sparkSession.createDataFrame([(r.host, r.path, r.pattern, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.select("host", "path", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = met.groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), "rule", F.col("rule_verdict") != "allow")).alias("b"))
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("b.rule"), "rule_verdict": F.col("b.rule_verdict")}).drop("b")


def link_targets(html: Column) -> Column:
    """Targets of canonical links and of refreshing meta tags in a page, as an array, with ``&amp;`` in its three spellings read as ``&``."""
    # What follows the last bracket closes no tag; without it every tag that opens also closes, so no part of a page is searched twice.
    html = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))
    links = F.when(html.rlike("(?i)canonical"), F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")))
    metas = F.when(html.rlike("(?i)http-equiv"), F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b")))
    none = F.array().cast("array<string>")
    hrefs = F.transform(F.coalesce(links, none), lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    urls = F.transform(F.coalesce(metas, none), lambda x: F.regexp_extract(x, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+(?:;[^\"'\s>;]+)*)", 1))
    return F.transform(F.filter(F.concat(hrefs, urls), lambda x: x != ""), lambda x: F.regexp_replace(x, r"(?i)&(?:amp|#0*38|#x0*26);", "&"))


def _tidied(path: Column) -> Column:
    """A path from its root without ``.`` and ``..`` steps; what follows ``?`` or ``#`` stays."""
    own, rest = F.regexp_extract(path, r"\A([^?#]*)", 1), F.regexp_extract(path, r"(?s)\A[^?#]*(.*)\z", 1)
    every = F.split(own, "/", -1)
    steps = F.slice(every, F.lit(2), F.size(every))
    kept = F.aggregate(
        steps, F.array(F.lit("")), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x)), lambda done: F.array_join(done, "/")
    )
    return F.when(own.rlike(r"/\.\.?(?:/|\z)"), F.concat(kept, rest)).otherwise(path)


def _resolved(target: Column, url: Column, host: Column) -> Column:
    """An absolute address for a link: full, ``//host/...``, ``/path``, ``?query`` and relative forms; null for places in the page and for other schemes."""
    scheme = F.regexp_extract(url, r"\A([^:/?#]+)://", 1)
    root, path = F.concat(scheme, F.lit("://"), host), path_of(url)
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"[^/]*\z", "")).otherwise("/")
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, _tidied(target)))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(~target.startswith("#") & ~target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") & (host != ""), F.concat(root, _tidied(F.concat(folder, target))))
    )


def _keyed(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """``url`` with host, path, rule, rule_verdict and the canonical key."""
    split = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return with_rule(split, rules).withColumn("key", canonical_key(F.col("url"), F.col("host"), F.col("path")))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` addresses of the links and refreshes found in pages; two links or more that leave one page give as many rows."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    found = pages.filter(html.isNotNull() & url.isNotNull()).select(url.alias("src"), F.explode(link_targets(html)).alias("to"))
    return found.select("src", _resolved(F.col("to"), F.col("src"), host_of(F.col("src"))).alias("dst")).filter("dst IS NOT NULL")


def judge(
    pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, and ``component`` (null for an address that stands alone)."""
    own = _keyed(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")), rules)
    edges = [link_edges(pages, url_col, html_col)] if html_col else []
    edges += [redirects.select(F.col("src").cast("string"), F.col("dst").cast("string"))] if redirects is not None else []
    blocked = own.filter("rule_verdict = 'block' AND key IS NOT NULL").select("key")
    if edges:
        every = edges[0]
        for more in edges[1:]:
            every = every.unionByName(more)
        # Pages are parsed once: the edges are written, and both ends are judged and keyed from there.
        every = written(every.distinct(), "edges")
        ends = _keyed(every.select(F.posexplode(F.array("src", "dst")).alias("end", "url"), F.struct("src", "dst").alias("edge")), rules)
        ends = written(ends.select("edge", "end", "key", F.coalesce(F.col("rule_verdict") == "block", F.lit(False)).alias("blocked")), "ends")
        one = lambda end: F.max(F.when(F.col("end") == end, F.col("key")))
        joined = components(ends.groupBy("edge").agg(one(0).alias("src"), one(1).alias("dst"))).withColumnRenamed("node", "key")
        blocked = blocked.unionByName(ends.filter("blocked AND key IS NOT NULL").select("key"))
        own = own.join(joined, "key", "left")
        blocked = blocked.join(joined, "key", "left")
    else:
        own, blocked = own.withColumn("component", F.lit(None).cast("string")), blocked.withColumn("component", F.lit(None).cast("string"))
    bad = blocked.select(F.coalesce("component", "key").alias("group")).distinct().withColumn("bad", F.lit(True))
    told = own.withColumn("group", F.coalesce("component", "key")).join(bad, "group", "left")
    return told.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("bad"), F.lit("block")), F.lit("allow")).alias("verdict"), "component")
