"""URL filter by rules, with verdicts carried over redirect and canonical-link aliases; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written
from .components import connected_components

#: Rules that are still broadcast.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names the page behind a url: host, path without a last slash, query; null without a host.

    Scheme and fragment do not count, so http and https forms are one page.
    """
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.coalesce(query, F.lit(""))))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.split(F.regexp_replace(path, "^/", ""), "/", -1), F.array().cast("array<string>"), step)
    last = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), last)


def resolved(target: Column, url: Column) -> Column:
    """The absolute form of a target found on the page ``url``; null for other schemes and for the page itself."""
    scheme, authority = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), host_of(url)
    path, tail = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(?s:(.*))$", 1)
    folder = F.regexp_extract(path_of(url), r"^(?s:(.*/))", 1)
    at = lambda x: F.concat(scheme, F.lit("://"), authority, x)
    return (
        F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), at(F.concat(_without_dots(path), tail)))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("?"), at(F.concat(path_of(url), target)))
        .otherwise(at(F.concat(_without_dots(F.concat(folder, path)), tail)))
    )


def alias_targets(html: Column, url: Column) -> Column:
    """Absolute urls that a page names as its canonical link or as the target of a refresh.

    Relative targets start at the page's url; a ``<base>`` element is not read.
    """
    attribute = r"""(?is)\b%s\s*=\s*["']?\s*([^"'\s>]+)"""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda x: x.rlike(r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""))
    canonical = F.transform(links, lambda x: F.regexp_extract(x, attribute % "href", 1))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda x: x.rlike(r"""(?i)http-equiv\s*=\s*["']?\s*refresh\b"""))
    refresh = F.transform(metas, lambda x: F.regexp_extract(x, r"""(?is)\burl\s*=\s*["']?\s*((?:&(?:amp|#0*38|#x0*26);|[^"'\s>;])+)""", 1))
    decoded = F.transform(F.concat(canonical, refresh), lambda x: F.regexp_replace(x, "&(?i:amp|#0*38|#x0*26);", "&"))
    return F.array_compact(F.transform(decoded, lambda x: resolved(x, url)))


def rule_matches(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and the rules that fit it or one of its parent domains, as an array."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    some = rules.select(ascii_lower(F.col("host")).alias("suffix"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").distinct()
    if some.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        some = F.broadcast(some)
    fits = hosts.select("host", F.explode(suffixes).alias("suffix")).filter("suffix != ''").join(some, "suffix")
    rule = F.concat("suffix", "rule_path")
    return fits.groupBy("host").agg(F.collect_list(F.struct(F.length(rule).alias("size"), (F.col("verdict") == "allow").alias("allows"), rule.alias("rule"), "rule_path", "verdict")).alias("rules"))


def judge(pages: DataFrame, rules: DataFrame, page: str = "page_id", url: str = "url", html: str | None = "html", edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and the alias class of every row of ``pages``.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the path of the url starts with
    its own; the longest wins, and allow wins between rules of equal text. A page without a rule takes the
    decision of its aliases: pages that share a name (``node_of``) or are joined by canonical links and
    redirects, found in ``html`` or given as ``edges`` (``from_url``, ``to_url``), any number of steps away.
    An explicit allow among them comes before a block; without either the page is allowed. A page's own rule
    always stands, so a block never reaches a page that a rule allows.

    A null url, or one without ``://``, has an empty host and path, no rule and no aliases. Repeated rows and
    null ids are judged like any other; other columns are not read. Urls and pages of any length are read whole, and
    an empty table gives no rows.
    """
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), *([F.col(html).alias("html")] if html else []))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "node": node_of(F.col("url"))})
    links = None
    if html:
        links = rows.filter(F.col("html").rlike("(?i)canonical|refresh")).select("node", F.explode(alias_targets(F.col("html"), F.col("url"))).alias("to"))
        links = links.select(F.col("node").alias("a"), node_of(F.col("to")).alias("b"))
    if edges is not None:
        more = edges.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        links = more if links is None else links.union(more)
    matches = written(rule_matches(rows.select("host").distinct(), rules))
    judged = rows.select("page_id", "host", "path", "node").join(matches, "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    judged = written(judged.select("page_id", "host", "path", "node", best["rule"].alias("rule"), best["verdict"].alias("own")))
    if links is not None:
        roots = connected_components(links)
        judged = judged.join(roots.select(F.col("v").alias("node"), "root"), "node", "left")
    else:
        judged = judged.withColumn("root", F.lit(None).cast("string"))
    judged = judged.withColumn("alias", F.coalesce("root", "node"))
    # Only classes that a block reaches, and that no explicit allow holds, change anything.
    votes = judged.filter("own is not null and alias is not null").groupBy("alias").agg(F.max(F.col("own") == "allow").alias("allows"), F.max(F.col("own") == "block").alias("blocks"))
    blocked = written(votes.filter("blocks and not allows").select("alias", F.lit("block").alias("passed")))
    verdict = F.coalesce("own", "passed", F.lit("allow"))
    return judged.join(blocked, "alias", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias")
