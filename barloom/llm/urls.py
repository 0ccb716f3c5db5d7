"""URL block lists that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.graph import connected_components
from barloom.llm.tables import ascii_lower, let, stored

ALLOW, BLOCK = "allow", "block"
#: Tags that can name another address of a page, and the attributes that do.
TAGS = r"(?is)<(?:link|meta)\b[^<>]*>"
CANONICAL = r"""(?is)\srel\s*=\s*["']?canonical\b"""
HREF = r"""(?is)\shref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?refresh\b"""
CONTENT = r"""(?is)\scontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def address(url: Column) -> Column:
    """(root, host, path, key) of an address; all but the key are empty without ``://``, the key NULL.

    The root is all up to the host. Two addresses of one page have one key: the scheme, the case
    of the host and the fragment do not matter.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))

    def taken(r):
        return F.struct(
            F.coalesce(ascii_lower(F.regexp_extract(r, r"^[^/?#]*", 0)), F.lit("")).alias("host"),
            F.coalesce(F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
            F.regexp_extract(r, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        )

    def named(p):
        return F.struct(
            F.concat(F.substring(url, F.lit(1), at + 2), p["host"]).alias("root"),
            p["host"].alias("host"),
            p["path"].alias("path"),
            F.concat(p["host"], p["path"], p["query"]).alias("key"),
        )

    return let(let(rest, taken), named)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL if none does.

    A rule ``host/path`` fits its host and all subdomains where the path starts with its own.
    Rules are a policy of a bounded number of entries, so they are literals of one expression;
    between rules of equal length an allow comes first.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != ALLOW, r[1]))

    def fits(rule):
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | host.endswith("." + name)
        return on_host & path.startswith(slash + rest) if slash else on_host

    found = [
        F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, rule in ordered
    ]
    empty = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*found, empty)


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) keys of pages that are one page by a canonical link or a refresh redirect in the HTML."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TAGS), F.lit(0))
    tagged = pages.select(F.col(url_col).alias("_url"), F.explode(tags).alias("_tag"))
    target = F.when(F.col("_tag").rlike(CANONICAL), F.regexp_extract("_tag", HREF, 1)).when(
        F.col("_tag").rlike(REFRESH), F.regexp_extract("_tag", CONTENT, 1)
    )
    found = tagged.select("_url", target.alias("_to")).filter("_to <> ''")

    def absolute(page):
        to = F.col("_to")
        return F.struct(
            page["key"].alias("key"),
            F.when(to.contains("://"), to)
            .when(to.startswith("//"), F.concat(F.lit("http:"), to))
            .when(to.startswith("/"), F.concat(page["root"], to))
            .otherwise(F.concat(page["root"], F.regexp_replace(page["path"], r"[^/]*$", ""), to))
            .alias("to"),
        )

    ends = found.select(let(address(F.col("_url")), absolute).alias("e"))
    return ends.select(F.col("e.key").alias("a"), address(F.col("e.to"))["key"].alias("b"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    redirects: Sequence[DataFrame] = (),
    url_col: str = "url",
    html_col: str = "html",
    default: str = ALLOW,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every page.

    A page's own rule decides. Without one, the page takes the decision of its aliases: pages
    reachable over redirects (frames ``a``, ``b`` of addresses) and over canonical links or refresh
    redirects in the HTML are one component; an explicitly allowed alias allows it, else a blocked
    one blocks it, else ``default`` holds. Targets that are no page themselves are judged by the rules
    as well and connect the pages that point to them.

    NULL addresses, or addresses without ``://``, have empty host and path, no rule and no aliases.
    Repeated rows each keep a row; columns named like the new ones are replaced.
    """
    placed = pages.withColumn("_at", address(F.col(url_col)))
    ruled = placed.withColumns(
        {
            "_own": matching_rule(F.col("_at.host"), F.col("_at.path"), rules),
            "_key": F.col("_at.key"),
        }
    )
    given = [r.select(address(F.col("a"))["key"].alias("a"), address(F.col("b"))["key"].alias("b")) for r in redirects]
    edges = stored(
        reduce(DataFrame.unionByName, given, alias_edges(pages, url_col=url_col, html_col=html_col))
        .filter("a <> b")
        .distinct(),
        "alias",
    )
    classes = stored(connected_components(edges), "aliases")
    # A key holds host and path, which is all that a rule looks at.
    member = F.regexp_extract("node", r"^[^/?#]*", 0), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    verdicts = (
        classes.withColumn("v", matching_rule(*member, rules)["verdict"])
        .groupBy("component")
        .agg(
            F.when(F.max(F.col("v") == ALLOW), ALLOW)
            .when(F.max(F.col("v") == BLOCK), BLOCK)
            .alias("_alias_verdict")
        )
        .filter("_alias_verdict is not null")
    )
    by_page = classes.join(verdicts, "component").select(
        F.col("node").alias("_key"), "_alias_verdict"
    )
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return ruled.join(by_page, "_key", "left").select(
        *names,
        F.col("_at.host").alias("host"),
        F.col("_at.path").alias("path"),
        F.col("_own.rule").alias("rule"),
        F.coalesce(F.col("_own.verdict"), F.col("_alias_verdict"), F.lit(default)).alias("verdict"),
    )
