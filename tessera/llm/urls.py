"""URL filters over redirect equivalence, in DataFrame functions only.

Rules judge each url. Redirects and canonical links join urls into classes, by distributed connected components; a
blocked url's class is blocked with it, save urls that a rule of their own allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, settle
from tessera.llm.graph import components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules_of(*lines: str) -> tuple[Rule, ...]:
    """Rules from lines like ``block example.com/en/``: a verdict, a host, and a path from its first slash."""
    out = []
    for line in lines:
        verdict, _, where = line.partition(" ")
        host, slash, path = where.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line}")
        out.append(Rule(host.lower(), slash + path, verdict))
    return tuple(out)


#: More rules than this would make too long an expression: give them in several calls, or as a longer-host table.
MOST_RULES = 2_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule's place among ``rules``; at equal length allow goes before block. Null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), rules[i].verdict, rules[i].name))
    found: Column | None = None
    for i in order:
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, i) if found is None else found.when(fits, i)
    return F.lit(None).cast("int") if found is None else found


def node_of(url: Column) -> Column:
    """A url as a node: scheme and host lower-cased, an empty path a slash, no fragment."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), UPPER, LOWER)
    return F.concat(scheme, F.lit("://"), host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def resolve(base: Column, link: Column) -> Column:
    """A link's url as seen from ``base``: absolute, scheme-relative, root-relative or relative to the last slash."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]*/|[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), link))
    )


# How HTML writes canonical links and redirects.
LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def page_edges(pages: DataFrame, url: Column, html: Column) -> DataFrame:
    """``src``, ``dst``: each page's canonical link and redirect. Pages without either, or with null columns, have none."""
    tags = pages.select(url.alias("url"), F.when(html.rlike("(?i)canonical|http-equiv"), html).alias("html")).where("html is not null and url is not null")
    links = tags.select("url", F.explode(F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(META_TAG), F.lit(0)), lambda t: F.regexp_extract(t, TARGET, 1)),
    )).alias("link")).where("link <> ''")
    return links.select(F.col("url").alias("src"), resolve(F.col("url"), F.col("link")).alias("dst")).where("dst is not null")


def filter_urls(pages: DataFrame, row_id: Column, url: Column, rules: tuple[Rule, ...], edges: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: ``row_id``, ``host``, ``path``, ``rule`` (name, else null), ``verdict`` and
    ``alias_of`` (the class's least url, else null).

    ``edges`` (``src``, ``dst``) may hold urls that no page has; rules judge these too. A rule of a url's own decides
    for it. Else the url is blocked if any url of its class is blocked by rule, and allowed if none is. A null url, or
    one without ``://``, has an empty host and path, no class, and is allowed unless a rule fits. Repeated rows each
    get theirs; empty tables give no rows. Classes are joined by url, never collected.
    """
    judged = pages.select(row_id.alias("row_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.select("row_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"), F.when(F.col("url").contains("://"), node_of(F.col("url"))).alias("node"))
    links = settle(edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a <> b"), "edges")
    verdicts = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.lit(r.verdict))]) if rules else None
    names = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.lit(r.name))]) if rules else None
    null = F.lit(None).cast("string")
    if links.isEmpty():
        classes = judged.select("row_id", "host", "path", "r", null.alias("component"), F.lit(False).alias("blocked"))
    else:
        classes = components(links, "a", "b")
        blocked = classes.where((verdicts[rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)] == "block") if rules else F.lit(False)).select("component").distinct()
        classes = classes.join(blocked.withColumn("blocked", F.lit(True)), "component", "left")
        classes = judged.join(classes, "node", "left").select("row_id", "host", "path", "r", "component", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    own = verdicts[F.col("r")] if rules else null
    name = names[F.col("r")] if rules else null
    return classes.select("row_id", "host", "path", name.alias("rule"), F.coalesce(own, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), F.col("component").alias("alias_of"))
