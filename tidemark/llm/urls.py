"""URL filters by redirect equivalence (DataFrame functions only).

A url gets the verdict of the longest rule that fits its host (or a parent
domain) and the start of its path. Urls without a rule of their own take the
verdict of their aliases: redirect and canonical-link edges form a graph whose
connected components are classes of equivalent urls, and a block decision on
one member reaches the others. An explicit allow wins: a url's own rule always
beats its class, and a class with an explicitly allowed member is not blocked.

Edges come from every canonical link and meta refresh outside comments and
scripts, with character references decoded, white space around them left out and relative
targets resolved against the page or its ``<base>``. Urls that differ in the case
of scheme or host, a default port, an empty path, dot segments, needless escapes
or the fragment are one url.

Null urls and urls without ``://`` have empty host and path, fit no rule and
have no aliases: verdict allow. Repeated rows are all judged alike. Other
columns of the pages, whatever their names, are kept out of the result. Very
long pages are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. The rules are a short list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("verdict"))).otherwise(out)
    return out


def fold_escapes(text: Column) -> Column:
    """text with the escapes of letters, digits and ``-._~`` decoded and the hex digits of all others in upper case."""

    def piece(x: Column) -> Column:
        code, after = F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30)
        plain = F.concat(F.chr(F.conv(code, 16, 10).cast("int")), after)
        return F.when(code.rlike(_UNRESERVED), plain).when(code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), code, after)).otherwise(F.concat(F.lit("%"), x))

    pieces = F.split(text, "%")
    return F.when(text.contains("%"), F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))).otherwise(text)


def node_of(url: Column) -> Column:
    """The url as a graph node; null without ://.

    Scheme and host are in lower case, without the scheme's default port; an empty path is ``/``; fragment, dot segments and needless
    escapes are gone.
    """
    clean = fold_escapes(F.regexp_replace(url, r"(?s)#.*$", ""))
    head = F.regexp_extract(clean, r"(?s)^(.*?://[^/?]*)", 1)
    path, query = F.regexp_extract(clean, r"(?s)^.*?://[^/?]*([^?]*)", 1), F.regexp_extract(clean, r"(?s)(\?.*)$", 1)
    parts = F.split(path, "/")
    climb = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    flat = F.concat(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), climb), F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    path = F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(flat, "/"))).otherwise(path)
    head = F.regexp_replace(F.regexp_replace(F.translate(head, _UPPER, _LOWER), r"^(http://.*):(80)?$", "$1"), r"^(https://.*):(443)?$", "$1")
    return F.when(clean.contains("://"), F.concat(head, F.when(path == "", "/").otherwise(path), query))


# Hex codes of the signs that need no escape in a url.
_UNRESERVED = "^(2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])$"
# Named character references that urls in attributes hold.
_NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}
#: Comments and elements whose contents are no markup; a page's links stand outside them.
_UNREAD = "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{x}\b.*?(?:</{x}\s*>|\z)" for x in ("script", "style", "template", "textarea", "title"))])
_TAG = r"""(?is)<(?:link|meta|base)\b(?:"[^"]*"|'[^']*'|[^'">])*>"""


def _attribute(name: str) -> str:
    return rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def decode_references(text: Column) -> Column:
    """text with its named (the five of XML) and numeric character references decoded; others stay."""

    def letter(number: Column) -> Column:
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(32)), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def piece(x: Column) -> Column:
        after = F.regexp_replace(x, r"(?s)^[^;]*;", "")
        out = F.when(x.rlike(r"^#[0-9]{1,7};"), F.concat(letter(F.regexp_extract(x, r"^#([0-9]{1,7});", 1).cast("int")), after))
        out = out.when(x.rlike(r"^#[xX][0-9a-fA-F]{1,6};"), F.concat(letter(F.conv(F.regexp_extract(x, r"^#[xX]([0-9a-fA-F]{1,6});", 1), 16, 10).cast("int")), after))
        for name, sign in _NAMED.items():
            out = out.when(x.startswith(name + ";"), F.concat(F.lit(sign), after))
        return out.otherwise(F.concat(F.lit("&"), x))

    pieces = F.split(text, "&")
    return F.when(text.contains("&"), F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))).otherwise(text)


#: A refresh: seconds and then the url with or without ``url=`` before it, or ``url=`` alone; and one that names none.
_REFRESH = r"""(?is)^\s*(?:[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?|url\s*=\s*)["']?([^"'\s]+)"""
_NOWHERE = r"""(?is)^\s*(?:[0-9.]+\s*[;,\s]\s*)?url\s*=[\s"']*$"""


def stripped(text: Column) -> Column:
    """text without white space around it, and without tabs and line breaks inside, as browsers read urls."""
    return F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]", ""), r"^[ \f]+|[ \f]+$", "")


def resolve(target: Column, base: Column) -> Column:
    """The absolute url of a link's target, seen from a base url; null for an empty target and for schemes without //."""
    root, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/")
    bare = F.regexp_replace(target, r"(?s)#.*$", "")
    out = F.when(bare == "", F.lit(None)).when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), bare)
    out = out.when(bare.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?):", 1), F.lit(":"), bare)).when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
    return out.when(bare.startswith("/"), F.concat(root, bare)).when(bare.startswith("?"), F.concat(root, path, bare)).otherwise(F.concat(root, folder, bare))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's url and the targets of its canonical links and its redirects (meta refresh).

    Targets may be relative, to the page or to its <base>; comments, scripts and the like hold no links.
    """

    def raw(tag: Column, name: str) -> Column:
        return F.regexp_replace(F.concat(*[F.regexp_extract(tag, _attribute(name), k) for k in (1, 2, 3)]), r"^\s+|\s+$", "")

    def each(start: str, test: Column, name: str, refresh: bool) -> Column:
        found = F.filter("tags", lambda t: t.rlike(rf"(?i)^<{start}") & test(t))
        return F.transform(found, lambda t: F.struct(raw(t, name).alias("raw"), F.lit(refresh).alias("refresh")))

    some = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("page"), F.regexp_extract_all(F.regexp_replace(html, f"(?is){_UNREAD}", " "), F.lit(_TAG), F.lit(0)).alias("tags"))
    canonical = each("link", lambda t: raw(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), "href", False)
    refresh = each("meta", lambda t: raw(t, "http-equiv").rlike(r"(?i)^refresh$"), "content", True)
    base = F.get(F.filter(F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)^<base")), lambda t: raw(t, "href")), lambda h: h != ""), 0)
    links = some.select("page", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("link"))
    # step by step, so that no expression holds another many times
    links = links.select("page", "base", "link.raw", "link.refresh")
    links = links.select("page", decode_references(F.col("base")).alias("base"), decode_references(F.col("raw")).alias("target"), "refresh")
    inside = F.when(F.col("target").rlike(_NOWHERE), "").otherwise(F.regexp_extract("target", _REFRESH, 1))
    links = links.select("page", stripped(F.col("base")).alias("base"), F.when(F.col("refresh"), inside).otherwise(stripped(F.col("target"))).alias("target"))
    links = links.select("page", resolve(F.col("base"), F.col("page")).alias("base"), "target")
    links = links.select("page", F.coalesce("base", "page").alias("base"), "target")
    links = links.select("page", resolve(F.col("target"), F.col("base")).alias("target"))
    # no filter here: it would be pushed through all steps; components() leaves out null ends and loops
    return links.select(node_of(F.col("page")).alias("a"), node_of(F.col("target")).alias("b"))


def class_verdicts(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(node): the urls whose class of aliases is blocked."""
    member = components(edges)
    judged = member.withColumn("own", match_rule(*host_path(F.col("node")), rules)["verdict"])
    classes = judged.groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    return member.join(classes.where("blocked = 1 and coalesce(allowed, 0) = 0").hint("merge"), "component").select("node")


def filter_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; edges (a, b) default to those in the pages' html."""
    host, path = host_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), match_rule(host, path, rules).alias("own"), node_of(F.col("url")).alias("node"))
    edges = keep(alias_edges(pages) if edges is None else edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")), "aliases")
    if edges.isEmpty():
        judged = judged.withColumn("blocked", F.lit(False))
    else:
        bad = class_verdicts(edges, rules).distinct().withColumn("blocked", F.lit(True))
        judged = judged.join(bad.hint("merge"), "node", "left")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), method).alias("verdict"))
