"""URL resolution and screening as Column expressions; ``join_url`` and
``announces`` are the same rules for one link, for workers that read pages.

``resolve_url`` follows the RFC 3986 resolution of the standard library's
``urllib.parse.urljoin`` (Python 3.13): scheme and netloc split by regex,
``;params`` split off the last segment for schemes that use them, dot
segments folded with ``aggregate``.  ``parse_url`` cannot be used: it returns
NULL for ``javascript:void(0)``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from urllib.parse import urljoin, urlparse, uses_netloc, uses_params, uses_relative

from pyspark.sql import Column
from .sqltext import F

from .text import let

def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _empty_str_array() -> Column:
    return F.array().cast("array<string>")


# urlsplit as one regex: scheme (only when every character before the first
# ':' is a scheme character), //netloc, path, ?query, #fragment.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# ;params of the last path segment: from its first ';' to the end.
_PARAMS = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"


# -- malformed hosts -------------------------------------------------------------
_HEX = "[0-9a-fA-F]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _ipv6_pattern() -> str:
    """An IPv6 address: eight groups, the last two also as IPv4, or fewer
    around one ``::``; then maybe a scope."""
    forms = [f"(?:{_HEX}:){{7}}{_HEX}", f"(?:{_HEX}:){{6}}{_IPV4}"]
    for k in range(8):
        before = f"(?:{_HEX}:){{{k - 1}}}{_HEX}" if k else ""
        after = [""]
        if k < 7:
            after.append(f"(?:{_HEX}:){{0,{6 - k}}}{_HEX}")
        if k < 6:
            after.append(f"(?:{_HEX}:){{0,{5 - k}}}{_IPV4}")
        forms.append(f"{before}::(?:{'|'.join(after)})")
    return f"(?:{'|'.join(forms)})(?:%[^%\\]]+)?"


# what stands between the first "[" and the next "]"
_BRACKETS = rf"(?s)^[^\[]*\[(?:v[0-9a-fA-F]+\.[^\]]+|{_ipv6_pattern()})(?:\].*)?$"
PLAIN_URL = r"^[\x{0}-\x{5A}\x{5C}\x{5E}-\x{7F}]*$"      # ASCII without brackets: never malformed


@functools.lru_cache(maxsize=1)
def _unsafe_in_host() -> str:
    """Characters that compatibility normalization turns into a delimiter."""
    return "".join(chr(c) for c in range(0x80, 0x30000) if set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c))))


def bad_host(netloc: Column) -> Column:
    """Whether the standard library (Python 3.13) refuses the host: an
    unpaired bracket, brackets around anything but an IPv6 (or ``v...``)
    address, or characters that normalize to delimiters."""
    unsafe = "[" + "".join("\\x{%X}" % ord(c) for c in _unsafe_in_host()) + "]"
    return ~netloc.rlike(PLAIN_URL) & (
        ((netloc.contains("[") | netloc.contains("]")) & ~(netloc.contains("]") & netloc.rlike(_BRACKETS))) | netloc.rlike(unsafe))


def split_url(u: Column, default_scheme: Column | str = "") -> Column:
    """``urlparse(u, default_scheme)`` -> struct(scheme, netloc, path,
    params, query, fragment), all strings."""
    clean = F.regexp_replace(F.regexp_replace(u, "[\\t\\r\\n]", ""), "^[\\x{0}-\\x{20}]+", "")

    def parts(c):
        scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(c, _SPLIT, 1)), F.lit("")),
                            _lit(default_scheme))
        return F.struct(scheme.alias("scheme"),
                        F.regexp_extract(c, _SPLIT, 2).alias("netloc"),
                        F.regexp_extract(c, _SPLIT, 3).alias("full_path"),
                        F.regexp_extract(c, _SPLIT, 4).alias("query"),
                        F.regexp_extract(c, _SPLIT, 5).alias("fragment"))

    def with_params(p):
        split = p["scheme"].isin(*uses_params)
        return F.struct(
            p["scheme"].alias("scheme"), p["netloc"].alias("netloc"),
            F.when(split, F.regexp_extract(p["full_path"], _PARAMS, 1)).otherwise(p["full_path"]).alias("path"),
            F.when(split, F.regexp_extract(p["full_path"], _PARAMS, 2)).otherwise(F.lit("")).alias("params"),
            p["query"].alias("query"), p["fragment"].alias("fragment"))
    return let(let(clean, parts), with_params)


def unparse_url(scheme, netloc, path, params, query, fragment) -> Column:
    """``urlunparse`` of six string Columns."""
    def build(p):
        url = F.when(p["params"] != "", F.concat(p["path"], F.lit(";"), p["params"])).otherwise(p["path"])
        return let(url, lambda url: F.concat(
            F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(F.lit("")),
            F.when(p["netloc"] != "",
                   F.concat(F.lit("//"), p["netloc"],
                            F.when((url != "") & ~url.startswith("/"), F.lit("/")).otherwise(F.lit("")), url))
             .when(url.startswith("//"), F.concat(F.lit("//"), url))
             .when((p["scheme"] != "") & p["scheme"].isin(*uses_netloc)
                   & ((url == "") | url.startswith("/")), F.concat(F.lit("//"), url))
             .otherwise(url),
            F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")),
            F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit(""))))
    return let(F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"),
                        params.alias("params"), query.alias("query"), fragment.alias("fragment")), build)


def _fold_dots(segments: Column) -> Column:
    def step(acc, s):
        return (F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .when(s == ".", acc)
                .otherwise(F.concat(acc, F.array(s))))
    def fold(segs):
        folded = F.aggregate(segs, _empty_str_array(), step)
        return F.when(F.element_at(segs, -1).isin(".", ".."),
                      F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return let(segments, fold)


def _join(x: Column) -> Column:
    """Resolution proper; ``x`` = struct(href, b, h) of raw href and the
    split base and href."""
    href, b, h = x["href"], x["b"], x["h"]
    scheme = h["scheme"]
    keep = (scheme != b["scheme"]) | ~scheme.isin(*uses_relative)
    own_netloc = scheme.isin(*uses_netloc) & (h["netloc"] != "")
    netloc = F.when(scheme.isin(*uses_netloc), b["netloc"]).otherwise(h["netloc"])
    no_path = (h["path"] == "") & (h["params"] == "")
    query_if_no_path = F.when(h["query"] != "", h["query"]).otherwise(b["query"])

    def segments_of(parts):
        base_parts = parts["base"]
        rel = F.concat(F.when(F.element_at(base_parts, -1) != "",
                              F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(base_parts),
                       parts["own"])
        rel = let(rel, lambda r: F.filter(r, lambda s, i: (i == 0) | (i == F.size(r) - 1) | (s != "")))
        segs = F.when(h["path"].startswith("/"), parts["own"]).otherwise(rel)
        return F.array_join(_fold_dots(segs), "/")
    joined = let(F.struct(F.split(b["path"], "/").alias("base"), F.split(h["path"], "/").alias("own")),
                 segments_of)
    joined = let(joined, lambda j: F.when(j == "", F.lit("/")).otherwise(j))
    return (F.when(keep, href)
            .when(own_netloc, unparse_url(scheme, h["netloc"], h["path"], h["params"],
                                          h["query"], h["fragment"]))
            .when(no_path, unparse_url(scheme, netloc, b["path"], b["params"],
                                       query_if_no_path, h["fragment"]))
            .otherwise(unparse_url(scheme, netloc, joined, h["params"], h["query"],
                                   h["fragment"])))


_PLAIN_PATH = r"^/(?:[A-Za-z0-9_\-][A-Za-z0-9_\-/]*)?$"
_PLAIN_SITE = r"^(https?://[A-Za-z0-9.\-]+)(?:[/?#]|$)"


def resolve_url(href: Column, base: Column | str) -> Column:
    """``urljoin(base, href)``; NULL where either has a malformed host.
    A plain absolute path needs no splitting."""
    def go(x):
        b = split_url(x["base"])
        return let(F.struct(x["href"].alias("href"), b.alias("b")),
                   lambda y: let(F.struct(y["href"].alias("href"), y["b"].alias("b"), split_url(y["href"], y["b"]["scheme"]).alias("h")),
                                 lambda z: F.when(~bad_host(z["b"]["netloc"]) & ~bad_host(z["h"]["netloc"]), _join(z))))

    def outer(x):
        return (F.when(x["base"].isNull() | (x["base"] == ""), x["href"])
                .when(x["href"].isNull() | (x["href"] == ""), x["base"])
                .when(x["href"].rlike(_PLAIN_PATH) & x["base"].rlike(_PLAIN_SITE),
                      F.concat(F.regexp_extract(x["base"], _PLAIN_SITE, 1), x["href"]))
                .otherwise(go(x)))
    return let(F.struct(href.alias("href"), _lit(base).alias("base")), outer)


_PLAIN_PATH_RE, _PLAIN_SITE_RE = re.compile(_PLAIN_PATH[1:-1]), re.compile(_PLAIN_SITE)
# absolute, with nothing that joining it to a sound base would change
_PLAIN_URL_RE = re.compile(r"https?://([A-Za-z0-9.\-]+)(/[A-Za-z0-9_\-/.]*)?")


@functools.lru_cache(maxsize=1024)
def _plain_site(base: str) -> str | None:
    m = _PLAIN_SITE_RE.match(base)
    return m and m[1]


def join_url(base: str | None, href: str | None) -> str | None:
    """``resolve_url`` of one link."""
    if not base:
        return href
    if not href:
        return base
    site = _plain_site(base)
    if site is not None:
        if _PLAIN_PATH_RE.fullmatch(href):
            return site + href
        if _PLAIN_URL_RE.fullmatch(href):
            return href
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def resolve_listing_url(href: Column, base: Column | str) -> Column:
    """Listing links keep a literal ``http://``/``https://`` prefix as is."""
    return F.when(href.startswith("http://") | href.startswith("https://"), href) \
        .otherwise(resolve_url(href, base))


# Path fragments that mark a non-announcement link.  The last
# three can never occur in a parsed path, so they never reject anything.
SKIP_PATTERNS = ["/about/", "/contact/", "/support/", "/pricing/",
                 "/documentation/", "/console/", "/signin/", "/signup/",
                 "javascript:", "mailto:", "#"]
# Path fragments that mark an announcement link.  Each implies
# a path longer than one character, which accepts the link anyway.
ACCEPT_PATTERNS = ["/new/", "/announcement/", "/blog/", "/press/",
                   "/release/", "/update/", "/launch/"]
DEFAULT_DOMAIN = "amazonaws.cn"


def is_announcement_url(url: Column, domain: str = DEFAULT_DOMAIN) -> Column:
    """Host empty or containing ``domain``; lowercased path free of skip
    patterns; and an accept pattern in the path or a path longer than 1."""
    def test(p):
        path = F.lower(p["path"])
        host_ok = (p["netloc"] == "") | p["netloc"].contains(domain)
        skipped = F.exists(F.array(*[F.lit(s) for s in SKIP_PATTERNS]), lambda s: path.contains(s))
        accepted = F.exists(F.array(*[F.lit(s) for s in ACCEPT_PATTERNS]), lambda s: path.contains(s))
        return host_ok & ~skipped & (accepted | (F.length(path) > 1)) & ~bad_host(p["netloc"])
    return F.coalesce(let(split_url(url), test), F.lit(False))


_SKIPPED = re.compile("|".join(map(re.escape, SKIP_PATTERNS)))


def announces(url: str, domain: str = DEFAULT_DOMAIN) -> bool:
    """``is_announcement_url`` of one link; a path that holds an accept
    pattern is longer than 1."""
    m = _PLAIN_URL_RE.fullmatch(url)
    if m is not None:
        host, path = m[1], m[2] or ""
    else:
        try:
            parts = urlparse(url)
        except ValueError:
            return False
        host, path = parts.netloc, parts.path
    return len(path) > 1 and (not host or domain in host) and not _SKIPPED.search(path.lower())


def join_listing_url(base: str | None, href: str) -> str | None:
    """``resolve_listing_url`` of one link."""
    return href if href.startswith(("http://", "https://")) else join_url(base, href)


def resolvable(href: Column, base: Column) -> Column:
    """Whether ``resolve_listing_url`` has a result, mostly without computing it."""
    return F.when(href.startswith("http://") | href.startswith("https://") | (href.rlike(PLAIN_URL) & base.rlike(PLAIN_URL)), F.lit(True)) \
        .otherwise(resolve_listing_url(href, base).isNotNull())


def url_host(url: Column) -> Column:
    return split_url(url)["netloc"]
