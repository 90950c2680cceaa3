"""Links: addresses in a page's HTML and their normal form, and places within a document."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.inline import anchor_ids, clean_target, fragment_name

# Schemes that may be opened with their usual ports, the longest address, what is escaped in each part.
SCHEMES = {"http": 80, "https": 443, "mailto": None}
LONGEST_URL = 4096
PATH, QUERY, FRAGMENT, USER = ' "#<>?`{}', " \"#<>'", ' "<>`', ' "#<>?`{}/:;=@[\\]^|'
HOST_NEVER = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, link_no, url: the targets of all links of a page's HTML, in order, as they are written."""
    found = lambda i: F.regexp_extract_all("html", F.lit(HREF), i)
    url = F.transform(F.arrays_zip(found(1).alias("a"), found(2).alias("b"), found(3).alias("c")), lambda x: F.concat(x["a"], x["b"], x["c"]))
    plain = F.posexplode(F.transform(url, lambda u: F.replace(F.replace(F.replace(u, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))))
    return pages.select("page_id", plain.alias("link_no", "url"))


def _escape(text: str, never: str) -> str:
    return "".join(c if " " <= c <= "~" and c not in never else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _number(part: str) -> int | None:
    """A part of a numeric host: decimal, octal or hexadecimal."""
    try:
        return int(part, 16) if part[:2].lower() == "0x" and part[2:] else 0 if part.lower() == "0x" else int(part, 8) if part[0] == "0" and part != "0" else int(part, 10) if part.isascii() and part.isdigit() else None
    except (ValueError, IndexError):
        return None


def normal_host(host: str) -> str | None:
    """A host in lower case, numeric ones in four decimal parts; null if it can't be one."""
    if host.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(host[1:-1]).compressed}]" if host.endswith("]") else None
        except ValueError:
            return None
    try:
        host = unquote_to_bytes(host).decode("utf-8").lower()
        host = host if host.isascii() else host.encode("idna").decode("ascii")
    except UnicodeError:
        return None
    if not host or HOST_NEVER.search(host):
        return None
    parts = host.removesuffix(".").split(".")
    if parts[-1].isdigit() or re.fullmatch(r"0x[0-9a-f]*", parts[-1]):
        numbers = [_number(p) for p in parts]
        if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
            return None
        return str(ipaddress.IPv4Address(numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))))
    return host


def normal_path(path: str) -> str:
    """Steps to the same and to the upper folder are taken, other characters escaped."""
    kept: list[str] = []
    steps = re.split(r"[/\\]", path)
    for i, step in enumerate(steps):
        dots = re.sub("%2e", ".", step, flags=re.I)
        if dots == "..":
            kept = kept[:-1]
        elif dots != ".":
            kept.append(_escape(step, PATH))
        if dots in (".", "..") and i == len(steps) - 1:
            kept.append("")
    return "/" + "/".join(kept)


def normal_url(value: str | None) -> str | None:
    """The normal form of an absolute http, https or mailto address; null for anything else."""
    if not value or len(value.encode("utf-16-le")) // 2 > LONGEST_URL:
        return None
    url = re.sub(r"[\t\n\r]", "", value.strip("".join(map(chr, range(33)))))
    scheme, colon, rest = url.partition(":")
    scheme = scheme.lower()
    if not colon or scheme not in SCHEMES:
        return None
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    tail = (mark + _escape(query, QUERY) if mark else "") + (hash_ + _escape(fragment, FRAGMENT) if hash_ else "")
    if scheme == "mailto":
        return f"mailto:{_escape(rest, '')}{tail}"
    place = re.match(r"[^/\\]*", rest := rest.lstrip("/\\"))[0]
    path = rest[len(place) :]
    user, at, place = place.rpartition("@")
    name, _, word = user.partition(":")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place, re.A)
    host = normal_host(found[1]) if found else None
    if host is None or int(found[2] or 0) > 65_535:
        return None
    port = f":{int(found[2])}" if found[2] and int(found[2]) != SCHEMES[scheme] else ""
    login = f"{_escape(name, USER)}{':' + _escape(word, USER) if word else ''}@" if at and (name or word) else ""
    return f"{scheme}://{login}{host}{port}{normal_path(path[1:])}{tail}"


def safe_links(links: DataFrame) -> DataFrame:
    """All columns of `links`, and href: the normal form of `url`, null if it isn't an address that may be opened."""

    @F.pandas_udf("string")
    def normal(urls: pd.Series) -> pd.Series:
        return pd.Series([normal_url(u) for u in urls], dtype=object)

    return links.withColumn("href", normal("url"))


def internal_links(links: DataFrame, names: DataFrame, refs: DataFrame, page_counts: DataFrame, headings: DataFrame) -> DataFrame:
    """doc, link_no, outcome, page, anchor: where links within documents lead.

    links: doc, link_no, kind, value. Kind `index` is the number of a page from 0, `ref` a page by its object (refs: doc, ref,
    index), `name` a name of the document's catalogue (names: doc, name, kind, value), which stands for one of these two, in
    one step; a name for a name leads nowhere. Kind `url` is a target in Markdown: `#` and a heading (headings: doc, pos,
    title) by its name, or `elsewhere`. A page beyond the document's (page_counts: doc, pages) is `broken`, like
    whatever isn't found; outcomes else are `page` and `heading`.
    """

    @F.pandas_udf("string")
    def asked(values: pd.Series) -> pd.Series:
        return pd.Series([fragment_name(v) for v in values], dtype=object)

    @F.pandas_udf("boolean")
    def inside(values: pd.Series) -> pd.Series:
        return pd.Series([clean_target(v or "").startswith("#") for v in values], dtype=bool)

    named = names.select("doc", F.col("name").alias("value"), F.lit("name").alias("kind"), F.col("kind").alias("to_kind"), F.col("value").alias("to"))
    x = links.join(named, ["doc", "kind", "value"], "left")
    direct = F.col("kind").isin("index", "ref")
    x = x.withColumn("k", F.when(direct, F.col("kind")).otherwise(F.col("to_kind"))).withColumn("v", F.when(direct, F.col("value")).otherwise(F.col("to")))
    objects = refs.select("doc", F.lit("ref").alias("k"), F.col("ref").alias("v"), F.col("index").cast("long").alias("at"))
    x = x.join(objects, ["doc", "k", "v"], "left").join(page_counts.select("doc", "pages"), "doc", "left")
    page = F.when(F.col("k") == "index", F.col("v").try_cast("long")).when(F.col("k") == "ref", F.col("at")) + 1
    x = x.withColumn("page", F.when(page.between(1, F.col("pages")), page).cast("int"))
    url = F.col("kind") == "url"
    x = x.withColumn("anchor", F.when(url, asked("value"))).withColumn("own", F.when(url, inside("value")))
    known = anchor_ids(headings).select("doc", "anchor", F.lit(True).alias("known"))
    x = x.join(known, ["doc", "anchor"], "left")
    outcome = F.when(url & ~F.col("own"), "elsewhere").when(url & F.coalesce("known", F.lit(False)), "heading").when(F.col("page").isNotNull(), "page").otherwise("broken")
    return x.select("doc", "link_no", outcome.alias("outcome"), "page", F.when(F.col("known"), F.col("anchor")).alias("anchor"))
