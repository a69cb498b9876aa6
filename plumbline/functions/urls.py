"""URL and host functions.

Two families: built-in expressions for absolute http(s)/file URLs in ordinary form, which keep
code generation and pushdown; and a pandas UDF that parses as browsers do (case, default ports, dot
segments, percent-encoding) for input that needs it.
"""

from __future__ import annotations

import ipaddress
import posixpath
import re
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from plumbline.functions.web import parse_url

UNPARSEABLE = "(unparseable URL)"
# Address ranges that must never be fetched, as network and prefix length.
BLOCKED_IPV4 = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
]
# Suffixes under which anyone can register.
PUBLIC_SUFFIXES = [
    "co.uk",
    "org.uk",
    "me.uk",
    "com.au",
    "net.au",
    "org.au",
    "co.nz",
    "co.za",
    "co.jp",
    "ne.jp",
    "or.jp",
    "com.br",
    "com.mx",
    "com.ar",
    "co.in",
    "com.sg",
    "com.hk",
    "com.tr",
    "com.cn",
    "com.tw",
]
MAX_HOSTS, MAX_HOST = 10, 253
_ABSOLUTE = r"^(?i)(https?|file)://([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$"


# --- built-in expressions -------------------------------------------------------------------


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _ABSOLUTE, group)


def is_absolute(url: Column) -> Column:
    """An http(s) or file URL; http(s) needs a host."""
    return F.coalesce(url.rlike(_ABSOLUTE) & ((F.lower(_part(url, 1)) == "file") | (_part(url, 2) != "")), F.lit(False))


def url_origin(url: Column) -> Column:
    return F.when(is_absolute(url), F.lower(F.concat(_part(url, 1), F.lit("://"), _part(url, 2))))


def url_path(url: Column) -> Column:
    path = _part(url, 3)
    return F.when(is_absolute(url), F.when(path == "", "/").otherwise(path))


def url_query(url: Column) -> Column:
    query = _part(url, 4)
    return F.when(is_absolute(url), F.when(query == "?", "").otherwise(query))


def url_hostname(url: Column) -> Column:
    """Lower-case host without credentials and port, or the unparseable marker."""
    host = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^[^@]*@", ""), r":\d*$", "")
    return F.when(is_absolute(url), host).otherwise(UNPARSEABLE)


def normalise_path(path: Column) -> Column:
    """Index pages and trailing slashes fold together; nothing is left as ``/``."""
    folded = F.regexp_replace(F.regexp_replace(path, r"(?i)/index\.html?$", "/"), r"/+$", "")
    return F.when(folded == "", "/").otherwise(folded)


def discovery_key(url: Column) -> Column:
    """Origin, normalised path and query: URLs with one key are one page. NULL if it is no absolute URL."""
    return F.concat(url_origin(url), normalise_path(url_path(url)), url_query(url))


def settled_location(url: Column) -> Column:
    """Where a URL leads, without query and fragment."""
    return F.coalesce(F.concat(url_origin(url), url_path(url)), F.lit(UNPARSEABLE))


def step_path(page_url: Column, target_url: Column) -> Column:
    """Path and query of a page on the target's host, else NULL."""
    on_host = is_absolute(page_url) & is_absolute(target_url) & (url_hostname(page_url) == url_hostname(target_url))
    return F.when(on_host, F.concat(url_path(page_url), url_query(page_url)))


def route_of(url: Column) -> Column:
    """A page's route: the normalised path; a file's last part."""
    name = F.concat(F.lit("/"), F.regexp_extract(url_path(url), r"([^/]*)$", 1))
    file = F.lower(F.substring(url, 1, 5)) == "file:"
    return F.when(file, normalise_path(name)).otherwise(F.coalesce(normalise_path(url_path(url)), F.lit("/")))


def reduce_urls(text: Column) -> Column:
    """Text whose URLs have lost query and fragment; punctuation that ends one stays."""
    return F.regexp_replace(text, r"""(?i)\b((?:https?|file)://[^\s"'<>?#]+)[?#][^\s"'<>]*?([.,;:!?)\]}]*)(?=[\s"'<>]|$)""", "$1$2")


def safe_href(url: Column) -> Column:
    """The URL if it is http(s), else an empty link."""
    return F.when(url.rlike(r"^(?i)https?://[^/?#\s]"), url).otherwise("#")


def host_allowed(host: Column, allowed: Column) -> Column:
    """Whether a host equals an allowed one or lies under it (``allowed`` is an array)."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"\.$", "")
    own = clean(host)
    entry = lambda a: clean(F.regexp_replace(a, r"^\*\.", ""))
    return F.coalesce(F.exists(allowed, lambda a: (own == entry(a)) | F.endswith(own, F.concat(F.lit("."), entry(a)))), F.lit(False))


#: An http(s) URL of a plain form, which the built-in expressions read as a browser does: a name whose last label is
#: letters, without escapes, Punycode or credentials. (``xn--`` labels are decoded and checked, so they are not plain.)
_PLAIN = r"^(?i)https?://(?!([^/?#]*\.)?xn--)([a-z0-9_-]+\.)*[a-z][a-z-]*(:\d{1,4})?([/?#][!-~]*)?$"


def host_as_browser(url: Column) -> Column:
    """The host of a URL as a browser shows it, NULL if it would refuse the URL. Only URLs that are not of plain form go to Python."""
    plain = F.coalesce(url.rlike(_PLAIN), F.lit(False))
    return F.when(plain, url_hostname(url)).otherwise(browser_url(F.when(~plain, url))["hostname"])


def target_refusal(url: Column, allowed: Column) -> Column:
    """Why a URL may not be audited, or NULL: no URL, scheme, credentials, host, private address.

    Hosts are those that a browser would connect to: numbers in any spelling are addresses, names
    are in ASCII.
    """
    plain = F.coalesce(url.rlike(_PLAIN), F.lit(False))
    read = browser_target(F.when(~plain, url), allowed)
    scheme = F.when(plain, "http").otherwise(read["scheme"])
    host = F.when(plain, url_hostname(url)).otherwise(read["host"])
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    numeric = host.rlike(r"^\d+(\.\d+){3}$") | host.startswith("[")
    return (
        F.when(scheme.isNull(), "invalid_url")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(~plain & read["login"], "credentials")
        .when(F.size(allowed) == 0, "no_allowed_hosts")
        .when(~F.when(plain, host_allowed(url_hostname(url), allowed)).otherwise(read["allowed"]), "host_not_allowed")
        .when(numeric & F.coalesce(blocked_ipv4(host), blocked_ipv6(F.when(numeric & ~plain, bare))), "private_address")
    )


def target_parts(url: Column) -> Column:
    """What of ``target_refusal`` depends on the URL alone: struct(early, host, late).

    ``early`` is why any list of hosts refuses it, ``late`` why one that allows ``host`` does.
    """
    plain = F.coalesce(url.rlike(_PLAIN), F.lit(False))
    read = browser_target(F.when(~plain, url), F.array().cast("array<string>"))
    scheme = F.when(plain, "http").otherwise(read["scheme"])
    host = F.when(plain, url_hostname(url)).otherwise(read["host"])
    numeric = host.rlike(r"^\d+(\.\d+){3}$") | host.startswith("[")
    early = F.when(scheme.isNull(), "invalid_url").when(~scheme.isin("http", "https"), "scheme").when(~plain & read["login"], "credentials")
    late = F.when(numeric & F.coalesce(blocked_ipv4(host), blocked_ipv6(F.when(numeric & ~plain, F.regexp_replace(host, r"^\[|\]$", "")))), "private_address")
    return F.struct(early.alias("early"), host.alias("host"), late.alias("late"))


def parts_refusal(parts: Column, allowed: Column) -> Column:
    """``target_refusal`` of a URL whose ``target_parts`` are known (a stored column): only its host is compared."""
    unlisted = F.when(F.size(allowed) == 0, "no_allowed_hosts").when(~host_allowed(parts["host"], allowed), "host_not_allowed")
    return F.coalesce(parts["early"], unlisted, parts["late"])


#: An http(s) URL that is written as a browser shows it: lower case, a name whose last label is letters, nothing but a path without dots.
_SHOWN = r"^https?://(?![^/]*(?:xn--|\.\.))(?:[a-z0-9_-][a-z0-9_.-]*\.)?[a-z][a-z-]*(?:/[A-Za-z0-9_~/-]*)?\z"


def url_facts(url: Column) -> Column:
    """All that a crawl asks of a URL, read once: struct(key, early, host, late), as ``browser_key`` and ``target_parts`` give them.

    Only URLs that are not written as a browser shows them go to Python.
    """
    shown = F.coalesce(url.rlike(_SHOWN), F.lit(False))
    none = F.lit(None).cast("string")
    bare = F.rtrim(url, F.lit("/"))
    key = F.when(F.locate("/", bare, 9) > 0, bare).otherwise(F.concat(bare, F.lit("/")))
    host = F.substring_index(F.substring_index(url, "/", 3), "/", -1)
    plain = F.struct(key.alias("key"), none.alias("early"), host.alias("host"), none.alias("late"))
    return F.when(shown, plain).otherwise(browser_facts(F.when(~shown, url)))


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a long, NULL if it is none. Numbers of a part have no leading zeros."""
    part = F.split(address, r"\.", 5)
    at = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("int")
    number = at(0).cast("long") * 16777216 + at(1) * 65536 + at(2) * 256 + at(3)
    # written back, so signs, blanks, leading zeros and parts that are too long are found by one comparison
    plain = F.concat_ws(".", *[at(i).cast("string") for i in range(4)])
    small = F.greatest(*[at(i) for i in range(4)]) < 256
    return F.when(small & (plain == address) & ~address.contains("-"), number)


def blocked_ipv4(address: Column) -> Column:
    """Whether an IPv4 address lies in a blocked range; NULL if it is no IPv4 address.

    A range is a text prefix or a comparison of its first parts, so no number is worked out.
    """
    part = F.split(address, r"\.", 5)
    at = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("int")
    hit = F.lit(False)
    for network, prefix in BLOCKED_IPV4:
        own, fixed = [int(x) for x in network.split(".")], prefix // 8
        inside = F.lit(True)
        for i in range(fixed):
            inside = inside & (at(i) == own[i])
        if prefix % 8:
            inside = inside & at(fixed).between(own[fixed], own[fixed] + (1 << (8 - prefix % 8)) - 1)
        hit = hit | inside
    return F.when(ipv4_number(address).isNotNull(), hit)


def blocked_address(address: Column) -> Column:
    """Whether an address must not be fetched. IPv4 is decided in SQL; what is no address is blocked."""
    four = blocked_ipv4(address)
    return F.coalesce(four, blocked_ipv6(F.when(ipv4_number(address).isNull(), address)))


def normalised_hosts(hosts: Column) -> Column:
    """Trimmed, lower-case, without a final dot, each once."""
    return F.array_distinct(F.transform(hosts, lambda h: F.regexp_replace(F.lower(F.trim(h)), r"\.$", "")))


def host_problem(host: Column) -> Column:
    """Why a (normalised) host cannot be allowed, or NULL."""
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "blank")
        .when(host.contains("*"), "wildcard")
        .when(host.rlike(r"[:/?#@]"), "not_just_a_host")
        .when(F.length(host) > MAX_HOST, "too_long")
        .when(~host.rlike(rf"^{label}(?:\.{label})+$"), F.when(host.rlike(r"[^\x20-\x7e]"), "not_punycode").otherwise("not_a_hostname"))
        .when(host.rlike(r"(^|\.)\d+$"), "address")
        .when(host.isin(*PUBLIC_SUFFIXES), "public_suffix")
    )


# --- as browsers do -------------------------------------------------------------------------


PARTS = ("protocol", "host", "hostname", "pathname", "search")


@pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in PARTS]))
def browser_url(urls: pd.Series) -> pd.DataFrame:
    """The parts of each URL as a browser reads them; NULLs if it would refuse it."""
    rows = []
    for url in urls:
        u = parse_url(url)
        rows.append((None,) * 5 if u is None else (f"{u.scheme}:", u.hostport, u.host or "", u.path, u.search))
    return pd.DataFrame(rows, columns=list(PARTS))


@pandas_udf(T.StructType([T.StructField("scheme", T.StringType()), T.StructField("host", T.StringType()), T.StructField("login", T.BooleanType()), T.StructField("allowed", T.BooleanType())]))
def browser_target(urls: pd.Series, allowed: pd.Series) -> pd.DataFrame:
    """Scheme, host, whether a login is in each URL and whether its host is an allowed one or below, as a browser reads it; NULLs if it would refuse it."""
    rows = []
    for url, hosts in zip(urls, allowed, strict=True):
        u = parse_url(url)
        if u is None:
            rows.append((None,) * 4)
            continue
        host = (u.host or "").lower().removesuffix(".")
        entries = [x.lower().removeprefix("*.").removesuffix(".") for x in (hosts if hosts is not None else ()) if x is not None]
        rows.append((u.scheme, u.host or "", bool(u.user or u.password), any(host == x or host.endswith(f".{x}") for x in entries)))
    return pd.DataFrame(rows, columns=["scheme", "host", "login", "allowed"]).astype({"login": "boolean", "allowed": "boolean"})


FACTS = ("key", "early", "host", "late")


def _facts(url: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    u = parse_url(url)
    if u is None:
        return None, "invalid_url", None, None
    host = u.host or ""
    early = "scheme" if u.scheme not in ("http", "https") else "credentials" if u.user or u.password else None
    address = host[0:1] == "[" or re.fullmatch(r"[0-9]+(\.[0-9]+){3}", host)
    late = "private_address" if address and _blocked_v6(host.strip("[]")) else None
    path = re.sub(r"/+$", "", re.sub(r"/index\.html?$", "/", u.path, flags=re.IGNORECASE)) or "/"
    return ("null" if u.scheme == "file" else f"{u.scheme}://{u.hostport}") + path + u.search, early, host, late


@arrow_udf(T.StructType([T.StructField(c, T.StringType()) for c in FACTS]))
def browser_facts(urls: pa.Array) -> pa.Array:
    """``url_facts`` of URLs of any form."""
    none = _facts(None)
    rows = [none if url is None else _facts(url) for url in urls.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(FACTS))], FACTS)


# what is not deterministic for the optimizer is neither worked out twice nor moved before the rows are dealt out
browser_facts = browser_facts.asNondeterministic()


def browser_origin(url: Column) -> Column:
    """Protocol and host, NULL for a URL that a browser refuses; ``null`` where a URL has no host."""
    parts = browser_url(url)
    return F.when(parts["protocol"] == "file:", "null").otherwise(F.concat(parts["protocol"], F.lit("//"), parts["host"]))


def browser_key(url: Column) -> Column:
    """The discovery key as a browser builds it: origin, normalised path and query; NULL if it would refuse the URL."""
    parts = browser_url(url)
    return F.concat(browser_origin(url), normalise_path(parts["pathname"]), parts["search"])


def browser_step_path(page_url: Column, target_url: Column) -> Column:
    """Path and query of a page on the target's host as a browser reads both, else NULL."""
    page, target = browser_url(page_url), browser_url(target_url)
    return F.when(page["hostname"] == target["hostname"], F.concat(page["pathname"], page["search"]))


def journey_origin(entry_url: Column, typed_url: Column) -> Column:
    """Where a journey of crawled pages starts: the origin of the crawl's entry page, or of the URL as typed."""
    return F.coalesce(browser_origin(entry_url), browser_origin(typed_url))


@pandas_udf(T.StringType())
def navigation_url(paths: pd.Series, targets: pd.Series, roots: pd.Series) -> pd.Series:
    """Where a step's path leads: below the target URL, or without one to a file below the fixture root; NULL if it would leave the root."""

    def one(path: str | None, target: str | None, root: str | None) -> str | None:
        if path is None:
            return None
        if target:
            led = parse_url(path, parse_url(target if target.endswith("/") else f"{target}/"))
            return None if led is None else led.href
        if root is None:
            return None
        top = posixpath.normpath(root)
        place = posixpath.normpath(posixpath.join(top, path))
        return "file://" + quote(place) if place == top or place.startswith(top.rstrip("/") + "/") else None

    return pd.Series([one(*row) for row in zip(paths, targets, roots, strict=True)], dtype=object)


def _ranges(networks: list[str]) -> list[tuple[int, int]]:
    """First and last number of each network."""
    return [(int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, networks)]


#: Blocked ranges as numbers, worked out once and not once an address.
_RANGES_V4 = _ranges([f"{n}/{p}" for n, p in BLOCKED_IPV4])
_RANGES_V6 = _ranges(["fc00::/7", "fe80::/10", "ff00::/8"])


def _blocked_v6(address: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((address or "").split("%")[0])
    except ValueError:
        return True
    number, ranges = int(ip), _RANGES_V4
    if ip.version == 6:
        high = number >> 32
        if high in (0, 0xFFFF) or high == 0x0064FF9B << 64:
            number &= 0xFFFFFFFF
        elif number >> 112 == 0x2002:
            number = (number >> 80) & 0xFFFFFFFF
        else:
            ranges = _RANGES_V6
    return any(first <= number <= last for first, last in ranges)


@pandas_udf(T.BooleanType())
def blocked_ipv6(addresses: pd.Series) -> pd.Series:
    """Whether each address (either version) lies in a blocked range; what is no address is blocked."""
    return addresses.map(_blocked_v6).astype(bool)
