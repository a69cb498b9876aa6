"""URLs and HTML as browsers read them: the URL standard's parser and the HTML standard's tokenizer.

Plain Python for use in tasks; the column functions are in ``urls`` and ``scans``. Of the domain
rules (UTS 46, not transitional) the mapping, normalisation, code point and Punycode checks are
kept; right-to-left and joiner rules between the letters of a label are not looked at.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

# Schemes with an authority and their default ports.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
# What each part escapes besides controls and what is beyond ASCII.
_QUERY, _FRAGMENT = " \"#<>'", ' "<>`'
_PATH = ' "#<>?`{}'
_USER = ' "#<>?`{}/:;=@[\\]^|'
#: Controls and blanks, which are cut off at both ends of a URL.
_EDGES = "".join(map(chr, range(0x21)))
_BAD_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_BAD_OPAQUE = re.compile(r"[\x00\t\n\r #/:<>?@\[\\\]^|]")
#: Full stops of other scripts, and letters that UTS 46 keeps where case folding would not.
_DOTS, _KEPT = "\u3002\uff0e\uff61", {"\u00df": "\u00df", "\u03c2": "\u03c2", "\u200c": "\u200c", "\u200d": "\u200d", "\u1e9e": "\u00df"}
_IGNORED = re.compile("[\u00ad\u034f\u180b-\u180f\u200b\u2060\u2064\ufe00-\ufe0f\ufeff]")


class Url(NamedTuple):
    """A parsed URL; ``host`` is None and ``path`` opaque where the scheme has no authority. Query and fragment are None if absent."""

    scheme: str
    user: str
    password: str
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def hostport(self) -> str:
        return (self.host or "") + ("" if self.port is None else f":{self.port}")

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    @property
    def href(self) -> str:
        login = "" if not (self.user or self.password) else self.user + (f":{self.password}" if self.password else "") + "@"
        front = f"{self.scheme}:" + ("" if self.host is None else f"//{login}{self.hostport}")
        return front + self.path + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")


def _escaped(text: str, also: str) -> str:
    """Percent-encoding of controls, of what is beyond ASCII and of ``also``; escapes that are there stay."""
    if text.isascii() and text.isprintable() and frozenset(also).isdisjoint(text):
        return text
    raw = text.encode("utf-8", "replace")
    return "".join(chr(b) if 0x20 <= b < 0x7F and chr(b) not in also else f"%{b:02X}" for b in raw)


def _ascii_domain(name: str) -> str | None:
    """A domain's ASCII form by UTS 46, or None."""
    if name.isascii():
        mapped = name.lower()
    else:
        mapped = _IGNORED.sub("", "".join("." if c in _DOTS else _KEPT.get(c) or unicodedata.normalize("NFKC", c.casefold()).casefold() for c in name))
        mapped = unicodedata.normalize("NFC", mapped)
    if mapped.isascii() and "xn--" not in mapped:
        return mapped
    labels = []
    for label in mapped.split("."):
        if label.startswith("xn--"):
            try:
                plain = label[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                return None
            if not plain or plain.isascii() or _ascii_domain(plain) != label:
                return None
        elif not label.isascii():
            if unicodedata.category(label[0]).startswith("M") or any(unicodedata.category(c) in ("Cc", "Cs", "Co", "Cn", "Zs", "Zl", "Zp") for c in label):
                return None
            label = "xn--" + label.encode("punycode").decode("ascii")
        labels.append(label)
    return ".".join(labels)


def _number(part: str) -> int | None:
    """A part of an IPv4 host: decimal, octal after 0, hexadecimal after 0x."""
    base = 16 if part[:2] in ("0x", "0X") else 8 if len(part) > 1 and part[0] == "0" else 10
    digits = part[2:] if base == 16 else part
    if base == 16 and not digits:
        return 0
    allowed = "0123456789abcdef"[:base]
    return int(digits, base) if digits and all(c in allowed for c in digits.lower()) else None


def _ipv4(host: str) -> str | bool | None:
    """A host that ends in a number as dotted decimals, None if that is no address; False if it does not end in one."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isascii() and last.isdigit()) and not re.fullmatch(r"0[xX][0-9a-fA-F]*", last):
        return False
    if len(parts) > 4:
        return None
    numbers = [_number(p) for p in parts]
    if any(n is None for n in numbers) or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str | None:
    """An IPv6 address in its shortest form, or None."""
    quad = re.search(r"(?:^|:)(\d+)\.(\d+)\.(\d+)\.(\d+)$", text)
    if quad:
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in quad.groups()):
            return None
        a, b, c, d = map(int, quad.groups())
        text = text[: quad.start(1)] + f"{a << 8 | b:x}:{c << 8 | d:x}"
    halves = text.split("::")
    if len(halves) > 2 or not text:
        return None
    groups = [h.split(":") if h else [] for h in halves]
    if any(not re.fullmatch(r"[0-9a-fA-F]{1,4}", g) for half in groups for g in half):
        return None
    known = sum(map(len, groups))
    if (len(halves) == 1 and known != 8) or (len(halves) == 2 and known > 7):
        return None
    values = [int(g, 16) for g in groups[0]] + [0] * (8 - known) + [int(g, 16) for half in groups[1:] for g in half]
    runs, at = [], 0
    while at < 8:
        end = at
        while end < 8 and values[end] == 0:
            end += 1
        if end - at > 1:
            runs.append((at - end, at, end))
        at = max(end, at + 1)
    shown = [f"{v:x}" for v in values]
    if not runs:
        return ":".join(shown)
    _, low, high = min(runs)
    return ":".join(shown[:low]) + "::" + ":".join(shown[high:])


def parse_host(text: str, special: bool = True) -> str | None:
    """A host as a URL shows it, or None if there is none: domains in ASCII, IPv4 in dotted decimals, IPv6 in brackets."""
    if text.startswith("["):
        found = _ipv6(text[1:-1]) if text.endswith("]") else None
        return None if found is None else f"[{found}]"
    if not special:
        return None if _BAD_OPAQUE.search(text) else _escaped(text, "")
    try:
        name = unquote_to_bytes(text).decode("utf-8") if "%" in text else text
    except UnicodeDecodeError:
        return None
    name = _ascii_domain(name)
    if not name or _BAD_HOST.search(name):
        return None
    address = _ipv4(name)
    return name if address is False else address


def _path(text: str, special: bool, before: list[str], file: bool = False) -> str:
    """A path with its dot segments worked off, on top of the segments before."""
    out = list(before)
    parts = re.split(r"[/\\]", text) if special else text.split("/")
    for i, part in enumerate(parts):
        name, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if name == "..":
            if out and not (file and len(out) == 1 and re.fullmatch("[A-Za-z]:", out[0])):
                out.pop()
            if last:
                out.append("")
        elif name != ".":
            if file and not out and re.fullmatch(r"[A-Za-z][:|]", part):
                part = part[0] + ":"
            out.append(_escaped(part, _PATH))
        elif last:
            out.append("")
    return "/" + "/".join(out)


def parse_url(text: str | None, base: Url | None = None) -> Url | None:
    """A URL, absolute or relative to a base, as a browser reads it; None where it would refuse it."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip(_EDGES))
    body, mark, tail = text.partition("#")
    fragment = _escaped(tail, _FRAGMENT) if mark else None
    found = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", body)
    if found:
        scheme, rest = found[1].lower(), body[found.end() :]
        special = scheme in PORTS
        if scheme == "file":
            base = base if base is not None and base.scheme == "file" else Url("file", "", "", "", None, "/", None, None)
        elif special and base is not None and base.scheme == scheme and not rest.startswith("//"):
            pass  # relative to a base of the same scheme
        elif special:
            return _with_authority(scheme, rest.lstrip("/\\"), fragment)
        elif rest.startswith("//"):
            return _with_authority(scheme, rest[2:], fragment)
        else:
            opaque, mark, query = rest.partition("?")
            path = _path(opaque[1:], False, []) if opaque.startswith("/") else _escaped(opaque, "")
            return Url(scheme, "", "", None, None, path, _escaped(query, ' "#<>') if mark else None, fragment)
    elif base is None:
        return None
    else:
        scheme, rest = base.scheme, body
        if base.host is None and not base.path.startswith("/"):
            return base._replace(fragment=fragment) if mark and not body else None
    special = scheme in PORTS
    slash = "/\\" if special else "/"
    if len(rest) > 1 and rest[0] in slash and rest[1] in slash:
        if scheme == "file":
            host, slashes, path = re.match(r"([^/\\?]*)([/\\]?)(.*)", rest[2:], re.S).groups()
            if re.fullmatch(r"[A-Za-z][:|]", host):
                return _located(Url("file", "", "", "", None, "/", None, None), host + slashes + path, [], fragment)
            name = "" if not host else parse_host(host)
            return None if name is None else _located(Url("file", "", "", "" if name == "localhost" else name, None, "/", None, None), path, [], fragment)
        return _with_authority(scheme, rest[2:].lstrip(slash) if special else rest[2:], fragment)
    if not rest:
        return base._replace(fragment=fragment)
    if rest[0] == "?":
        return base._replace(query=_escaped(rest[1:], _QUERY), fragment=fragment)
    if rest[0] in slash:
        return _located(base, rest[1:], [], fragment)
    return _located(base, rest, base.path.split("/")[1:-1], fragment)


def _located(at: Url, rest: str, before: list[str], fragment: str | None) -> Url:
    """``rest`` (a path and a query) on the host of ``at``."""
    path, mark, query = rest.partition("?")
    special = at.scheme in PORTS
    return at._replace(path=_path(path, special, before, at.scheme == "file"), query=_escaped(query, _QUERY if special else ' "#<>') if mark else None, fragment=fragment)


def _with_authority(scheme: str, rest: str, fragment: str | None) -> Url | None:
    special = scheme in PORTS
    authority, slash, after = re.match(r"([^/\\?]*)([/\\]?)(.*)" if special else r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    login, at, place = authority.rpartition("@")
    user, _, password = login.partition(":")
    ported = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place, re.S)
    if ported is None or (at and not place):
        return None
    name, port = ported[1], int(ported[2]) if ported[2] else None
    if (port or 0) > 65_535 or (not name and (special or ported[2] is not None or at)):
        return None
    host = parse_host(name, special) if name else ""
    if host is None:
        return None
    here = Url(scheme, _escaped(user, _USER), _escaped(password, _USER), host, None if port == PORTS.get(scheme) else port, "/" if special else "", None, fragment)
    return _located(here, after, [], fragment) if special or slash or after[:1] != "?" and after else here._replace(query=_escaped(after[1:], ' "#<>') if after else None)


# --- HTML -----------------------------------------------------------------------------------

# Elements whose content is text (noscript where scripts run), and how a name ends.
RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_TAG = re.compile(r"</?[A-Za-z]|<[!?]|</")
_NAME = re.compile(r"[^\t\n\f\r />]+")
_BLANKS = re.compile(r"[\t\n\f\r /]*")
_ATTRIBUTE = re.compile(r"(=?[^\t\n\f\r />=]*)[\t\n\f\r ]*(?:=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r >\"'][^\t\n\f\r >]*)|(?=>)|(?=[\"'])))?")
_REFERENCE = re.compile(r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_LONGEST = max(map(len, html5))


def attribute_text(raw: str) -> str:
    """An attribute's value: a named reference without semicolon stays as it is before a letter, digit or ``=``."""
    if "&" not in raw:
        return raw

    def read(found: re.Match) -> str:
        text = found[0]
        if text[1] == "#":
            return html.unescape(text if text.endswith(";") else text + ";") or "\ufffd"
        name = text[1:]
        for n in range(min(len(name), _LONGEST), 0, -1):
            if name[:n] in html5:
                after = name[n : n + 1] or raw[found.end() : found.end() + 1]
                if name[n - 1] != ";" and (after == "=" or (after.isascii() and after.isalnum())):
                    return text
                return html5[name[:n]] + name[n:]
        return text

    return _REFERENCE.sub(read, raw)


def _script_end(text: str, at: int) -> int:
    """Where a script's content ends: its end tag, but not one of a script that is written in a comment."""
    level = 0
    for found in re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I).finditer(text, at):
        if found[0] == "<!--":
            level = max(level, 1)
            if re.match(r"-*>", text[found.end() :][:64]):
                level = 0
        elif found[0] == "-->":
            level = 0
        elif not found[1]:
            level = 2 if level == 1 else level
        elif level < 2:
            return found.start()
        else:
            level = 1
    return len(text)


def start_tags(text: str) -> Iterator[tuple[str, dict[str, str], bool, bool]]:
    """(name, attributes, whether it is an end tag, whether it closes itself) of all tags that a browser with scripts finds.

    Comments, also open ones, and the content of scripts, styles and other text elements have no
    tags. In SVG and MathML such elements have ordinary content. Of equal attributes the first counts;
    values are as written. A tag that the text does not close is none.
    """
    at, foreign = 0, []
    while True:
        found = _TAG.search(text, at)
        if found is None:
            return
        at = found.start()
        if text.startswith("<!--", at):
            short = re.match(r"<!---?>", text[at : at + 6])
            end = None if short else re.compile(r"--!?>").search(text, at + 4)
            at = at + short.end() if short else end.end() if end else len(text)
            continue
        if text.startswith("<![CDATA[", at) and foreign:
            at = text.find("]]>", at)
            at = len(text) if at < 0 else at + 3
            continue
        closes = text.startswith("</", at)
        if not text[at + 1 + closes : at + 2 + closes].isalpha() or not text[at + 1 + closes].isascii():
            at = text.find(">", at)
            at = len(text) if at < 0 else at + 1
            continue
        name = _NAME.match(text, at + 1 + closes)
        tag, attributes, at, itself = name[0].lower(), {}, name.end(), False
        while True:
            blanks = _BLANKS.match(text, at)
            at = blanks.end()
            if at >= len(text):
                return
            if text[at] == ">":
                itself = text[at - 1] == "/"
                at += 1
                break
            found = _ATTRIBUTE.match(text, at)
            if found.end() < len(text) and text[found.end()] in "\"'" and text[found.start() : found.end()].rstrip("\t\n\f\r ").endswith("="):
                return  # a quoted value without an end
            value = next((x for x in found.groups()[1:] if x is not None), "")
            attributes.setdefault(found[1].lower(), value)
            at = max(found.end(), at + 1)
        if tag in ("svg", "math", "foreignobject", "desc") and not (itself and foreign):
            if closes and tag in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(tag) :]
            elif not closes and not itself and (tag in ("svg", "math") or foreign):
                foreign.append(tag)
        alien = bool(foreign) and foreign[-1] in ("svg", "math")
        yield tag, attributes, closes, alien
        if closes or alien:
            continue
        if tag == "plaintext":
            return
        if tag == "script":
            at = _script_end(text, at)
        elif tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I).search(text, at)
            at = end.start() if end else len(text)


def anchors(text: str | None) -> tuple[str | None, list[str | None]]:
    """The address of the first base element with one, and of every anchor with one, in order; None for an anchor of SVG.

    What stands in a template is no part of the page.
    """
    base, out, templates = None, [], 0
    for tag, attributes, closes, alien in start_tags(text or ""):
        if tag == "template" and not alien:
            templates = max(0, templates - 1) if closes else templates + 1
        elif not closes and not templates and "href" in attributes:
            if tag == "a":
                out.append(None if alien else attribute_text(attributes["href"]))
            elif tag == "base" and base is None and not alien:
                base = attribute_text(attributes["href"])
    return base, out


def page_anchors(text: str | None, url: str | None, most: int) -> list[str | None]:
    """Where the first ``most`` anchors of a page lead: resolved against its base, None where that cannot be read."""
    base, found = anchors(text)
    own = parse_url(url)
    named = parse_url(base, own) if base is not None else None
    if named is not None and named.scheme not in ("data", "javascript"):
        own = named
    out = []
    for link in found[:most]:
        at = None if link is None else parse_url(link, own)
        out.append(None if at is None else at.href)
    return out
