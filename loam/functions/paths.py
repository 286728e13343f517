"""Link targets and resource hosts: the few functions that built-ins can't express, as Arrow UDFs."""

from __future__ import annotations

import ipaddress
import posixpath
import re
from collections.abc import Callable
from itertools import groupby
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def _decoded(match: re.Match) -> str:
    try:
        return unquote_to_bytes(match[0]).decode()
    except UnicodeDecodeError:
        return match[0]


def normalized_path(path: str) -> str:
    """A path with forward slashes and without single dots and parents that it names; a final slash stays."""
    path = path.replace("\\", "/")
    if not path:
        return ""
    found = posixpath.normpath(path)
    found = "/" + found.lstrip("/") if found.startswith("/") else found
    if found == ".":
        return ""
    return found + "/" if path.endswith("/") and not found.endswith("/") else found


def resolve_one(source: str, raw: str) -> str | None:
    """The bundle path that a link in ``source`` points to; None outside the bundle and for a target without a path."""
    target = re.split(r"[#?]", _ESCAPE.sub(r"\1", raw), maxsplit=1)[0]
    target = _RUN.sub(_decoded, target)
    if not target or "\0" in target:
        return None
    path = normalized_path(target[1:] if target.startswith("/") else posixpath.join(posixpath.dirname(normalized_path(source)), target))
    if not path or path == ".." or path.startswith(("../", "/")):
        return None
    return path.removesuffix(".md")


@F.pandas_udf(StringType())
def resolve_target(source: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or r is None else resolve_one(s, r) for s, r in zip(source, raw)], dtype=object)


# Schemes whose hosts are domains or addresses, and what no host holds.
SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")
_FORBIDDEN = re.compile(r"[\x00\t\n\r #/:<>?@\[\\\]^|]")


def _six(host: str) -> str | None:
    """An IPv6 address in its short form."""
    try:
        groups = [f"{int.from_bytes(pair):x}" for pair in zip(*[iter(ipaddress.IPv6Address(host).packed)] * 2)]
    except ValueError:
        return None
    best = max((len(list(run)) for zero, run in groupby(groups, key="0".__eq__) if zero), default=0)
    if best < 2:
        return ":".join(groups)
    at = next(i for i in range(8) if groups[i : i + best] == ["0"] * best)
    return ":".join(groups[:at]) + "::" + ":".join(groups[at + best :])


def host_of(url: str) -> str | None:
    """The host of a URL as a browser has it, in lower case, without brackets, port, user and final dots."""
    url = re.sub(r"[\t\r\n]", "", url.strip("".join(map(chr, range(33)))))
    match = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    if not match:
        return None
    scheme, rest = match[1].lower(), url[match.end() :]
    special = scheme in SPECIAL
    if special:
        rest = rest.replace("\\", "/") if scheme != "file" or rest[:2].replace("\\", "/") == "//" else ""
        rest = rest.lstrip("/") if scheme != "file" else rest[2:]
    elif rest.startswith("//"):
        rest = rest[2:]
    else:
        return None
    host = re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2]
    if host.startswith("["):
        inner, closed, port = host[1:].partition("]")
        host, port = _six(inner) if closed else None, port.removeprefix(":")
    else:
        host, _, port = host.partition(":")
        if special:
            host = _domain(host)
        elif _FORBIDDEN.search(host):
            return None
        else:
            host = "".join(c if " " < c <= "~" else quote(c) for c in host)
    if host is None or (port and not (port.isdigit() and port.isascii() and int(port) < 65536)):
        return None
    return host.rstrip(".").lower() or None


def _domain(host: str) -> str | None:
    host = unquote_to_bytes(host).decode("utf-8", "replace")
    try:
        host = host.lower() if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    if _FORBIDDEN.search(host) or "%" in host:
        return None
    if re.search(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$", host):  # ends in a number, so it is an address or nothing
        address = _address(host.removesuffix("."))
        return None if address is None else str(address)
    return host


def aliases_of(host: str) -> list[str]:
    """A configured host and the forms that URLs may have of it."""
    literal = host.lower()
    authority = f"[{literal}]" if ":" in literal else literal
    found = [literal] + [host_of(f"{scheme}://{authority}") for scheme in ("http", "any") if scheme == "any" or "%" not in literal]
    return list(dict.fromkeys(h for h in found if h))


def _address(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """Also short, integer, octal and hexadecimal IPv4 forms."""
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        pass
    parts = host.split(".")
    if not 1 <= len(parts) <= 4 or not all(re.fullmatch(r"0[xX][0-9a-fA-F]*|[0-9]+", p) for p in parts):
        return None
    try:
        numbers = [int(p, 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    value = 0
    for n in numbers[:-1]:
        if n > 255:
            return None
        value = value * 256 + n
    value = value * 256 ** (5 - len(parts)) + numbers[-1]
    return ipaddress.IPv4Address(value) if numbers[-1] < 256 ** (5 - len(parts)) else None


# Fixed networks that count as private.
PRIVATE = [
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
        "::/128", "::1/128", "fc00::/7", "fe80::/10",
    )
]


def private_one(host: str | None) -> bool:
    if not host:
        return False
    if host in ("localhost", "local") or host.endswith((".localhost", ".local")):
        return True
    address = _address(host)
    if address is None:
        return False
    if address.version == 6:
        low = int(address) & 0xFFFFFFFF
        if int(address) >> 32 in (0, 0xFFFF) and low >> 16:  # an IPv4 address within
            address = ipaddress.IPv4Address(low)
    return any(address.version == n.version and address in n for n in PRIVATE)


def _of_each(values: pd.Series, made: Callable[[str | None], object]) -> pd.Series:
    """What is made of each value, once for each different one."""
    known = {v: made(v) for v in set(values)}
    return pd.Series([known[v] for v in values], dtype=object)


@F.pandas_udf(StringType())
def resource_host(url: pd.Series) -> pd.Series:
    return _of_each(url, lambda u: None if u is None else host_of(u))


def trimmed_url(url: str) -> str:
    """Without the punctuation that follows a URL in a sentence; brackets go if they weren't opened in it."""
    opened = {")": url.count("(") - url.count(")"), "]": url.count("[") - url.count("]")}
    end = len(url)
    while end:
        last = url[end - 1]
        if last in opened and opened[last] < 0:
            opened[last] += 1
        elif last not in ".,;:!?":
            break
        end -= 1
    return url[:end]


@F.pandas_udf(BooleanType())
def has_private_url(urls: pd.Series) -> pd.Series:
    """Whether any of a list of URLs, as found in a text, has a private host."""
    return urls.map(lambda found: any(private_one(host_of(trimmed_url(u))) for u in found))


@F.pandas_udf(BooleanType())
def is_private_host(host: pd.Series) -> pd.Series:
    return _of_each(host, private_one)


def relative_one(source: str, target: str) -> str:
    return posixpath.relpath(target, posixpath.dirname(source) or ".")


@F.pandas_udf(StringType())
def relative_target(source: pd.Series, target: pd.Series) -> pd.Series:
    """How a link in ``source`` spells the path ``target``."""
    return pd.Series([None if s is None or t is None else relative_one(s, t) for s, t in zip(source, target)], dtype=object)


@F.pandas_udf(StringType())
def posix_path(path: pd.Series) -> pd.Series:
    """With forward slashes, and without the dots and parents that it names."""
    return path.map(normalized_path, na_action="ignore")


# Device names that no file may have.
DEVICES = ("CON", "PRN", "AUX", "NUL", *[f"{name}{i}" for name in ("COM", "LPT") for i in range(1, 10)])


def portable_segment(name: str, fallback: str) -> str:
    """A path's part that every file system takes."""
    name = re.sub(r"[<>:\"|?*\x00-\x1f]", "-", name).rstrip(" .") or fallback
    return f"_{name}" if name.split(".")[0].upper() in DEVICES else name


def concept_path_one(path: str) -> str:
    """The path of a concept that is made from a source path; ValueError where it has none within the bundle."""
    plain = re.sub(r"^\./", "", path.replace("\\", "/"))
    last = plain.split("/")[-1].strip()
    if not plain.strip() or plain.startswith("/") or "\0" in plain or re.match(r"[A-Za-z]:/", plain):
        raise ValueError(f"a source path must be a relative path: {path!r}")
    if last in ("", ".", "..") or re.sub(r"(?i)\.md$", "", last) in ("", ".", ".."):
        raise ValueError(f"a source path must name a file: {path!r}")
    parts: list[str] = []
    for part in plain.split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"a source path must stay within its folder: {path!r}")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    stem = portable_segment(re.sub(r"(?i)\.md$", "", parts.pop()), "concept")
    return "/".join([*(portable_segment(p, "segment") for p in parts), f"{stem}.md"])


@F.pandas_udf(StringType())
def concept_path(path: pd.Series) -> pd.Series:
    return path.map(concept_path_one)


@F.pandas_udf(StringType())
def path_key(path: pd.Series) -> pd.Series:
    """Equal for paths that some file system can't tell apart: composed characters in lower case."""
    return path.str.normalize("NFC").str.lower()


def identity_one(identity: str) -> str:
    """Fowler-Noll-Vo 1a of the UTF-16 units in 32 bits, in base 36 of seven digits at least."""
    units, value = identity.encode("utf-16-le", "surrogatepass"), 0x811C9DC5
    for i in range(0, len(units), 2):
        value = (value ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193 % (1 << 32)
    digits = ""
    while value:
        value, d = divmod(value, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits.rjust(7, "0")


@F.pandas_udf(StringType())
def identity_hash(identity: pd.Series) -> pd.Series:
    return identity.map(identity_one, na_action="ignore")
