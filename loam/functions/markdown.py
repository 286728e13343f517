"""Places of headings and links in Markdown, for texts that need more than the regular expressions of parsing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Parentheses inside each other in a link's destination.
MOST_PARENTHESES = 64
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_OPENING = re.compile(r" {0,3}(`{3,}(?=[^`\r\n]*$)|~{3,})")
_TICKS = re.compile(r"`+")
_MARK = re.compile(r"\\[^\r\n]|!?\[|\]|[\r\n]")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
_SPACES = re.compile(r"[ \t]*")
_TITLE = re.compile(r"\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|\((?:[^)\\\r\n]|\\.)*\)")
_ANGLES = re.compile(r"<((?:[^<>\\\r\n]|\\[^\r\n])*)>")
_STEP = re.compile(r"(?:[^\\()\s]|\\[^\s]|\\(?=[\s]|\Z))+|[()]")


def without_fences(body: str) -> str:
    """Fenced code as blanks; every other character stays where it is."""
    out, fence = [], None
    for line in _LINE.findall(body):
        text = line.rstrip("\r\n")
        if fence is not None:
            mark = text.strip(" \t")
            if len(text) - len(text.lstrip(" ")) < 4 and mark and len(mark) >= len(fence) and set(mark) == {fence[0]}:
                fence = None
        elif match := _OPENING.match(text):
            fence = match[1]
        else:
            out.append(line)
            continue
        out.append(" " * len(text) + line[len(text) :])
    return "".join(out)


def without_code(text: str) -> str:
    """Code spans as blanks: from a run of backticks to the next of the same length."""
    runs = [(m.start(), m.end()) for m in _TICKS.finditer(text)]
    runs = [(s + 1, e) if _escaped(text, s) else (s, e) for s, e in runs]
    runs = [(s, e) for s, e in runs if s < e]
    later: dict[int, list[int]] = {}
    for i in range(len(runs) - 1, -1, -1):
        later.setdefault(runs[i][1] - runs[i][0], []).append(i)
    out, at, i = [], 0, 0
    while i < len(runs):
        start, end = runs[i]
        same = later[end - start]
        while same and same[-1] <= i:
            same.pop()
        if same:
            close = same[-1]
            out += [text[at:start], re.sub(r"[^\r\n]", " ", text[start : runs[close][1]])]
            at, i = runs[close][1], close
        i += 1
    return "".join([*out, text[at:]])


def _escaped(text: str, at: int) -> bool:
    start = at
    while start and text[start - 1] == "\\":
        start -= 1
    return (at - start) % 2 == 1


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """(target, place after the closing parenthesis) of what follows an opening one."""
    start = at
    at = _SPACES.match(text, at).end()
    target = ""
    if at == start or text[at : at + 1] not in (")", '"', "'", "("):
        if text[at : at + 1] == "<":
            found = _ANGLES.match(text, at)
            if not found:
                return None
            target, start = found[1], found.end()
        else:
            begin, depth = at, 0
            while step := _STEP.match(text, at):
                if step[0] == "(":
                    depth += 1
                    if depth > MOST_PARENTHESES:
                        return None
                elif step[0] == ")":
                    if not depth:
                        return text[begin:at], step.end()
                    depth -= 1
                at = step.end()
            if depth or text[at : at + 1] in ("\r", "\n", ""):
                return None
            target, start = text[begin:at], at
    else:
        start = at - 1  # blanks stand before what follows
    at = _SPACES.match(text, start).end()
    if text[at : at + 1] == ")":
        return target, at + 1
    title = _TITLE.match(text, at) if at > start else None
    if not title:
        return None
    at = _SPACES.match(text, title.end()).end()
    return (target, at + 1) if text[at : at + 1] == ")" else None


def links(body: str) -> Iterator[tuple[str, str, int, int]]:
    """(label, target, start, end) of the inline links; images are none, and a link holds no other link."""
    masked = without_code(without_fences(body))
    open_: list[tuple[int, bool]] = []
    at = 0
    while mark := _MARK.search(masked, at):
        at = mark.end()
        if mark[0] in ("[", "!["):
            open_.append((at - 1, mark[0] == "!["))
        elif mark[0] in ("\r", "\n"):
            open_ = []
        elif mark[0] == "]" and open_:
            start, image = open_.pop()
            if image or masked[at : at + 1] != "(":
                continue
            found = _destination(body, at + 1)
            if found:
                yield body[start + 1 : at - 1].strip(), found[0], start, found[1]
                at = found[1]
                open_ = [o for o in open_ if o[1]]  # what surrounds a link is no link


def without_links(text: str) -> str:
    """The text with each inline link as its label, and without images; of a link in a label only the inner one counts."""
    open_: list[tuple[int, bool]] = []
    gone: list[tuple[int, int]] = []
    at = 0
    while mark := _MARK.search(text, at):
        at = mark.end()
        if mark[0] in ("[", "!["):
            open_.append((at - 1, mark[0] == "!["))
        elif mark[0] in ("\r", "\n"):
            open_ = []
        elif mark[0] == "]" and open_:
            start, image = open_.pop()
            found = _destination(text, at + 1) if text[at : at + 1] == "(" else None
            if found and image:
                gone.append((start - 1, found[1]))
                at = found[1]
            elif found:
                gone += [(start, start + 1), (at - 1, found[1])]
                at = found[1]
                open_ = [o for o in open_ if o[1]]
    out, done = [], 0
    for start, end in sorted(gone):
        out.append(text[done:start])
        done = max(done, end)
    return "".join([*out, text[done:]])


def headings(body: str) -> Iterator[tuple[int, str, int, int]]:
    """(level, title, start, end) of the headings with number signs."""
    at = 0
    for line in _LINE.findall(without_fences(body)):
        text = line.rstrip("\r\n")
        if match := _HEADING.fullmatch(text):
            yield len(match[1]), (match[2] or "").strip(" \t"), at, at + len(text)
        at += len(line)


_PLACES = ArrayType(
    StructType().add("what", StringType()).add("label", StringType()).add("target", StringType())
    .add("line", IntegerType()).add("column", IntegerType()).add("offset", IntegerType())
)


def _places(content: str, body: str) -> list[tuple]:
    """Headings and links with line, column and offset in the file; columns and offsets count UTF-16 units."""
    head = len(content) - len(body)
    ends = [m.end() for m in re.finditer(r"\r\n|\n|\r", content)]
    wide = [m.start() for m in re.finditer(r"[\U00010000-\U0010ffff]", content)]
    from bisect import bisect_left, bisect_right

    def place(at: int) -> tuple[int, int, int]:
        line = bisect_right(ends, at)
        start = ends[line - 1] if line else 0
        offset = at + bisect_left(wide, at)
        return line + 1, offset - start - bisect_left(wide, start) + 1, offset

    found = [("heading", title, None, *place(head + start)) for _, title, start, _ in headings(body)]
    return found + [("link", label, target, *place(head + start)) for label, target, start, _ in links(body)]


@F.pandas_udf(_PLACES)
def places(content: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or b is None else _places(c, b) for c, b in zip(content, body)], dtype=object)


@F.pandas_udf(ArrayType(StructType().add("text", StringType()).add("target", StringType())))
def scanned_links(body: pd.Series) -> pd.Series:
    """Links of the texts that aren't null, by a scan in linear time."""
    return pd.Series([None if b is None else [(label or None, target) for label, target, *_ in links(b)] for b in body], dtype=object)


@F.pandas_udf(StringType())
def unlinked(text: pd.Series) -> pd.Series:
    """:func:`without_links` of the texts that aren't null."""
    return text.map(without_links, na_action="ignore")
