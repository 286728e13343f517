"""The YAML of front matter as values, by the events of an installed parser and the core schema."""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

try:
    import yaml
except ImportError:  # then front matter that isn't plain lines is refused
    yaml = None

#: Collections inside each other, the outermost mapping included, and values that aliases may stand for.
MOST_NESTED, MOST_ALIASES = 200, 100
# Why front matter is refused.
NO_MAPPING = "Front matter must be a YAML mapping."
NESTED = f"Front matter must not hold more than {MOST_NESTED} nested collections."
KEYS = "Front matter keys must be strings."
TAGS = "Front matter holds an invalid explicit YAML tag value."
RECURSIVE = "Front matter must not hold recursive YAML aliases."
FINITE = "Front matter numbers must be finite."
ALIASES = "Front matter holds too many aliases."
UNIQUE = "Front matter keys must be unique."
#: What the parser's complaints say of front matter, by a part of their words.
_COMPLAINTS = {
    "scanning a quoted scalar": "Front matter has an open quote", "cannot start any token": "Front matter has a reserved mark or is indented by tabs",
    "expected <block end>": "Front matter is indented unevenly", "did not find expected key": "Front matter is indented unevenly",
    "mapping values are not allowed": "Front matter nests a mapping within a line", "sequence entries are not allowed": "Front matter has a list within a line",
}

# The scalars of the core schema.
_NULL = re.compile(r"~|null|Null|NULL|")
_BOOL = re.compile(r"true|True|TRUE|false|False|FALSE")
_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+\.[0-9]*)(?:[eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")
_DATE = re.compile(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*", re.DOTALL)
_CORE = "tag:yaml.org,2002:"
_TEXTS = {"str": re.compile("(?s).*"), "binary": re.compile("(?s).*"), "timestamp": _DATE}
_TYPED = {"int": _INT, "float": _FLOAT, "bool": _BOOL, "null": _NULL}


class FrontMatterError(ValueError):
    pass


def scalar_value(text: str):
    """A plain scalar by the core schema; whole numbers are integers, however written."""
    if _NULL.fullmatch(text):
        return None
    if _BOOL.fullmatch(text):
        return text[0] in "tT"
    if _INT.fullmatch(text):
        return int(text, {"0o": 8, "0x": 16}.get(text[:2], 10))
    if _FLOAT.fullmatch(text):
        number = float(re.sub(r"\.(inf|nan)", r"\1", text.lower()))
        return int(number) if math.isfinite(number) and number.is_integer() else number
    return text


def _events(text: str) -> list:
    """The parser's events, with the complaint that ends them in our words."""
    if yaml is None:
        raise FrontMatterError("No YAML reader is installed for this front matter.")
    try:
        return list(yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
    except yaml.MarkedYAMLError as e:
        words = f"{e.context} {e.problem}"
        said = next((ours for part, ours in _COMPLAINTS.items() if part in words), "Front matter is no valid YAML")
        mark = e.context_mark if "quoted" in words else e.problem_mark or e.context_mark
        raise FrontMatterError(f"{said} at line {mark.line + 1}.") from None
    except yaml.YAMLError as e:
        raise FrontMatterError(f"Front matter is no valid YAML: {str(e).splitlines()[0]}") from None


def _tagged(tag: str, value, kind: str):
    """A value under an explicit tag: by the core schema's, checked; other tags wrap it under their name."""
    if not tag.startswith(_CORE):
        return {tag if tag.startswith("!") else f"!{tag}": value}
    name = tag.removeprefix(_CORE)
    pairs = kind == "seq" and all(isinstance(x, dict) and len(x) == 1 for x in value)
    if {"map": kind == "map", "set": kind == "map", "seq": kind == "seq", "omap": pairs, "pairs": pairs}.get(name, False):
        return value
    if kind == "scalar" and name in _TEXTS and _TEXTS[name].fullmatch(value):
        return value
    if kind == "scalar" and name in _TYPED and _TYPED[name].fullmatch(value):
        return scalar_value(value)
    raise FrontMatterError(TAGS)


class _Builder:
    """Values from events: a value is a pair of it and of how many aliases it stands on."""

    def __init__(self, text: str) -> None:
        self._text, self._events, self._i = text, _events(text), 0
        self._anchors: dict[str, tuple | None] = {}

    def _next(self):
        self._i += 1
        return self._events[self._i - 1]

    def document(self):
        kinds = [type(e) for e in self._events]
        if kinds.count(yaml.DocumentStartEvent) != 1:
            raise FrontMatterError(NO_MAPPING)
        self._i = kinds.index(yaml.DocumentStartEvent) + 1
        first = self._events[self._i]
        if not isinstance(first, yaml.MappingStartEvent) or (first.tag or f"{_CORE}map") not in (f"{_CORE}map", f"{_CORE}set"):
            raise FrontMatterError(NO_MAPPING)
        return self._value(self._next(), 0)[0]

    def _value(self, event, depth: int) -> tuple:
        if isinstance(event, yaml.AliasEvent):
            if event.anchor not in self._anchors:
                raise FrontMatterError(f"Front matter has an alias without an anchor at line {event.start_mark.line + 1}.")
            if (found := self._anchors[event.anchor]) is None:
                raise FrontMatterError(RECURSIVE)
            if found[1] >= MOST_ALIASES:
                raise FrontMatterError(ALIASES)
            return found[0], found[1] + 1
        if event.anchor:
            self._anchors[event.anchor] = None
        if isinstance(event, yaml.ScalarEvent):
            plain = not event.style and event.tag is None
            made = (scalar_value(event.value) if plain else event.value if event.tag in (None, "!") else _tagged(event.tag, event.value, "scalar")), 0
            if isinstance(made[0], float) and not math.isfinite(made[0]):
                raise FrontMatterError(FINITE)
        elif depth >= MOST_NESTED:
            raise FrontMatterError(NESTED)
        else:
            mapping = isinstance(event, yaml.MappingStartEvent)
            value, aliases = (self._mapping if mapping else self._sequence)(depth + 1)
            if aliases > MOST_ALIASES:
                raise FrontMatterError(ALIASES)
            made = (value if event.tag in (None, "!") else _tagged(event.tag, value, "map" if mapping else "seq")), aliases
        if event.anchor:
            self._anchors[event.anchor] = made
        return made

    def _sequence(self, depth: int) -> tuple[list, int]:
        found, aliases = [], 0
        while not isinstance(event := self._next(), yaml.SequenceEndEvent):
            value, more = self._value(event, depth)
            found.append(value)
            aliases += more
        return found, aliases

    def _mapping(self, depth: int) -> tuple[dict, int]:
        found, aliases = {}, 0
        while not isinstance(event := self._next(), yaml.MappingEndEvent):
            before = self._text[: event.start_mark.index].rpartition("\n")[2] if event.start_mark.column else ""
            if before.rstrip().endswith("?") or isinstance(event, yaml.CollectionStartEvent):
                raise FrontMatterError(KEYS)
            key, _ = self._value(event, depth)
            if not isinstance(key, str):
                raise FrontMatterError(KEYS)
            if key in found:
                raise FrontMatterError(UNIQUE)
            found[key], more = self._value(self._next(), depth)
            aliases += more
        return found, aliases


def front_matter(text: str) -> dict:
    """The mapping of some front matter; :class:`FrontMatterError` where it is none."""
    return _Builder(re.sub(r"\r\n?", "\n", text)).document()


_LIST = ArrayType(StringType())
READ = (
    StructType().add("invalid", StringType()).add("json", StringType()).add("rest", StringType()).add("keys", _LIST)
    .add("texts", MapType(StringType(), StringType())).add("lists", MapType(StringType(), _LIST))
    .add("values", MapType(StringType(), StringType()))
)


@F.pandas_udf(READ)
def read_front_matter(front: pd.Series) -> pd.DataFrame:
    """For each front matter that isn't null: why it is refused, or its JSON, that without resources, keys, text fields,
    lists of texts, and the values of all keys as JSON texts that are equal for equal values. Equal ones are read once."""
    known = {text: _read(text) for text in set(front)}
    return pd.DataFrame([known[text] for text in front], columns=READ.names)


def _read(text: str | None) -> tuple:
    """A row of :func:`read_front_matter`."""
    if text is None:
        return (None,) * 7
    try:
        found = front_matter(text)
    except FrontMatterError as e:
        return str(e), None, None, re.findall(r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):", text), {}, {}, {}
    texts = {k: v for k, v in found.items() if isinstance(v, str)}
    lists = {k: kept for k, v in found.items() if isinstance(v, list) and (kept := [x for x in v if isinstance(x, str)])}
    rest = {k: v for k, v in found.items() if k != "resource"}
    values = {k: json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in found.items()}
    return None, *[json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in (found, rest)], list(found), texts, lists, values


def ordered_entries(text: str, order: Sequence[str]) -> str:
    """The entries of a block mapping by rank and key, each after the entries whose anchors its aliases name.

    An entry is its lines. As long as one may come, the first by rank and key comes; entries that wait for one
    another come by rank too. An anchor that is set twice, a mapping in braces, or what is no mapping leaves all as it is.
    """
    try:
        events = _events(text)
    except FrontMatterError:
        return text
    first = next((e for e in events if isinstance(e, yaml.MappingStartEvent)), None)
    starts, keys, anchors, aliases, depth, is_key = [], [], [], [], 0, True
    for event in events:
        if isinstance(event, yaml.CollectionStartEvent):
            depth += 1
        if depth == 1 and event is not first and isinstance(event, yaml.NodeEvent) and is_key:
            starts.append(event.start_mark.line)
            text_key = isinstance(event, yaml.ScalarEvent) and (event.style or event.tag or isinstance(scalar_value(event.value), str))
            keys.append(event.value if text_key else None)
            anchors.append([])
            aliases.append(set())
        if starts and isinstance(event, yaml.AliasEvent):
            aliases[-1].add(event.anchor)
        elif starts and getattr(event, "anchor", None):
            anchors[-1].append(event.anchor)
        ends_node = isinstance(event, (yaml.ScalarEvent, yaml.AliasEvent)) and depth == 1 or isinstance(event, yaml.CollectionEndEvent) and depth == 2
        if isinstance(event, yaml.CollectionEndEvent):
            depth -= 1
        if ends_node:
            is_key = not is_key
    lines = text.rstrip("\n").split("\n")
    named = [a for own in anchors for a in own]
    if first is None or first.flow_style or len(set(named)) < len(named) or len(set(starts)) < len(starts) or any(lines[s][:1] in " \t?" for s in starts):
        return text
    owner = {a: i for i, own in enumerate(anchors) for a in own}
    waits = [{owner[a] for a in own if a in owner} - {i} for i, own in enumerate(aliases)]
    ranks = {key: n for n, key in reversed(list(enumerate(order)))}
    place = [(key is None, ranks.get(key, len(ranks)), key or "", i) for i, key in enumerate(keys)]
    after: list[list[int]] = [[] for _ in keys]
    for i, own in enumerate(waits):
        for j in own:
            after[j].append(i)
    free, every, done = [place[i] for i, own in enumerate(waits) if not own], sorted(place), []
    heapq.heapify(free)
    left, at = set(range(len(keys))), 0
    while left:
        while free and free[0][3] not in left:
            heapq.heappop(free)
        if free:
            i = heapq.heappop(free)[3]
        else:
            while every[at][3] not in left:
                at += 1
            i = every[at][3]
        done.append(i)
        left.discard(i)
        for j in after[i]:
            waits[j].discard(i)
            if j in left and not waits[j]:
                heapq.heappush(free, place[j])
    ends = [*starts[1:], len(lines)]
    pieces = ["\n".join(lines[starts[i] : ends[i]]) for i in done]
    return "\n".join([*lines[: starts[0]], *pieces]) + "\n" if starts else text


def with_anchors_ordered(front: Column, order: Sequence[str]) -> Column:
    """:func:`ordered_entries` of a column, null where it is."""

    @F.pandas_udf(StringType())
    def ordered(text: pd.Series) -> pd.Series:
        return text.map(lambda t: ordered_entries(t, order), na_action="ignore")

    return ordered(front)
