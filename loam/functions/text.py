"""Column expressions for bundle text: patterns, slugs, tokens, links, time stamps.

All of them are built-in functions, so they stay inside generated code. Java's ``\\b`` and ``\\s``
differ from the Markdown tools' in what they count as a letter or as white space, so patterns
spell their classes out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
AWS_KEY = r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])"
BLANKS = r"\t\x0B\f \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SECRET_VALUE = rf"(?i)(?<![A-Za-z0-9_])(?:api[_-]?key|secret|token)(?![A-Za-z0-9_])[{BLANKS}]*[:=][{BLANKS}]*['\"]?[A-Za-z0-9_.-]{{20,}}"
EMAIL = r"(?i)(?<![A-Z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Z0-9_])"
TAG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
FILE_NAME = r"^[a-z0-9][a-z0-9_./-]*\.md$"
ISO_UTC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{3})?Z$"
TOKEN_BREAK = r"[^\p{IsAlphabetic}\p{N}_-]+"
WIDE_BREAK = r"[^\x00-\x7F\p{IsAlphabetic}\p{N}]+"  # that part of it which isn't ASCII
RESERVED = ("index.md", "log.md")
VERSIONS = ("0.1",)
STALE_DAYS = 180
HUB_DEGREE = 25


def trimmed(c: Column) -> Column:
    """Without Markdown white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(F.length(trimmed(c)), F.lit(0)) == 0


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def slugify(title: Column) -> Column:
    """Heading to anchor: lower case, words joined by single dashes."""
    bare = F.regexp_replace(F.lower(title), r"[`*_~]", "")
    kept = F.regexp_replace(bare, rf"[^\p{{IsAlphabetic}}\p{{N}}{SPACE}-]+", "")
    dashed = F.regexp_replace(trimmed(kept), rf"[{SPACE}]+", "-")
    return F.regexp_replace(dashed, "-+", "-")


def ascii_slug(c: Column, fallback: str = "item") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", F.lit(fallback)).otherwise(made)


def tokens(c: Column) -> Column:
    """Sorted different search terms of two characters and more."""
    split = F.split(F.lower(c), TOKEN_BREAK)
    return F.sort_array(F.array_distinct(F.filter(split, lambda t: F.length(t) >= 2)))


def narrow_breaks(c: Column) -> Column:
    """A text's terms as in :func:`tokens`, in place and repeated, with nothing but ASCII characters between them."""
    return F.regexp_replace(F.lower(c), WIDE_BREAK, " ")


def unescape_destination(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def link_kind(raw: Column) -> Column:
    """anchor, external, internal, or unknown for a blank target."""
    target = trimmed(unescape_destination(raw))
    return (
        F.when(target == "", "unknown")
        .when(target.startswith("#"), "anchor")
        .when(target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), "external")
        .otherwise("internal")
    )


def concept_id(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_kind(path: Column) -> Column:
    name = base_name(path)
    return F.when(name == RESERVED[0], "index").when(name == RESERVED[1], "log").otherwise("concept")


def iso_utc_ms(c: Column) -> Column:
    """Milliseconds of a strict UTC time stamp with a real date; null for anything else."""
    return F.when(c.rlike(ISO_UTC), F.unix_millis(F.try_to_timestamp(c)))


def normalized_timestamp(c: Column) -> Column:
    """A real date gets midnight UTC; other texts stay."""
    date = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(c).isNotNull()
    return F.when(date, F.concat(c, F.lit("T00:00:00.000Z"))).otherwise(c)


# Each pattern is tried only where a fixed part of it is found, which is far cheaper to look for.


def has_private_key(c: Column) -> Column:
    return F.contains(c, F.lit("-----BEGIN ")) & c.rlike(PRIVATE_KEY)


def has_token(c: Column) -> Column:
    low = F.lower(c)
    named = F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | (F.contains(low, F.lit("api")) & F.contains(low, F.lit("key")))
    return (F.contains(c, F.lit("AKIA")) & c.rlike(AWS_KEY)) | (named & c.rlike(SECRET_VALUE))


def has_email(c: Column) -> Column:
    return F.contains(c, F.lit("@")) & c.rlike(EMAIL)


def normalized_body(c: Column) -> Column:
    """Line feeds only, no blanks at line ends, no double or outer empty lines, one final line feed.

    For text without fenced code; see :func:`loam.operators.formatting.formatted` for the rest.
    """
    lf = F.regexp_replace(c, r"\r\n|\r", "\n")
    bare = F.regexp_replace(lf, r"[ \t]+(?=\n|$)", "")
    once = F.regexp_replace(bare, r"\n{3,}", "\n\n")
    inner = F.regexp_replace(once, r"^\n+|\n+$", "")
    return F.when(inner == "", F.lit("")).otherwise(F.concat(inner, F.lit("\n")))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([\\`*_\[\]<>#|])", r"\\$1"), r"[\r\n]+", " ")


def escape_markdown_text(c: Column) -> Column:
    """The text on one line, with a backslash before every ASCII punctuation character."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?|\n", " "), r"([!-/:-@\[-`{-~])", r"\\$1")


def json_text(c: Column) -> Column:
    """The text as a JSON string, which is also a YAML scalar; null for null."""
    made = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(made, F.lit(6), F.length(made) - 6))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def canonical_json(c: Column) -> Column:
    """JSON text with keys in order at every level, so that equal values are equal texts."""
    return F.to_json(F.try_parse_json(c))


def code_span(c: Column) -> Column:
    """The text as an inline code span, in more backticks than it holds in a row."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)
    ticks = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(c.startswith("`") | c.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(ticks, pad, c, pad, ticks)


def spaced_code_span(c: Column) -> Column:
    """The text on one line as a code span with a space on either side."""
    flat = F.regexp_replace(c, r"\r\n?|\n", " ")
    runs = F.transform(F.regexp_extract_all(flat, F.lit("(`+)"), F.lit(1)), F.length)
    ticks = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    return F.concat(ticks, F.lit(" "), flat, F.lit(" "), ticks)


def title_from_path(path: Column) -> Column:
    """A file's name as a title: words for dashes and underscores, capitals at their start."""
    return F.initcap(F.regexp_replace(F.regexp_replace(base_name(path), r"\.md$", ""), "[-_]+", " "))


def terminal_safe(c: Column) -> Column:
    """Control characters, which could steer a terminal, as question marks."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "?")
