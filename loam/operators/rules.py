"""Rules as queries: every rule turns concepts or links into diagnostics, and lint is their union."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from loam.functions import text as T
from loam.functions.paths import aliases_of, has_private_url, is_private_host, resource_host
from loam.operators import graph as G
from loam.operators.scopes import scoped, within
from loam.session import written

# Severities from most to least, and score points of each.
SEVERITIES = ("error", "warning", "advice", "info")
RANK = {s: 4 - i for i, s in enumerate(SEVERITIES)}
POINTS = {"error": 20, "warning": 8, "advice": 3}
# The levels of the rules, by default and in presets.
DEFAULTS = {
    "spec/invalid-frontmatter": "error", "spec/unsupported-version": "error", "spec/missing-frontmatter": "error", "spec/missing-type": "error",
    "spec/invalid-concept-path": "error", "hygiene/missing-title": "warning", "hygiene/missing-description": "warning",
    "hygiene/empty-body": "warning", "hygiene/duplicate-title": "warning", "hygiene/duplicate-resource": "warning",
    "graph/broken-internal-link": "warning", "graph/orphan-concept": "advice", "graph/no-backlinks": "advice",
    "graph/high-degree-hub": "advice", "graph/circular-reference": "warning", "style/frontmatter-key-order": "warning",
    "style/timestamp-format": "warning", "style/tag-format": "warning", "style/file-name-format": "warning",
    "agent/missing-summary": "off", "agent/missing-usage": "off", "agent/missing-owner": "off",
    "agent/metric-missing-source": "off", "agent/runbook-missing-symptoms": "off", "agent/api-missing-auth-notes": "off",
    "security/suspicious-secret": "error", "security/private-key": "error", "security/token-looking-value": "warning",
    "security/unredacted-email": "warning", "security/internal-url": "warning", "security/private-url": "warning",
    "security/non-allowlisted-resource": "error", "agent/missing-index": "off", "agent/stale-timestamp": "off",
    "agent/deprecated-missing-replacement": "off",
}
PRESETS = {
    "recommended": {
        "spec/missing-type": "error", "spec/invalid-frontmatter": "error", "hygiene/missing-title": "warning",
        "hygiene/missing-description": "warning", "hygiene/empty-body": "warning", "graph/broken-internal-link": "warning",
        "graph/orphan-concept": "advice", "security/suspicious-secret": "error", "security/private-key": "error",
        "security/token-looking-value": "warning", "security/unredacted-email": "warning", "security/internal-url": "warning",
    },
    "strict": {
        "hygiene/missing-title": "error", "hygiene/missing-description": "error", "hygiene/empty-body": "error",
        "graph/broken-internal-link": "error", "graph/no-backlinks": "warning", "style/frontmatter-key-order": "warning",
        "style/timestamp-format": "warning", "security/private-key": "error", "security/token-looking-value": "warning",
        "security/unredacted-email": "warning", "security/internal-url": "warning", "security/private-url": "warning",
        "security/non-allowlisted-resource": "error",
    },
    "agent-ready": {
        "agent/missing-summary": "advice", "agent/missing-usage": "advice", "agent/missing-owner": "advice",
        "agent/metric-missing-source": "warning", "agent/runbook-missing-symptoms": "warning", "agent/api-missing-auth-notes": "advice",
        "graph/no-backlinks": "advice", "graph/orphan-concept": "advice",
    },
}
#: The level from which a lint fails, where a preset sets one.
PRESET_FAIL_ON = {"strict": "warning"}
DOCTOR = {"agent/missing-index": "warning", "agent/stale-timestamp": "warning", "agent/deprecated-missing-replacement": "warning"}
KEY_ORDER = ("type", "title", "description", "resource", "tags", "timestamp")


@dataclass
class Config:
    """Levels by rule over presets and defaults, and the rules' parameters."""

    rules: Mapping[str, str] = field(default_factory=dict)
    presets: tuple[str, ...] = ("recommended",)
    version: str = "0.1"
    allow_hosts: tuple[str, ...] = ()
    key_order: tuple[str, ...] = KEY_ORDER
    hub_degree: int = T.HUB_DEGREE
    stale_days: int = T.STALE_DAYS
    now_ms: int | None = None
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ()
    fail_on: str | None = None

    def __post_init__(self):
        for name in self.presets:
            if name not in PRESETS:
                raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
        for rule, level in self.rules.items():
            if level not in (*SEVERITIES, "off") or (rule not in DEFAULTS and "/" not in rule):
                raise ValueError(f"no such rule or level: {rule!r}: {level!r}")
        if self.fail_on is not None and self.fail_on not in SEVERITIES:
            raise ValueError(f"no such level: {self.fail_on!r}")

    def level(self, rule: str, default: str | None = None) -> str:
        found = DEFAULTS[rule] if default is None else default
        for name in self.presets:
            found = PRESETS[name].get(rule, found)
        return self.rules.get(rule, found)

    @property
    def fails_on(self) -> str:
        """The level from which a lint fails: the configured one, that of the last preset with one, or error."""
        found = [PRESET_FAIL_ON[p] for p in self.presets if p in PRESET_FAIL_ON]
        return self.fail_on or (found[-1] if found else "error")


@dataclass
class Context:
    """What rules read: parsed files, links and degrees. Each is a table that rules share.

    With ``scope``, a column's name, the rows are many bundles', whose ids are scoped by it; see :mod:`loam.operators.scopes`.
    """

    parsed: DataFrame
    links: DataFrame
    config: Config
    scope: str | None = None

    @property
    def concepts(self) -> DataFrame:
        return self.parsed.where("kind = 'concept'")

    @property
    def edges(self) -> DataFrame:
        return self.links.where("kind = 'internal' AND resolved").select("source", "target")

    @property
    def concept_edges(self) -> DataFrame:
        """The edges between concepts."""
        inner = self.edges.join(self.concepts.select(F.col("id").alias("source")), "source", "left_semi")
        return inner.join(self.concepts.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")

    def shared_key(self, key: Column) -> Column:
        """What rows of one bundle share by ``key``."""
        return scoped(F.col(self.scope), key) if self.scope else key

    def each(self, having: Column | None = None) -> DataFrame:
        """(path, id): one row without a path for the bundle, or for each of many, if ``having`` holds of its files."""
        whole = self.parsed.groupBy(self.scope) if self.scope else self.parsed.groupBy()
        rows = whole.agg((F.lit(True) if having is None else having).alias("has")).where("has")
        none = F.lit(None).cast("string")
        return rows.select(none.alias("path"), (scoped(F.col(self.scope), F.lit("")) if self.scope else none).alias("id"))

    @cached_property
    def has_internal_links(self) -> bool:
        return bool(self.links.where("kind = 'internal'").limit(1).count())

    @cached_property
    def has_resources(self) -> bool:
        return bool(self.parsed.where(F.size("resource") > 0).limit(1).count())

    @cached_property
    def degree(self) -> DataFrame:
        """Written once, as several rules read it."""
        return written(G.degrees(self.concepts, self.edges), "degrees")


def found(rows: DataFrame, message: str | Column, path: str | None = "path", concept: str | None = "id") -> DataFrame:
    """Diagnostics of some rows; the code and the level come with the union."""
    text = F.lit(message) if isinstance(message, str) else message
    column = lambda c: F.lit(None).cast("string") if c is None else F.col(c)
    return rows.select(text.alias("message"), column(path).alias("path"), column(concept).alias("concept_id"))


def _has_heading(pattern: str) -> Column:
    return F.exists("headings", lambda h: F.lower(h["title"]).rlike(pattern))


def _titled(word: str) -> Column:
    """Whether a heading is this word or ends in it."""
    return F.exists("headings", lambda h: (F.lower(h["title"]) == word) | F.lower(h["title"]).endswith(f" {word}"))


def _typed(*types: str) -> Column:
    return F.lower("type").isin(*types)


def _scanned(concepts: DataFrame) -> DataFrame:
    """With the text that secrets are looked for in, and whether it holds a private key or a token, each tried once."""
    rows = concepts.withColumn("scanned", F.concat_ws("\n", "front_json", "front", "body"))
    return rows.withColumns({"private": T.has_private_key(F.col("scanned")), "token": T.has_token(F.col("scanned"))})


def _shared(rows: DataFrame, message: str) -> DataFrame:
    """Members of groups of two and more (columns: key, path, id).

    Groups are counted first and joined back on the key, which Spark can split where a key is hot.
    """
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found(rows.join(groups, "key"), message)


#: URLs in a text, as far as no blank, quote or angle bracket ends them.
_URL = r"(?i)(?<![A-Za-z0-9_])(https?://[^\s<>\"']+)"


def _internal_urls(c: Context) -> DataFrame:
    """Concepts with a URL of a private host outside their resources."""
    plain = F.regexp_replace(F.coalesce("front", F.lit("")), r"(?m)^resource:.*(?:\n[ ]*-.*)*", "")
    text = F.concat_ws("\n", F.coalesce("front_rest", F.when(F.col("invalid").isNull(), plain)), "body")
    rows = c.concepts.where(F.contains(F.lower(text), F.lit("http"))).select("path", "id", F.array_distinct(F.regexp_extract_all(text, F.lit(_URL), F.lit(1))).alias("urls"))
    return rows.where(F.size("urls") > 0).where(has_private_url("urls"))


def _resources(c: Context) -> DataFrame:
    return c.concepts.select("path", "id", F.explode("resource").alias("url")).withColumn("host", resource_host("url"))


def _metric_source(c: Context) -> DataFrame:
    tables = c.concepts.where(_typed("table")).select(F.col("id").alias("target"))
    sourced = c.edges.join(tables, "target", "left_semi").select(F.col("source").alias("id"))
    return c.concepts.where(_typed("metric")).join(sourced, "id", "left_anti")


def _cycles(c: Context) -> DataFrame:
    cycles = G.representative_cycles(c.concept_edges, G.strong_components(c.concept_edges))
    if c.scope:
        cycles = cycles.withColumn("cycle", F.transform("cycle", within))
    return cycles.join(c.concepts.select(F.col("id").alias("scc"), "path"), "scc").withColumnRenamed("scc", "id")


def _stale(config: Config) -> Column:
    now = F.lit(config.now_ms).cast("long") if config.now_ms is not None else F.unix_millis(F.current_timestamp())
    return now - T.iso_utc_ms(F.col("timestamp")) > config.stale_days * 86_400_000


def _deprecated(config: Config) -> Column:
    old = (F.lower("status") == "deprecated") | F.exists("tags", lambda t: F.lower(t) == "deprecated")
    return F.coalesce(old, F.lit(False)) & ~F.coalesce("replaced", F.lit(False)) & ~_has_heading("replacement|migration|deprecation")


def _key_order(config: Config) -> Column:
    order = F.array(*[F.lit(k) for k in config.key_order])
    rank = lambda k: F.coalesce(F.nullif(F.array_position(order, k), F.lit(0)), F.lit(1 << 30))
    wanted = F.transform(F.array_sort(F.transform("keys", lambda k: F.struct(rank(k).alias("r"), k.alias("k")))), lambda x: x["k"])
    return wanted != F.col("keys")


def _bad_path(config: Config) -> Column:
    good = r"^(?!/)(?!.*//)(?!(?:.*/)?\.{1,2}/)(?:[^\\\x00]*/)?(?!\.{0,2}\.md$)[^/\\\x00]+\.md$"
    return F.col("front").isNotNull() & ~F.col("path").rlike(good)


def _version(c: Context) -> DataFrame:
    return c.each() if c.config.version not in T.VERSIONS else c.parsed.limit(0).select("path", "id")


#: Rules that decide on a concept alone: the condition and the message. Lint reads the concepts once for all of them.
ROW_RULES: dict[str, tuple[Callable[[Config], Column], str]] = {
    "spec/missing-frontmatter": (lambda c: F.col("front").isNull(), "The file has no front matter."),
    "spec/missing-type": (lambda c: F.col("front").isNotNull() & F.col("invalid").isNull() & T.blank(F.col("type")), "The concept has no type."),
    "spec/invalid-concept-path": (_bad_path, "The path is no normal relative path of a Markdown file."),
    "hygiene/missing-title": (lambda c: T.blank(F.col("title")), "The concept has no title."),
    "hygiene/missing-description": (lambda c: T.blank(F.col("description")), "The concept has no description."),
    "hygiene/empty-body": (lambda c: F.col("empty"), "The body is empty."),
    "style/frontmatter-key-order": (_key_order, "The front matter's keys are out of order."),
    "style/timestamp-format": (
        lambda c: F.col("timestamp").isNotNull() & T.iso_utc_ms(F.col("timestamp")).isNull(),
        "The time stamp is not ISO 8601 in UTC.",
    ),
    "style/file-name-format": (lambda c: ~F.col("path").rlike(T.FILE_NAME), "The file name has other characters than it should."),
    "agent/missing-summary": (
        lambda c: T.blank(F.col("description")) & ~_titled("summary"),
        "There is neither a summary nor a description.",
    ),
    "agent/missing-usage": (lambda c: _typed("api", "metric") & ~_titled("usage"), "There is no heading on usage."),
    "agent/missing-owner": (lambda c: _typed("api", "metric", "runbook") & T.blank(F.col("owner")), "There is no owner."),
    "agent/runbook-missing-symptoms": (lambda c: _typed("runbook") & ~_titled("symptoms"), "There is no heading on symptoms."),
    "agent/api-missing-auth-notes": (
        lambda c: _typed("api") & ~_has_heading(r"(?<![a-z0-9_])(?:auth(?:entication|orization|n|z)?|oauth2?)(?![a-z0-9_])"),
        "There is no heading on authentication.",
    ),
    "security/suspicious-secret": (lambda c: F.col("private") | F.col("token"), "The text seems to hold a secret."),
    "security/private-key": (lambda c: F.col("private"), "The text holds a private key."),
    "security/token-looking-value": (lambda c: F.col("token"), "The text holds what looks like a token."),
    "security/unredacted-email": (lambda c: T.has_email(F.col("scanned")), "The text holds an e-mail address."),
    "agent/stale-timestamp": (_stale, "The time stamp is old."),
    "agent/deprecated-missing-replacement": (_deprecated, "Deprecated without a replacement."),
}

#: Rules that need groups, links or several rows of a concept.
RULES: dict[str, Callable[[Context], DataFrame]] = {
    "spec/invalid-frontmatter": lambda c: found(c.parsed.where("invalid IS NOT NULL"), F.col("invalid"), concept="id" if c.scope else None),
    "spec/unsupported-version": lambda c: found(_version(c), "The bundle's version is not supported."),
    "hygiene/duplicate-title": lambda c: _shared(
        c.concepts.where(~T.blank(F.col("title"))).select(c.shared_key(F.lower(T.trimmed(F.col("title")))).alias("key"), "path", "id"),
        "Another concept has this title.",
    ),
    "hygiene/duplicate-resource": lambda c: _shared(
        c.concepts.withColumn("key", F.explode(F.array_distinct(F.transform("resource", lambda r: F.lower(T.trimmed(r))))))
        .where("key <> ''").select("path", "id", c.shared_key(F.col("key")).alias("key")),
        "Another concept has this resource.",
    ),
    "graph/broken-internal-link": lambda c: found(
        c.links.where("kind = 'internal' AND NOT resolved"), F.concat(F.lit("No file for the link to "), "target_raw"), "source_path", "source"
    ),
    "graph/orphan-concept": lambda c: found(_placed(c, G.orphans(c.degree)), "Nothing links here or from here."),
    "graph/no-backlinks": lambda c: found(_placed(c, G.no_backlinks(c.degree)), "Nothing links here."),
    "graph/high-degree-hub": lambda c: found(_placed(c, G.hubs(c.degree, c.config.hub_degree)), "The concept has very many neighbours."),
    "graph/circular-reference": lambda c: found(_cycles(c), F.concat(F.lit("Links go round: "), F.array_join("cycle", " -> "))),
    "style/tag-format": lambda c: found(
        c.concepts.select("path", "id", F.explode("tags").alias("tag")).where(~F.col("tag").rlike(T.TAG)), F.concat(F.lit("Not a tag: "), "tag")
    ),
    "agent/metric-missing-source": lambda c: found(_metric_source(c), "The metric links to no table."),
    "security/internal-url": lambda c: found(_internal_urls(c), "The text links to a private host."),
    "security/private-url": lambda c: found(_resources(c).where(is_private_host("host")), F.concat(F.lit("Private resource: "), "url")),
    "security/non-allowlisted-resource": lambda c: found(
        _resources(c).where(F.col("host").isNotNull() & ~F.col("host").isin([a for h in c.config.allow_hosts for a in aliases_of(h)])),
        F.concat(F.lit("Resource of another host: "), "url"),
    ),
    "agent/missing-index": lambda c: found(c.each(F.count_if(F.col("kind") == "index") == 0), "The bundle has no index."),
}


def _placed(c: Context, ids: DataFrame) -> DataFrame:
    return ids.join(c.concepts.select("id", "path"), "id")


def _row_diagnostics(c: Context, only: Callable[[str], bool]) -> DataFrame | None:
    """All active row rules in one pass: an array of what a concept breaks, exploded."""
    hits = []
    for code, (condition, message) in ROW_RULES.items():
        if (level := c.config.level(code)) != "off" and only(code):
            parts = {"code": code, "severity": level, "severity_rank": RANK[level], "message": message}
            hits.append(F.when(condition(c.config), F.struct(*[F.lit(v).alias(k) for k, v in parts.items()])))
    if not hits:
        return None
    broken = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("d")
    return _scanned(c.concepts).select(broken, "path", F.col("id").alias("concept_id")).select("d.*", "path", "concept_id")


#: What a contained rule may return, and the code of a diagnostic that tells of its failure.
EXTRA_COLUMNS, FAILED = ("message", "path", "concept_id"), "plugin/rule-failed"
_PORTABLE = r"^(?!/)(?![A-Za-z]:)(?!.*//)(?!(?:.*/)?\.{1,2}(?:/|$))[^\\\x00]+(?<!/)$"


def _contained(context: Context, code: str, level: str, rule: Callable[[Context], DataFrame]) -> DataFrame:
    """The diagnostics of an added rule, written; one ``plugin/rule-failed`` where it fails or returns anything else.

    A rule may give another ``code`` of its own, and must give a message; a path must be a normal relative one.
    """
    spark = context.parsed.sparkSession
    try:
        made = rule(context)
        if not isinstance(made, DataFrame) or "message" not in made.columns:
            raise TypeError("a rule must return a DataFrame with a column message")
        own = F.when(F.col("code") != "", F.col("code")) if "code" in made.columns else F.lit(None)
        text = [F.col(c).cast("string").alias(c) if c in made.columns else F.lit(None).cast("string").alias(c) for c in EXTRA_COLUMNS]
        rows = written(made.select(F.coalesce(own, F.lit(code)).alias("code"), *text), "rule")
        bad = rows.where("message IS NULL OR NOT coalesce(path RLIKE '" + _PORTABLE.replace("\\", "\\\\") + "', true)")
        if bad.limit(1).count():
            raise TypeError("a diagnostic needs a message, and its path must be a normal relative one")
    except Exception as e:  # whatever it is, it must not end the other rules' lint
        message = f"Rule {code!r} failed: {e}"
        row = [(FAILED, message[:2000], None, None)]
        rows, level = spark.createDataFrame(row, "code string, message string, path string, concept_id string"), "error"
    return rows.select("code", F.lit(level).alias("severity"), F.lit(RANK[level]).alias("severity_rank"), *EXTRA_COLUMNS)


def lint(
    context: Context,
    extra: Mapping[str, tuple[str, Callable[[Context], DataFrame]]] | None = None,
    only: Callable[[str], bool] = lambda code: True,
) -> DataFrame:
    """(code, severity, severity_rank, message, path, concept_id) of all rules that aren't off.

    ``extra`` adds rules: name to (severity, function of the context to (message, path, concept_id)). The configured
    level of a rule's name overrides its severity, and a rule that fails becomes a diagnostic.
    ``only`` leaves rules out by their code, before anything is built for them.
    """
    config = context.config
    out = _row_diagnostics(context, only)
    for code, rule in RULES.items():
        level = config.level(code)
        if level == "off" or not only(code) or not _may_fire(code, context):
            continue
        head = [F.lit(code).alias("code"), F.lit(level).alias("severity"), F.lit(RANK[level]).alias("severity_rank")]
        more = rule(context).select(*head, *EXTRA_COLUMNS)
        out = more if out is None else out.unionByName(more)
    for code, (severity, rule) in (extra or {}).items():
        if severity not in SEVERITIES:
            raise ValueError(f"no such level: {severity!r}")
        if (level := config.level(code, severity)) != "off" and only(code):
            more = _contained(context, code, level, rule)
            out = more if out is None else out.unionByName(more)
    if out is None:
        empty = "code string, severity string, severity_rank int, message string, path string, concept_id string"
        out = context.parsed.sparkSession.createDataFrame([], empty)
    return out


def _may_fire(code: str, context: Context) -> bool:
    """Whether a rule can find anything, as the context's written counts tell."""
    if code == "security/non-allowlisted-resource":
        return bool(context.config.allow_hosts)
    if code in ("graph/broken-internal-link", "graph/high-degree-hub", "graph/no-backlinks", "graph/circular-reference"):
        return context.has_internal_links
    if code in ("hygiene/duplicate-resource", "security/private-url"):
        return context.has_resources
    return True


def ordered(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy(F.desc("severity_rank"), F.coalesce("path", F.lit("")), "code", "message")


def severity_counts(diagnostics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row with a count of every severity, zeros included; ``by`` gives a row for each of its values."""
    return diagnostics.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def readiness(counts: DataFrame) -> DataFrame:
    """``counts`` with ``score``: 100 less the points of each diagnostic, at least 0."""
    lost = sum((F.col(s) * p for s, p in POINTS.items()), F.lit(0))
    return counts.withColumn("score", F.greatest(F.lit(0).cast("long"), F.lit(100) - lost))


def by_severity(diagnostics: DataFrame) -> DataFrame:
    """(severity_rank, severity, diagnostics): how many of each severity there are, most severe first, zeros left out."""
    return diagnostics.groupBy("severity_rank", "severity").agg(F.count(F.lit(1)).alias("diagnostics")).orderBy(F.desc("severity_rank"))


def used_rules(diagnostics: DataFrame) -> DataFrame:
    """(ordinal, code): the different rules of some diagnostics, in order of their codes."""
    # a handful of codes, so one task may number them
    return diagnostics.select("code").distinct().orderBy("code").select((F.monotonically_increasing_id()).alias("ordinal"), "code").coalesce(1)


def exceeds(diagnostics: DataFrame, fail_on: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: whether any diagnostic is as severe as ``fail_on``; ``by`` gives a row for each of its values."""
    return diagnostics.groupBy(*by).agg(F.coalesce(F.max("severity_rank") >= RANK[fail_on], F.lit(False)).alias("exceeds"))


def doctor_diagnostics(context: Context) -> DataFrame:
    """Diagnostics, written, with the agent-ready rules and the three of the doctor."""
    levels = {**DOCTOR, **context.config.rules}
    presets = context.config.presets if "agent-ready" in context.config.presets else (*context.config.presets, "agent-ready")
    config = Config(**{**context.config.__dict__, "rules": levels, "presets": presets})
    return written(lint(Context(context.parsed, context.links, config, context.scope)), "doctor")


def doctor(context: Context) -> tuple[DataFrame, DataFrame]:
    """The doctor's diagnostics, and one row of counts and score."""
    diagnostics = doctor_diagnostics(context)
    return diagnostics, readiness(severity_counts(diagnostics))
