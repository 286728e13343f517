"""Token counts of whole texts: pieces are counted once for each distinct pre-token, and summed by frequency."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from tokenizers import Tokenizer

from loam.session import small_batches, written

#: A single space between two characters that are no white space always begins a pre-token, so texts are cut there.
_BETWEEN = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
#: Where a text has none of these, nor a space at its ends, all its spaces are such.
_BESIDE = (*[" " + c for c in "\t\n\x0b\f\r"], *[c + " " for c in " \t\n\x0b\f\r"])
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters that every Unicode version has as such: ASCII's, and the Latin ones up to U+024F but for two signs among them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Chunks of these and ASCII need no Unicode tables: fixed values, the same alternatives as the byte-level pre-tokenizer's.
_SURE = re.compile(f"[\\x00-\\x7f{_LETTERS}]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\x0b\f\r{_LETTERS}0-9]+|[ \t\n\x0b\f\r]+(?![^ \t\n\x0b\f\r])|[ \t\n\x0b\f\r]+")
#: Chunks of text that a task remembers, and characters of them.
_REMEMBERED, _REMEMBERED_CHARS = 300_000, 16 << 20
#: Pre-tokens that are sent to all tasks with their pieces: the most common ones, at most so many, of so many bytes together.
COMMON, COMMON_BYTES = 1 << 16, 16 << 20


class PreTokenizer:
    """What a tokenizer file says of pre-tokens and special strings.

    It must be byte-level with the pattern of its library and without prefix space, normalizer or added
    strings that take the white space around them, as then the pieces of a text are those of its pre-tokens.
    """

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        found = json.loads(definition)
        first = found.get("pre_tokenizer") or {}
        added = found.get("added_tokens") or []
        if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or found.get("normalizer"):
            raise ValueError("only byte-level tokenizers without prefix space and normalizer have pieces by pre-token")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added strings must not depend on what is around them")
        specials = sorted((a["content"] for a in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def cut(self, text: str) -> tuple[list[str], list[str], int]:
        """(chunks, chunks with a space before them, special strings): no pre-token of a text spans two of them."""
        segments = self._special.split(text) if self._special is not None else [text]
        firsts, spaced = [], []
        for segment in segments:
            plain = segment[:1] != " " and segment[-1:] != " " and not any(x in segment for x in _BESIDE)
            if plain and (segment.isascii() or not _ODD_SPACE.search(segment)):
                first, *more = segment.split(" ")
            else:
                first, *more = _BETWEEN.split(segment)
            firsts.append(first)
            spaced += more
        return firsts, spaced, len(segments) - 1

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk, its space included."""
        if chunk.isascii() or _SURE.fullmatch(chunk):
            return _SPLIT.findall(chunk)
        # offsets, since the mapped strings have a character for each byte
        return [chunk[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]

    def count(self, text: str) -> tuple[Counter[str], int]:
        """The frequencies of a text's pre-tokens, and how many special strings it has, which are a token each."""
        firsts, spaced, specials = self.cut(text)
        return Counter(w for chunk in [*firsts, *[" " + c for c in spaced]] for w in self.words(chunk)), specials

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=4)
def _loaded(definition: str) -> PreTokenizer:
    return PreTokenizer(definition)


class _Sums:
    """Tokens of whole texts by their chunks: of each chunk what its common pre-tokens make together, and its other pre-tokens.

    Chunks are remembered up to a bound and then forgotten together; a single text's own are always held.
    """

    def __init__(self, own: PreTokenizer, common: dict[str, int]) -> None:
        self._own, self._common = own, common
        self._known: dict[str, int] = {}
        self._rest: dict[str, list[str]] = {}
        self._chars = 0

    def _look(self, chunk: str) -> tuple[int, list[str]]:
        known, rest = 0, []
        for word in self._own.words(chunk):
            have = self._common.get(word)
            if have is None:
                rest.append(word)
            else:
                known += have
        return known, rest

    def of(self, text: str) -> tuple[int, Counter[str]]:
        firsts, spaced, total = self._own.cut(text)
        more: list[str] = []
        for chunk in firsts:
            known, rest = self._look(chunk)
            total += known
            more += rest
        unseen = set(spaced).difference(self._known)
        if len(self._known) + len(unseen) > _REMEMBERED or self._chars > _REMEMBERED_CHARS:
            self._known, self._rest, self._chars = {}, {}, 0
            unseen = set(spaced)
        for chunk in unseen:
            self._known[chunk], rest = self._look(" " + chunk)
            self._chars += len(chunk)
            if rest:
                self._rest[chunk] = rest
        total += sum(map(self._known.__getitem__, spaced))
        of_rest = self._rest
        more += [word for chunk in spaced if chunk in of_rest for word in of_rest[chunk]]
        return total, Counter(more)


def _strings(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows of bounded size; the last of a row says how many bytes it may have."""
    made, size = [], 0
    for *row, weight in rows:
        made.append(row)
        size += weight
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)
            made, size = [], 0
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)


_WORDS = pa.schema([("word", pa.string()), ("times", pa.int64())])


def pretokens(docs: DataFrame, definition: str, text_col: str = "text", most: int = 300_000) -> DataFrame:
    """(word, times): each distinct pre-token of all texts, and how often they hold it.

    A task counts chunks of text, up to ``most`` different ones before it takes them apart and passes their
    pre-tokens on, so a common one is shuffled a few times for each task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(definition)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(told.value)

        def apart(firsts: Counter[str], spaced: Counter[str]) -> Iterator[tuple]:
            total: Counter[str] = Counter()
            for chunks, before in ((firsts, ""), (spaced, " ")):
                for chunk, n in chunks.items():
                    for word in own.words(before + chunk):
                        total[word] += n
            for word, n in total.items():
                yield word, n, len(word) + 8

        def rows() -> Iterator[tuple]:
            firsts: Counter[str] = Counter()
            spaced: Counter[str] = Counter()
            for batch in batches:
                for text in _strings(batch.column(0)):
                    first, more, _ = own.cut(text)
                    firsts.update(first)
                    spaced.update(more)
                    if len(firsts) + len(spaced) >= most:
                        yield from apart(firsts, spaced)
                        firsts.clear()
                        spaced.clear()
            yield from apart(firsts, spaced)

        yield from _batches(rows(), _WORDS)

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, times long")
    return parts.groupBy("word").agg(F.sum("times").alias("times"))


def pieces(words: DataFrame, definition: str) -> DataFrame:
    """(word, times, pieces): how many tokens each of the distinct pre-tokens has."""
    told = words.sparkSession.sparkContext.broadcast(definition)
    schema = pa.schema([*_WORDS, ("pieces", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(told.value)
        for batch in batches:
            found = pa.array(own.pieces(batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=schema)

    return words.select("word", "times").mapInArrow(count, "word string, times long, pieces long")


def _common(words: DataFrame) -> dict[str, int]:
    """The pieces of the most frequent pre-tokens, bounded in number and bytes."""
    bytes_ = F.sum(F.octet_length("word")).over(Window.orderBy(F.desc("times"), "word").rowsBetween(Window.unboundedPreceding, 0))
    most = words.where(F.octet_length("word") <= COMMON_BYTES // 1024).orderBy(F.desc("times"), "word").limit(COMMON)
    return {r["word"]: r["pieces"] for r in most.withColumn("size", bytes_).where(F.col("size") <= COMMON_BYTES).select("word", "pieces").collect()}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: the tokens that the file's library gives for the whole text.

    Begin and end tokens are not added, special strings inside a text are one token each, and nothing
    is cut or padded. Ids of tokens are never made: texts are scanned for their distinct pre-tokens,
    each of which is tokenized once; then for the frequencies in each text, of which the most frequent pre-tokens,
    at most 65536 and 16 MB, are summed where they are found. The others are joined with their pieces; each
    of them makes less than a 65536th of all occurrences, unless long ones fill the 16 MB or it is itself longer than 16 KB, so no key is
    hot. ``over_limit`` says whether there are more than ``limit`` tokens.

    Null texts count as empty and have no tokens. Very long texts are counted whole, in one task each. Rows
    that repeat an id or a text are counted each; an id may be null. An empty table stays empty. Only
    ``id_col`` and ``text_col`` are read, whatever other columns are called.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    PreTokenizer(definition)  # refuses other kinds before any work
    words = written(pieces(pretokens(docs, definition, text_col), definition), "pieces")
    told = spark.sparkContext.broadcast((definition, _common(words)))
    id_type = docs.schema[id_col].dataType.simpleString()
    rest_type = "array<struct<word:string,n:bigint>>"
    fields = [("row", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rest", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, common = told.value
        own = _Sums(_loaded(text_of), common)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, at = batch.column(0), 0
            schema = pa.schema([("id", ids.type), *fields])

            def rows() -> Iterator[tuple]:
                nonlocal row
                for text, size in zip(_strings(batch.column(1)), batch.column(2).to_pylist()):
                    known, more = own.of(text)
                    rest = [{"word": word, "n": n} for word, n in more.items()]
                    yield row, size, known, rest, 64 + sum(len(word) + 16 for word in more)
                    row += 1

            for part in _batches(rows(), pa.schema(fields)):
                yield pa.RecordBatch.from_arrays([ids.slice(at, part.num_rows), *part.columns], schema=schema)
                at += part.num_rows

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))
    found = written(found.mapInArrow(sums, f"id {id_type}, row long, n_bytes long, known long, rest {rest_type}"), "sums")
    rest = found.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("n"))
    more = rest.join(words.select("word", "pieces"), "word").select("row", (F.col("n") * F.col("pieces")).alias("n_tokens"))
    every = found.select("row", F.col("known").alias("n_tokens")).union(more).groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"))
    counted: Column = F.col("n_tokens")
    return found.select("id", "row", "n_bytes").join(every, "row").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (counted > limit).alias("over_limit"))
