"""Token counts against the library, over awkward texts and over the registered query."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loam.llm import tokens
from loam.llm.queries import QUERIES, table as load
from tests.llm.common import SCHEMA, docs, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    n = len(LIBRARY.encode(text or "", add_special_tokens=False))
    return len((text or "").encode()), n


def test_registered_query(spark, sf):
    found = {r["doc_id"]: r for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    rows = load(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        size, n = expected(r["text"])
        assert (found[r["doc_id"]]["n_bytes"], found[r["doc_id"]]["n_tokens"], found[r["doc_id"]]["over_limit"]) == (size, n, n > 512)


def test_awkward_rows(spark, monkeypatch):
    """Nulls, repeats, special strings, odd white space and scripts; few pre-tokens are common, so that most are joined."""
    monkeypatch.setattr(tokens, "COMMON", 3)
    texts = ["<|endoftext|>a<|endoftext|><|endoftext|>", "  two  spaces\n\n x", "I'll we're 'S o'clock", " nb　wide\x85x", "12a٣字字😀", "x" * 50_000, "\x1c \x1f", " "]
    rows = docs() + [(900 + i, t, *[None] * 8) for i, t in enumerate(texts)] + [(900, "again", *[None] * 8)]
    found = tokens.count_tokens(table(spark, rows), PATH).collect()
    want = sorted((repr(r[0]), *expected(r[1])) for r in rows)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == want
    assert tokens.count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_pretokens_of_random_texts():
    own = tokens.PreTokenizer(open(PATH, encoding="utf-8").read())
    rnd = random.Random(3)
    alphabet = [chr(c) for c in range(128)] + ["'s", "'ll", "  ", "\r\n", "é", " ", "　", "᠎", "\x85", "​", "字", "😀", "<|endoftext|>"] * 6
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))
        found, specials = own.count(text)
        assert sum(n * found[w] for w, n in zip(found, own.pieces(list(found)))) + specials == expected(text)[1], repr(text)


def test_other_kinds_are_refused():
    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            tokens.PreTokenizer(open(public_tokenizers.path(name), encoding="utf-8").read())
