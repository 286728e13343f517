"""Small documents with every awkward case: nulls, empty and long texts, repeats, ties, clashing columns."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, keep string, digest string, shard string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(seed=0, n=60):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gämma", "DELTA", "É", "é", "x", "ça", "\x0bv", " "]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))) for _ in range(n)]
    texts += ["", None, " \t\n", "É", "é", "A\nB", "a\nb", "line " * 12 + "\n" + "x", "long word " * 30_000]
    texts += [t and t.upper() for t in texts[:8]] + texts[:6]
    ids = list(range(100, 100 + len(texts)))
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s1", "s2", "", None]), 0, "i", "z", "k", "d", "h") for i, t in zip(ids, texts)]
    rows += [(None, "no id", "en", None, None, *"izkdh"), (None, None, None, "s2", None, *"izkdh")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
