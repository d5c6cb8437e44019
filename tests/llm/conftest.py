"""A small table of documents with every awkward case, and plain-Python helpers."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def _documents():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(150).split()
    rows = [(0, say(80)), (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one two"), (6, "ONE  two\nthree é́ ß x \x1cq")]
    rows += [(10 + i, say(40) + "\n" + passage + "\n" + say(30 + i)) for i in range(4)]
    rows += [(20, " ".join(base)), (21, " ".join(base)), (22, " ".join(base)), (22, " ".join(base))]
    for i in range(6):  # near copies
        own = list(base)
        for _ in range(i + 1):
            own[r.randrange(150)] = r.choice(vocabulary)
        rows.append((30 + i, " ".join(own)))
    rows += [(40, "\n".join(["again and again the same line of words here"] * 9)), (41, "a### b%%% " * 40), (42, say(12000)), (43, say(2300)), (None, say(50))]
    sources = ["b", "a", None, "é", "b", "b", "z"]
    return [(k, t, "en", sources[i % 7], len(t or ""), "x", 1, "y", 2.0) for i, (k, t) in enumerate(rows)]


DOCUMENTS = _documents()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, ledger string, cover int, taken string, size double"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(DOCUMENTS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain():
    return [(r[0], r[1], r[3]) for r in DOCUMENTS]
