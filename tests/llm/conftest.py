"""Small documents with every awkward case."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, keys string, s0 string, p string, low string, _part int"
SYLLABLES = {"en": ["the", "ing", "wh", "tion", "ou", "er"], "de": ["sch", "ung", "ein", "ver", "keit", "zu"], "fr": ["eau", "que", "ai", "eux", "lle", "oi"]}
TOXIC = ["idiot", "scum", "moron", "trash"]


def sentence(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def doc(i, text, lang="en"):
    return (i, text, lang, f"src{i % 3}", None if text is None else len(text), "k", "x", "p", "l", 1)


@pytest.fixture(scope="session")
def corpus():
    """(rows, labels): copies, near copies, junk, toxic words, nulls, blanks, repeats, a long text."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(160):
        lang = ("en", "de", "fr")[i % 3]
        words = sentence(rng, lang, rng.randint(30, 120)).split()
        toxic, bad = i % 5 == 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(TOXIC)
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append(doc(i, " ".join(words), lang))
        labels.append((i, 0 if bad else 1, int(toxic)))
    base = rows[2][1].split()
    rows += [doc(200 + k, " ".join(base)) for k in range(4)]
    for k in range(12):
        near = list(base)
        near[(7 * k) % len(near)] = f"edit{k}"
        rows.append(doc(300 + k, " ".join(near)))
    rows += [doc(400, None), doc(401, ""), doc(402, " \t\n"), doc(403, "one"), doc(404, "one two"), doc(405, "ONE  Two"), doc(406, "12 34 !!")]
    rows += [rows[3], rows[3], doc(500, sentence(rng, "en", 6000)), (None, "no key at all", None, None, None, "k", "x", "p", "l", 1)]
    labels += [(0, 1, 1), (9999, 1, 0)]
    return rows, labels


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], DOC)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
