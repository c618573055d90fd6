import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate double"


def passages(seed=7):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)] + ["é", "Größe", "naïve", "日本語"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    return rng, say


def messy_rows():
    """Nulls, empty and blank texts, copies, near copies, shared passages, odd white space, one long text, extra columns."""
    rng, say = passages()
    shared = say(60)
    base = say(120)
    texts = [None, None, "", " \t\n", "one", "two words", say(34), say(35), say(36), base, base, base, base + " tail", "Head " + base]
    for _ in range(12):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "EDIT"
        texts.append(" ".join(w))
    for i in range(6):
        texts.append(say(rng.randrange(5, 60)) + "\n" + shared + "\r\n" + say(rng.randrange(5, 60)))
    texts += [shared[: len(shared) // 2], shared.replace(" ", "  "), "ab " * 90, "x" * 250, "x" * 99, "日本" * 60, say(40) + "\x00" + say(3), say(3000) + " " + shared]
    texts += [say(rng.randrange(1, 80)) for _ in range(25)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or ""), 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def messy_docs(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
