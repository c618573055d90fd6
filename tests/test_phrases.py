"""The phrase index against a plain search of every value in every text."""

import random

from folioframe.operators import evaluate


def test_all_values_in_all_texts(spark):
    rng = random.Random(4)
    words = ["an", "ann", "anna", "na", "b", "bo", "bob", "x/y", "12"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(i, say(rng.randrange(0, 40)), "p") for i in range(60)] + [(3, say(20), "p"), (60, None, "q"), (61, "", "q"), (62, "anna", "q"), (62, "anna", "q"), (63, "b" * 5000 + " bob", "q")]
    values = [(i, say(n), i) for i, n in enumerate([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 5, 5, 7])] + [(50, None, 0), (51, "", 0), (52, "n", 0), (53, "a b", 0), (54, "nn an", 0), (55, "Anna, BOB", 0), (56, "zz", 0), (57, "bbb bo", 0), (58, "n bob a", 0), (0, "an", 9)]
    v = spark.createDataFrame(values, "item int, value string, q int")
    t = spark.createDataFrame(texts, "at int, text string, word string").repartition(3)
    norm = lambda x: " ".join((x or "").lower().replace(",", " ").split())
    want = sorted((i, x, q, a, w) for i, x, q in values for a, d, w in texts if norm(x) and norm(x) in norm(d))
    assert sorted(map(tuple, evaluate.values_in_texts(v, t).collect())) == want
    assert evaluate.values_in_texts(v, t.limit(0)).count() == 0 and evaluate.values_in_texts(v.limit(0), t).count() == 0


def test_a_text_is_hashed_before_it_becomes_words(spark):
    texts = spark.createDataFrame([(1, "a b a")], "doc_id int, text string")
    plan = evaluate.word_positions(texts)._jdf.queryExecution().optimizedPlan().toString()  # from the last step down
    assert plan.index("posexplode") < plan.index("xxhash64")
