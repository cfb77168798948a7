"""Small tables with the awkward rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int"


def awkward(spark, n=120, seed=1, vocab=40):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(vocab)] + ["É", "foo-bar", "A#", "12", "Ω"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t", ", "]) for _ in range(rng.randrange(0, 90)))
        rows.append([i, text])
    for i in range(n, n + 40):  # exact and near copies
        text = rows[rng.randrange(n)][1]
        if i % 2:
            cut = text.split(" ")
            cut[rng.randrange(len(cut))] = "edited"
            text = " ".join(cut)
        rows.append([i, text])
    passage = " ".join(rng.choice(words) for _ in range(60))
    for i in range(n + 40, n + 60):
        rows.append([i, f"start{i} w1 {passage} end{i}\nw2 w3"])
    rows += [[None, "w1 w2 w3"], [9001, None], [9002, ""], [9003, " \n\t "], [9004, "w1 " * 3000], [9005, "x" * 20000], [9006, rows[3][1]], [9006, rows[3][1]]]
    return spark.createDataFrame([(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), None if t is None else len(t), "k", 7) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
