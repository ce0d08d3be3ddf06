"""Small documents with copies, near copies, repeats, and awkward rows."""

import random

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value string, h1 string, spans string, Score string"


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    passage, texts = sentence(45), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(texts[r.randrange(len(texts))])
        elif kind == 2 and texts:
            words = (texts[r.randrange(len(texts))] or "").split()
            if words:
                words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append(f"{sentence(30)}\n{passage}  {sentence(10)}")
        elif kind == 4:
            texts.append("again and " * 40 + sentence(5))
        else:
            texts.append(sentence(r.randrange(1, 120)))
    texts += [None, "", " \t\n ", "one", "one", "One", "é" * 150, "é" * 150, "x" * 101, sentence(5000), "\u00a0a b\u3000c", passage]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(d, texts[d], "en", f"s{d % 4}" if d % 9 else None, None, "v", "h", "s", "k") for d in order]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
