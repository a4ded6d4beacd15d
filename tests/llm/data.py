"""Small tables with every edge: nulls, empty and very long texts, repeated rows, ties, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, windows string, doc string, rank int"


def words(rng, n, kinds=60):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def edge_texts():
    rng = random.Random(5)
    passage = words(rng, 60, 10_000)
    body = [words(rng, 120, 10_000) for _ in range(8)]
    near = body[0].split()
    near[100] = "changed"
    return [
        (0, body[0]), (1, body[0]), (2, " ".join(near)), (3, body[1] + "\n" + passage), (4, passage + "\t" + body[2]), (5, body[3]),
        (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "one two"), (11, "Über  naïve\x0bwörds — 日本語\xa0x"),
        (12, "the " * 4000), (13, "x" * 60_000), (14, words(rng, 9000, 10_000)), (5, body[3]), (None, body[4]), (None, None), (15, passage),
        (16, " ".join(body[5].split()[:40]) + " " + body[6]), (17, body[7] + " " + " ".join(body[5].split()[:40])),
    ]


def documents(spark, rows=None):
    rows = edge_texts() if rows is None else rows
    langs = [None, "en", "fr", "de"]
    full = [(i, t, langs[k % 4], f"src{k % 3}" if k % 5 else None, len(t) if t is not None else None, 0.5, "taken", "taken", 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return documents(spark, [])
