"""Documents with every odd thing that the operators must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60_000))
ROWS = [
    (1, "a b c d e f g h"),
    (2, None),
    (3, ""),
    (4, "a b c d e f g h"),
    (4, "a b c d e f g h"),
    (None, "x y"),
    (None, "x y"),
    (5, " \n\t"),
    (6, LONG),
    (7, "ünïcode Kelvin 🙂 日本 a\x00b \x1c x"),
    (8, "A B C D E F G H"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, DIGEST string, blob string, _id long, _c0 string, held boolean, w string, TEXT2 string, kept boolean, n long, label string, dim int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z", None, 9, "q", None, "w", None, True, 1, "l", 3) for i, t in rows], SCHEMA)


def words(rnd, n, kinds=2000):
    return [f"w{rnd.randrange(kinds)}" for _ in range(n)]
