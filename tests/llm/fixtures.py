"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("__b", T.StringType()), T.StructField("n_lines", T.StringType()), T.StructField("bands", T.StringType()),
])


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, passage, line = say(60), say(20), say(14)
    out: list[tuple[int | None, str | None]] = []
    for i in range(60):
        body = [say(r.randint(1, 40)) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            body.insert(r.randint(0, len(body)), passage)
        if i % 4 == 0:
            body.append(("  " if i % 8 else "\t") + (line if i % 12 else line.upper()))
        if i % 5 == 0:
            words = shared.split()
            for _ in range(i // 15):
                words[r.randrange(len(words))] = "Q%d" % i
            body = [" ".join(words)]
        out.append((i * 3, "\n".join(body)))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (None, passage), (1003, "one two"), (1004, "one two"), (1005, "12 34 !"), (1006, say(6000)), (1007, shared), (1008, shared), (1009, "a\r\nb \x0b c\n\n")]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ["en", "fr", None][k % 3], "s", len(t or ""), "x", "y", "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def got(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r))
