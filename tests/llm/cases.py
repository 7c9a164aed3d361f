"""Small tables that hold the awkward rows: nulls, blanks, ties, repeated rows, long texts, clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def passage(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    long = passage(1, 6000)
    near = passage(2, 300).split()
    texts = [
        (0, passage(3)), (1, passage(3)), (2, f"{passage(4)} {passage(5)}"), (3, f"{passage(6)} {passage(5)} tail"), (4, long), (5, f"{long[:9000]} x {long[9000:]}"),
        (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "One"), (11, "one"), (11, "one"), (12, "é" * 60), (13, "é" * 60 + "!"),
        (14, " ".join(near)), (15, " ".join([*near[:150], "changed", *near[151:]])), (None, passage(3)), (None, "no id"), (16, "it " * 300), (17, "it " * 200), (18, passage(5) + "\x00\x00" + passage(4)),
        (19, passage(3).upper()), (20, f"a{passage(3)}"), (20, f"b{passage(3)}"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, str(x)) for x in row)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def want(data):
    return sorted(data, key=key)
