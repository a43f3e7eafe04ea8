"""Small documents that every operator of the subpackage has to stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple nutmeg oak pine quince rowan spruce tupelo".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) + str(r.randrange(50)) * (r.random() < 0.2) for _ in range(n))


def odd_texts() -> list:
    """Null, empty, white space, one word, one very long word, very long text, ties and copies."""
    a, b = prose(1, 120), prose(2, 150)
    return [None, "", "", " \t\n ", "word", "one two three", a, a, a, a + " changed", a.replace("oak", "ash"), b, b + "\n", b.upper(), "x" * 30_000, prose(3, 6000), "naïve Ünïcode 漢字 😀 text " * 20, "\x00nul\x00bytes here and there", a]


def frame(spark, texts, ids=None, **extra):
    rows = [(i if ids is None else ids[i], t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
