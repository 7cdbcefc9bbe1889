"""Small tables with every awkward case the operators must take."""

from __future__ import annotations

import random

DOC_KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row", "fp", "key", "th", "s", "l", "t", "n", "k", "h", "u", "v", "slice", "f", "w", "node", "root", "rep", "_n", "label_", "_th", "_gone", "gone_id", "id", "wide", "group", "x", "measure", "low", "high")


def prose(seed: int, n: int, words: str = "ab cd ef gh ij kl mn op qr st uv wx yz the of and to in") -> str:
    rng = random.Random(seed)
    pool = words.split()
    return " ".join(rng.choice(pool) + rng.choice(pool) for _ in range(n))


def awkward_docs() -> list[tuple]:
    base = prose(1, 60)
    rows = [
        (1, base, "en", "web", 10), (2, base, "en", "web", 10), (3, base + " tail word", "de", None, None),
        (4, None, "en", "web", None), (5, "", None, "book", 0), (6, " \t\n ", "en", "book", 4), (7, "one", "fr", "web", 3),
        (8, "Two WORDS", "fr", "web", 9), (9, "... !!! 123 |", "en", "web", 13), (10, "ÉÀ 日本語 🎉 x y\x1cz ퟿", "fr", "x", 5),
        (11, prose(2, 30000), "en", "web", 1), (12, prose(3, 40), None, None, None), (13, prose(3, 40) + " " + prose(4, 40), "de", "web", 1),
        (14, "same same " * 200, "de", "web", 1), (None, base, "en", "web", 1), (None, None, None, None, None),
        (15, prose(5, 50), "en", "web", 1), (15, prose(5, 50), "en", "web", 1),
    ]
    return rows


def with_clashes(df):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i).cast("string"))
    return df


def docs(spark, rows=None):
    return spark.createDataFrame(awkward_docs() if rows is None else rows, DOC_KIND)


def words(text):
    return (text or "").encode().split()


def classes(nodes, linked):
    """Smallest reachable node by brute force."""
    nodes = list(nodes)
    root = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if root[a] != root[b] and linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root
