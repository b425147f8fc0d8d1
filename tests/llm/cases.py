"""Small tables with nulls, empties, long texts, ties, repeats and clashing names, and brute-force forms."""

import random
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may have them as columns of their own.
CLASH = ["size", "key", "bucket", "h", "th", "fp", "row", "rank", "n", "_id", "body", "level", "share", "copies", "place", "uid", "shard", "runs", "raw"]


def prose(seed: int, words: int, line: int = 12) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice(["an", "el", "or", "ti", "ben", "sha", "ru", "mo", "qui"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(out[k : k + line]) for k in range(0, words, line))


def odd_documents():
    """Rows for DOCS: every case that the operators name in their docstrings."""
    long = prose(1, 30_000)
    rows = [(k, prose(k + 10, 40 + 13 * k), "en" if k % 2 else "fr", f"s{k % 5}", 1) for k in range(40)]
    rows += [(100 + k, rows[3][1], "en", "s0", 1) for k in range(12)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n\x0b\x0c\r ", "en", "s1", 0), (203, "a", "en", "ä", 1), (204, "a a", "fr", "z", 1)]
    rows += [(205, long, "en", "s2", 1), (206, "x" * 50_000, "fr", "s2", 1), (207, "123 456    ", None, "", 1), (208, "naïve Ünïcode \U0001f600 ẞtraße", "fr", None, 1)]
    rows += [(None, "no id here but words", "en", "s0", 1), (None, None, None, None, None), (5, rows[5][1], "en", "s0", 1), (5, "another text under a used id", "en", "s0", 1)]
    return rows


def odd_frame(spark, rows=None, clash=True):
    df = spark.createDataFrame(odd_documents() if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    return df


def smallest_reachable(ids, linked):
    """Brute-force components: ``linked(i, j)`` over all pairs."""
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)].append(d)
    return [min(low[find(i)], default=None) for i in range(len(ids))]


def runs_removed(texts: dict, min_words: int) -> dict:
    """Texts less every run of lines of ``min_words`` words that an earlier text has, pair by pair."""
    lines = {i: t.split("\n") for i, t in texts.items()}
    out = {}
    for b in sorted(lines):
        dead = [False] * len(lines[b])
        for a in (x for x in lines if x < b):
            for i in range(len(lines[a])):
                for j in range(len(lines[b])):
                    n = 0
                    while i + n < len(lines[a]) and j + n < len(lines[b]) and lines[a][i + n] == lines[b][j + n]:
                        n += 1
                    if sum(len(x.encode().split()) for x in lines[b][j : j + n]) >= min_words:
                        dead[j : j + n] = [True] * n
        out[b] = "\n".join(x for x, d in zip(lines[b], dead, strict=True) if not d)
    return out
