"""Small tables with the awkward cases: nulls anywhere, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, length long, rank int, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(0, 120)) for _ in range(n)]
    shared = words(rng, 45)
    rows = []
    for i in range(n):
        t = base[i]
        if i % 7 == 0:
            t = t + " " + shared
        if i % 11 == 3:
            t = base[i - 1]
        if i % 13 == 5:
            t = shared + "\n" + t + "\t" + shared
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t ", "en", None, 4), (None, base[0], None, "s2", None), (None, words(rng, 30), "en", "s2", 1)]
    rows += [rows[3], rows[3], (n + 3, words(rng, 30_000, 50), "de", "s0", 0), (n + 4, "x" * 200_000, "fr", "s3", 0), (n + 5, "Ünïcödé 日本語 🙂 ß İ ſ \x1c \x00 end", "en", "s9", 0)]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "k") for r in rows], DOC_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


VEC_SCHEMA = "vec_id long, embedding array<float>, label int, score double, dim int, rkey long"


def vectors(spark, seed=2, n=400, dim=12):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dim)], i % 5, 0.0, 1, 2) for i in range(n)]
    same = [0.25] * dim
    rows += [(n + i, same, 1, 0.0, 1, 2) for i in range(60)]
    rows += [(1000, None, 1, 0.0, 1, 2), (1050, [0.1, None] + [0.0] * (dim - 2), 1, 0.0, 1, 2), (1100, [float("nan")] * dim, 1, 0.0, 1, 2), (1150, [float("inf")] * dim, None, 0.0, 1, 2)]
    rows += [(1200, [0.0] * dim, 1, 0.0, 1, 2), (1250, [0.5, 0.5], 1, 0.0, 1, 2), (1300, [0.5, 0.4], 1, 0.0, 1, 2), (None, same, 1, 0.0, 1, 2), rows[50], rows[50]]
    return spark.createDataFrame(rows, VEC_SCHEMA)


def vector_rows(df):
    """(vec_id, list of doubles) of the rows that may take part."""
    import math

    out = []
    for r in df.select("vec_id", "embedding").collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            out.append((r.vec_id, [float(x) for x in r.embedding]))
    return out
