"""Small tables and plain versions that the operators are compared with."""

import random
import re
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = {
    "documents": DOCS,
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def docs(spark, texts, first=0, langs=None):
    rows = [(first + i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def write(root, **frames):
    """A folder with the tables given, others empty."""
    spark = next(iter(frames.values())).sparkSession
    for name, schema in TABLES.items():
        (frames.get(name) if name in frames else spark.createDataFrame([], schema)).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return str(root)


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=80):
    """{doc_id: least doc_id reachable} of (doc_id, text) rows, over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}
