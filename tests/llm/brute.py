"""Plain versions that the tests compare with."""

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
TABLE = f"{SF}/documents.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, *rows, **more):
    """(doc_id, text) rows in the table's columns, with columns whose names operators use inside."""
    data = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or ""), "x", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, hash string, size int")


def table(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(TABLE).select("doc_id", "text").collect()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_links(docs):
    """({doc_id: number of documents of similarity 0.8 or more}, {doc_id: smallest doc_id of its class}); texts without words are alike."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    root, links = {i: i for i in docs}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    empty = [i for i in docs if not sets[i]]
    for i in docs:
        shared = Counter(j for g in sets[i] for j in holders[g] if j != i)
        near = [j for j, n in shared.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)] if sets[i] else [j for j in empty if j != i]
        links[i] = len(near)
        for j in near:
            join(i, j)
    return {i: links[i] for i in docs}, {i: find(i) for i in docs}
