"""Small corpora with every odd case, and plain versions of the operators."""

from __future__ import annotations

import random
import re

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: names that operators use inside, as further columns of a table
CLASHES = ("id", "hash", "key", "node", "rank", "n", "size", "copies", "target", "score", "kept", "start", "text2", "bucket", "_source", "_before", "component", "start")


def frame(spark, docs, partitions=3):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""
    rows = [(d[0], d[1], *(d[2:] or ("en", "s")), len(d[1] or "")) for d in docs]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    for name in dict.fromkeys(CLASHES):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéfgß", k=rng.randint(1, 7))) for _ in range(300)]

    def para(k):
        return " ".join(rng.choices(words, k=k))

    shared = [para(40) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [para(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(shared)
            if rng.random() < 0.5:
                q = q[rng.randint(0, len(q) // 2):]
            if rng.random() < 0.3:
                w = q.split()
                w[len(w) // 2] = "XX"
                q = " ".join(w)
            parts += [q, para(rng.randint(0, 30))]
        docs.append((i, " ".join(parts)))
    docs += [
        (200, "a" * 1500), (201, "ab" * 400), (202, None), (203, ""), (None, shared[0]), (204, shared[1][:100]), (205, shared[1][:99]), (206, "a" * 100),
        (150, docs[10][1]), (151, docs[10][1]), (151, docs[10][1]), (152, "  \n\t "), (153, para(9000)), (154, "### *** |"), (None, None)]
    return docs


def family(seed=5):
    """Near copies in groups of one to thirty."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(3000)]
    docs, i = [], 0
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(6, 150))
        for _ in range(rng.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
            docs.append((i, t.upper() if rng.random() < 0.2 else t))
            i += 1
    return docs + [
        (i, None), (i + 1, ""), (i + 2, "  \n"), (i + 3, "a b"), (i + 4, "A  b\n"), (None, docs[3][1]), (4, docs[4][1]), (4, docs[4][1]), (5, "zz yy xx")]


def plain_components(docs, percent=85, by_group=False):
    """Rows of the contract; with ``by_group``, the smallest id of each group of documents with words, once for each group."""
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    order = [-1 if d is None else d for d, _ in docs]
    least = {}
    for i, d in enumerate(order):
        least[root(i)] = min(least.get(root(i), d), d)
    if by_group:
        return [None if least[g] == -1 else least[g] for g in {root(i) for i in range(len(docs)) if sets[i]}]
    return [(docs[i][0], len(sets[i]), None if least[root(i)] == -1 else least[root(i)], order[i] == least[root(i)]) for i in range(len(docs))]


def plain_repeats(docs, length=100):
    """Per row: the text's bytes and a mask of those removed."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        raw = (docs[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                gone[p:p + length] = True
            else:
                seen.add(raw[p:p + length])
        out[i] = raw, gone
    return [out[i] for i in range(len(docs))]
