from __future__ import annotations

import random
import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, fold=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD) if fold else text)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def corpus(n=60, seed=3):
    """Texts with copies, near copies, shared passages, nulls, empty and odd ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(45)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(texts) < 4:
            w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        elif kind == 1:
            w = words(r.choice(texts))
        elif kind in (2, 3):
            w = words(r.choice(texts))
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind == 4:
            w = [r.choice(vocabulary) for _ in range(r.randint(0, 30))] + passage + [r.choice(vocabulary) for _ in range(9)]
        else:
            w = [r.choice(vocabulary) for _ in range(r.randint(0, 5))]
        texts.append("".join(x + r.choice([" ", "\n", "\t ", " "]) for x in w))
    texts += [None, "", " \n ", "one", "Two wOrds", "two words", "x" * 5000, " ".join(["same"] * 200), " ".join(vocabulary * 30)]
    return [(i, t, ["en", "de", None][i % 3], [None, "src0", "src1", "src2"][min(3, i % 5)], len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows=None, partitions=3):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def components(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
