"""Plain versions of the operators and awkward rows for their tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (6, "two words"), (7, "a\x85b c \x1c d"),
    (8, "Ünï cödé 日本語 \U0001f600 text"), (None, "no id at all"), (None, None), (9, "x" * 30000), (10, "word " * 4000),
]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copy_rows(seed=5, groups=12):
    """Ids and texts with exact copies, near copies around the limit, and a passage many share."""
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    rows = []
    for g in range(groups):
        base = sentence(rng, rng.choice([3, 5, 8, 20, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            text = base.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
            rows.append(" ".join(text))
        rows.append(sentence(rng, 50) + " " + shared + " " + sentence(rng, 20))
    rng.shuffle(rows)
    return [(100 + 3 * i, t) for i, t in enumerate(rows)]


def shingles(text, k, fold=True):
    w = words(lower(text) if fold else text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def classes(rows, k=4, num=85, den=100):
    """(sets' sizes, smallest reachable id) by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), None if i is None else find(i)) for i, s in sets}


def without_repeats(rows, n=13):
    """(id, words, removed, kept text) by looking up every window."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[j : j + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - n + 1):
            if i is not None and first[tuple(w[j : j + n])] < i:
                gone.update(range(j, j + n))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out
