"""Plain versions of the corpus operators, by their definitions, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())

LONG = " ".join(f"w{i}" for i in range(40_000))

#: Null and empty texts, white space, one word, a very long text, a word without end, ties and repeated rows.
TEXTS = [
    (0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, LONG), (6, LONG + " end"), (7, "x" * 100_000), (8, "é ß 日本語 ▁ K"),
    (9, "The quick brown fox jumps over the lazy dog and runs away from the old barn tonight"), (9, "The quick brown fox jumps over the lazy dog and runs away from the old barn tonight"),
    (9, "Another text with the same id"), (None, "The quick brown fox jumps over the lazy dog and runs away from the old barn tonight"), (None, None), (10, "12345 67890 !!! ..."),
]


def words(text):
    return WORD.findall(text or "")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, k, percent):
    """Smallest id that each row reaches, for rows (id, text)."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) if sets[i] else docs[i][0] for i in range(len(docs))]


def kept_words(docs, width):
    """Words that each row (id, text) keeps."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            if d is not None:
                g = tuple(w[i : i + width])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = {i + j for i in range(len(w) - width + 1) if d is not None and first[tuple(w[i : i + width])] < d for j in range(width)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def overlaps(docs, items, window, substitutions):
    """(id, item) pairs with a window of so many words alike but for the substitutions; short items count whole."""
    out = set()
    for d, t in docs:
        w = alnum_words(t)
        for item, u in items:
            v = alnum_words(u)
            n = min(window, len(v))
            if len(v) < 8:
                continue
            for i in range(len(w) - n + 1):
                for j in range(len(v) - n + 1):
                    if sum(a != b for a, b in zip(w[i : i + n], v[j : j + n])) <= substitutions * n // window:
                        out.add((d, item))
    return out
