"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key string, root string,"
    " size string, taken string, range string, shard string, _id string, _doc string, signature string, anchor string"
)
VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi") for c in ("", "n", "r", "st")]


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", "."]) + ("\n" if i % 17 == 16 else ""))
    return " ".join(out)


def documents(n=160, seed=3):
    """Rows (doc_id, text, lang, source, n_chars): originals, copies, near copies, shared passages, edge cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([5, 30, 60, 120, 400])) for _ in range(n)]
    for i in range(10, n, 7):
        texts[i] = texts[i - 5]  # exact copies
    for i in range(12, n, 5):
        w = texts[i - 4].split(" ")
        for _ in range(rng.choice([1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts[i] = " ".join(w)  # near copies, some of them too far
    passage = prose(rng, 60)
    for i in range(3, n, 9):
        texts[i] += " " + passage
    base = prose(rng, 100).split(" ")
    for i in range(n - 40, n - 5):  # one group of copies that differ in a word or two each
        w = list(base)
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts[i] = " ".join(w)
    texts[0], texts[1], texts[2] = None, "", " \t\n "
    texts[4], texts[5] = "one two three", "ONE  two\tthree"
    texts[6], texts[7] = "éé ßß " * 4000, "word " * 6
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s0"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, texts[20], "en", "s1", 1))
    rows += [rows[30], rows[30]]
    return rows


def frame(spark, rows):
    """Rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, *["x"] * 11) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=85):
    """doc_id-list index -> (set size, component's least doc_id) by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def substring_distance(pattern, text):
    """Least edit distance of pattern to any substring of text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def jump(key, n):
    """The published loop with wrapping 64-bit arithmetic."""
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b
