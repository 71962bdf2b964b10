"""Plain Python versions of the operators' rules, and awkward rows, for the tests."""

import re
import string
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

#: doc_id, text, lang, source, n_chars and columns whose names the operators use inside
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, node string, root string, "
              "kept string, n string, pos string, line string, ids string, hits string, name string")


def docs_frame(spark, rows):
    """(doc_id, text[, lang]) rows with every further column filled."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", None if r[1] is None else len(r[1]), *["x"] * 10) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def lower(text):
    return text.translate(_LOWER)


def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def groups(sets, percent):
    """Index of the smallest member reachable by links, per set."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


def line_key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def common_lines(texts, min_docs):
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            held[line_key(line)].add(i)
    return {k for k, v in held.items() if len(v) >= min_docs and k}


def quality(text, windows, line_share, min_words=50, pct=50, copies=(), copy_words=1 << 60):
    """(base counts, kept) of the quality rules."""
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    lines, seen, dup_lines, dup_chars = text.split("\n"), set(), 0, 0
    for line in lines:
        if WORD.search(line):
            if line in seen:
                dup_lines += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)

    def covered(n, first):
        count, inside, met = defaultdict(int), set(), set()
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        for g in grams:
            count[g] += 1
        for i, g in enumerate(grams):
            if count[g] > 1 and (first or g in met):
                inside |= set(range(i, i + n))
            met.add(g)
        return inside

    repeat = len(covered(3, True))
    base = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup_lines, "n_repeat_words": repeat,
            "base_failed": len(words) < min_words or 100 * repeat > pct * len(words)}
    bad = dup_chars > line_share * chars
    for n, share in windows:
        later = covered(n, False)
        places = sum(i - 1 not in later for i in later)
        if len(later) > copy_words or places > 1:
            share = min(share, dict(copies).get(n, share))
        bad |= sum(len(words[i]) for i in later) > share * chars
    return base, not base["base_failed"] and not bad
