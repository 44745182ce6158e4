"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text, size):
    words = WORD.findall(ascii_lower(text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def linked_components(texts, size, num, den):
    """{id: smallest id reachable} for {id: text}; compares every pair."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def repeat_words(text):
    words = WORD.findall(text or "")
    runs = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def sha(text):
    return hashlib.sha256(ascii_lower(text).encode()).hexdigest()
