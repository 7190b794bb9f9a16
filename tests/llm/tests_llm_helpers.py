"""Brute-force versions that several tests use."""

import re


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_groups(texts, k, percent):
    """A group number for each text; texts without words are alone."""
    own, group = [shingles(t, k) for t in texts], [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if own[i] and own[j] and group[i] != group[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def brute_windows(text, items, window):
    """Whether the text holds a window of an item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = split(text)
    for x in map(split, items):
        n = min(window, len(x))
        held = {tuple(own[p : p + n]) for p in range(len(own) - n + 1)}
        if n and any(tuple(x[j : j + n]) in held for j in range(len(x) - n + 1)):
            return True
    return False
