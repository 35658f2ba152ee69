"""Plain answers to what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter

NO_ID = 2**63 - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rank(doc_id):
    return NO_ID if doc_id is None else doc_id


def suffix_rows(docs, length=100):
    """(doc_id, bytes, removed, spans, hash) with strings that start earlier removed."""
    first = {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            key, place = raw[i : i + length], (rank(doc_id), i)
            first[key] = min(first.get(key, place), place)
    rows = []
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (rank(doc_id), i):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        rows.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def window_rows(docs, window=13):
    """(doc_id, words, removed, hash) with windows of smaller documents removed."""
    first = {}
    for doc_id, text in docs:
        own = words(text)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, NO_ID), rank(doc_id))
    rows = []
    for doc_id, text in docs:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < rank(doc_id):
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        rows.append((doc_id, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def shingles(text, size=5):
    own = words(lowered(text))
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def near_rows(docs, percent=75):
    """(doc_id, shingles, component, kept) with all pairs compared; ids are distinct."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(d, len(s), root(d), root(d) == d) for d, s in sets.items()]


def unigram_rows(docs, held_out):
    """Word counts of training documents, with one end each."""
    counts = Counter()
    for doc_id, text in docs:
        if not held_out(doc_id):
            counts.update([*words(lowered(text)), "\n"])
    return counts
