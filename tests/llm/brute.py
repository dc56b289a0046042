"""Plain versions that the operators are compared with."""

import hashlib
import re
from itertools import combinations

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def md5_int(word):
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, words):
    found = WORD.findall(lower(text))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def join_components(rows, words=4, similarity=85):
    """doc_id to component by all pairs; ids must differ."""
    sets = {i: shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations([i for i in sets if sets[i]], 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            one, other = sorted((find(a), find(b)))
            root[other] = one
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)
