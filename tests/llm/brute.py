"""Plain versions of the operators, one text at a time."""

import re
import zlib

import numpy as np


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, words=3):
    import xxhash

    own = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not own:
        return 0
    shingles = [" ".join(own[i: i + words]) for i in range(max(1, len(own) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def least_reached(ids, linked):
    """Least id that links reach from each; linked(i, j) on positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def gone_lines(docs, least):
    """Numbers of the lines to delete by id, of (id, text) pairs with distinct ids."""
    docs = sorted(docs)
    lines = [t.split("\n") if t is not None else [] for _, t in docs]
    places = {}
    for d, own in enumerate(lines):
        for i, line in enumerate(own):
            places.setdefault(line, []).append((d, i))
    out = {}
    for d, own in enumerate(lines):
        gone = set()
        for i in range(len(own)):
            best = 0
            for e, j in places[own[i]]:
                if (e, j) >= (d, i):
                    break
                k = 0
                while i + k < len(own) and j + k < len(lines[e]) and own[i + k] == lines[e][j + k]:
                    k += 1
                best = max(best, k)
            if best and sum(len([w for w in x.split(" ") if w]) for x in own[i: i + best]) >= least:
                gone.update(range(i, i + best))
        out[docs[d][0]] = gone
    return out


def crc_of(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
