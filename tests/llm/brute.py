"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


def components(nodes, linked):
    """Smallest reachable node by node; `linked` says whether two are linked."""
    nodes, root = list(nodes), {}
    for n in nodes:
        root[n] = n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    """doc_id -> (fingerprint, component) for different doc_ids."""
    prints = {i: fingerprint(t) for i, t in docs}
    group = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    return {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def leaks(docs, benchmark):
    """One row per document: doc_id, n_words, n_hit, sorted item ids, and the longest match:
    words, item, position."""
    windows = defaultdict(set)
    for item, text in benchmark:
        own = words(text)
        size = min(10, len(own))
        for i in range(len(own) - size + 1 if own and item is not None else 0):
            windows[tuple(own[i : i + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                found = windows.get(tuple(own[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc, len(own), len(hit), sorted(items), *longest(own, benchmark)))
    return out


def longest(own, benchmark):
    """The longest run of words of any item that holds a whole window of it."""
    best = (0, None, None)
    for item, text in benchmark:
        test = words(text)
        size = min(10, len(test))
        for start in range(len(test) - size + 1 if test and item is not None else 0):
            for p in range(len(own) - size + 1):
                n = 0
                while p + n < len(own) and start + n < len(test) and own[p + n] == test[start + n]:
                    n += 1
                if n >= size and (best[1] is None or (-n, str(item), p) < (-best[0], best[1], best[2])):
                    best = (n, str(item), p)
    return best


def repeats(texts, length):
    """n_bytes, n_removed, n_spans, digest of the rest, of each text."""
    raw = [(t or "").encode() for t in texts]
    places = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if places[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(r, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def shingles(line, size=5):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def line_keepers(docs, similarity=0.8, min_chars=0, size=5):
    """(doc_id, line) -> place of the line of its group that stays; blank lines are alone."""
    places = defaultdict(list)
    for doc, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            own = lower(line.strip(" "))
            if len(own) >= min_chars:
                places[own].append((doc, n))
    blank = places.pop("", [])
    sets = {line: shingles(line, size) for line in places}

    def near(a, b):
        both = len(sets[a] & sets[b])
        return both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9

    group, first = components(sorted(places), near), {}
    for line, root in group.items():
        first[root] = min([first[root], *places[line]] if root in first else places[line])
    kept = {place: first[group[line]] for line, own in places.items() for place in own}
    return kept | {place: place for place in blank}


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    """Base findings: kind:start:end by start, then kind."""
    text, found = text or "", []
    for kind, rank, pattern, least in (("assign", 1, ASSIGN, 6), ("access", 2, r"AKIA[A-Z0-9]+", 20), ("hex", 3, r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]
