"""Plain, slow versions of what the operators compute."""

import re
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_classes(rows, percent=75):
    """Per row (id, text): (set size, least id that links reach)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return [(len(sets[i]), (min(least[find(i)], default=None) if sets[i] else rows[i][0])) for i in range(len(rows))]


def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items, window=13):
    """(n_words, n_hit, ids of the items found) of a text against (id, text) items."""
    w, hit, found = words13(text), set(), set()
    for k, item in items:
        v = words13(item)
        width = min(window, len(v))
        for s in range(len(v) - width + 1) if v else ():
            for p in range(len(w) - width + 1):
                if w[p:p + width] == v[s:s + width]:
                    hit.update(range(p, p + width))
                    found.add(k)
    return len(w), len(hit), found


def base_spans(text):
    out = []
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 12, 2),
             ("access", "AKIA[A-Z0-9]+", 0, 18, 0), ("hex", "[0-9a-f]+", 0, 16, 0))
    for n, (kind, pattern, flags, least, group) in enumerate(kinds):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]
