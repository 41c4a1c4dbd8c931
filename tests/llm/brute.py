"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    found = words((text or "").translate(LOWER))
    if not found:
        return set()
    width = min(size, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def near_components(docs, size, percent=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def base_statistics(text):
    text = text or ""
    found = words(text)
    windows = {}
    for i in range(len(found) - 2):
        windows.setdefault(tuple(found[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def packed(rows, capacity):
    """Best fit over all bins in turn; rows of (doc_id, length, source, cluster) in the order of placing."""
    bins, out = [], []
    for doc_id, length, source, cluster in rows:
        whole, last = divmod(length, capacity)
        if whole and not last:
            whole, last = whole - 1, capacity
        for piece in range(whole):
            bins.append([0, {None}, set()])
            out.append((doc_id, piece, piece * capacity, capacity, len(bins) - 1, 0))
            bins[-1][1].clear()
            bins[-1].append("closed")
        fits = [
            (b[0], k) for k, b in enumerate(bins) if len(b) == 3 and b[0] >= last and source not in b[1] and cluster not in b[2]
        ]
        if fits:
            k = min(fits)[1]
        else:
            bins.append([capacity, set(), set()])
            k = len(bins) - 1
        place = capacity - bins[k][0]
        bins[k][0] -= last
        bins[k][1].add(source)
        bins[k][2].add(cluster)
        out.append((doc_id, whole, whole * capacity, last, k, place))
    return out


def filled(budget, children):
    """Budget dealt to (weight, capacity) children step by step."""
    from fractions import Fraction

    given = [Fraction(0)] * len(children)
    left = Fraction(budget)
    open_ = set(range(len(children)))
    while open_ and left > 0:
        weight = sum(children[i][0] for i in open_)
        full = [i for i in open_ if given[i] + left * children[i][0] / weight >= children[i][1]]
        if not full:
            for i in open_:
                given[i] += left * children[i][0] / weight
            break
        for i in full:
            left -= children[i][1] - given[i]
            given[i] = Fraction(children[i][1])
            open_.discard(i)
        # What is left is dealt anew, from nothing, among those that are open.
    return given


def normal_line(line):
    return re.sub("[0-9]+", "0", " ".join(words(line.translate(LOWER))))


def judged(docs, limit, max_lost=75, family_lost=25):
    """(doc_id, removed lines, lost words, kept) of rows (doc_id, text, host), by the rule for lines of all lengths."""
    lines = [[normal_line(line) for line in (text or "").split("\n") if words(line)] for _, text, _ in docs]

    def lost(frequent):
        hit = [[line for line in own if (doc[2], line) in frequent] for doc, own in zip(docs, lines, strict=True)]
        return hit, [sum(len(words(line)) for line in own) for own in hit]

    def often(document):
        seen = {}
        for (_, text, host), own in zip(docs, lines, strict=True):
            for line in own:
                seen.setdefault((host, line), set()).add(document(text or ""))
        return {key for key, found in seen.items() if len(found) > limit}

    _, n = lost(often(lambda text: text))
    much = sorted({d[1] or "" for d, k in zip(docs, n, strict=True) if 100 * k > family_lost * len(words(d[1]))})
    family = {much[i]: f for i, (_, f) in near_components(list(enumerate(much)), 2, 95).items()}
    hit, n = lost(often(lambda text: family.get(text, text)))
    out = []
    for (doc_id, text, _), own, k in zip(docs, hit, n, strict=True):
        size, _, _, _, repeated = base_statistics(text)
        failed = size < 50 or 100 * repeated > 50 * size
        out.append((doc_id, len(set(own)), k, not failed and 100 * k <= max_lost * size))
    return out
