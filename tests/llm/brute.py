"""Plain versions of the operators, for small inputs."""

import itertools
import re


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def shingles(text, width):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_duplicates(docs, width, num, den):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with ids."""
    sets = [shingles(t, width) for _, t in docs]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    links = set()
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        links |= {(i, j) for j, n in shared.items() if den * n >= num * (len(s) + len(sets[j]) - n)}
    group = components(len(docs), links)
    least = {}
    for (d, _), g in zip(docs, group, strict=True):
        least[g] = min(least.get(g, d), d)
    return {d: (len(s), least[g]) for (d, _), s, g in zip(docs, sets, group, strict=True)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def removed_lines(docs, normalise, simhash, min_words, distance, similarity):
    """{doc_id: [line numbers]} to take out of (doc_id, text) rows."""
    where = {}
    for d, t in sorted(docs):
        for i, line in enumerate((t or "").split("\n")):
            n = normalise(line)
            if len(n.split()) >= min_words:
                where.setdefault(n, []).append((d, i))
    lines = sorted(where)
    sims = [simhash(x) for x in lines]
    links = []
    for i, j in itertools.combinations(range(len(lines)), 2):
        if (sims[i] ^ sims[j]).bit_count() <= distance:
            longer = max(len(lines[i]), len(lines[j]))
            if edit_distance(lines[i], lines[j]) <= int((1 - similarity) * longer + 1e-9):
                links.append((i, j))
    groups = {}
    for x, g in zip(lines, components(len(lines), links), strict=True):
        groups.setdefault(g, []).extend(where[x])
    out = {}
    for at in groups.values():
        for d, i in sorted(at)[1:]:
            out.setdefault(d, []).append(i)
    return {d: sorted(x) for d, x in out.items()}
