"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter

import duckdb
import numpy as np

from chronolith.llm import decontaminate, line_dedup

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(nodes, edges):
    """Least node of each node's component."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n) and n]
    return {d: (len(sets[d]), c) for d, c in groups(ids, edges).items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def kept_lines(rows):
    """{(doc_id, line_no)} that stay, and all of them."""
    lines = {}
    where = {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if n := " ".join(x.lower().split()):
                where[d, i] = n
                lines[n] = min(lines.get(n, (d, i)), (d, i))
    names = sorted(lines)
    size = np.array([len(x) for x in names])
    # An edit changes at most six counts of runs of three characters by one.
    profiles = line_dedup.profiles(names).astype(np.int16)
    edges = []
    for i in range(len(names)):
        j = np.arange(i + 1, len(names))
        most = np.floor(np.maximum(size[j], size[i]) * (1 - line_dedup.SIMILARITY) + 1e-9)
        for k in j[(np.abs(size[j] - size[i]) <= most) & (np.abs(profiles[j] - profiles[i]).sum(1) <= 6 * most)]:
            a, b = names[i], names[k]
            if line_dedup.similar(a, b):  # held against distance() in a test of its own
                edges.append((a, b))
    comp = groups(names, edges)
    first = {}
    for n, c in comp.items():
        first[c] = min(first.get(c, lines[n]), lines[n])
    return {k for k, n in where.items() if first[comp[n]] == k}, set(where)


def without_lines(rows):
    keep, every = kept_lines(rows)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        if any((d, i) in every and (d, i) not in keep for i in range(len(own))):
            t = "\n".join(x for i, x in enumerate(own) if (d, i) not in every or (d, i) in keep)
            if not t.strip(" \t\r\n"):
                continue
        out.append((d, t))
    return out


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def contaminated(rows, items):
    """{(doc_id, item_id)} by trying every window."""
    k, found = decontaminate.WORDS, set()
    cut = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    for item_id, text in items:
        item = plain_words(text)
        if not item:
            continue
        if len(item) < k:
            found |= {(d, item_id) for d, t in rows if any((w := plain_words(t))[i : i + len(item)] == item for i in range(len(plain_words(t))))}
            continue
        own = Counter(cut(item))
        total = sum(own.values())
        for doc_id, t in rows:
            s = cut(plain_words(t))
            for at in range(max(1, len(s) - total + 1)):
                window = s[at : at + total]
                common = sum((own & Counter(window)).values())
                if common / (total + len(window) - common) >= decontaminate.SIMILARITY:
                    found.add((doc_id, item_id))
                    break
    return found


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{name}.parquet'").fetchall()
