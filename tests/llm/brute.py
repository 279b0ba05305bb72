"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(docs, percent, width=5):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in held[g])
        for g in s:
            held[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def suffix_rows(docs, length=50):
    """(id, bytes, removed, spans, digest of the rest) of every row of docs."""
    first = {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                cover[p : p + length] = True
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((i, len(b), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


def cut(docs, length=50):
    """(id, what is left of the text: only whole characters of covered stretches go), for distinct ids."""
    first = {}
    for i, t in sorted(docs):
        b = t.encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, t in docs:
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                cover[p : p + length] = True
        at, rest = 0, []
        for ch in t:
            n = len(ch.encode())
            if not cover[at : at + n].all():
                rest.append(ch)
            at += n
        out[i] = "".join(rest)
    return out


def pipeline(docs):
    """{id: text} after each of the first four stages, for rows (id, text) with distinct ids."""
    stages = [{i: t for i, t in docs if t and any(ch.isalpha() for ch in t)}]
    first = {}
    for i, t in sorted(stages[0].items()):
        first.setdefault(t, i)
    stages.append({i: t for t, i in first.items()})
    groups = near(list(stages[1].items()), 80)
    stages.append({i: t for i, t in stages[1].items() if groups[i][2]})
    stages.append({i: t for i, t in cut(list(stages[2].items())).items() if t.strip(" ")})
    return stages


def suffix(docs, length=50):
    return {i: tuple(rest) for i, *rest in suffix_rows(docs, length)}


def cross_entropy(docs, targets, alpha):
    """Score of every row of docs, (id, text), in their order; the background's counts are scaled to the target's number of words."""
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in docs]
    target = [i is not None and i in targets for i, _ in docs]
    own = [(collections.Counter(zip(["", *w], w, strict=False)), collections.Counter(["", *w][:-1])) for w in words]
    b, bt, c, ct = (collections.Counter() for _ in range(4))
    for (grams, heads), t in zip(own, target, strict=True):
        b.update(grams)
        c.update(heads)
        if t:
            bt.update(grams)
            ct.update(heads)
    size = max(1, len({x for w in words for x in w}))
    k = sum(len(w) for w, t in zip(words, target, strict=True) if t) / max(1, sum(map(len, words)))
    out = []
    for (grams, heads), t, w in zip(own, target, words, strict=True):
        total = 0.0
        for (v, x), n in grams.items():
            p_t = (bt[v, x] - n * t + alpha) / (ct[v] - heads[v] * t + alpha * size)
            p_b = (k * (b[v, x] - n) + alpha) / (k * (c[v] - heads[v]) + alpha * size)
            total += n * (math.log(p_b) - math.log(p_t))
        out.append(total / len(w) if w else None)
    return out


def sessions(rows, gap, length, late, final_value=60.0):
    """rows: (id, us, arrived us, client, kind, value). (client, session, start, end, clicks, late, cents, closed by, digest) in any order."""
    once, out = {}, []
    for i, us, arrived, client, kind, value in rows:
        if i is None or us is None or client is None:
            continue
        good = value is not None and math.isfinite(value)
        e = (us, client, arrived is not None and arrived - us > late, kind == "purchase" and good and value >= final_value, math.floor(100 * value + 0.5) if good else 0)
        once[i] = min(once.get(i, e), e)
    streams, lates = collections.defaultdict(list), collections.defaultdict(list)
    for i, (us, client, is_late, final, cents) in once.items():
        (lates if is_late else streams)[client].append((us, i, final, cents))
    for client, events in streams.items():
        found = []
        for e in sorted(events):
            last = found[-1][0][-1] if found else None
            why = None if not found else "end" if last[2] else "gap" if e[0] - last[0] >= gap else "length" if e[0] - found[-1][0][0][0] > length else ""
            if why == "":
                found[-1][0].append(e)
                continue
            if found:
                found[-1][1] = why
            found.append([[e], None])
        for k, (s, why) in enumerate(found):
            until = found[k + 1][0][0][0] if k + 1 < len(found) else math.inf
            n_late = sum(s[0][0] <= x[0] < until for x in lates[client])
            path = hashlib.sha256(",".join(str(e[1]) for e in s).encode()).hexdigest()
            out.append((client, s[0][1], s[0][0], s[-1][0], len(s), n_late, sum(e[3] for e in s), why or ("end" if s[-1][2] else "none"), path))
    return out


def fingerprint(text, width=4):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(fps, distance=4):
    """fps: (id, fingerprint). {id: smallest id reachable} by links of at most ``distance`` bits."""
    top = {i: i for i, _ in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    values = np.array([f for _, f in fps], np.uint64)
    for k, (i, f) in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ np.uint64(f)) <= distance).tolist():
            a, b = find(i), find(fps[j][0])
            top[max(a, b)] = min(a, b)
    return {i: find(i) for i in top}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, queries, k=50):
    """docs: [(id, text)], queries: [(id, text)]. [(query, rank, document, score)]."""
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(w for _, c, _ in counts for w in c)
    asked = collections.defaultdict(set)
    for q, t in queries:
        if q is not None:
            asked[q] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for q, words in asked.items():
        scores = []
        for i, c, n in counts:
            m = 100 - 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)
