"""Plain Python statements of what the operators return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def exact(docs):
    """docs: (doc_id, text). Per row: keep_id, group_size, kept, sha."""
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    groups = defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    return {
        i: (min(groups[n]), len(groups[n]), i == min(groups[n]), hashlib.sha256(n.encode()).hexdigest())
        for i, n in norm.items()
    }


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(w) < 10 or 100 * len(covered) > 20 * len(w),
    )


def mix(docs, pattern=(5, 2, 1)):
    """docs: (doc_id, text, source). Targets by repeated resharing, takes by sorting."""
    size = {i: len(words(t)) for i, t, _ in docs}
    by = defaultdict(list)
    for i, _, s in docs:
        by[s].append(i)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: pattern[k % len(pattern)] for k, s in enumerate(order)}
    total = {s: sum(size[i] for i in by[s]) for s in order}
    target, free = {}, set(order)
    left = float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.discard(s)
    taken = {}
    for s in order:
        goal = int(target[s] + 1e-9)
        epochs, rest = divmod(goal, total[s]) if total[s] else (0, 0)
        for i in sorted(by[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            head = min(size[i], rest)
            rest -= head
            taken[i] = epochs * size[i] + head
    return size, total, target, taken


def pieces(docs, tokenizer, limit=4096):
    out = {}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            out[i, n] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    return out


def shingles(text, size=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def components(docs, num=90, size=3):
    """docs: (doc_id, text). Component by all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    ids = sorted(sets)
    for a in ids:
        shared = Counter()
        for g in sets[a]:
            for b in by[g]:
                if b > a:
                    shared[b] += 1
        for b, n in shared.items():
            if 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def one_of_near_copies(docs):
    """docs: (doc_id, text, source) with ids of their own. The smallest id of each component over
    five words at 80 in 100; documents without words stay."""
    found = components([d[:2] for d in docs], 80, 5)
    return [d for d in docs if found[d[0]][1] == d[0]]


def mixed(docs):
    """docs: (doc_id, text, source). The texts of the mix: whole ones by epochs, then the head."""
    size, total, _, taken = mix(docs)
    out = []
    for i, text, source in docs:
        if not size[i]:
            continue
        whole, head = divmod(taken[i], size[i])
        out += [(i, text, source)] * whole
        if head:
            end = list(WORD.finditer(text))[head - 1].end()
            out.append((i, text[:end], source))
    return out


def without_spread_lines(docs):
    """docs: (doc_id, text, source). Spread lines go, and what has no word left by that."""
    kept = spread_lines(docs)
    return [(i, kept[i], s) for i, t, s in docs if kept[i] == t or words(kept[i])]


def spread_lines(docs, min_sites=10, min_sites_long=3, long_words=8, min_words=3, min_sites_short=20):
    """docs: (doc_id, text, source). Texts without spread lines but their first occurrence."""
    sites, first = defaultdict(set), {}
    for i, t, s in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            n = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
            if n:
                sites[n].add(s or "")
                first.setdefault(n, (i, k))

    def needed(n):
        many = len(n.split(" "))
        return min_sites_short if many < min_words else min_sites_long if many >= long_words else min_sites

    bad = {n for n, s in sites.items() if len(s) >= needed(n)}
    out = {}
    for i, t, _ in docs:
        if t is None:
            out[i] = None
            continue
        keep = []
        for k, line in enumerate(t.split("\n")):
            n = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
            if n not in bad or first[n] == (i, k):
                keep.append(line)
        out[i] = "\n".join(keep)
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    """Base spans as (kind, start, end)."""
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 13 <= len(only(m)) <= 19 and luhn(only(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(only(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def personal_digest(text):
    found = personal(text)
    counts = tuple(sum(k == kind for k, _, _ in found) for kind in ("email", "ip", "card", "phone"))
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    return counts, hashlib.sha256(listed.encode()).hexdigest(), listed
