"""Plain definitions of the operators' results, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, n):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % n == 0


def removal(rows, length=400):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, int)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if r else b""
        out.append((doc_id, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def private(text):
    found = []
    for number, (kind, pattern) in enumerate(PRIVATE.items()):
        for match in re.finditer(pattern, text or ""):
            value, digits = match.group(), re.sub("[^0-9]", "", match.group())
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((match.start(), number, kind, match.end()))
    found.sort()
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)
    return [sum(f[1] == n for f in found) for n in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; capped sources' excess is shared again until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= above


def simhash(text):
    import xxhash

    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def simhash_groups(rows):
    prints = [simhash(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)].append(doc_id)
    return [(d, f"{prints[i]:016x}", min(ids[root(i)], default=None)) for i, (d, _) in enumerate(rows)]


def kneser_ney(rows, discounts):
    train = [words(lower(t)) + ["</s>"] for d, t in rows if not fold(d, 10)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    number = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    before = Counter(w for _, w in pairs)
    top, low = discounts(number(pairs.values())), discounts(number(before.values()))
    total, classes = Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), k in pairs.items():
        total[a] += k
        classes[a][min(k, 3) - 1] += 1
    mass = sum(low[min(x, 3) - 1] for x in before.values()) / len(pairs) if pairs else 1
    out = {}
    for doc_id, text in rows:
        w = words(lower(text)) + ["</s>"]
        base = score = 0.0
        for a, b in zip(["<s>", *w[:-1]], w):
            base += math.log10((count[b] + 0.1) / (n + 0.1 * (v + 1)))
            q = mass / (v + 1) + ((before[b] - low[min(before[b], 3) - 1]) / len(pairs) if before[b] else 0)
            k = pairs.get((a, b), 0)
            free = sum(x * y for x, y in zip(top, classes[a])) / total[a] if total[a] else 1
            score += math.log10(((k - top[min(k, 3) - 1]) / total[a] if k else 0) + free * q)
        out[doc_id] = (fold(doc_id, 10), len(w), sum(count[x] > 0 for x in w), n, base, score)
    return out


def quality(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered, seen, repeated = Counter(windows), set(), set(), 0
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def archive(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        payload, ids = (html or "").encode(), [i for i in groups[html or ""] if i is not None]
        top = max(ids, default=None)
        again = len(payload) >= 1000 and len(groups[html or ""]) > 1 and top is not None and top != page_id
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None))
    return out


def contamination(docs, benchmark, size=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in benchmark:
        w = split(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[s : s + size])].add(item)
    out = {}
    for doc_id, text in docs:
        w, hit, items = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    items |= windows[tuple(w[s : s + n])]
        names = ",".join(sorted(str(i) for i in items if i is not None))
        bad = bool(hit) and 20 * len(hit) >= len(w)
        out[doc_id] = (len(w), len(hit), len(items - {None}), hashlib.sha256(names.encode()).hexdigest(), bad)
    return out


def shingle_set(text, width):
    """The distinct word shingles of a text; a shorter text is one."""
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def alike(a, b):
    """Jaccard similarity; two texts without words are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0
