"""Plain single-process versions of the operators, to hold results against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return fold(host), slash + path


def fixed_rule(host, path):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    hit = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def contamination(docs, items, size=10):
    """docs: {id: text}, items: {id: text} -> {id: (n_words, n_hit, item names)}."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    known = defaultdict(set)
    for i, t in items.items():
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k:k + n])].add(i)
    out = {}
    for d, t in docs.items():
        w, hit, named = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in known:
                    hit.update(range(k, k + n))
                    named |= known[x]
        out[d] = (len(w), len(hit), sorted(str(i) for i in named if i is not None))
    return out


def fingerprint(text, k=4):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """{id: fingerprint} -> {id: least id reachable}."""
    ids, parent = sorted(prints), {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def repeated_bytes(texts, length=200):
    """[bytes] -> [covered flags]: bytes in a string of ``length`` that also starts elsewhere."""
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]].append((d, i))
    out = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i:i + length] = b"\1" * length
    return out


def cut(text, covered):
    kept = bytes(b for b, c in zip(text, covered) if not c)
    spans = sum(c and not p for p, c in zip(b"\0" + bytes(covered), covered))
    return len(text), sum(covered), spans, hashlib.sha256(kept).hexdigest()


def crc(b):
    return zlib.crc32(b)
