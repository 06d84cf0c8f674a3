"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def roots(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_duplicates(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    found = roots(links, list(sets))
    return {i: (len(sets[i]), found[i], found[i] == i) for i in sets}


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, x in zip(d, gone, strict=True) if not x)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(d), spans, kept))
    return out


def items_found(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        words = word.findall(lower(text))
        for at in range(max(1, len(words) - 12)) if words else []:
            windows.setdefault(tuple(words[at : at + 13]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        words, hit, found = word.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if own := windows.get(tuple(words[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= own
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal_data(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
