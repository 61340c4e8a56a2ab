"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def code_length(samples, text, order):
    """Bits of ``text`` under byte context counts of ``samples``, by recursion."""
    counts = {}
    for sample in samples:
        data = b"\n" * order + lower(sample).encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1

    def bits(context, byte):
        seen = counts.get(context)
        shorter = lambda: 8.0 if not context else bits(context[1:], byte)
        if not seen:
            return shorter()
        whole = sum(seen.values()) + len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / whole)
        return -math.log2(len(seen) / whole) + shorter()

    data = b"\n" * order + lower(text).encode()
    return sum(bits(data[i - order : i], data[i]) for i in range(order, len(data)))


def shared_bytes(docs, length):
    """{doc_id: (n_removed, n_spans, kept)} for {doc_id: text}."""
    first = {}
    data = {d: (t or "").encode() for d, t in docs.items()}
    for d, t in data.items():
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(d, first.get(t[i : i + length], d))
    out = {}
    for d, t in data.items():
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g))
    return out


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, items)}."""
    windows = {}
    for item, text in items:
        w = words(text)
        need = min(window, len(w))
        for i in range(len(w) - need + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + need]), set()).add(str(item))
    out = {}
    for d, text in docs.items():
        w, hit, names = words(text), set(), set()
        for need in {len(k) for k in windows}:
            for i in range(len(w) - need + 1):
                found = windows.get(tuple(w[i : i + need]))
                if found:
                    names |= found
                    hit |= set(range(i, i + need))
        out[d] = (len(w), len(hit), sorted(names))
    return out


def shingles(text):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def near_classes(docs, similarity=0.8):
    """{doc_id: smallest doc_id of its component} over all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = sum((sets[a] & sets[b]).values())
            if shared and shared >= similarity * sum((sets[a] | sets[b]).values()) - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in docs}


def without_boilerplate(rows, ratio, least):
    """{doc_id: text} of (doc_id, host, text) rows."""
    pages = {}
    for _, host, text in rows:
        if text is not None:
            pages.setdefault(host, set()).add(text)
    bad = {}
    for host, texts in pages.items():
        counts = Counter(line for t in texts for line in {x.strip(" ") for x in t.split("\n")} if line)
        bad[host] = {line for line, n in counts.items() if n >= least and n > len(texts) * ratio}
    drop = lambda host, line: line.strip(" ") in bad[host] if line.strip(" ") else False
    return {d: None if t is None else "\n".join(x for x in t.split("\n") if not drop(h, x)) for d, h, t in rows}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            each = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(each) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    found = [
        (m.start(), number, m.end(), kind)
        for number, (kind, pattern) in enumerate(PII.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def gear_chunks(data, values, reach, least, most, mask):
    """Edges of the chunks of one text, byte by byte."""
    edges, last = [0], 0
    starts = lambda i: i == len(data) or (data[i] & 0xC0) != 0x80
    for i in range(1, len(data) + 1):
        h = sum(values[data[i - 1 - j]] << j for j in range(min(reach, i)))
        cut = i == len(data) or (h & mask) == 0 and starts(i)
        while cut and i - last > most:
            last += most
            while not starts(last):
                last -= 1
            edges.append(last)
        if cut and (i - last >= least or i == len(data) and i > last):
            edges.append(i)
            last = i
    return edges


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
