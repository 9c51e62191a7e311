"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

DATA = "/root/testdata"


def rows(sf, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DATA}/{sf}/{name}.parquet").to_pylist()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def linked(fps, ids, radius=4):
    """Smallest id reachable from each row over fingerprints within the radius."""
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= radius):
            a, b = find(i), find(int(j) + i + 1)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


def contaminated(docs, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [("" if b["item_id"] is None else str(b["item_id"]), word.findall(lower(b["text"]))) for b in bench]
    windows = {}
    for name, w in items:
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for d in docs:
        w, hit, found = word.findall(lower(d["text"])), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((d["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def line_key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def lines_kept(docs, min_docs):
    found = {}
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            found.setdefault(line_key(line), set()).add(d["doc_id"])
    hot = {k for k, v in found.items() if len(k) >= 1 and len(v) >= min_docs}
    out = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [x for x in lines if line_key(x) not in hot]
        out.append((d["doc_id"], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
