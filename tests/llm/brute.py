"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, size=10):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w and item is not None else ():
            wins[tuple(w[i : i + size])].add(item)
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if items_here := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_here
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def repeated_spans(docs, length=100):
    """docs: (doc_id, text) in order."""
    seen, out = set(), []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            part = b[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(part)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def secrets(text):
    text, spans = text or "", []
    for k, (pattern, group, least) in enumerate([
        (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    counts = Counter(k for _, k, _ in spans)
    names = ("assign", "access", "hex")
    return counts[0], counts[1], counts[2], ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, radius=2):
    prints = [(doc, fingerprint(text)) for doc, text in docs]
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if least[j] < least[i] and (a ^ b).bit_count() <= radius:
                    least[i], changed = least[j], True
    groups = defaultdict(list)
    for i, g in enumerate(least):
        groups[g].append(prints[i][0])
    smallest = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(doc, f"{fp:016x}", smallest[least[i]]) for i, (doc, fp) in enumerate(prints)]


def targets(sizes, most=3):
    """sizes: source -> words. Shares out, stops, and shares the excess again until nothing is above."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = {}, list(order), sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= most * sizes[s]
            open_.remove(s)
