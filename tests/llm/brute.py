"""Plain Python versions of the operators, for small inputs."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import xxhash


def op5(rows, window=35):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op6(rows, window=200):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + window] for _, b in docs for k in range(len(b) - window + 1))
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k:k + window]] > 1:
                gone[k:k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def op7(rows, distance=3):
    prints = [(i, fingerprint(t)) for i, t in rows]
    different = sorted({f for _, f in prints})
    comp = components(different, [(a, b) for a, b in itertools.combinations(different, 2) if (a ^ b).bit_count() <= distance])
    least = {}
    for i, f in prints:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return [(i, f"{f:016x}", least.get(comp[f])) for i, f in prints]


def op9(rows):
    """rows: (conv_id, turn, role, text); without formatted_chars."""
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def op10(rows):
    """Without the added kinds: (doc_id, n_assign, n_access, n_hex, base_sha256)."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = []
    for i, t in rows:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        names = ("assign", "access", "hex")
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))
        out.append((i, *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    return out


def op11(rows, least=100, longest=5, top=2000, share=100):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    some = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    held = {}
    for (lang, w), a in some.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[lang, w[i:i + k]] = max(a, held.get((lang, w[i:i + k]), 0))
    best = {}
    for (lang, w), a in some.items():
        if 100 * held.get((lang, w), -1) >= share * a:
            continue
        cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        best.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), cut[2], cut[3]))
    return [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in best.items() for k, (s, a, p, left, right) in enumerate(sorted(all_)[:top])]


def op12(rows, least=100):
    """rows: (page_id, url, html)."""
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    out = []
    for k in order:
        page, _, html = rows[k]
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        again = len(body) >= least and digest in first
        out.append((page, len(body), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, page)
    return out


def trie(convs):
    """convs: {id: [(role, text), ..]} to the nodes as op13 returns them."""
    member = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            member.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in member if p)
    leaves, saved = Counter(), Counter()
    for p, ids in member.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ids) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, ids in member.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(p))
        out.append((min(ids), len(p), min(member[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def op13(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return trie(made)
