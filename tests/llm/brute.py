"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(found))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def _marks(seqs, window):
    seen = Counter(tuple(s[k : k + window]) if not isinstance(s, bytes) else s[k : k + window] for s in seqs for k in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for k in range(len(s) - window + 1):
            if seen[tuple(s[k : k + window]) if not isinstance(s, bytes) else s[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        out.append(gone)
    return out


def word_windows(texts, window):
    seqs = [words(t) for t in texts]
    return [(len(s), sum(g), sha(b" ".join(w for w, x in zip(s, g) if not x))) for s, g in zip(seqs, _marks(seqs, window))]


def byte_windows(texts, window):
    seqs = [(t or "").encode() for t in texts]
    out = []
    for s, g in zip(seqs, _marks(seqs, window)):
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((len(s), sum(g), spans, sha(bytes(b for b, x in zip(s, g) if not x))))
    return out


def shingles(text):
    held = [w.lower() for w in words(text)]
    if len(held) < 5:
        return {tuple(held)} if held else set()
    return {tuple(held[k : k + 5]) for k in range(len(held) - 4)}


def joined(n, links):
    """The least member of each place's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def near(texts, percent=85):
    sets = [shingles(t) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links.append((i, j))
    return [len(s) for s in sets], joined(len(texts), links)
