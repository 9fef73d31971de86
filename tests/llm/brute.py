"""Plain Python versions of the operators' results, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LATIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_duplicates(docs, width=2, percent=80):
    """docs: (doc_id, text) with unique ids -> {doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, text in docs:
        w = SPACE_WORD.findall((text or "").translate(ASCII_LOWER))
        sets[i] = frozenset(tuple(w[j:j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    repeated = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            len(w) < 10 or 100 * len(repeated) > 20 * len(w))


def secret_spans(text):
    """{kind: [(start, end)]} by the fixed patterns, as they are stated"""
    text = text or ""
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    return {"assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 12],
            "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
            "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
            "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
            "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))],
            "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]}


def joined(spans):
    kinds = list(spans)
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, kind in enumerate(kinds) for a, b in spans[kind]))


def repeats_removed(docs, width=35):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept_sha256)] in the same order"""
    words = [SPACE_WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {k for j in range(len(w) - width + 1) if seen[tuple(w[j:j + width])] > 1 for k in range(j, j + width)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def contamination(docs, items, width=10):
    """-> {doc_id: (n_words, n_hit, n_items, items_sha256)}"""
    windows = defaultdict(set)
    for i, t in items:
        w = LATIN_WORD.findall((t or "").translate(ASCII_LOWER))
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j:j + n])].add(i)
    lengths = {len(k) for k in windows}
    out = {}
    for i, t in docs:
        w = LATIN_WORD.findall((t or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j:j + n])):
                    found |= own
                    hit.update(range(j, j + n))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fill_in_middle(doc_id, text, rate=100, suffix_first=50, seed=7):
    """n, form, prefix_chars, middle_chars, output"""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < suffix_first:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def hard_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, label, vector) -> sorted rows of the result"""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        kept[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for a, label, u in kept:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(u, v, strict=False)), i, other == label) for i, other, v in kept if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(n, t) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(fits[:negatives], 1)]
    return sorted(out)
