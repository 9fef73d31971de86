"""Secret scanning: fixed patterns plus a linear-chain conditional random field.

Tokens are all runs of characters between blanks, quotes, brackets and the marks
``= : , ; | ` ``, whatever their length and letters; the marks around a token
belong to its context.  The field tags every token of a text as begin, inside or
outside.  A token whose state scores prove that no best path tags it other than
outside (see ``uncertain``) needs no search; Viterbi runs on the rest, and so is
exact for the whole text.

Features are the token's shape, the words and marks before and after it, and
counts over the whole file, hashed into a table of fixed size.  Each comes from
one token, one gap or the file, so the state scores of a text are sums of rows of
small tables that each task fills as it meets new tokens and gaps.

The field is trained here by maximum likelihood on a bounded sample of pieces of
texts, tagged by the fixed patterns: the value of an assignment, access keys, and
hexadecimal runs that have a letter (bare digits are more often card or phone
numbers).  Half of these are learned in a form that the patterns do not know
(short groups, plain letters, capitals, with marks).  What it learns of shape and context then finds secrets that the
patterns miss; the patterns' own spans always stay, and the field's are those
that overlap none of them.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import filterfalse, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import stored

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is matched whole
KINDS = ("assign", "access", "hex", "crf")

#: Splitting by it gives gap, token, gap, ..., token, gap.
TOKEN = re.compile(r"([^\s\"'`=:,;()<>\[\]{}|]+)")
OUTSIDE, BEGIN, INSIDE = range(3)
#: Pieces of each kind (with a secret; without one, but with a key-like token; others) that training reads at most; the
#: smallest hashes are drawn.
SAMPLE_CHAINS = 3000
#: Texts are cut into pieces of so many tokens for training; decoding takes them whole.
PIECE = 16
KINDS_OF_PIECE = 3
FEATURES = 1 << 18
STEPS, RATE, PENALTY = 80, 0.1, 1e-3
#: Features in fewer pieces are not learned: the fixed patterns miss some secrets, and these must not be learned by heart.
LEAST_CHAINS = 5
FORBIDDEN = -1e9
#: Rows of a task's tables of scores, after which it starts new ones; longer tokens are not remembered.
MEMORY, LONGEST = 500_000, 64


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), each kind leftmost and without overlap."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def _pieces(text: str) -> tuple[list[str], np.ndarray]:
    """Gaps and tokens in turn, and where each starts."""
    parts = TOKEN.split(text)
    return parts, _starts(parts)


def _starts(parts: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.cumsum(sizes) - sizes


def _chains(text: str) -> list[list[tuple[int, int]]]:
    """The text's tokens as one chain of (start, end); none without tokens."""
    parts, starts = _pieces(text)
    chain = [(int(at), int(at) + len(t)) for at, t in zip(starts[1::2], parts[1::2], strict=True)]
    return [chain] if chain else []


def _bucket(x: float, *edges: float) -> int:
    return bisect_left(edges, x)


def _key_like(t: str) -> bool:
    return len(t) >= 8 and not t.isalpha() and any(map(str.isdigit, t))


HEX_DIGITS = frozenset("0123456789abcdef")
#: ASCII digits, capitals and small letters, each as one; turns are counted between the first two and the rest.
_CLASSES = str.maketrans({c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "x" for c in map(chr, range(128))})
_CHANGES = ("du", "ud", "dl", "ld", "dx", "xd", "ul", "lu", "ux", "xu")
_SIZES, _VARIED, _TURNS = (3, 5, 7, 11, 15, 19, 31, 47), (0.2, 0.4, 0.6, 0.8), (0.05, 0.15, 0.3, 0.5)


def _shape(token: str) -> tuple:
    """What the shape features of a token depend on."""
    t = token.rstrip(".?") or token
    n = len(t)
    letters = set(t)
    size, varied, hexadecimal = bisect_left(_SIZES, n), bisect_left(_VARIED, len(letters) / n), letters <= HEX_DIGITS
    if t.isalpha():
        if t.islower():
            return size, varied, hexadecimal, "0010", 0, 0, 0, ""
        if n > 1 and t.isascii() and t.istitle():
            return size, varied, hexadecimal, "0110", 0, bisect_left(_TURNS, 1 / n), 0, ""
    if t.isascii():
        c = t.translate(_CLASSES)
        digits, upper, lower, turns = c.count("d"), c.count("u"), c.count("l"), sum(map(c.count, _CHANGES))
    else:
        digits, upper, lower = (sum(map(kind, t)) for kind in (str.isdigit, str.isupper, str.islower))
        turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in pairwise(t))
    return (size, varied, hexadecimal, f"{digits > 0:d}{upper > 0:d}{lower > 0:d}{digits + upper + lower < n:d}",
            _bucket(digits / n, 0.0, 0.2, 0.5, 0.8, 0.99), bisect_left(_TURNS, turns / n), _bucket(t.count("."), 0, 1, 3),
            t[:4] if t[:4].isupper() else "")


def _shape_features(size: int, varied: int, hexadecimal: bool, shape: str, digits: int, turns: int, dots: int, head: str) -> list[str]:
    return ["bias", f"shape={shape}", f"size={size}", f"shape,size={shape},{size}", f"hex={hexadecimal}", f"digits={digits}",
            f"turns={turns}", f"varied={varied}", f"dots={dots}", f"head={head}"]


def _known(token: str) -> str:
    return f"known={token if len(token) < 12 else ''}"


def _before_features(token: str) -> list[list[str]]:
    """Of the next token, and of the one after it."""
    w = token.lower()
    return [[f"word-1={w}", f"first-1={w[:4]}", f"last-1={w[-3:]}"], [f"word-2={w}"]]


def _gap_features(gap: str) -> list[list[str]]:
    """Of the token after the gap, and of the one before it."""
    mark = gap.strip()[-1:] or gap[-1:]
    return [[f"mark={mark}", f"assigned={bool(re.search(r'[:=][ \"\']*$', gap))}"], [f"next={gap[:1]}"]]


def _file_features(text: str) -> list[str]:
    lines, raw = text.count("\n") + 1, np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    digits = np.count_nonzero((raw >= 48) & (raw < 58)) / (len(raw) + 1)
    return [f"file-assignments={_bucket((text.count('=') + text.count(':')) / lines, 0.0, 0.1, 0.5, 1)}",
            f"file-digits={_bucket(digits, 0.001, 0.005, 0.02, 0.1)}"]


QUOTED = "quoted"


def _quotes(gap: str) -> tuple[bool, bool]:
    """Whether a token after the gap, and one before it, has a quote next to it."""
    return gap[-1:] in ("\"", "'"), gap[:1] in ("\"", "'")


def _numbers(features: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) % FEATURES for x in features]


def _features(parts: list[str], at: int, file: list[str], words: bool = True) -> list[int]:
    """Feature numbers of the token ``parts[at]``, with or without those of the words before it."""
    f = _shape_features(*_shape(parts[at])) + [_known(parts[at])] + _gap_features(parts[at - 1])[0] + _gap_features(parts[at + 1])[1] + file
    if words and at >= 3:
        f += _before_features(parts[at - 2])[0]
    if words and at >= 5:
        f += _before_features(parts[at - 4])[1]
    if _quotes(parts[at - 1])[0] and _quotes(parts[at + 1])[1]:
        f.append(QUOTED)
    return _numbers(f)


class _Rows(dict):
    """Key -> row of a table; ``rows`` makes those of keys that are met for the first time."""

    def __init__(self, width: int, rows) -> None:
        super().__init__()
        self.table, self.used, self.rows = np.empty((1024, width)), 0, rows

    def of(self, keys: list[str]) -> np.ndarray:
        if self.used > MEMORY:
            self.clear()
            self.table, self.used = np.empty((1024, self.table.shape[1])), 0
        if new := list(filterfalse(self.__contains__, set(keys))):
            end = self.used + len(new)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.empty((max(len(self.table), len(new)), self.table.shape[1]))])
            self.table[self.used : end] = self.rows(new)
            self.update(zip(new, range(self.used, end)))
            self.used = end
        out = self.table[np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))]
        for key in new:
            if len(key) > LONGEST:
                del self[key]
        return out


class _Numbers(dict):
    """Key -> its number, and a table with a row of each; starts anew when there are too many."""

    def __init__(self, width: int, row) -> None:
        super().__init__()
        self.cells, self.width, self.row = array("d"), width, row

    def __missing__(self, key) -> int:
        self[key] = at = len(self)
        self.cells.extend(self.row(key))
        return at

    def table(self) -> np.ndarray:
        return np.frombuffer(self.cells).reshape(-1, self.width)

    def trim(self) -> None:
        if len(self) > MEMORY:
            self.clear()
            self.cells = array("d")


class Scorer:
    """State scores of texts under given weights."""

    def __init__(self, weights: np.ndarray) -> None:
        known = {int(i): tuple(weights[i].tolist()) for i in np.flatnonzero(weights.any(1))}

        def total(features: list[str]) -> list[float]:
            a = b = c = 0.0
            for i in _numbers(features):
                if i in known:
                    x, y, z = known[i]
                    a, b, c = a + x, b + y, c + z
            return [a, b, c]

        self.total = lambda features: np.array(total(features))
        shapes = _Numbers(3, lambda key: total(_shape_features(*key)))
        heads, tails = _Numbers(3, lambda x: total([f"first-1={x}"])), _Numbers(3, lambda x: total([f"last-1={x}"]))
        digest, unknown = xxhash.xxh32_intdigest, _numbers([_known(" " * 12)])[0]

        def token_rows(tokens: list[str]) -> np.ndarray:
            """Of each, the sums of ``_shape_features`` and ``_known``, and of both of ``_before_features``."""
            for kept in (shapes, heads, tails):
                kept.trim()
            numbers, kinds = [], []
            for t in tokens:
                w = t.lower()
                raw = w.encode("utf-8", "replace")
                own = unknown if len(t) >= 12 else digest(b"known=" + (raw if w == t else t.encode("utf-8", "replace")))
                numbers += own, digest(b"word-1=" + raw), digest(b"word-2=" + raw)
                kinds += shapes[_shape(t)], heads[w[:4]], tails[w[-3:]]
            own, before, second = weights[np.array(numbers) % FEATURES].reshape(-1, 3, 3).swapaxes(0, 1)
            shape, head, tail = np.array(kinds).reshape(-1, 3).T
            return np.concatenate([shapes.table()[shape] + own, before + heads.table()[head] + tails.table()[tail], second], 1)

        self.tokens = _Rows(9, token_rows)
        self.gaps = _Rows(8, lambda gaps: [[*(x for f in _gap_features(g) for x in total(f)), *_quotes(g)] for g in gaps])
        self.quoted = self.total([QUOTED])

    def emissions(self, text: str, parts: list[str]) -> np.ndarray:
        t, g = self.tokens.of(parts[1::2]), self.gaps.of(parts[0::2])
        e = t[:, :3] + g[:-1, :3] + g[1:, 3:6] + self.total(_file_features(text))
        e[1:] += t[:-1, 3:6]
        e[2:] += t[:-2, 6:9]
        return e + (g[:-1, 6] * g[1:, 7])[:, None] * self.quoted


def _covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals with the characters of sorted spans."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _overlaps(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    at = bisect_left(covered, end, key=itemgetter(0))  # disjoint: the last one ahead of the end also ends last
    return at > 0 and covered[at - 1][1] > start


#: Digits, as letters; and marks that rewritten values hold.
_LETTERS, _MARKS = str.maketrans("0123456789", "gkmqrtvxyz"), "!$@#%&*^~?"


def rewritten(value: str, number: int) -> str:
    """A value in a form that the patterns do not know: short groups, letters, capitals, or with marks."""
    plain = "".join(c for c in value if c.isalnum())
    letters = plain.translate(_LETTERS)
    if number % 8 < 4:  # of half of them the groups hold no digits
        plain = letters
    parts = [plain[i : i + 4] for i in range(0, len(plain), 4)]
    form = number % 4
    if form == 0:
        return " ".join(parts[:6]).lower()
    if form == 3:
        return "".join(part + _MARKS[(number + i) % len(_MARKS)] for i, part in enumerate(parts[:4]))
    return letters.lower() if form == 1 else letters.upper()


def _rewritten_piece(text: str, span: tuple[int, int], number: int) -> tuple[list[str], list[int]]:
    """Parts and tags of a secret's surroundings with the secret rewritten."""
    start, end = span
    value = rewritten(text[start:end], number)
    left = max(0, start - 60)
    parts, starts = _pieces(text[left:start] + value + text[end : end + 60])
    chain = [(int(a), int(a) + len(t)) for a, t in zip(starts[1::2], parts[1::2], strict=True)]
    return parts, _weak_tags(chain, [(start - left, start - left + len(value))])


def _secret_values(text: str) -> list[tuple[int, int, int]]:
    """What the fixed patterns say is secret: of an assignment, its value."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    rest = [s for s in fixed_spans(text) if s[1] == 1 or (s[1] == 2 and not text[s[0] : s[2]].isdigit())]
    return sorted([(a, 0, b) for a, b in values] + rest)


def _weak_tags(chain: list[tuple[int, int]], covered: list[tuple[int, int]]) -> list[int]:
    tags = []
    for start, end in chain:
        inside = _overlaps(covered, start, end)
        tags.append((INSIDE if tags and tags[-1] != OUTSIDE else BEGIN) if inside else OUTSIDE)
    return tags


_FORM = "struct<parts:array<string>,lead:int,tags:array<int>>"
_PIECE = f"seen long, kind int, secret boolean, tags array<int>, forms array<{_FORM}>, file array<string>"


def _examples(batches: Iterator[pa.RecordBatch], bound: int = SAMPLE_CHAINS) -> Iterator[pa.RecordBatch]:
    """Pieces for training: hash, kind, whether it has a secret, tags, forms (as it is, rewritten), file features.

    A form has its gaps and tokens, the first ``lead`` of them context only.  Of
    each kind the ``bound`` distinct pieces of smallest hash in the task: no other
    can be among those of all rows.
    """
    drawn: list[dict] = [{} for _ in range(KINDS_OF_PIECE)]
    heaps: list[list[int]] = [[] for _ in drawn]
    form = lambda parts, lead, tags: {"parts": parts, "lead": lead, "tags": tags}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            parts = TOKEN.split(text or "")
            n = len(parts) // 2
            if not n:
                continue
            file, covered = None, _covered(_secret_values(text))
            starts = _starts(parts).tolist() if covered else []
            for at in range(0, n, PIECE):
                end = min(n, at + PIECE)
                left = max(0, 2 * at - 4)
                own = parts[left : 2 * end + 1]
                seen = xxhash.xxh3_64_intdigest("".join(own).encode("utf-8", "replace")) >> 1
                if not covered and all(len(h) == bound and seen > -h[0] for h in heaps[1:]):
                    continue  # of either kind, it is not drawn
                first, last = (starts[2 * at + 1], starts[2 * end]) if covered else (0, 0)
                kind = 0 if _overlaps(covered, first, last) else 1 if any(len(t) >= 8 and _key_like(t) for t in parts[2 * at + 1 : 2 * end : 2]) else 2
                if seen in drawn[kind] or (len(heaps[kind]) == bound and seen > -heaps[kind][0]):
                    continue
                file = file or _file_features(text)
                tags = [OUTSIDE] * (end - at)
                if covered:
                    tags = _weak_tags([(starts[i], starts[i] + len(parts[i])) for i in range(2 * at + 1, 2 * end, 2)], covered)
                forms = [form(own, 2 * at - left, tags)]
                if kind == 0:
                    span = covered[bisect_right(covered, first, key=itemgetter(1))]  # the first that ends in the piece
                    other, other_tags = _rewritten_piece(text, span, seen >> 2)
                    forms.append(form(other, 0, other_tags))
                drawn[kind][seen] = (seen, kind, kind == 0, tags, forms, file)
                heapq.heappush(heaps[kind], -seen)
                if len(heaps[kind]) > bound:
                    del drawn[kind][-heapq.heappop(heaps[kind])]
    texts = pa.list_(pa.string())
    schema = pa.schema([("seen", pa.int64()), ("kind", pa.int32()), ("secret", pa.bool_()), ("tags", pa.list_(pa.int32())),
                        ("forms", pa.list_(pa.struct([("parts", texts), ("lead", pa.int32()), ("tags", pa.list_(pa.int32()))]))),
                        ("file", texts)])
    rows = [dict(zip(schema.names, r, strict=True)) for kind in drawn for r in kind.values()]
    for at in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_pylist(rows[at : at + 1000], schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of drawn pieces: hash, tags, number of features by token, features.

    Half of the pieces go without the words before a token, so that the patterns'
    own key words do not carry all the weight.
    """
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = r["form"]["parts"]
            f = [_features(parts, i, r["file"], r["seen"] % 2 == 0) for i in range(r["form"]["lead"] + 1, len(parts), 2)]
            rows.append({"seen": r["seen"], "tags": r["form"]["tags"], "sizes": [len(x) for x in f], "features": [y for x in f for y in x]})
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("seen", pa.int64()), ("tags", ints), ("sizes", ints), ("features", ints)]))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _no_jump(transitions: np.ndarray) -> np.ndarray:
    out = transitions.copy()
    out[OUTSIDE, INSIDE] = FORBIDDEN
    return out


def fit(chains: list[tuple[list[int], list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """State weights (feature, tag) and transitions (from, to) of highest penalised likelihood."""
    learned, moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    if not chains:
        learned[:, OUTSIDE] = 1.0
        return learned, _no_jump(moves)
    frequent = np.bincount(np.concatenate([np.unique(np.concatenate(fs)) for _, fs in chains]), minlength=FEATURES) >= LEAST_CHAINS
    number, weights = np.cumsum(frequent) - 1, np.zeros((np.count_nonzero(frequent), 3))  # the others stay 0
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves)]
    groups = []  # chains of one length at a time
    for n in sorted({len(tags) for tags, _ in chains}):
        own = [c for c in chains if len(c[0]) == n]
        sizes = np.array([len(f) for _, fs in own for f in fs])
        features, token = np.concatenate([f for _, fs in own for f in fs]), np.repeat(np.arange(len(sizes)), sizes)
        kept = frequent[features]
        groups.append((n, np.array([tags for tags, _ in own]), number[features[kept]], token[kept]))
    for step in range(1, STEPS + 1):
        grad_w, grad_m = PENALTY * len(chains) * weights, PENALTY * len(chains) * moves
        t = _no_jump(moves)
        for n, tags, features, token in groups:
            count = len(tags)
            e = np.stack([np.bincount(token, weights[features, k], count * n) for k in range(3)], -1).reshape(count, n, 3)
            forward, backward = np.empty_like(e), np.empty_like(e)
            forward[:, 0] = e[:, 0] + t[OUTSIDE]
            for i in range(1, n):
                forward[:, i] = e[:, i] + _log_sum(forward[:, i - 1, :, None] + t, 1)
            backward[:, -1] = t[:, OUTSIDE]
            for i in range(n - 2, -1, -1):
                backward[:, i] = _log_sum(t + (e[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            total = _log_sum(forward[:, -1] + backward[:, -1], 1)
            gap = (np.exp(forward + backward - total[:, None, None]) - np.eye(3)[tags]).reshape(-1, 3)
            for k in range(3):
                grad_w[:, k] += np.bincount(features, gap[token, k], len(weights))
            path = np.concatenate([np.zeros((count, 1), int), tags, np.zeros((count, 1), int)], 1)
            np.add.at(grad_m, (path[:, :-1], path[:, 1:]), -1.0)
            grad_m[OUTSIDE] += np.exp(forward[:, 0] + backward[:, 0] - total[:, None]).sum(0)
            grad_m[:, OUTSIDE] += np.exp(forward[:, -1] + backward[:, -1] - total[:, None]).sum(0)
            for i in range(1, n):
                pair = forward[:, i - 1, :, None] + t + (e[:, i] + backward[:, i])[:, None, :]
                grad_m += np.exp(pair - total[:, None, None]).sum(0)
        for p, g, (m, v) in zip((weights, moves), (grad_w, grad_m), state, strict=True):
            g /= len(chains)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    learned[frequent] = weights
    return learned, _no_jump(moves)


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a chain between outside tokens."""
    score, back = emissions[0] + moves[OUTSIDE], []
    for e in emissions[1:]:
        step = score[:, None] + moves
        back.append(step.argmax(0))
        score = step.max(0) + e
    tag = int((score + moves[:, OUTSIDE]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


def uncertain(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Numbers of the tokens that some best path may tag other than outside.

    Take a longest run of such tags in a path and make it outside: the score falls
    by at most the sum of ``gain`` over the run plus ``ends``.  A token none of whose
    runs (the best one by running sums) has a sum above 0 is outside in every best path.
    """
    inner = moves[1:, 1:].max() - moves[OUTSIDE, OUTSIDE]
    ends = moves[OUTSIDE, BEGIN] + moves[1:, OUTSIDE].max() - 2 * moves[OUTSIDE, OUTSIDE] - inner
    gain = e[:, 1:].max(1) - e[:, OUTSIDE] + inner

    def up_to(x: np.ndarray) -> np.ndarray:  # greatest sum of a run that ends here
        total = np.cumsum(x)
        return total - np.minimum.accumulate(total - x)

    return np.flatnonzero(up_to(gain) + up_to(gain[::-1])[::-1] - gain + ends >= -1e-6)


def tagged_spans(text: str, scorer: Scorer, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that the best path through all tokens of the text tags; end marks of a sentence are left out."""
    parts = TOKEN.split(text)
    if len(parts) < 3:
        return []
    e, out = scorer.emissions(text, parts), []
    at = uncertain(e, moves)
    starts = _starts(parts) if len(at) else ()
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        for i, tag in zip(run, viterbi(e[run], moves), strict=True):
            token, start = parts[2 * i + 1], int(starts[2 * i + 1])
            end = start + (len(token.rstrip(".?")) or len(token))
            if tag == BEGIN:
                out.append((start, 3, end))
            elif tag == INSIDE:
                out[-1] = (out[-1][0], 3, end)
    return out


def new_spans(text: str, base: list[tuple[int, int, int]], scorer: Scorer, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """The field's spans that overlap none of the fixed patterns'."""
    covered = _covered(base)
    return [s for s in tagged_spans(text, scorer, moves) if not _overlaps(covered, s[0], s[2])]


def train(docs: DataFrame, sample_chains: int = SAMPLE_CHAINS) -> tuple[np.ndarray, np.ndarray]:
    """A field fitted to at most ``sample_chains`` distinct pieces of each kind.

    A piece counts once, however many copies it has: one copied text cannot fill the sample.
    """
    rows = stored(docs.select("text").mapInArrow(partial(_examples, bound=sample_chains), _PIECE), "chains")
    drawn = []
    for kind in range(KINDS_OF_PIECE):
        part = rows.where(F.col("kind") == kind)
        most = part.select("seen").distinct().orderBy("seen").limit(sample_chains).agg(F.max("seen")).first()[0]
        part = part.where(F.col("seen") <= F.lit(most)).groupBy("seen").agg(F.min(F.struct("forms", "file")).alias("p"))
        # of half of the pieces, by a bit of the hash, the rewritten form if there is one
        use = F.when(F.shiftright("seen", 1) % 2 == 0, F.size("p.forms") - 1).otherwise(0)
        part = part.select("seen", F.get("p.forms", use).alias("form"), "p.file")
        drawn += part.mapInArrow(_numbered, "seen long, tags array<int>, sizes array<int>, features array<int>").orderBy("seen").collect()
    return fit([(r.tags, np.split(np.array(r.features, np.int64), np.cumsum(r.sizes)[:-1])) for r in drawn])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, sample_chains: int = SAMPLE_CHAINS) -> DataFrame:
    """``find`` with a field trained on the rows themselves."""
    return find(docs, train(docs, sample_chains))


def find(docs: DataFrame, field: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base (array of kind, start, end), spans (likewise, all).

    Offsets are code points, the end exclusive, ordered by start and kind.  A
    null or empty text has no spans.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"struct<base:{span},spans:{span}>")
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        weights, moves = model.value
        scorer = Scorer(weights)
        for texts in batches:
            base = [fixed_spans(t or "") for t in texts]
            more = [new_spans(t or "", b, scorer, moves) for t, b in zip(texts, base, strict=True)]
            yield pd.DataFrame({"base": map(named, base), "spans": [named(sorted(a + b)) for a, b in zip(base, more, strict=True)]})

    return docs.select("doc_id", spans_of(F.col("text")).alias("found")).select("doc_id", "found.base", "found.spans")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, one row per row of ``docs``."""
    def joined(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select("doc_id", *map(count, KINDS[:3]), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
