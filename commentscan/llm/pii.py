"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger learns from labelled spans: those that the base patterns find in a bounded sample of the corpus, each also
rewritten in forms that the patterns miss (a bracketed "at", a phone number without +, a card number with dots). Texts
are cut into overlapping windows, and each window is decoded on its own. A span that touches the edge of its window
may be cut there: unless another window has it whole, it is decoded again in windows of twice the width, until it
ends inside one. Of overlapping spans from different windows the surest ones stay. Every kind of span holds a digit,
an @ or a bracketed "at", so windows without any are all "no span" and not computed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: An address is what stands of LOCAL before an @, and a match of HOST from there on.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: A number can only begin where no digit stands before it, so a long run of digits is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents with base spans to learn from (those whose texts have the smallest hashes), and windows, at most; and of each
#: document the spans, and the windows around other numbers, to learn from. All four bound the training only.
MAX_TEXTS, MAX_WINDOWS = 1_000, 2_500
MAX_SPANS_EACH, MAX_NUMBERS_EACH = 6, 1
WIDTH, STRIDE = 96, 48
HIDDEN, EPOCHS, BATCH, RATE = 16, 14, 125, 0.02
#: Characters of an added span, at most: windows grow no wider than twice that. Base spans may have any length.
LONGEST = 1_024
#: Log-odds by which a decoded span must beat "no span".
MARGIN = 2.0
LANES = 1024

#: Every text that plausible() accepts holds one of these; as there, case is ignored and digits are of any script.
_ANCHOR = re.compile(r"[\d@]|[(\[]at[)\]]", re.I)
_SYMBOLS = {c: k + 2 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz@.-+() _:/[],|=\"\n")}  # 0: beyond the text, 1: any other
_DIGIT = len(_SYMBOLS) + 2
V, K = _DIGIT + 2, 1 + 2 * len(KINDS)
_CODE = np.ones(128, np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = list(_SYMBOLS.values())
_CODE[[ord(c.upper()) for c in "abcdefghijklmnopqrstuvwxyz"]] = [_SYMBOLS[c] for c in "abcdefghijklmnopqrstuvwxyz"]
_CODE[[ord(c) for c in "0123456789"]] = _DIGIT
FORBIDDEN = np.float32(-1e4)


def luhn(digits: str) -> bool:
    return sum(map(int, digits[-1::-2])) % 10 == -sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]) % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octet(part: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each @ outwards: every character is looked at a few times at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        host = HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost non-overlapping matches per kind; those that fail the check are dropped."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


class Taken:
    """Disjoint stretches of a text, sorted; those that overlap are joined."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def overlaps(self, start: int, end: int) -> bool:
        """Whether some stretch has a character of start:end."""
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def plausible(kind: int, text: str) -> bool:
    """Whether a decoded span can be of its kind."""
    d = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|\(at\)|\[at\]) ?[\w-]+(( ?\(dot\) ?| ?\[dot\] ?|\.)[\w-]+)+", text, re.I))
    if kind == 1:
        return bool(re.fullmatch(r"\d{1,3}([.,] ?\d{1,3}){3}", text)) and all(int(p) <= 255 for p in re.findall(r"\d{1,3}", text))
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"[(+]?[\d]+[\x20().\d/-]*\d", text)) and not d == text


def encoded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.where(points < 128, points, 127)]


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold an anchor."""
    starts: dict[int, None] = {}
    for m in _ANCHOR.finditer(text):
        last = m.start() // STRIDE
        for k in (last - 1, last):
            if k >= 0:
                starts[k * STRIDE] = None
    return list(starts)


class Tagger:
    """A bidirectional LSTM over character classes, and linear-chain CRF transitions over BIO tags."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        new = lambda *shape: (rng.normal(size=shape) * 0.15).astype(np.float32)
        self.p = {"x0": new(V, 4 * HIDDEN), "x1": new(V, 4 * HIDDEN), "u0": new(HIDDEN, 4 * HIDDEN), "u1": new(HIDDEN, 4 * HIDDEN)}
        self.p |= {"o": new(2 * HIDDEN, K), "b": np.zeros(K, np.float32), "t": np.zeros((K, K), np.float32)}
        for k in "01":
            self.p["x" + k][:, HIDDEN : 2 * HIDDEN] += 1  # remember, at first
        self.barred = np.zeros((K, K), np.float32)
        for kind in range(len(KINDS)):
            inside = 2 + 2 * kind
            self.barred[:, inside] = FORBIDDEN
            self.barred[[inside - 1, inside], inside] = 0

    def states(self, x: np.ndarray, keep: bool = False):
        n, length = x.shape
        out = np.zeros((n, length, 2 * HIDDEN), np.float32)
        caches = []
        for way in (0, 1):
            wx, u = self.p[f"x{way}"], self.p[f"u{way}"]
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            cache = []
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                g = wx[x[:, t]] + h @ u
                gates = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                a = np.tanh(g[:, 3 * HIDDEN :])
                before_h, before_c = h, c
                c = f * c + i * a
                s = np.tanh(c)
                h = o * s
                out[:, t, way * HIDDEN : (way + 1) * HIDDEN] = h
                if keep:
                    cache.append((t, before_h, before_c, i, f, o, a, s))
            caches.append(cache)
        return out, caches

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.states(x)[0] @ self.p["o"] + self.p["b"]

    def _marginals(self, e: np.ndarray):
        """Forward-backward: tag and transition marginals of a batch."""
        n, length, _ = e.shape
        trans = self.p["t"] + self.barred
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.barred[0]
        norm = lambda v: (m := v.max(1, keepdims=True)) + np.log(np.exp(v - m).sum(1, keepdims=True))
        for t in range(1, length):
            alpha[:, t] = norm(alpha[:, t - 1, :, None] + trans)[:, 0] + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = norm((trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :]).transpose(0, 2, 1))[:, 0]
        total = norm(alpha[:, -1])
        pair = np.zeros((K, K), np.float32)
        for t in range(1, length):
            pair += np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t] - total)[:, None, :]).sum(0)
        return np.exp(alpha + beta - total[:, None]), pair

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, caches = self.states(x, keep=True)
        e = h @ self.p["o"] + self.p["b"]
        tags, pair = self._marginals(e)
        de = tags.copy()
        np.put_along_axis(de, y[..., None], np.take_along_axis(de, y[..., None], 2) - 1, 2)
        de /= len(x)
        seen = np.zeros((K, K), np.float32)
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad = {"t": (pair - seen) / len(x), "b": de.sum((0, 1)), "o": np.einsum("nlh,nlk->hk", h, de, optimize=True)}
        dh_all = de @ self.p["o"].T
        for way in (0, 1):
            u = self.p[f"u{way}"]
            gx, gu = np.zeros_like(self.p[f"x{way}"]), np.zeros_like(u)
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for t, before_h, before_c, i, f, o, a, s in reversed(caches[way]):
                dh = dh + dh_all[:, t, way * HIDDEN : (way + 1) * HIDDEN]
                dc = dc + dh * o * (1 - s * s)
                dg = np.concatenate([dc * a * i * (1 - i), dc * before_c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - a * a)], 1)
                np.add.at(gx, x[:, t], dg)
                gu += before_h.T @ dg
                dh, dc = dg @ u.T, dc * f
            grad |= {f"x{way}": gx, f"u{way}": gu}
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tagger:
        rng = np.random.default_rng(5)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                part = order[at : at + BATCH]
                for k, g in self.gradient(x[part], y[part]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (RATE / (1 + epoch / 4)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def decode(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Per window the spans (first, end, kind, margin over "no span") of the best tag sequence."""
        e = self.scores(x)
        n, length, _ = e.shape
        trans = self.p["t"] + self.barred
        best, back = e[:, 0] + self.barred[0], np.zeros((n, length, K), np.int8)
        for t in range(1, length):
            s = best[:, :, None] + trans
            back[:, t] = s.argmax(1)
            best = s.max(1) + e[:, t]
        tag = np.zeros((n, length), np.int8)
        tag[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            tag[:, t - 1] = back[np.arange(n), t, tag[:, t]]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(n)]
        for w in np.flatnonzero((tag > 0).any(1)).tolist():
            row = tag[w].tolist()
            at = 0
            while at < length:
                if row[at] % 2 == 1:
                    end = at + 1
                    while end < length and row[end] == row[at] + 1:
                        end += 1
                    path = sum(e[w, k, row[k]] - e[w, k, 0] for k in range(at, end)) + sum(trans[a, b] for a, b in zip(row[at : end - 1], row[at + 1 : end], strict=True))
                    path += trans[0, row[at]] - trans[0, 0] * (end - at)
                    out[w].append((at, end, row[at] // 2, float(path)))
                    at = end
                else:
                    at += 1
        return out


def rewritten(text: str, kind: int, rng: np.random.Generator) -> str:
    """The span in a form that the base patterns miss."""
    if kind == 0:
        at = ("(at)", "[at]", " (at) ", " [at] ")[rng.integers(4)]
        name, host = text.split("@", 1)
        return name + at + (host if rng.random() < 0.5 else host.replace(".", (" (dot) ", " [dot] ")["[" in at]))
    if kind == 1:
        return text.replace(".", (", ", ". ")[rng.integers(2)])
    if kind == 2:
        d = _digits(text)
        return (".", "/", " - ")[rng.integers(3)].join(d[k : k + 4] for k in range(0, len(d), 4))
    return re.sub(r"^\+[0-9]+ ?", "", text) if len(_digits(re.sub(r"^\+[0-9]+ ?", "", text))) >= 9 else text[1:]


def examples(text: str, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows around the base spans of a text with the spans in them, plain and rewritten, and one without spans."""
    rng = np.random.default_rng(seed)
    spans = base_spans(text)
    out = []
    for start, kind, end in spans[:MAX_SPANS_EACH]:
        if any(s < end and start < e and (s, k) != (start, kind) for s, k, e in spans) or end - start > STRIDE:
            continue
        for change in (False, True):
            span = rewritten(text[start:end], kind, rng) if change else text[start:end]
            lead = int(rng.integers(0, WIDTH - len(span) + 1)) if len(span) < WIDTH else 0
            left = text[max(0, start - lead) : start]
            others = [(s, k, e) for s, k, e in spans if e > start - lead and s < start]
            window = (left + span + text[end : end + WIDTH - len(left) - len(span)])[:WIDTH]
            after = [(s, k, e) for s, k, e in spans if s < end + WIDTH and e > end]
            if not others and not after:
                out.append((window, [(len(left), kind, len(left) + len(span))]))
    taken = Taken((s, e) for s, _, e in spans)
    clean = [m.start() for m in re.finditer(r"[0-9]+", text) if not taken.overlaps(m.start() - WIDTH, m.start() + WIDTH)]
    for at in clean[:MAX_NUMBERS_EACH]:
        window = text[max(0, at - WIDTH // 2) :][:WIDTH]
        if not any(len(d) >= 9 for d in re.findall(r"[0-9]+", window)):
            out.append((window, []))
    at = int(rng.integers(0, max(1, len(text) - WIDTH)))
    window = text[at : at + WIDTH]
    return [*out, (window, [])] if not re.search(r"[0-9@]", window) else out


def _example_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [x for t in b.column("text").to_pylist() for x in examples(t, zlib.crc32(t.encode()))]
        columns = [pa.array([w for w, _ in found], pa.string()), pa.array([[v for s in spans for v in s] for _, spans in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["window", "spans"])


def train(docs: DataFrame) -> Tagger | None:
    """A tagger from at most MAX_TEXTS texts that may hold spans, those with the smallest hashes; None without spans.

    Hashes are chosen first, so that no task sees more than its share of the texts; windows are MAX_WINDOWS at most.
    """
    texts = docs.select(common.text_or_empty(docs).alias("text")).withColumn("hash", F.xxhash64("text"))
    may = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9][\x20().0-9-]{8}|[0-9]{12}|[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
    chosen = common.written(texts.filter(may).select("hash").distinct().orderBy("hash").limit(MAX_TEXTS), "personal-data-sample")
    sample = texts.join(F.broadcast(chosen), "hash").select("text")  # MAX_TEXTS hashes
    rows = sample.mapInArrow(_example_rows, "window string, spans array<int>").distinct()
    rows = rows.orderBy(F.crc32("window"), "window", "spans").limit(MAX_WINDOWS).toArrow()
    found = list(zip(rows["window"].to_pylist(), rows["spans"].to_pylist(), strict=True))
    if not any(spans for _, spans in found):
        return None
    x, y = np.zeros((len(found), WIDTH), np.int64), np.zeros((len(found), WIDTH), np.int64)
    for k, (window, spans) in enumerate(found):
        x[k, : len(window)] = encoded(window)
        for s, kind, e in zip(spans[::3], spans[1::3], spans[2::3], strict=True):
            y[k, s:e] = 2 + 2 * kind
            y[k, s] = 1 + 2 * kind
    return Tagger().fit(x, y)


def extensible(kind: int, piece: str) -> bool:
    """Whether a text that holds the piece can be plausible."""
    if kind == 0:
        return not re.search(r"[^\w.%+@()\[\] -]", piece)
    if kind == 1:
        return len(piece.strip()) <= 18
    return len(_digits(piece)) <= (19 if kind == 2 else 15)


def decoded(texts: list[str], where: list[tuple[int, int]], width: int, tagger: Tagger) -> Iterator[tuple[tuple[int, int], tuple[int, int, int, int, float, bool]]]:
    """Windows (text, start) of that width with each span in them: (text, first, end, kind, margin, cut); a cut one touches an edge inside the text."""
    codes: dict[int, np.ndarray] = {}
    lanes = max(1, LANES * WIDTH // width)
    for at in range(0, len(where), lanes):
        part = where[at : at + lanes]
        x = np.zeros((len(part), width), np.int64)
        for row, (k, s) in enumerate(part):
            if k not in codes:
                codes = {k: encoded(texts[k])}
            piece = codes[k][s : s + width]
            x[row, : len(piece)] = piece
        for (k, s), spans in zip(part, tagger.decode(x), strict=True):
            for a, e, kind, score in spans:
                yield (k, s), (k, s + a, s + e, kind, score, (a == 0 and s > 0) or (e == width and s + width < len(texts[k])))


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger adds to the base ones, none overlapping another: the surest first, over all windows.

    Of equally sure ones the one that starts first goes first, then by kind and end.
    """
    fixed = [Taken((s, e) for s, _, e in base) for base in bases]
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    width = WIDTH
    spans = {x for _, x in decoded(texts, [(k, s) for k, t in enumerate(texts) for s in windows_of(t)], width, tagger)}
    while spans:
        whole: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for k, s, e, kind, score, cut in spans:
            if not cut:
                whole.setdefault((k, kind, s // width), []).append((s, e))
                if score >= MARGIN:
                    found[k].append((-score, s, kind, e))
        pieces: dict[tuple[int, int], list[tuple[int, int, int, float]]] = {}
        for k, s, e, kind, score, cut in spans:
            beside = [x for at in (s // width - 1, s // width) for x in whole.get((k, kind, at), ())] if cut else []
            if cut and width < 2 * LONGEST and extensible(kind, texts[k][s:e]) and not any(a <= s and e <= b for a, b in beside) and not fixed[k].overlaps(s, e):
                start = max(0, ((s + e) // 2 - width) // (width // 2) * (width // 2))  # few windows, however many pieces
                pieces.setdefault((k, start), []).append((s, e, kind, score))
        width *= 2
        wider: dict[tuple[int, int], list[tuple[int, int, int, int, float, bool]]] = {}
        for (k, start), x in decoded(texts, sorted(pieces), width, tagger):
            wider.setdefault((k, start), []).append(x)
        spans = set()
        for (k, start), cut_spans in pieces.items():
            for s, e, kind, score in cut_spans:
                again = [x for x in wider.get((k, start), ()) if x[1] < e and s < x[2]]
                spans.update(again)
                if score >= MARGIN and not any(x[5] or x[4] >= MARGIN for x in again):
                    found[k].append((-score, s, kind, e))
    out = []
    for text, taken, spans in zip(texts, fixed, found, strict=True):
        new = []
        for _, s, kind, e in sorted(set(spans)):
            s, e = s + len(text[s:e]) - len(text[s:e].lstrip()), e - len(text[s:e]) + len(text[s:e].rstrip())
            if s < e and not taken.overlaps(s, e) and plausible(kind, text[s:e]):
                taken.add(s, e)
                new.append((s, kind, e))
        out.append(new)
    return out


def find_personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with base_spans and spans: arrays of (start, rank, end), sorted; rank numbers KINDS.

    docs: text and any others (columns named like the added ones are replaced). Spans count code points, the end
    excluded. Null and empty texts have none. Added spans overlap neither base spans nor each other; base spans of
    different kinds may overlap. Without a tagger there are base spans only. Repeated rows get equal spans, whatever their
    ids; an empty table gives no rows. Added spans have about LONGEST characters at most. Work grows with the length of a text, not with its square.
    """
    kind = "array<struct<start:int,rank:int,end:int>>"

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
        rows = lambda found: pa.array([[{"start": s, "rank": k, "end": e} for s, k, e in sorted(x)] for x in found], of)
        for b in batches:
            texts = b.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, tagger) if tagger else [[] for _ in texts]
            yield pa.RecordBatch.from_arrays([b.column("row"), rows(base), rows([x + y for x, y in zip(base, more, strict=True)])], ["row", "base_spans", "spans"])

    rest = [c for c in docs.columns if c not in ("text", "base_spans", "spans")]
    packed = docs.select(F.struct(*rest, docs["text"]).alias("row"), common.text_or_empty(docs).alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, base_spans {kind}, spans {kind}"
    return packed.mapInArrow(spans, schema).select("row.*", "base_spans", "spans")


def joined(spans: Column) -> Column:
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def op2_personal_data(spark, sf_dir):
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = find_personal_data(docs, train(docs))
    counts = [F.size(F.filter("base_spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return done.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
