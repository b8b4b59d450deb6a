"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds to them.

`base_spans` finds what the patterns of the four kinds define. The model is trained in numpy on windows
of the corpus, labelled by those spans and by variants of them that the patterns do not cover (a number
without its plus sign, other separators). At use, texts are cut into overlapping windows; each is decoded
by Viterbi, and all spans of a text are reconciled together: spans cut by a window's edge give way to the
window that holds them whole, and of overlapping spans the set of greatest total score stays. Base spans
always stay. A span of any kind holds a digit or an @, so windows without one hold no span and are skipped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import chunks, map_arrow, text_bytes

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

# ---- patterns -----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so the look-behind only spares tries
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if domain:
            done = at = domain.end()
            yield start, done


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """All spans of the patterns, by start and then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(_small(p) for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# ---- windows ------------------------------------------------------------------------------------

#: Characters of a window, and from one window's start to the next's.
WIDTH, STRIDE = 96, 48
_MARKS = "@.-+() _%:/=\"',\n#*[]|;"
_CLASSES = 5 + len(_MARKS)
_CLASS = np.full(128, 3, np.uint8)
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 5 + _i
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2
PAD = _CLASSES
_TRIGGER = np.zeros(256, bool)
_TRIGGER[48:58] = _TRIGGER[64] = True


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points), 4, np.uint8)
    ascii_ = points < 128
    out[ascii_] = _CLASS[points[ascii_]]
    return out


def windows(codes: np.ndarray) -> list[int]:
    """Starts of the windows that hold a digit or an @."""
    hit = np.flatnonzero((codes == 0) | (codes == 5))
    if len(hit) == 0:
        return []
    last = max(0, (len(codes) - WIDTH + STRIDE - 1) // STRIDE)
    first = np.maximum(0, (hit - WIDTH) // STRIDE + 1)
    starts = set()
    for a, b in set(zip(np.minimum(first, last).tolist(), np.minimum(hit // STRIDE, last).tolist())):
        starts.update(range(a, b + 1))
    return [s * STRIDE for s in sorted(starts)]


# ---- model --------------------------------------------------------------------------------------

HIDDEN = 16
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _start_params(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    p = {"trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS)}
    for d in "lr":
        p[f"x{d}"] = rng.normal(0, 0.3, (_CLASSES + 1, 4 * h))
        p[f"h{d}"] = rng.normal(0, 1 / h ** 0.5, (h, 4 * h))
        p[f"x{d}"][:, h:2 * h] += 1  # gates that keep
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(p, d: str, codes: np.ndarray, keep: bool):
    """States of one direction over (batch, width) codes already in its order."""
    n, width, h = *codes.shape, HIDDEN
    x = p[f"x{d}"][codes]
    state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    out, tape = np.empty((n, width, h), np.float32), []
    for t in range(width):
        gates = x[:, t] + state @ p[f"h{d}"]
        s = _sigmoid(gates[:, :3 * h])
        g = np.tanh(gates[:, 3 * h:])
        before = cell
        cell = s[:, h:2 * h] * before + s[:, :h] * g
        hot = np.tanh(cell)
        previous, state = state, s[:, 2 * h:] * hot
        out[:, t] = state
        if keep:
            tape.append((s, g, before, hot, previous))
    return out, tape


def emissions(p, codes: np.ndarray) -> np.ndarray:
    left, _ = _lstm(p, "l", codes, False)
    right, _ = _lstm(p, "r", codes[:, ::-1], False)
    return left @ p["out"][:HIDDEN] + right[:, ::-1] @ p["out"][HIDDEN:] + p["bias"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _forward_backward(p, scores: np.ndarray):
    """Log weights of all ways to and from each tag, and of all ways."""
    forward, back = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = p["first"] + scores[:, 0]
    for t in range(1, scores.shape[1]):
        forward[:, t] = _log_sum(forward[:, t - 1, :, None] + p["trans"], 1) + scores[:, t]
    for t in range(scores.shape[1] - 2, -1, -1):
        back[:, t] = _log_sum(p["trans"] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    return forward, back, _log_sum(forward[:, -1], 1)


def marginals(p, scores: np.ndarray) -> np.ndarray:
    """The probability of each tag at each place, transitions counted."""
    forward, back, total = _forward_backward(p, scores)
    return np.exp(forward + back - total[:, None, None])


def _crf_gradient(p, scores: np.ndarray, tags: np.ndarray):
    """Loss, and its gradients by emission, transition and first tag."""
    n, width, _ = scores.shape
    forward, back, total = _forward_backward(p, scores)
    trans = np.zeros_like(p["trans"])
    for t in range(width - 1):
        ahead = p["trans"] + (scores[:, t + 1] + back[:, t + 1])[:, None, :]
        trans += np.exp(forward[:, t, :, None] + ahead - total[:, None, None]).sum(0)
    emit = np.exp(forward + back - total[:, None, None])
    first = emit[:, 0].sum(0)
    rows = np.arange(n)
    gold = p["first"][tags[:, 0]] + scores[rows[:, None], np.arange(width), tags].sum(1) + p["trans"][tags[:, :-1], tags[:, 1:]].sum(1)
    emit[rows[:, None], np.arange(width), tags] -= 1
    np.add.at(first, tags[:, 0], -1)
    np.add.at(trans, (tags[:, :-1], tags[:, 1:]), -1)
    return float((total - gold).mean()), emit / n, trans / n, first / n


def _lstm_gradient(p, d: str, codes, tape, grad):
    h = HIDDEN
    gx, gh = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"])
    dstate = np.zeros((len(codes), h), np.float32)
    dcell = np.zeros((len(codes), h), np.float32)
    for t in range(codes.shape[1] - 1, -1, -1):
        s, g, before, hot, previous = tape[t]
        i, f, o = s[:, :h], s[:, h:2 * h], s[:, 2 * h:]
        dstate = dstate + grad[:, t]
        dcell = dcell + dstate * o * (1 - hot * hot)
        gates = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), dstate * hot * o * (1 - o), dcell * i * (1 - g * g)], 1)
        gh += previous.T @ gates
        np.add.at(gx, codes[:, t], gates)
        dstate, dcell = gates @ p[f"h{d}"].T, dcell * f
    return gx, gh


def fit(codes: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, seed: int = 42, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Parameters after `steps` batches of Adam; examples (windows, WIDTH) in a fixed shuffled order."""
    rng = np.random.default_rng(seed)
    p = _start_params(rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    order = rng.permutation(len(codes))
    for step in range(steps):
        at = order[np.arange(step * batch, (step + 1) * batch) % len(order)]
        x, y = codes[at], tags[at]
        left, tl = _lstm(p, "l", x, True)
        right, tr = _lstm(p, "r", x[:, ::-1], True)
        states = np.concatenate([left, right[:, ::-1]], 2)
        _, emit, trans, first = _crf_gradient(p, states @ p["out"] + p["bias"], y)
        emit = emit.astype(np.float32)
        g = {"out": np.einsum("nth,ntk->hk", states, emit), "bias": emit.sum((0, 1)), "trans": trans, "first": first}
        down = emit @ p["out"].T
        g["xl"], g["hl"] = _lstm_gradient(p, "l", x, tl, down[:, :, :HIDDEN])
        g["xr"], g["hr"] = _lstm_gradient(p, "r", x[:, ::-1], tr, down[:, ::-1, HIDDEN:])
        size = sum(float((a * a).sum()) for a in g.values()) ** 0.5
        for k in p:
            a = g[k] * min(1.0, 5 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v2[k] = 0.99 * v2[k] + 0.01 * a * a
            p[k] = (p[k] - rate * (1 - 0.8 * step / steps) * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v2[k] / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    return p


def viterbi(p, scores: np.ndarray) -> np.ndarray:
    """The best tags of each window; an inside follows a begin or inside of its kind alone."""
    n, width, k = scores.shape
    allowed = np.full((k, k), -1e9, np.float32)
    for a in range(k):
        for b in range(k):
            if b == 0 or b % 2 == 1 or a in (b, b - 1):
                allowed[a, b] = 0
    trans = p["trans"] + allowed
    best = p["first"] + scores[:, 0] + np.where((np.arange(k) > 0) & (np.arange(k) % 2 == 0), -1e9, 0)
    back = np.empty((n, width, k), np.int8)
    for t in range(1, width):
        ways = best[:, :, None] + trans
        back[:, t] = ways.argmax(1)
        best = ways.max(1) + scores[:, t]
    tags = np.empty((n, width), np.int64)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(width - 1, 0, -1):
        tags[:, t - 1] = back[rows, t, tags[:, t]]
    return tags


# ---- training windows ---------------------------------------------------------------------------

#: Documents that training windows are cut from, about (a sample by hash of the key), windows, and steps.
SAMPLE, TRAIN_WINDOWS, STEPS = 20_000, 6_000, 220


def _variants(text: str, span: Span, salt: int) -> Iterator[tuple[str, Span]]:
    """The text with the span as it is, and once more with it written another way."""
    a, b, kind = span
    yield text, span
    value = text[a:b]
    digits = _NO_DIGIT.sub("", value)
    other = None
    if kind == 3:
        d = digits[-10:]
        other = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"+{digits}", f"00{digits[:2]} {d[2:5]} {d[5:]}")[salt % 5]
    elif kind == 2:
        other = (" ", "-")[salt % 2].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    elif kind == 0:
        name, _, host = value.partition("@")
        other = (f"{name} @ {host}", f"{name}@{host.split('.', 1)[-1]}", f"{name.upper()}@{host}", f"{name}[@]{host}")[salt % 4]
    if other and other != value:
        yield text[:a] + other + text[b:], (a, a + len(other), kind)


def training_windows(text: str, salt: int) -> list[tuple[list[int], list[int]]]:
    """(classes, tags) around every base span, and of windows with digits but no span."""
    out = []
    spans = base_spans(text)
    for s in spans:
        for varied, (a, b, kind) in _variants(text, s, salt):
            shift = len(varied) - len(text)
            start = max(0, a - 8 - (salt * 7 + a) % 40)
            tags = np.zeros(len(varied) + 1, np.int64)
            for x, y, k in spans:
                x, y = (x + shift, y + shift) if x >= s[1] else (x, y)
                if (x, k) != (s[0], s[2]):
                    tags[x] = 1 + 2 * k
                    tags[x + 1:y] = 2 + 2 * k
            tags[a], tags[a + 1:b] = 1 + 2 * kind, 2 + 2 * kind
            out.append((classes(varied[start:start + WIDTH]).tolist(), tags[start:min(start + WIDTH, len(varied))].tolist()))
    codes = classes(text)
    free = [s for s in windows(codes) if not any(a < s + WIDTH and b > s for a, b, _ in spans)]
    for s in free[:4]:
        out.append((codes[s:s + WIDTH].tolist(), [0] * len(codes[s:s + WIDTH])))
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, steps: int = STEPS, seed: int = 42) -> dict[str, np.ndarray] | None:
    """Parameters fitted on windows of about `sample` documents, TRAIN_WINDOWS windows at most; None without any."""
    share = sample / max(1, docs.count())
    mark = F.xxhash64(F.lit(seed), F.col(key))
    rows = docs.select(F.col(text).alias("t"), mark.alias("h")).where("t is not null")
    if share < 1:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if "@" in t or _DIGIT.search(t):
                    found += [(h, i, x, y) for i, (x, y) in enumerate(training_windows(t, h % 997))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                 pa.array([f[2] for f in found], pa.list_(pa.int32())), pa.array([f[3] for f in found], pa.list_(pa.int32()))],
                names=["h", "i", "x", "y"])

    def fitted(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table.column("i")), np.asarray(table.column("h"))))
        x, y = table.column("x").to_pylist(), table.column("y").to_pylist()
        codes, tags = np.full((len(order), WIDTH), PAD, np.int64), np.zeros((len(order), WIDTH), np.int64)
        for row, i in enumerate(order):
            codes[row, :len(x[i])], tags[row, :len(y[i])] = x[i], y[i]
        p = fit(codes, tags, steps, seed=seed)
        return pa.table({"name": list(p), "shape": [list(v.shape) for v in p.values()], "data": [v.astype(np.float32).tobytes() for v in p.values()]})

    found = map_arrow(rows, cut, "h bigint, i int, x array<int>, y array<int>").orderBy("h", "i").limit(TRAIN_WINDOWS).withColumn("all", F.lit(0))
    parts = found.groupBy("all").applyInArrow(fitted, "name string, shape array<bigint>, data binary").collect()  # a few kilobytes
    return {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in parts} or None


_DIGIT = re.compile(r"[0-9]")

# ---- use ----------------------------------------------------------------------------------------

#: Least mean probability of a span's tags.
SURE = 0.75
#: Windows decoded at once.
BATCH = 512


def _holds(text: str, kind: int) -> bool:
    """What a span of the kind must have, however it is written."""
    digits = _NO_DIGIT.sub("", text)
    if kind == 0:
        name, _, host = text.partition("@")
        return bool(name.strip(" [(")) and "." in host and not re.search(r"\n", text)
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and _small(p) for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9\x20-]", text)
    return 10 <= len(digits) <= 15 and bool(re.search(r"[-+(). ]", text)) and not re.search(r"[^0-9()+. /\x20-]", text)


def _best(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Spans without overlap of the greatest total score."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, -1, False)]
    for i, s in enumerate(spans):
        j = int(np.searchsorted(ends[:i], s[0], "right"))
        take = best[j][0] + s[3] * (s[1] - s[0])
        best.append((take, j, True) if take > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans)
    while i > 0:
        _, j, taken = best[i]
        if taken:
            out.append(spans[i - 1])
        i = j
    return out[::-1]


#: A span, or a piece of one, that a window shows: start, end, kind, score, and whether the window's edge cuts it on the left and right.
Piece = tuple[int, int, int, float, bool, bool]


def _decoded(codes: list[np.ndarray], places: list[tuple[int, int]], p: dict[str, np.ndarray], sure: float) -> Iterator[tuple[int, int, Piece]]:
    """(text, window, piece) of what the windows (text, start) show."""
    for at in range(0, len(places), BATCH):
        some = places[at:at + BATCH]
        x = np.full((len(some), WIDTH), PAD, np.int64)
        for row, (i, s) in enumerate(some):
            part = codes[i][s:s + WIDTH]
            x[row, :len(part)] = part
        scores = emissions(p, x)
        tags = viterbi(p, scores)
        odds = np.take_along_axis(marginals(p, scores), tags[:, :, None], 2)[:, :, 0]
        for row, (i, s) in enumerate(some):
            size = min(WIDTH, len(codes[i]) - s)
            for b in np.flatnonzero(tags[row, :size] % 2 == 1).tolist():
                e = b + 1
                while e < size and tags[row, e] == tags[row, b] + 1:
                    e += 1
                if (score := float(odds[row, b:e].mean())) >= sure:
                    yield i, s, (s + b, s + e, (int(tags[row, b]) - 1) // 2, score, b == 0 and s > 0, e == size and s + size < len(codes[i]))


def stitched(pieces: list[Piece]) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, score) of the spans that pieces make up: whole ones, and chains of overlapping pieces of one kind
    whose ends no edge cuts, scored by the mean over their characters."""
    out = [x[:4] for x in pieces if not x[4] and not x[5]]
    chain: list[Piece] = []

    def close() -> None:
        start, end = chain[0][0], max(x[1] for x in chain)
        open_left = all(x[4] for x in chain if x[0] == start)
        open_right = all(x[5] for x in chain if x[1] == end)
        if len(chain) > 1 and not open_left and not open_right:
            out.append((start, end, chain[0][2], sum(x[3] * (x[1] - x[0]) for x in chain) / sum(x[1] - x[0] for x in chain)))

    for x in sorted(pieces, key=lambda x: (x[2], x[0], -x[1])):
        if chain and (x[2] != chain[0][2] or x[0] >= max(y[1] for y in chain)):
            close()
            chain = []
        chain.append(x)
    if chain:
        close()
    return out


def find_spans(texts: list[str], p: dict[str, np.ndarray] | None, sure: float = SURE) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text.

    A span that a window's edge cuts is put together from its pieces in neighbouring windows, which are decoded too
    where they are not already, so its place and length decide nothing.
    """
    base = [base_spans(t) for t in texts]
    if p is None:
        return [(b, b) for b in base]
    codes = [classes(t) for t in texts]
    places = [(i, s) for i, c in enumerate(codes) for s in windows(c)]
    known, pieces = set(places), {}
    while places:
        more = set()
        for i, s, piece in _decoded(codes, places, p, sure):
            pieces.setdefault(i, set()).add(piece)
            if piece[4]:
                more.add((i, s - STRIDE))
            if piece[5]:
                more.add((i, s + STRIDE))
        places = sorted(more - known)
        known |= more
    out = []
    for i, (text, own) in enumerate(zip(texts, base)):
        spans = [s for s in stitched(list(pieces.get(i, ()))) if not any(s[0] < b and s[1] > a for a, b, _ in own) and _holds(text[s[0]:s[1]], s[2])]
        out.append((own, sorted(own + [s[:3] for s in _best(spans)], key=lambda s: (s[0], s[2]))))
    return out


def _found(column: pa.Array, p) -> list[tuple[list[Span], list[Span]]]:
    """The spans of each row; rows without a digit or @ have none."""
    found = [np.zeros(0, np.int64)]
    for a, b in chunks(column):
        data, offsets = text_bytes(column[a:b])
        marks = np.concatenate([[0], np.cumsum(_TRIGGER[data])])
        found.append(a + np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]]))
    rows = np.concatenate(found)
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(column)
    for i, spans in zip(rows.tolist(), find_spans(column.take(pa.array(rows)).to_pylist(), p)):
        out[i] = spans
    return out


def personal_data(df: DataFrame, p: dict[str, np.ndarray] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row: counts and digest of the base
    spans, and all spans as text. Null and empty texts have none. Other columns are not looked at."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _found(batch.column(1), p)
            counts = [pa.array([sum(s[2] == k for s in own) for own, _ in spans], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(named(own).encode()).hexdigest() for own, _ in spans]), pa.array([named(s) for _, s in spans])],
                names=["k", *KINDS, "sha", "spans"])

    schema = f"k {kind}, email bigint, ip bigint, card bigint, phone bigint, sha string, spans string"
    return map_arrow(df.select(F.col(key).alias("k"), F.col(text).alias("t")), run, schema).toDF(
        key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


def masked(df: DataFrame, p: dict[str, np.ndarray] | None, text: str = "text") -> DataFrame:
    """`df` with every span of its text replaced by its kind in capitals and brackets; overlapping spans are
    replaced as one, by the kind of the first. Other columns and null texts stay as they are."""
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            found = _found(column, p)
            rows = [i for i, (_, spans) in enumerate(found) if spans]
            if rows:
                texts = column.to_pylist()
                for i in rows:
                    parts, done = [], 0
                    for a, b, k in found[i][1]:
                        if a >= done:
                            parts += [texts[i][done:a], f"[{KINDS[k].upper()}]"]
                        done = max(done, b)
                    texts[i] = "".join(parts) + texts[i][done:]
                column = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1:]], names=names)

    return map_arrow(df, run, df.schema)
