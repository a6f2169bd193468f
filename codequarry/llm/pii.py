"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

Rules find the base spans: e-mail addresses, IP addresses, card and phone numbers of strict form. A model adds what
has the look of one without the form (addresses broken by spaces, IPv6, card numbers with other separators or lengths,
phone numbers without a plus). It is trained in numpy, here, from labelled spans that `labelled` makes by a fixed
seed: SAMPLES texts, so training costs the same whatever the corpus. The network can't add up check digits, so what
it adds must also be `plausible`.

A text is read in windows of WINDOW characters, each half overlapping the next. Every window is decoded by Viterbi;
what the windows of one text say is then reconciled over the whole text: of spans that overlap, the one that lies
farthest from its window's edges stays. A span must hold a digit or an at sign, so a window without either can hold
none and isn't run through the network: the result is the same.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
SAMPLES, LENGTH, HIDDEN, EPOCHS, BATCH = 3072, 64, 16, 6, 48
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As all numbers of a run end where the run ends, a match starts at a run's first digit or nowhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile("[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        # a local part ends at its at sign, so no other start within it would fare better
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of strict form, by kind as listed, then start; code points, end exclusive. Linear in the text."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The symbol of each code point: punctuation marks are told apart, letters and digits by class."""
    out = np.full(0x110000, 5, np.int8)
    out[:0x3000] = [4 if chr(i).isalpha() else 5 for i in range(0x3000)]
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[ord(c)] = 8 + i
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[ord(" ")], out[[9, 10, 11, 12, 13]] = 6, 7
    return out


SYMBOLS = 40


def encode(texts: list[str], width: int) -> np.ndarray:
    """Symbols of each text, padded with 0."""
    out = np.zeros((len(texts), width), np.int8)
    sizes = np.array([len(t) for t in texts])
    flat = _classes()[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")]
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


# -- labelled spans


def _words(r: random.Random) -> str:
    letters = r.choice(["etaoinshrdlu", "etaoinshrdluéèçñüöß"])
    w = "".join(r.choice(letters) for _ in range(r.randint(1, 11)))
    w = r.choice([w, w, w, w, w.capitalize(), w.upper()])
    return w + r.choice(["", "", "", "", "", "", ".", ",", ".\n", "###", "$$$", "!!", " |", "&&&", "%%%", "***"])


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _entity(r: random.Random) -> tuple[str, str]:
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    kind = r.choice(KINDS)
    if kind == "email":
        at = r.choice(["@", "@", "@", " @ "])
        host = ".".join(word() + r.choice(["", _digits(r, 1)]) for _ in range(r.randint(1, 2)))
        return kind, r.choice([word(), f"{word()}.{_digits(r, 2)}", f"{word()}_{word()}", f"{word()}-{word()}"]) + at + host + r.choice([".com", ".org", ".net", ".de"])
    if kind == "ip":
        if r.random() < 0.2:
            return kind, ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8))
        return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        sep = r.choice(["", "", "", " ", "-", "."])
        groups = r.choice([(4, 4, 4, 4), (4, 6, 5)])
        body = _digits(r, sum(groups) - 1)
        body += next(d for d in "0123456789" if luhn(body + d))
        cuts = [sum(groups[:i]) for i in range(len(groups) + 1)]
        return kind, sep.join(body[a:b] for a, b in zip(cuts, cuts[1:]))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return kind, r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"{a}.{b}.{c}"])


def _other(r: random.Random) -> str:
    """What has digits or signs and is no personal data."""
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    return r.choice(
        [
            lambda: f'token = "{hexes(40)}"',
            lambda: hexes(r.choice([8, 32, 40, 64])),
            lambda: f'TOKEN = "{hexes(40).upper()}"',
            lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.",
            lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}",
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}",
            lambda: _digits(r, r.randint(1, 8)) + r.choice(["", ".", ",", "%"]),
            lambda: _digits(r, r.randint(21, 40)),
            lambda: f"${r.randint(1, 999)}.{r.randint(0, 99):02}",
            lambda: f"{r.randint(1, 999)},{_digits(r, 3)}",
            lambda: "@" + _words(r),
            lambda: f"{r.randint(1, 99)}/{r.randint(1, 99)}",
            lambda: f"({r.randint(1, 99)})",
            lambda: _words(r) + _digits(r, 2),
        ]
    )()


def labelled(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """n texts with their spans, the same for the same seed."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans, size = "", [], r.randint(20, LENGTH)
        kind = r.random()
        entity = _entity(r) if kind < 0.6 else None
        before = r.randint(0, 30)
        while len(text) < before:
            text += _words(r) + " "
        text = text[-before:] if before else ""
        if entity:
            if text and text[-1] not in " \n":
                text += " "
            spans.append((entity[0], len(text), len(text) + len(entity[1])))
            text += entity[1] + r.choice(["", "", "", ".", ",", "###", "!!", "$$$"]) + r.choice([" ", " ", "\n"])
            if r.random() < 0.3:
                kind2, more = _entity(r)
                spans.append((kind2, len(text), len(text) + len(more)))
                text += more + " "
        elif kind < 0.9:
            text += " " + _other(r) + " "
        while len(text) < size:
            text += _words(r) + " "
        text = text[: max(size, spans[-1][2] if spans else 0)]
        out.append((text, spans))
    return out


# -- the network


def _tags(samples: list[tuple[str, list[Span]]], width: int) -> np.ndarray:
    out = np.zeros((len(samples), width), np.int64)
    for row, (_, spans) in zip(out, samples):
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            row[a:b] = k + 1
            row[a : a + 1] = k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forbidden() -> np.ndarray:
    """Penalties that keep an inside tag after its own kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[[t for t in range(TAGS) if t not in (inside - 1, inside)], inside] = -1e4
    return out


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
    """Hidden states (time, direction, row, HIDDEN) of both directions, the second over the reversed text."""
    n, steps = x.shape
    both = np.stack([x, x[:, ::-1]])
    h = np.zeros((2, n, HIDDEN), np.float32)
    c = np.zeros_like(h)
    states, trace = np.empty((steps, 2, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = np.stack([wx[0][both[0, :, t]], wx[1][both[1, :, t]]]) + np.matmul(h, wh)
        gates = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        g = np.tanh(z[..., 3 * HIDDEN :])
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[t] = h
        if keep:
            trace.append((i, f, o, g, before, tc, last))
    return states, trace, both


def _features(states: np.ndarray) -> np.ndarray:
    """(row, time, 2 * HIDDEN) in the order of the text."""
    return np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray, mask: np.ndarray):
    """Mean negative log-likelihood, and its gradients by emissions and transitions."""
    n, steps, k = e.shape
    full = trans + mask
    start = full[0]  # a text begins as if after an outside tag
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0] + start
    for t in range(1, steps):
        alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + full, 1)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = _lse(full + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    de = np.exp(alpha + beta - z[:, None, None])
    pair = np.exp(alpha[:, :-1, :, None] + full + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    dt = pair.sum(axis=(0, 1))
    dt[0] += de[:, 0].sum(axis=0)
    rows, at = np.arange(n)[:, None], np.arange(steps)[None, :]
    gold = e[rows, at, y].sum(axis=1) + start[y[:, 0]] + full[y[:, :-1], y[:, 1:]].sum(axis=1)
    de[rows, at, y] -= 1
    np.subtract.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    np.subtract.at(dt[0], y[:, 0], 1)
    return float((z - gold).mean()), de / n, dt / n


class Tagger:
    """wx, wh: input and recurrent weights of both directions; wo, bo: emissions; trans: CRF transitions."""

    def __init__(self, seed: int):
        g = np.random.default_rng(seed)
        self.wx = g.normal(0, 0.3, (2, SYMBOLS, 4 * HIDDEN)).astype(np.float32)
        self.wx[..., HIDDEN : 2 * HIDDEN] += 1
        self.wh = g.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.wo = g.normal(0, 0.2, (2 * HIDDEN, TAGS)).astype(np.float32)
        self.bo = np.zeros(TAGS, np.float32)
        self.trans = np.zeros((TAGS, TAGS), np.float32)
        self.mask = _forbidden()

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.wo, self.bo, self.trans]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        states, trace, both = _lstm(x, self.wx, self.wh, True)
        feats = _features(states)
        loss, de, dt = _crf_gradient(feats @ self.wo + self.bo, y, self.trans, self.mask)
        dwo = np.einsum("ntf,ntk->fk", feats, de)
        df = (de @ self.wo.T).transpose(1, 0, 2)
        dh_out = np.stack([df[..., :HIDDEN], df[::-1, :, HIDDEN:]], axis=1)
        dwx, dwh = np.zeros_like(self.wx), np.zeros_like(self.wh)
        dh, dc = np.zeros_like(states[0]), np.zeros_like(states[0])
        back = self.wh.transpose(0, 2, 1)
        for t in range(len(trace) - 1, -1, -1):
            i, f, o, g, before, tc, last = trace[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=-1)
            dc = dc * f
            dh = np.matmul(dz, back)
            dwh += np.matmul(last.transpose(0, 2, 1), dz)
            for d in (0, 1):
                np.add.at(dwx[d], both[d, :, t], dz[d])
        return loss, [dwx, dwh, dwo.astype(np.float32), de.sum(axis=(0, 1)), dt.astype(np.float32)]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each row, by Viterbi."""
        e = _features(_lstm(x, self.wx, self.wh, False)[0]) @ self.wo + self.bo
        full = self.trans + self.mask
        n, steps, _ = e.shape
        score, back = e[:, 0] + full[0], np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            ways = score[:, :, None] + full
            back[t] = ways.argmax(axis=1)
            score = e[:, t] + ways.max(axis=1)
        out = np.empty((n, steps), np.int8)
        out[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out


@functools.lru_cache(maxsize=2)
def trained(seed: int = 7) -> Tagger:
    """Fitted by Adam to SAMPLES labelled texts, EPOCHS times; the same for the same seed."""
    samples = labelled(SAMPLES, seed)
    width = max(len(t) for t, _ in samples)
    x, y = encode([t for t, _ in samples], width), _tags(samples, width)
    net, g = Tagger(seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    step, last = 0, EPOCHS * -(-SAMPLES // BATCH)
    for _ in range(EPOCHS):
        order = g.permutation(SAMPLES)
        for at in range(0, SAMPLES, BATCH):
            rows = order[at : at + BATCH]
            _, grads = net.gradient(x[rows], y[rows])
            step += 1
            rate = 0.02 * (1 - 0.95 * step / last)
            norm = max(1.0, float(np.sqrt(sum(float((d * d).sum()) for d in grads))) / 5)
            for p, d, a, b in zip(net.params(), grads, m, v):
                d = d / norm
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


# -- windows


def _starts(text: str) -> Iterator[int]:
    """Starts of the windows that hold a digit or an at sign."""
    n, last = len(text), -1
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        for w in (k - 1, k):
            # a window that begins less than a stride before the end says nothing that the one before doesn't see
            if w > last and w >= 0 and (w == 0 or (w + 1) * STRIDE < n):
                yield w * STRIDE
                last = w


def _runs(tags: np.ndarray) -> Iterator[Span]:
    at, n = 0, len(tags)
    for start in np.flatnonzero(tags % 2 == 1).tolist():
        if start < at:
            continue
        inside, at = tags[start] + 1, start + 1
        while at < n and tags[at] == inside:
            at += 1
        yield KINDS[(int(tags[start]) - 1) // 2], start, at


def plausible(kind: str, found: str) -> bool:
    """What a span of the model has to be: digits that pass Luhn for a card, numbers in range for an address."""
    if kind == "email":
        return "@" in found
    digits = [c for c in found if "0" <= c <= "9"]
    if kind == "ip":
        parts = found.split(".")
        return found.count(":") >= 2 or (len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts))
    if any(c.isalpha() for c in found):
        return False
    return 7 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn("".join(digits))


def reconcile(found: list[tuple[int, str, int, int]], base: list[Span], text: str) -> list[Span]:
    """Spans of the model that stay. found: (margin to the window's edges, kind, start, end) of one whole text.

    Base spans win, then wider margins, then earlier starts; no two spans that stay overlap, and each is plausible
    and holds a digit or an at sign."""
    taken = sorted((a, b) for _, a, b in base)
    reach = []  # of base spans, which may overlap one another: the farthest end so far
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else b))
    own: list[tuple[int, int, str]] = []
    for _, kind, a, b in sorted(found, key=lambda x: (-x[0], x[2], x[3], x[1])):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if not (_TRIGGER.search(text, a, b) and plausible(kind, text[a:b])):
            continue
        i = bisect.bisect_left(taken, (b, -1))
        if i and reach[i - 1] > a:
            continue
        j = bisect.bisect_left(own, (b, -1, ""))
        if j and own[j - 1][1] > a:
            continue
        bisect.insort(own, (a, b, kind))
    return [(kind, a, b) for a, b, kind in own]


def find_all(texts: list[str], net: Tagger, base: list[list[Span]], most: int = 512) -> list[list[Span]]:
    """What the model adds to the base spans of each text. At most `most` windows are held at a time."""
    found: list[list[tuple[int, str, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int]] = []

    def flush() -> None:
        parts = [texts[i][at : at + WINDOW] for i, at in held]
        for (i, at), tags, part in zip(held, net.decode(encode(parts, WINDOW)), parts):
            if not tags.any():
                continue
            left, right = at == 0, at + WINDOW >= len(texts[i])
            for kind, a, b in _runs(tags[: len(part)]):
                margin = min(WINDOW if left else a, WINDOW if right else len(part) - b)
                found[i].append((margin, kind, at + a, at + b))
        held.clear()

    for i, text in enumerate(texts):
        for at in _starts(text):
            held.append((i, at))
            if len(held) == most:
                flush()
    if held:
        flush()
    return [reconcile(f, b, t) if f else [] for f, b, t in zip(found, base, texts)]


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Adds base and spans (arrays of kind, start, end) to a table with a `text` column.

    base: spans of strict form; spans: those and what the model adds, both by kind as listed, then start. Positions
    are code points, ends are exclusive. Null text counts as empty and has none. Whole texts are read, however long,
    in windows; no row depends on another, so nothing is shuffled and equal rows get equal results. Columns of the
    input stay, but for base and spans, which are replaced; an empty table gives an empty one.
    """
    kept = docs.drop("base", "spans")
    names = [*kept.columns, "base", "spans"]
    schema = T.StructType([*kept.schema.fields, T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])
    net = trained(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                added = find_all(texts, net, base)
                rows = lambda spans: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], _ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns, rows(base), rows([_ordered(b + a) for b, a in zip(base, added)])], names)

    return kept.mapInArrow(run, schema)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans becomes its first span's kind in angle brackets."""
    out, at, done = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= done:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = done = max(done, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Replaces personal data in `text` by its kind (`<EMAIL>`); all columns stay, null text stays null."""
    net, names, schema = trained(seed), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                given = part.column("text").to_pylist()
                texts = [t or "" for t in given]
                base = [base_spans(t) for t in texts]
                new = [None if g is None else redact_text(t, b + a) for g, t, b, a in zip(given, texts, base, find_all(texts, net, base))]
                yield pa.RecordBatch.from_arrays([pa.array(new, part.schema.field("text").type) if c == "text" else part.column(c) for c in names], names)

    return docs.mapInArrow(run, schema)
