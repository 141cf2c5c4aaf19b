"""Personal data by rules and by a character tagger: a bidirectional LSTM with CRF transitions.

The rules find e-mail addresses, IP addresses, card and telephone numbers. The tagger is
trained in numpy from labelled spans: windows of the texts where no rule's match was rejected, and
windows put together from such spans side by side, which the greedy rules cannot part. It
is run over overlapping windows around every digit and @ sign; text without these
cannot hold a span of the four kinds. Spans decoded in all windows of a text are reconciled
together: first those not cut by a window's edge, then longer ones, none overlapping another.
They are added where no rule's span is, if they meet the form of their kind.

Null and empty texts have no spans. Equal texts have equal spans. A text is searched whole, in
linear time. The tagger is fitted on at most ``FIT_WINDOWS`` windows, the first in hash
order; without any spans to learn from only the rules apply. An empty table gives no rows.
Columns named like an added one are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.common import map_added, slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
FIT_WINDOWS = 3_000
LENGTH, STEP, MARGIN = 160, 112, 48
HIDDEN, STEPS, BATCH, RATE = 20, 260, 48, 0.02
SEED = 11

# The forms of the four kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, kind, end


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, one look per @ sign and the run of characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def fits(kind: int, text: str) -> bool:
    """The check on a match of the kind's form."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in text.split("."))
    digits = digits_of(text) if kind else ""
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 10 <= len(digits) <= 15


def candidates(text: str) -> list[Span]:
    """All leftmost matches of the four forms, checked or not."""
    out = [(s, 0, e) for s, e in emails(text)]
    if HINT.search(text):
        out += [(m.start(), k, m.end()) for k, form in ((1, IP), (2, CARD), (3, PHONE)) for m in form.finditer(text)]
    return sorted(out)


def rule_spans(text: str) -> list[Span]:
    return [(s, k, e) for s, k, e in candidates(text) if fits(k, text[s:e])]


def _classes() -> np.ndarray:
    """Character classes below 128: 1 other, then digits, lower, capital, space, and signs of their own."""
    table = np.ones(128, np.int64)
    table[48:58], table[97:123], table[65:91], table[[9, 10, 13, 32]] = 2, 3, 4, 5
    for i, c in enumerate("@.+-()_%,:;=/\"'"):
        table[ord(c)] = 6 + i
    return table


CLASSES = _classes()
N_CLASSES = 22
N_TAGS = 1 + 2 * len(KINDS)


def _forbidden() -> tuple[np.ndarray, np.ndarray]:
    """A large negative weight where a span would go on that has not begun: between tags, and at the start."""
    between, begin = np.zeros((N_TAGS, N_TAGS), np.float32), np.zeros(N_TAGS, np.float32)
    for tag in range(2, N_TAGS, 2):
        between[:, tag] = begin[tag] = -1e4
        between[[tag - 1, tag], tag] = 0
    return between, begin


FORBIDDEN, NO_START = _forbidden()


def encode(texts: list[str], length: int = LENGTH) -> np.ndarray:
    out = np.zeros((len(texts), length), np.int64)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t[:length].encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, : len(codes)] = np.where(codes < 128, CLASSES[np.minimum(codes, 127)], 1)
    return out


def tags_of(spans: list[Span], length: int = LENGTH) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Weights by name; both directions of the LSTM are stacked in the first axis."""

    w: dict[str, np.ndarray]

    @staticmethod
    def new(rng: np.random.Generator) -> Tagger:
        h = HIDDEN
        bias = np.zeros((2, 1, 4 * h))
        bias[:, :, h : 2 * h] = 1
        return Tagger(
            {
                "x": rng.normal(0, 0.3, (2, N_CLASSES, 4 * h)), "h": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)), "b": bias,
                "out": rng.normal(0, 0.3, (2 * h, N_TAGS)), "c": np.zeros(N_TAGS),
                "trans": np.zeros((N_TAGS, N_TAGS)), "begin": np.zeros(N_TAGS),
            }
        )

    def lstm(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (batch, time, 2 * hidden) of class numbers (batch, time)."""
        w, h = self.w, HIDDEN
        both = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, len(x), h)), np.zeros((2, len(x), h))
        out = np.empty((2, x.shape[1], len(x), h))
        inner = w["x"] + w["b"]
        for t in range(x.shape[1]):
            z = np.stack([inner[0][both[0, :, t]], inner[1][both[1, :, t]]]) + state @ w["h"]
            gates = _sigmoid(z[:, :, : 3 * h])
            fresh = np.tanh(z[:, :, 3 * h :])
            before, old = cell, state
            cell = gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * fresh
            squashed = np.tanh(cell)
            state = gates[:, :, 2 * h :] * squashed
            out[:, t] = state
            if keep is not None:
                keep.append((both[:, :, t], gates, fresh, before, old, squashed))
        return np.concatenate([out[0], out[1, ::-1]], axis=2).transpose(1, 0, 2)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.lstm(x) @ self.w["out"] + self.w["c"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequences by Viterbi."""
        e, trans = self.emissions(x), self.w["trans"] + FORBIDDEN
        score, back = self.w["begin"] + NO_START + e[:, 0], np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            paths = score[:, :, None] + trans
            back[:, t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + e[:, t]
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(x))
        for t in range(e.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log likelihood of the tag sequences."""
        w, h, keep = self.w, HIDDEN, []
        states = self.lstm(x, keep)
        e, trans = states @ w["out"] + w["c"], w["trans"] + FORBIDDEN
        n, length = x.shape
        total = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        ahead = [w["begin"] + NO_START + e[:, 0]]
        for t in range(1, length):
            ahead.append(total(ahead[-1][:, :, None] + trans, 1) + e[:, t])
        after = [np.zeros((n, N_TAGS))]
        for t in range(length - 1, 0, -1):
            after.append(total(trans + (e[:, t] + after[-1])[:, None, :], 2))
        after.reverse()
        ahead, after = np.stack(ahead, 1), np.stack(after, 1)
        whole = total(ahead[:, -1], 1)
        share = np.exp(ahead + after - whole[:, None, None])
        rows, time = np.arange(n)[:, None], np.arange(length)[None, :]
        de = share.copy()
        de[rows, time, y] -= 1
        steps = np.exp(ahead[:, :-1, :, None] + trans + (e + after)[:, 1:, None, :] - whole[:, None, None, None]).sum(axis=(0, 1))
        np.add.at(steps, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        de /= n
        grad = {
            "trans": steps / n, "begin": de[:, 0].sum(axis=0), "c": de.sum(axis=(0, 1)),
            "out": np.tensordot(states, de, ((0, 1), (0, 1))),
            "x": np.zeros_like(w["x"]), "h": np.zeros_like(w["h"]), "b": np.zeros_like(w["b"]),
        }
        ds = (de @ w["out"].T).transpose(1, 0, 2)
        ds = np.stack([ds[:, :, :h], ds[::-1, :, h:]])
        dh, dc = np.zeros((2, n, h)), np.zeros((2, n, h))
        back = w["h"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            classes, gates, fresh, before, old, squashed = keep[t]
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            dh = dh + ds[:, t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * fresh * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - fresh**2)], axis=2)
            for d in range(2):
                np.add.at(grad["x"][d], classes[d], dz[d])
            grad["h"] += old.transpose(0, 2, 1) @ dz
            grad["b"] += dz.sum(axis=1, keepdims=True)
            dh, dc = dz @ back, dc * f
        return grad


def train(windows: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = SEED) -> Tagger | None:
    """A tagger from labelled windows and from windows composed of their spans; None without spans."""
    rng = np.random.default_rng(seed)
    spans = [(kind, text[s:e]) for text, found in windows for s, kind, e in found if e - s <= 60]
    plain = [w[0] for w in windows if not w[1]] or [re.sub(r"[0-9@+]", "", w[0]) for w in windows]
    if not spans:
        return None
    by_kind = [[t for k, t in spans if k == kind] for kind in range(len(KINDS))]
    by_kind = [(k, own) for k, own in enumerate(by_kind) if own]

    def compose() -> tuple[str, list[Span]]:
        pick = lambda items: items[int(rng.integers(len(items)))]
        text, found = plain[int(rng.integers(len(plain)))][: int(rng.integers(5, 50))], []
        for _ in range(int(rng.integers(1, 4))):
            kind, own = pick(by_kind)
            span = pick(own)
            text += pick([" ", " ", " ", ", ", "; ", " / "])
            found.append((len(text), kind, len(text) + len(span)))
            text += span
        return text + pick([" ", ".", ", ", "\n"]) + pick(plain)[:40], found

    tagger = Tagger.new(rng)
    m, v = ({k: np.zeros_like(x) for k, x in tagger.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        batch = [windows[int(rng.integers(len(windows)))] if rng.random() < 0.4 else compose() for _ in range(BATCH)]
        length = 112
        x = encode([t for t, _ in batch], length)
        y = np.stack([tags_of([s for s in found if s[2] <= length], length) for _, found in batch])
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        for name, g in tagger.gradients(x, y).items():
            g = np.clip(g, -5, 5)
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.99 * v[name] + 0.01 * g * g
            tagger.w[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
    tagger.w = {k: x.astype(np.float32) for k, x in tagger.w.items()}
    return tagger


def windows_of(text: str) -> list[tuple[int, str]]:
    """(offset, text) of overlapping windows that cover all digits and @ signs with a margin."""
    out, end = [], 0
    spans: list[list[int]] = []
    for hint in HINT.finditer(text):
        low, high = max(0, hint.start() - MARGIN), min(len(text), hint.end() + MARGIN)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for low, high in spans:
        at = low
        while True:
            end = min(at + LENGTH, high)
            out.append((at, text[at:end]))
            if end == high:
                break
            at += STEP
    return out


def spans_of_tags(tags: np.ndarray) -> list[Span]:
    out, start, kind = [], -1, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        inside = tag and tag % 2 == 0 and kind == (tag - 2) // 2
        if start >= 0 and not inside:
            out.append((start, kind, i))
            start, kind = -1, -1
        if tag % 2 == 1:
            start, kind = i, (tag - 1) // 2
    return out


def reconcile(found: list[tuple[bool, Span]], rules: list[Span], text: str) -> list[Span]:
    """Tagger spans that no rule's span overlaps, whole ones first, then longer ones, without overlaps."""
    taken, out = [(s, e) for s, _, e in rules], []
    forms = (EMAIL, IP, CARD, PHONE)
    for _, (s, k, e) in sorted(set(found), key=lambda f: (f[0], f[1][0] - f[1][2], f[1])):
        if any(s < b and a < e for a, b in taken):
            continue
        part = text[s:e]
        whole = forms[k].fullmatch(part)
        if whole and fits(k, part):
            out.append((s, k, e))
            taken.append((s, e))
    return out


def find(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(rules' spans, added spans) of every text."""
    rules = [rule_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if tagger is not None:
        cut = [(i, at, part) for i, t in enumerate(texts) for at, part in windows_of(t)]
        found: dict[int, list[tuple[bool, Span]]] = {}
        for first in range(0, len(cut), 512):
            block = cut[first : first + 512]
            for (i, at, part), tags in zip(block, tagger.decode(encode([p for _, _, p in block]))):
                for s, k, e in spans_of_tags(tags[: len(part)]):
                    edge = s == 0 and at > 0 or e == len(part) and at + e < len(texts[i])
                    found.setdefault(i, []).append((edge, (at + s, k, at + e)))
        for i, spans in found.items():
            added[i] = reconcile(spans, rules[i], texts[i])
    return list(zip(rules, added))


def _hinted(column: pa.Array) -> np.ndarray:
    """True for the texts with a digit or @ sign."""
    raw, borders = text_bytes(column)
    hint = np.r_[0, np.cumsum((raw >= 48) & (raw <= 57) | (raw == 64))]
    return hint[borders[1:]] > hint[borders[:-1]]


SAMPLE = T.StructType([T.StructField("window", T.StringType()), T.StructField("spans", T.StringType())])


def learn(docs: DataFrame, text: str = "text", rows: int = FIT_WINDOWS) -> Tagger | None:
    """Trains on at most ``rows`` windows without rejected matches, the first in hash order."""

    def run(batches):
        for batch in slices(batches, text):
            out = []
            for t in batch.column(text).filter(pa.array(_hinted(batch.column(text)))).to_pylist():
                for _, part in windows_of(t):
                    every = candidates(part)
                    kept = [(s, k, e) for s, k, e in every if fits(k, part[s:e])]
                    lost = any(len(digits_of(part[s:e])) > 7 for s, k, e in set(every) - set(kept) if not any(a <= s and e <= b for a, _, b in kept))
                    inner = [x for x in kept if not any(y != x and y[0] <= x[0] and x[2] <= y[2] for y in kept)]
                    if not lost and all(a[2] <= b[0] for a, b in zip(inner, inner[1:])):
                        out.append((part, written(inner)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["window", "spans"])

    sample = docs.select(text).mapInArrow(run, SAMPLE).distinct().orderBy(F.xxhash64("window"), "window").limit(rows).collect()
    return train([(r["window"], read(r["spans"])) for r in sample]) if sample else None


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def read(spans: str) -> list[Span]:
    parts = [p.split(":") for p in spans.split(",") if p]
    return [(int(s), KINDS.index(k), int(e)) for k, s, e in parts]


def masked(text: str, spans: list[Span]) -> str:
    """The text with a mark for each span; of overlapping spans the first gives the mark for all."""
    out, at, open_ = [], 0, 0
    for s, k, e in sorted(spans):
        if s >= open_:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = open_ = max(open_, e)
    return "".join(out) + text[at:]


FOUND = T.StructType([T.StructField(n, T.StringType()) for n in ("rule_spans", "spans", "masked")])


def detect(df: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """Adds the rules' spans, all spans, and the text with the spans masked."""

    def work(batch):
        column = batch.column(text)
        which = np.flatnonzero(_hinted(column))
        n = len(column)
        rules, every = np.full(n, "", object), np.full(n, "", object)
        out = column.fill_null("").to_pylist() if len(which) else None
        if len(which):
            texts = [out[i] for i in which]
            for i, (own, more) in zip(which.tolist(), find(texts, tagger)):
                rules[i], every[i] = written(own), written(own + more)
                if own or more:
                    out[i] = masked(out[i], own + more)
        return [pa.array(rules, pa.string()), pa.array(every, pa.string()), pa.array(out, pa.string()) if out is not None else column.fill_null("")]

    return map_added(df, text, FOUND, work)
