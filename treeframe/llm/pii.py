"""PII: fixed patterns, and a linear-chain conditional random field that adds spans.

The four patterns (email, ip, card, phone) give the base spans. The field labels tokens (runs
of letters, runs of digits, any other character but white space) from word-shape features of
the token and its two neighbours on each side. It is trained by maximum likelihood, forward
and backward in numpy batches, on a small labelled table (text, spans), and decoded by
Viterbi in numpy batches. A span it labels is added if the kind's digits are valid and it
does not overlap a base span; base spans always stay.

A token with no digit, ``@`` or ``+`` within NEAR tokens may only be outside; this is a
constraint of the field, like the transitions that are not allowed. So the stretches near such
characters can be decoded apart from each other and the rest left out, with the same result.

Every text is settled by itself in one pass, without a shuffle. Defined results: null is an
empty text without spans; texts of any length are searched whole; null ids are carried along;
repeated rows get equal rows; an empty table gives an empty result; only the named columns are
read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, string_buffers

KINDS = ("email", "ip", "card", "phone")
NEAR = 5
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

# The base patterns. Quantifiers that cannot give back are possessive, and a run
# of digits is entered at its start only; both leave the matches as they are.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out: list[tuple[int, int, int]] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


# ---- tokens and shapes

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_PUNCTUATION = "@.+-()_%:/,;'\"[]{}<>=#*!?|&$\\~^`"
SHAPES = 40 + len(_PUNCTUATION) + 2
_TRIGGER_FROM = 20  # shapes 20..39: digits


def _shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        return _TRIGGER_FROM + min(len(token), 19)
    if c.isalpha():
        return min(len(token), 5) + (6 if token[0].isupper() and not token[1:2].isupper() else 12 if token.isupper() else 0)
    k = _PUNCTUATION.find(c)
    return 40 + k if k >= 0 else 40 + len(_PUNCTUATION)


_EDGE = 40 + len(_PUNCTUATION) + 1  # before the first and after the last token
_TRIGGERS = np.zeros(SHAPES, bool)
_TRIGGERS[_TRIGGER_FROM : _TRIGGER_FROM + 20] = True
_TRIGGERS[[40 + _PUNCTUATION.index("@"), 40 + _PUNCTUATION.index("+")]] = True


def tokenized(text: str) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Places of tokens, their shapes, and whether white space stands before each."""
    places, shapes, cache = [], [], {}
    for m in _TOKEN.finditer(text):
        t = m[0]
        s = cache.get(t)
        if s is None:
            s = cache[t] = _shape(t)
        places.append(m.span())
        shapes.append(s)
    ends = np.array([0] + [p[1] for p in places[:-1]], np.int64)
    starts = np.array([p[0] for p in places], np.int64)
    return places, np.array(shapes, np.int64), (starts > ends[: len(starts)]).astype(np.int64)


# ---- the field


@dataclass
class Field:
    """Scores of labels by the shapes at five offsets, with and without white space before, and of transitions."""

    shape: np.ndarray  # [5, SHAPES, LABELS]
    space: np.ndarray  # [3, 2, LABELS]: before the token, before the next, before the last one
    transition: np.ndarray  # [LABELS, LABELS]

    def unary(self, shapes: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Scores [tokens, LABELS] of one text's tokens."""
        n = len(shapes)
        padded = np.concatenate([[_EDGE] * 2, shapes, [_EDGE] * 2])
        gaps = np.concatenate([[1], space, [1]])
        out = sum(self.shape[k][padded[k : k + n]] for k in range(5))
        out = out + self.space[0][gaps[1 : n + 1]] + self.space[1][gaps[2 : n + 2]] + self.space[2][gaps[:n]]
        return out


def near_trigger(shapes: np.ndarray) -> np.ndarray:
    """Which tokens have a trigger within NEAR of them."""
    return np.convolve(np.pad(_TRIGGERS[shapes].astype(int), NEAR), np.ones(2 * NEAR + 1, int), "valid") > 0


def allowed() -> np.ndarray:
    """Which label may follow which: inside only after begin or inside of its kind."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def viterbi(scores: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """Best labels of each sequence, outside labels standing before and after; by batches of like length."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    for a in range(0, len(order), 512):
        part = order[a : a + 512]
        sizes = np.array([len(scores[i]) for i in part])
        n = int(sizes.max(initial=0))
        if not n:
            continue
        u = np.zeros((len(part), n, LABELS))
        for j, i in enumerate(part):
            u[j, : sizes[j]] = scores[i]
        best = u[:, 0] + transition[0]
        back = np.zeros((len(part), n, LABELS), np.int8)
        for t in range(1, n):
            on = sizes > t
            way = best[on][:, :, None] + transition[None]
            back[on, t] = way.argmax(1)
            best[on] = way.max(1) + u[on, t]
        label = (best + transition[:, 0]).argmax(1)
        rows = np.arange(len(part))
        path = np.zeros((len(part), n), np.int64)
        for t in range(n - 1, -1, -1):
            on = sizes > t
            path[on, t] = label[on]
            label = np.where(on, back[rows, t, label], label)
        for j, i in enumerate(part):
            out[i] = path[j, : sizes[j]]
    return out


def labelled_table(rows: int = 400, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: sentences of made-up words with and without personal data."""
    rng = random.Random(seed)
    syllables = "an the er on tion ble re ing ouß é qu ción ment ha th ea in or keit".split()

    def word():
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        return rng.choice([w, w, w, w.capitalize(), w.upper()])

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", "", " ", "-", "."])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4)) if sep else d

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"00{digits(2)} {a} {b}{c}", f"{a}-{b}-{c}", f"+1.{a}.{b}.{c}"])

    def ip():
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def email():
        w = word().lower()
        return rng.choice([f"{w}.{digits(2)}@mail{digits(1)}.example.com", f"{w}@{word().lower()}.org", f"{w}_{word().lower()}@{word().lower()}-{word().lower()}.net"])

    made = dict(zip(KINDS, (email, ip, card, phone), strict=True))
    plain = [
        lambda: digits(rng.randint(1, 6)), lambda: f"{digits(1)}.{digits(1)}.", lambda: f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()} + {word()}", lambda: f"@{word()}", lambda: f"{digits(3)} {word()}", lambda: f"({digits(4)})",
    ]
    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(2, 7)):
            r = rng.random()
            if r < 0.12:
                kind = rng.choice(KINDS)
                piece = made[kind]()
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = rng.choice(plain)() if r < 0.22 else word()
            text += piece + rng.choice([" ", " ", " ", " ", ", ", ". ", "!! ", ".*** ", " | ", "\n"])
        table.append((text.strip(), spans))
    return table


def train(table: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 80, rate: float = 0.2, l2: float = 1e-4) -> Field:
    """Maximum likelihood by Adam; expectations by forward and backward passes over padded batches."""
    seqs = []
    for text, spans in table:
        places, shapes, space = tokenized(text)
        gold = np.zeros(len(shapes), np.int64)
        for kind, a, b in spans:
            on = [i for i, (s, e) in enumerate(places) if s < b and e > a]
            for i in on:
                gold[i] = 2 + 2 * KINDS.index(kind)
            gold[on[0]] = 1 + 2 * KINDS.index(kind)
        if len(shapes):
            seqs.append((shapes, space, gold))
    n, size = len(seqs), np.array([len(s[0]) for s in seqs])
    most = int(size.max())
    shape_at = np.full((5, n, most), _EDGE)
    gap_at = np.zeros((3, n, most), np.int64)
    gold, mask, far = np.zeros((n, most), np.int64), np.arange(most)[None, :] < size[:, None], np.zeros((n, most), bool)
    for i, (shapes, space, g) in enumerate(seqs):
        m = len(g)
        padded = np.concatenate([[_EDGE] * 2, shapes, [_EDGE] * 2])
        gaps = np.concatenate([[1], space, [1]])
        for k in range(5):
            shape_at[k, i, :m] = padded[k : k + m]
        gap_at[0, i, :m], gap_at[1, i, :m], gap_at[2, i, :m] = gaps[1 : m + 1], gaps[2 : m + 2], gaps[:m]
        gold[i, :m] = g
        far[i, :m] = ~near_trigger(shapes) & (g == 0)
    ok = allowed()
    one = np.zeros((n, most, LABELS))
    one[np.arange(n)[:, None], np.arange(most)[None, :], gold] = mask
    params = [np.zeros((5, SHAPES, LABELS)), np.zeros((3, 2, LABELS)), np.zeros((LABELS, LABELS))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    path = np.concatenate([np.zeros((n, 1), int), gold], 1)  # outside before the first
    steps_taken = np.zeros((LABELS, LABELS))
    np.add.at(steps_taken, (path[:, :-1][mask], path[:, 1:][mask]), 1)
    np.add.at(steps_taken, (gold[np.arange(n), size - 1], 0), 1)

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, steps + 1):
        shape, space, trans = params
        u = sum(shape[k][shape_at[k]] for k in range(5)) + sum(space[k][gap_at[k]] for k in range(3))
        u[far, 1:] = -1e4
        t = np.where(ok, trans, -1e4)
        forward, backward = np.zeros((most, n, LABELS)), np.zeros((most, n, LABELS))
        forward[0] = u[:, 0] + t[0]
        for k in range(1, most):
            new = lse(forward[k - 1][:, :, None] + t[None], 1) + u[:, k]
            forward[k] = np.where(mask[:, k][:, None], new, forward[k - 1])
        z = lse(forward[-1] + t[:, 0][None], 1)
        backward[-1] = t[:, 0]
        for k in range(most - 2, -1, -1):
            new = lse(t[None] + (u[:, k + 1] + backward[k + 1])[:, None, :], 2)
            backward[k] = np.where(mask[:, k + 1][:, None], new, backward[k + 1])
        p = np.exp(forward + backward - z[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
        pair = np.zeros((LABELS, LABELS))
        for k in range(1, most):
            e = np.exp(forward[k - 1][:, :, None] + t[None] + (u[:, k] + backward[k])[:, None, :] - z[:, None, None])
            pair += (e * mask[:, k][:, None, None]).sum(0)
        pair[0] += p[:, 0].sum(0)
        pair[:, 0] += p[np.arange(n), size - 1].sum(0)
        diff = (p - one)[mask]
        grads = [np.zeros_like(x) for x in params]
        for k in range(5):
            for c in range(LABELS):
                grads[0][k, :, c] = np.bincount(shape_at[k][mask], diff[:, c], SHAPES)
        for k in range(3):
            for c in range(LABELS):
                grads[1][k, :, c] = np.bincount(gap_at[k][mask], diff[:, c], 2)
        grads[2] = np.where(ok, pair - steps_taken, 0)
        for i, g in enumerate(grads):
            g = g / n + l2 * params[i]
            m, v = moments[i]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[i] = (m, v)
            params[i] = params[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(params[0], params[1], np.where(ok, params[2], -1e4))


_trained: list[Field] = []


def trained() -> Field:
    """The field of the labelled table above, trained once in a process."""
    if not _trained:
        _trained.append(train(labelled_table()))
    return _trained[0]


def _valid(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", s))
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 6) and all(len(p) < 6 for p in parts)
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d) and not set(s) - set("0123456789 .-")
    return 10 <= len(d) <= 15 and len(s) > len(d) and not set(s) - set("0123456789 .-()+")


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field labels, of any validity, for each text."""
    places, pieces, scores = [], [], []
    for i, text in enumerate(texts):
        at, shapes, space = tokenized(text)
        places.append(at)
        if not len(shapes):
            continue
        u = field.unary(shapes, space)
        edge = np.diff(np.concatenate([[0], near_trigger(shapes).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            pieces.append((i, a))
            scores.append(u[a:b])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, first), labels in zip(pieces, viterbi(scores, field.transition), strict=True):
        k = 0
        while k < len(labels):
            if labels[k] % 2 == 1:
                kind, end = (labels[k] - 1) // 2, k + 1
                while end < len(labels) and labels[end] == labels[k] + 1:
                    end += 1
                out[i].append((KINDS[kind], places[i][first + k][0], places[i][first + end - 1][1]))
                k = end
            else:
                k += 1
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, base and added spans) of each text."""
    out = []
    for text, found in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = []
        for kind, a, b in found:
            if _valid(kind, text[a:b]) and not any(s < b and a < e for s, e in taken):
                added.append((kind, a, b))
        both = sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))
        out.append((base, both))
    return out


_MAY = np.zeros(256, bool)
_MAY[48:58] = True
_MAY[[43, 64]] = True


def _candidates(column: pa.Array):
    """(first row, rows that may hold spans, their texts): texts with a digit, + or @."""
    raw, offsets = string_buffers(column)
    for a, b in slices(offsets):
        seen = np.concatenate([[0], np.cumsum(_MAY[raw[offsets[a] : offsets[b]]])])
        at = offsets[a : b + 1] - offsets[a]
        rows = a + np.flatnonzero(seen[at[1:]] > seen[at[:-1]])
        yield rows, column.take(pa.array(rows)).to_pylist()


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Each row of docs as (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    sent = docs.sparkSession.sparkContext.broadcast(field or trained())
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = len(batch)
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, spans, added = [nothing] * n, [""] * n, np.zeros(n, np.int64)
            for rows, texts in _candidates(batch.column(1)):
                for r, (base, both) in zip(rows, all_spans(texts, sent.value), strict=True):
                    if both:
                        for k, _, _ in base:
                            counts[KINDS.index(k), r] += 1
                        digest[r] = hashlib.sha256(_joined(base).encode()).hexdigest()
                        spans[r] = _joined(both)
                        added[r] = len(both) - len(base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with [KIND] in place of each span; of overlapping ones the first names the whole."""
    out, at, kind = [], 0, ""
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data in text replaced by [KIND]; other columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(field or trained())
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            new = {}
            for rows, texts in _candidates(batch.column(at)):
                for r, text, (_, both) in zip(rows, texts, all_spans(texts, sent.value), strict=True):
                    if both:
                        new[int(r)] = redacted(text, both)
            if new:
                values = batch.column(at).to_pylist()
                for r, text in new.items():
                    values[r] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.column(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
