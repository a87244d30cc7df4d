"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what has no pattern.

The patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. The
CRF finds persons (after a cue) and secrets; it is trained on the small labelled table of
pii_examples by gradient ascent on the likelihood, with forward-backward in numpy.

Decoding is exact Viterbi in numpy batches. A token is called plain if, whatever its
neighbours' labels, labelling it O scores higher than any other label; such a token is O in
every best path, so only the runs between plain tokens are decoded, padded to one length.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_examples import expand

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# A number that fails from its first digit fails from any other, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = re.compile(r"^\W*(?:[A-Za-z_]+[=:]\W*)?|\W*$")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: each @ is tried once, with all that may stand before it, so time is linear in the text."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost, non-overlapping for each kind; failing matches go."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


class _Classes(dict):
    """Character classes for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c if c in "=:.@\"'+-_," else "#"
        return out


_CLASSES = _Classes()


def _word(token: str) -> str:
    """A token as a cue: without marks around it, but with an abbreviation's dot or a label's colon."""
    return token.strip("\"',;!").lower()


class Tagger:
    """A linear-chain CRF. Features of a token: its shape, its size, its mix of letters and digits,
    and itself if it is a cue, for the token, the one before and the one after."""

    #: Tokens, and characters of tokens, that are remembered at most.
    MEMO_LIMIT = 200_000
    MEMO_CHARS = 4_000_000

    def __init__(self, rows: list[tuple[list[str], list[str]]] | None = None, steps: int = 200, rate: float = 0.1, decay: float = 1e-3):
        rows = expand() if rows is None else rows
        self.labels = ["O", *sorted({k for _, kinds in rows for k in kinds} - {"O"})]
        #: Words within two places before spans, and never inside one or in a row without spans.
        apart = {_word(t) for tokens, kinds in rows for t, k in zip(tokens, kinds, strict=True) if k != "O" or set(kinds) == {"O"}}
        beside = {_word(tokens[j]) for tokens, kinds in rows for i, k in enumerate(kinds) if k[0] == "B" for j in range(max(0, i - 2), i)}
        self.cues = {w for w in beside - apart if w}
        self.features: dict[str, int] = {}
        coded = [[self._features(t, grow=True) for t in tokens] for tokens, _ in rows]
        self._train(coded, [[self.labels.index(k) for k in kinds] for _, kinds in rows], steps, rate, decay)
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.chars = 0
        # Row 0 is the place before the first and after the last token of a text.
        self.score = np.zeros((1024, 3, len(self.labels)))
        self.score[0] = self._score(self._features(""))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "score", "chars")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _features(self, token: str, grow: bool = False) -> list[int]:
        shape = re.sub(r"(.)\1+", r"\1+", token.translate(_CLASSES))
        names = [f"shape {shape}" if len(shape) <= 8 else f"mixed {'d' in shape} {'x' in shape} {'X' in shape}", f"size {min(len(token) // 4, 5)}"]
        if "d" in shape and ("x" in shape or "X" in shape):
            names.append(f"letters and digits {min(len(token) // 8, 2)}")
        word = _word(token)
        names.append(f"cue {word}" if word in self.cues else "no cue")
        names.append("bias" if token else "edge")
        if grow:
            for n in names:
                self.features.setdefault(n, len(self.features))
            self.features.setdefault("edge", len(self.features))
        return [self.features[n] for n in names if n in self.features]

    def _score(self, features: list[int]) -> np.ndarray:
        return self.weights[:, features].sum(1)

    def _train(self, rows: list[list[list[int]]], labels: list[list[int]], steps: int, rate: float, decay: float) -> None:
        n, size, k = len(rows), max(map(len, rows)), len(self.labels)
        count = len(self.features)
        present = np.zeros((n, size + 2, count))
        present[:, :, self.features["edge"]] = 1
        mask = np.zeros((n, size))
        gold = np.zeros((n, size), int)
        for i, (row, y) in enumerate(zip(rows, labels, strict=True)):
            for t, features in enumerate(row):
                present[i, t + 1] = 0
                present[i, t + 1, features] = 1
            mask[i, : len(row)], gold[i, : len(row)] = 1, y
        views = [present[:, 1:-1], present[:, :-2], present[:, 2:]]
        self.weights, self.move = np.zeros((3, count, k)), np.zeros((k, k))
        target = np.eye(k)[gold] * mask[..., None]
        pairs = np.einsum("nta,ntb,nt->ab", target[:, :-1], target[:, 1:], mask[:, 1:])
        state = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros_like(self.move), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            e = sum(v @ w for v, w in zip(views, self.weights, strict=True))
            up, down = np.empty_like(e), np.zeros_like(e)
            up[:, 0] = e[:, 0]
            for t in range(1, size):
                new = e[:, t] + _logsum(up[:, t - 1][:, :, None] + self.move, 1)
                up[:, t] = np.where(mask[:, t, None] > 0, new, up[:, t - 1])
            for t in range(size - 2, -1, -1):
                new = _logsum(self.move + (e[:, t + 1] + down[:, t + 1])[:, None, :], 2)
                down[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
            norm = _logsum(up[:, -1], 1)
            marginal = np.exp(up + down - norm[:, None, None]) * mask[..., None]
            joint = np.exp(up[:, :-1, :, None] + self.move + (e + down)[:, 1:, None, :] - norm[:, None, None, None])
            grads = [np.stack([np.einsum("ntf,ntk->fk", v, target - marginal, optimize=True) for v in views]) - decay * n * self.weights, pairs - np.einsum("ntab,nt->ab", joint, mask[:, 1:]) - decay * n * self.move]
            for i, (own, g) in enumerate(zip((self.weights, self.move), grads, strict=True)):
                m, v = state[2 * i], state[2 * i + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                own += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def viterbi(self, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of runs (runs x steps x labels) that stand between labels O."""
        n, steps, k = emit.shape
        best, back = emit[:, 0] + self.move[0], np.zeros((n, steps, k), np.int8)
        last = best + self.move[:, 0]
        finals = [last]
        for t in range(1, steps):
            through = best[:, :, None] + self.move
            back[:, t] = through.argmax(1)
            best = through.max(1) + emit[:, t]
            finals.append(best + self.move[:, 0])
        out = np.zeros((n, steps), np.int8)
        ends = np.stack(finals, 1)[np.arange(n), sizes - 1].argmax(1)
        now = np.zeros(n, np.int64)
        for t in range(steps - 1, -1, -1):
            now = np.where(sizes - 1 == t, ends, now)
            out[:, t] = now
            now = back[np.arange(n), t, now] if t else now
        return out

    def tag(self, texts: list[str]) -> dict[int, list[tuple[int, str]]]:
        """By text: (token number, label) of the tokens that are not O; tokens are split at white space."""
        split = [t.split() for t in texts]
        flat: list[str] = []
        for tokens in split:
            flat += tokens
            flat.append("")
        flat = ["", *flat]
        ids = list(map(self.ids.get, flat))
        if None in ids:
            if len(self.ids) > self.MEMO_LIMIT or self.chars > self.MEMO_CHARS:
                self._forget()
            shapes: dict[tuple[int, ...], np.ndarray] = {}
            for t in dict.fromkeys(flat):
                if t not in self.ids:
                    i = self.ids[t] = len(self.ids)
                    self.chars += len(t)
                    if i >= len(self.score):
                        self.score = np.concatenate([self.score, np.zeros_like(self.score)])
                    f = tuple(self._features(t))
                    if f not in shapes:
                        shapes[f] = self._score(list(f))
                    self.score[i] = shapes[f]
            ids = list(map(self.ids.__getitem__, flat))
        at = np.array(ids)
        emit = self.score[at, 0]
        emit[1:] += self.score[at[:-1], 1]
        emit[:-1] += self.score[at[1:], 2]
        gain = (self.move - self.move[:, :1]).max(0) + (self.move - self.move[:1]).max(1)
        open_ = ((emit - emit[:, :1] + gain)[:, 1:] >= 0).any(1) & (at != 0)
        found: dict[int, list[tuple[int, str]]] = {}
        if not open_.any():
            return found
        edges = np.flatnonzero(np.diff(np.concatenate([[0], open_.view(np.int8), [0]])))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        firsts = np.flatnonzero(at == 0)  # firsts[i] stands right before text i
        order = np.argsort(sizes, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 256)):
            long = int(sizes[part].max())
            reach = np.minimum(starts[part][:, None] + np.arange(long), len(emit) - 1)
            labels = self.viterbi(emit[reach], sizes[part])
            for i, t in zip(*np.nonzero(labels), strict=True):
                if t < sizes[part[i]]:
                    where = int(starts[part[i]] + t)
                    doc = int(np.searchsorted(firsts, where)) - 1
                    found.setdefault(doc, []).append((where - int(firsts[doc]) - 1, self.labels[labels[i, t]]))
        return {doc: sorted(x) for doc, x in found.items()}

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) by text, in code points; marks and signs at a span's ends are left out."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for doc, tagged in self.tag(texts).items():
            places = [m.span() for m in re.finditer(r"\S+", texts[doc])]
            runs: list[list] = []
            for t, label in tagged:
                kind = label[2:]
                if label[0] == "I" and runs and runs[-1][2] == kind and runs[-1][1] == t - 1:
                    runs[-1][1] = t
                else:
                    runs.append([t, t, kind])
            for a, b, kind in runs:
                start, end = places[a][0], places[b][1]
                start += _EDGE.match(texts[doc][start:end]).end()
                while end > start and not texts[doc][end - 1].isalnum():
                    end -= 1
                if end > start:
                    out[doc].append((start, end, kind))
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def all_spans(texts: list[str], tagger: Tagger) -> Iterator[tuple[list, list]]:
    """For each text its base spans, and all spans: those and the tagger's that overlap none of them."""
    for text, more in zip(texts, tagger.spans(texts), strict=True):
        base = base_spans(text)
        starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
        # The base spans that start before a span ends: does one of them end behind its start?
        extra = [x for x in more if not (n := bisect_left(starts, x[1])) or ends[n - 1] <= x[0]]
        yield base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else len(KINDS), x[2]))


def _chunks(texts: list[str], size: int = 500_000) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size or i == len(texts) - 1:
            yield start, i + 1
            start, n = i + 1, 0


def find_pii(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (of all kinds).

    Spans are kind:start:end, by start, comma-joined, in code points, end exclusive; a null
    text counts as empty. Every row gives a row, repeated ones too; a null id stays null;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, digests, spans, sizes = [], [], [], []
            for a, b in _chunks(texts):
                for base, every in all_spans(texts[a:b], shared.value):
                    counts.append([sum(x[2] == k for x in base) for k in KINDS])
                    digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest())
                    spans.append(",".join(f"{k}:{s}:{e}" for s, e, k in every))
                    sizes.append(len(every))
            columns = {id_col: batch.column(0)}
            columns |= {f"n_{k}": pa.array([c[i] for c in counts], pa.int64()) for i, k in enumerate(KINDS)}
            yield pa.RecordBatch.from_pydict(columns | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()), "n_spans": pa.array(sizes, pa.int64())})

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in angle brackets; null stays null.

    Where spans overlap, the union is replaced once, by the kind that starts first. All rows
    and all other columns stay as they are, repeated rows too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def one(text: str, spans: list[tuple[int, int, str]]) -> str:
        out, at, end_of_last = [], 0, -1
        for start, end, kind in spans:
            if start >= end_of_last:
                out += [text[at:start], f"<{kind}>"]
            at = end_of_last = max(end, end_of_last)
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        given = texts.tolist()
        plain, out = [t or "" for t in given], []
        for a, b in _chunks(plain):
            out += [one(t, every) for t, (_, every) in zip(plain[a:b], all_spans(plain[a:b], shared.value), strict=True)]
        return pd.Series([None if g is None else o for g, o in zip(given, out, strict=True)], dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col).cast("string")))
