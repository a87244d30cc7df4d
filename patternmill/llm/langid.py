"""Language identification: averaged hashed subword embeddings, a linear softmax, rejection.

A word (a run of letters, lower-cased) is the mean of the embeddings of its hashed character
n-grams, word boundaries included; a text is the mean of its words; a linear layer and a
softmax give the classes. Everything is learned by stochastic gradient descent in numpy on
windows of words from a bounded sample of labelled rows.

Because the model is linear up to the softmax, each distinct word has a fixed contribution
to the logits, so prediction looks words up in a table and sums rows over the whole text.

A temperature, fitted on windows of documents kept out of the gradient steps, turns logits into
calibrated scores. The rejection threshold is the quantile of those scores that leaves all
but REJECT_SHARE of such windows. Longer texts score higher, so there is one for each doubling
of the number of words, as far as the held-out documents hold enough windows of that length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: Letters, and numbers in other signs than digits such as fractions, which count among \w too.
_RUN = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{re.escape(_SIGNS)}]+")
#: Labelled rows per language that training reads at most, on average.
ROWS_PER_LANG = 400
#: Bytes of text per language that training reads at most; the rows with the least hashes come first.
BYTES_PER_LANG = 8 << 20
#: Share of calibration windows whose score lies below the rejection threshold of their length.
REJECT_SHARE = 0.001
MEMO_LIMIT = 200_000
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; texts without such signs, nearly all, are cut by the simple pattern."""
    found = _RUN.findall(text.lower())
    return found if "".join(found).isalpha() or not found else _LETTERS.findall(text.lower())


def in_training(id_col: Column) -> Column:
    """Whether the training fold may read this row: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


class LanguageModel:
    def __init__(self, langs: list[str], buckets: int = 1 << 15, dim: int = 16, seed: int = 5):
        self.langs, self.buckets = langs, buckets
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
        self.out = np.zeros((dim, len(langs)), np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        self.temperature = 1.0
        #: Rejection thresholds of texts of 1, 2 to 3, 4 to 7, ... words; the last is for longer ones too.
        self.thresholds = [0.0]
        self.rng = rng
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.logits = np.zeros((1024, len(self.langs)))
        self.table = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "logits", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def subwords(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash buckets of every 2-, 3- and 4-gram of the words, marks at both ends included, and each one's word."""
        chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
        ids, owners, h = [], [], chars
        for n in (2, 3, 4):
            h = (h[:-1] * _STEP + chars[n - 1 :]) * _STEP
            inside = of[: len(h)] == of[n - 1 :]
            ids.append((((h ^ (h >> np.uint64(29))) * _STEP >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)[inside])
            owners.append(of[: len(h)][inside])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ids)[order], owner[order]

    def train(self, texts: list[str], labels: list[int], epochs: int = 4, window: int = 30, batch: int = 64, rate: float = 1.0) -> None:
        """SGD on windows of words, as many of each language an epoch; every fifth document only calibrates."""
        split = [words_of(t) for t in texts]
        known = list(dict.fromkeys(w for words in split for w in words))
        ids, owner = self.subwords(known)
        pieces = dict(zip(known, np.split(ids, np.searchsorted(owner, np.arange(1, len(known)))), strict=True))
        held = np.arange(len(split)) % 5 == 4

        def windows(keep: np.ndarray, a_lang: int) -> tuple[list[list[str]], np.ndarray]:
            got, labels_of = [], []
            usable = [i for i in np.flatnonzero(keep) if split[i]]
            docs = Counter(labels[i] for i in usable)
            for i in usable:
                words = split[i]
                for start in self.rng.integers(0, max(1, len(words) - window + 1), -(-a_lang // docs[labels[i]])):
                    got.append(words[start : start + int(self.rng.integers(3, window + 1))])
                    labels_of.append(labels[i])
            return got, np.array(labels_of)

        def flat(got: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = [pieces[w] for words in got for w in words]
            each = np.array([len(x) for x in ids])
            of = np.repeat(np.arange(len(got)), [len(words) for words in got])
            weight = 1.0 / (each * np.bincount(of, minlength=len(got))[of])
            return np.concatenate(ids), np.repeat(of, each), np.repeat(weight, each).astype(np.float32)

        def mean(ids: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
            return np.add.reduceat(self.vectors[ids] * weight[:, None], np.searchsorted(of, np.arange(n)))

        for epoch in range(epochs):
            got, y = windows(~held, 1200)
            order = self.rng.permutation(len(got))
            step = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                ids, of, weight = flat([got[i] for i in take])
                h = mean(ids, of, weight, len(take))
                p = _softmax(h @ self.out + self.bias)
                p[np.arange(len(take)), y[take]] -= 1
                grad = (p @ self.out.T)[of] * weight[:, None]
                self.out -= step / 8 * (h.T @ p)
                self.bias -= step / 64 * p.sum(0)
                np.subtract.at(self.vectors, ids, step * grad)
        kept, y = windows(held if held.any() else ~held, 1200)
        if kept:
            logits = mean(*flat(kept), len(kept)) @ self.out + self.bias
            grid = np.geomspace(0.25, 8, 41)
            loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            usable = [i for i in np.flatnonzero(held if held.any() else ~held) if split[i]]
            self._calibrate([split[i] for i in usable], [labels[i] for i in usable])

    def _calibrate(self, docs: list[list[str]], labels: list[int]) -> None:
        """Sets the thresholds from windows of each length, as many of each language."""
        sums = [np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self._word_logits(words), 0)]) for words in docs]
        self.thresholds = []
        least = 1
        # A quantile needs as many windows that do not overlap as one of them is of all.
        while not self.thresholds or sum(len(words) // least for words in docs) >= 1 / REJECT_SHARE:
            long = [i for i, words in enumerate(docs) if len(words) >= least]
            each = Counter(labels[i] for i in long)
            means = []
            for i in long:
                n = len(docs[i])
                for _ in range(-(-1200 // each[labels[i]])):
                    size = int(self.rng.integers(least, min(2 * least, n + 1)))
                    start = int(self.rng.integers(0, n - size + 1))
                    means.append((sums[i][start + size] - sums[i][start]) / size)
            scores = _softmax((np.array(means) + self.bias) / self.temperature).max(1)
            self.thresholds.append(float(np.quantile(scores, REJECT_SHARE)))
            least *= 2

    def threshold(self, n_words: int) -> float:
        return self.thresholds[min(max(n_words, 1).bit_length(), len(self.thresholds)) - 1]

    def _word_logits(self, words: list[str]) -> np.ndarray:
        """A row of logits for each word."""
        ids = list(map(self.index.get, words))
        if None in ids:
            self._learn(words)
            ids = list(map(self.index.get, words))
            if None in ids:  # the table was emptied meanwhile
                self._learn(words)
                ids = list(map(self.index.get, words))
        return self.logits[ids]

    def _learn(self, words: list[str]) -> None:
        """Adds the logits of words that are not in the table yet."""
        if len(self.index) > MEMO_LIMIT:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        ids, owner = self.subwords(new)
        at, n = len(self.index), len(new)
        self.index.update(zip(new, range(at, at + n), strict=True))
        each = np.bincount(owner, minlength=n)
        if self.table is None:
            self.table = self.vectors.astype(np.float64) @ self.out
        own = np.stack([np.bincount(owner, self.table[ids, k], n) / each for k in range(len(self.langs))], 1)
        if at + n > len(self.logits):
            self.logits = np.concatenate([self.logits[:at], np.zeros((at + 2 * n, len(self.langs)))])
        self.logits[at : at + n] = own

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Languages and calibrated scores in 0 to 1, over whole texts; `und` and 0 without a letter."""
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score, and whether the score is too low for a text of that length."""
        split = [words_of(t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in split])
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        if not sizes.sum() or not self.langs:
            return out
        some = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        mean = np.add.reduceat(self._word_logits([w for x in split for w in x]), starts) / sizes[some][:, None]
        p = _softmax((mean + self.bias) / self.temperature)
        for i, best, score in zip(some.tolist(), p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            out[i] = self.langs[best], score, score < self.threshold(len(split[i]))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits a model on about rows_per_lang training rows of each language, chosen by a hash of the id.

    Of those, rows whose texts together pass bytes_per_lang are left out, but for the first.
    Null texts, ids and languages take no part; repeated rows count as often as they are there. Only the training fold is read, and only text and lang. One pass counts rows by language
    (without texts), a second reads the texts of the rows whose hash lies below each
    language's share. Without labelled rows the model knows no language and says `und`.
    """
    fold = docs.filter(in_training(F.col(id_col)) & F.col(lang_col).isNotNull())
    counts = sorted((r["lang"], r["n"]) for r in fold.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect())
    at = F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in counts:
        share = F.when(F.col(lang_col) == lang, int(min(1.0, rows_per_lang / n) * (1 << 30))).otherwise(share)
    rows = fold.filter((at < share) & F.col(text_col).isNotNull()).select(at.alias("at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ahead = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("at", "id", "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter((F.col("ahead") == 0) | (F.col("ahead") + F.octet_length("text") <= bytes_per_lang)).drop("ahead").collect()
    rows.sort(key=lambda r: (r["at"], r["id"], r["lang"], r["text"]))
    langs = [lang for lang, _ in counts]
    model = LanguageModel(langs)
    if rows:
        model.train([r["text"] for r in rows], [langs.index(r["lang"]) for r in rows])
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected added (columns of those names are replaced).

    Only the text decides. rejected says that the text has no letter (or is null), or that
    its score is below the model's threshold for as many words. Repeated rows get equal answers.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            got = []
            texts = texts.tolist()
            while texts:  # about a million characters at a time
                n, size = 0, 0
                while n < len(texts) and size < 1_000_000:
                    size += len(texts[n] or "")
                    n += 1
                got += own.judge(texts[:n])
                texts = texts[n:]
            yield pd.DataFrame({"lang_pred": [x for x, _, _ in got], "score": [s for _, s, _ in got], "rejected": [r for _, _, r in got]})

    found = unused(docs, "__lang_found")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], run(F.col(text_col).cast("string")).alias(found))
    return out.select(*[F.col(f"`{c}`") for c in kept], f"{found}.lang_pred", f"{found}.score", f"{found}.rejected")
