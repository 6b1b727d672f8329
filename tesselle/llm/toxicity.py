"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

Words are runs between white space, lower-cased and stripped of characters at their ends that are
neither letters nor digits; each has an embedding at its hash. Filters of widths 1, 2 and 3 slide
over the whole text, their maxima feed one logistic unit. Training uses a bounded, documented
sample of labelled rows, the only thing gathered on the driver.

Thresholds are calibrated by language: the language of a text is guessed from the text alone
(counts of hashed words), each language's threshold is chosen on rows kept out of training, and the
score is shifted so that 0.5 is the threshold everywhere. Null and empty texts have a score too.
Rows are scored one by one: equal texts get equal scores, repeated rows and null ids count like
others, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselle.llm.langid import MOST_LANGS, key_rates, rate_column, slices, unit_hash
from tesselle.llm.memory import Memory, release, tidy
from tesselle.llm.storage import text_rows
from tesselle.llm.words import pieces

WIDTHS = (1, 2, 3)


@dataclass(frozen=True)
class Params:
    """``most`` bounds the sample: about so many rows of each class, chosen by a hash of doc_id, of up to
    ``longest`` characters each (longer texts are scored, not learned from). So the driver gathers
    no more than 2 * most * longest / 2 words of 4 bytes, and about 20 MB of ordinary documents."""

    most: int = 5000
    longest: int = 50_000
    buckets: int = 1 << 18
    dim: int = 12
    filters: int = 12
    epochs: int = 8
    batch: int = 64
    rate: float = 0.05
    seed: int = 17
    #: Share of the sample kept out of training for the thresholds.
    calibrate: float = 0.2


class Words(Memory):
    """Raw word to bucket; bounded memory."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def make(self, raw: str) -> int:
        a, b = 0, len(raw)
        while a < b and not raw[a].isalnum():
            a += 1
        while b > a and not raw[b - 1].isalnum():
            b -= 1
        w = raw[a:b].lower()
        return 1 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % (self.buckets - 1) if w else 0

    def ids(self, text: str | None) -> np.ndarray:
        """Buckets of a whole text's words, one place at least; words without letter or digit are bucket 0."""
        runs = (t.split() for t in pieces(text or ""))
        got = np.concatenate([np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in runs])
        return got if len(got) else np.zeros(1, np.int32)


#: Places of a run that is convolved at once.
RUN = 1 << 16
_REACH = max(WIDTHS) - 1


def windows(docs: list[np.ndarray], most: int = RUN) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(documents, ids) of runs of about ``most`` places. A longer document is cut: each of its windows holds its places
    and the words that the filters of the last ones reach, so that the maxima over its windows are those of the whole."""
    own, run, size = [], [], 0
    for k, d in enumerate(docs):
        for a in range(0, len(d), most):
            last = a + most >= len(d)
            own.append(k)
            run.append(np.concatenate([d[a:], np.zeros(_REACH, np.int32)]) if last else d[a : a + most + _REACH])
            if not last and len(run[-1]) < most + _REACH:
                run[-1] = np.concatenate([run[-1], np.zeros(most + _REACH - len(run[-1]), np.int32)])
            size += len(run[-1])
            if size >= most:
                yield own, run
                own, run, size = [], [], 0
    if own:
        yield own, run


def _lay(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row with blanks between documents, document starts and lengths."""
    gap = np.zeros(_REACH, np.int32)
    flat = np.concatenate([x for d in docs for x in (d, gap)])
    length = np.array([len(d) for d in docs])
    return flat, np.concatenate([[0], np.cumsum(length + len(gap))[:-1]]), length


class Net:
    def __init__(self, p: Params):
        g = np.random.Generator(np.random.PCG64(p.seed))
        self.p = p
        self.emb = (g.standard_normal((p.buckets, p.dim)) * 0.05).astype(np.float32)
        self.emb[0] = 0
        self.w = {w: (g.standard_normal((w, p.dim, p.filters)) / np.sqrt(w * p.dim)).astype(np.float32) for w in WIDTHS}
        self.b = {w: np.zeros(p.filters, np.float32) for w in WIDTHS}
        self.out = (g.standard_normal(len(WIDTHS) * p.filters) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def maps(self, flat: np.ndarray) -> dict[int, np.ndarray]:
        """Filter responses at every place, one matrix for each width."""
        h = self.emb[flat]
        got = {}
        for w in WIDTHS:
            z = h @ self.w[w][0]
            for j in range(1, w):
                z[:-j] += h[j:] @ self.w[w][j]
            got[w] = z
        return got

    def pooled(self, docs: list[np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Pooled responses of a training batch, the places they stem from, and the ids in a row."""
        flat, start, length = _lay(docs)
        cut = np.stack([start, start + length], axis=1).ravel()
        maps = self.maps(flat)
        top = {w: np.maximum.reduceat(z, cut, axis=0)[::2] for w, z in maps.items()}
        x = np.concatenate([np.maximum(top[w] + self.b[w], 0) for w in WIDTHS], axis=1)
        at = {w: np.stack([s + z[s : s + n].argmax(axis=0) for s, n in zip(start, length)]) for w, z in maps.items()}
        return x, at, flat

    def logits(self, docs: list[np.ndarray], most: int = RUN) -> np.ndarray:
        top = {w: np.full((len(docs), self.p.filters), -np.inf, np.float32) for w in WIDTHS}
        for own, run in windows(docs, most):
            start = np.cumsum([0, *(len(x) for x in run)])
            cut = np.stack([start[:-1], start[1:] - _REACH], axis=1).ravel()
            for w, z in self.maps(np.concatenate(run)).items():
                np.maximum.at(top[w], own, np.maximum.reduceat(z, cut, axis=0)[::2])
        x = np.concatenate([np.maximum(top[w] + self.b[w], 0) for w in WIDTHS], axis=1)
        return (x @ self.out + self.bias[0]).astype(np.float64)

    def train(self, docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> None:
        p = self.p
        g = np.random.Generator(np.random.PCG64(p.seed + 1))
        # Squared gradients so far (Adagrad): steps shrink for what has moved, rare words move at once.
        seen = {id(a): np.full_like(a, 1e-6) for a in (self.emb, self.out, self.bias, *self.w.values(), *self.b.values())}

        def step(a: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
            s = seen[id(a)]
            if rows is None:
                s += grad * grad
                a -= p.rate * grad / np.sqrt(s)
            else:
                s[rows] += grad * grad
                a[rows] -= p.rate * 3 * grad / np.sqrt(s[rows])

        for _ in range(p.epochs):
            order = g.permutation(len(docs))
            for k in range(0, len(order), p.batch):
                own = order[k : k + p.batch]
                x, at, flat = self.pooled([docs[i] for i in own])
                prob = 1 / (1 + np.exp(-(x @ self.out + self.bias[0])))
                d = ((prob - label[own]) * weight[own] / len(own)).astype(np.float32)
                dx = np.outer(d, self.out) * (x > 0)
                g_out, g_bias = x.T @ d + 1e-5 * self.out, np.array([d.sum()], np.float32)
                rows, grads, done = [], [], []
                for i, w in enumerate(WIDTHS):
                    dz = dx[:, i * p.filters : (i + 1) * p.filters]
                    gw = np.empty_like(self.w[w])
                    for j in range(w):
                        word = flat[np.minimum(at[w] + j, len(flat) - 1)]
                        gw[j] = np.einsum("nfd,nf->df", self.emb[word], dz)
                        rows.append(word.ravel())
                        grads.append((dz[:, :, None] * self.w[w][j].T[None]).reshape(-1, p.dim))
                    done.append((self.w[w], gw))
                    done.append((self.b[w], dz.sum(axis=0)))
                step(self.out, g_out)
                step(self.bias, g_bias)
                for a, ga in done:
                    step(a, ga)
                rows, back = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(rows), p.dim), np.float32)
                np.add.at(total, back, np.concatenate(grads))
                total[rows == 0] = 0
                step(self.emb, total, rows)


class Guess:
    """The language of a text from its words alone: naive Bayes over hashed words."""

    def __init__(self, docs: list[np.ndarray], langs: list[str | None], buckets: int = 1 << 14, most: int = MOST_LANGS):
        often = Counter(x for x in langs if x is not None)
        self.names = sorted(sorted(often, key=lambda x: (-often[x], x))[:most]) or ["all"]
        self.buckets = buckets
        count = np.full((buckets, len(self.names)), 0.1)
        known = set(self.names)
        for d, lang in zip(docs, langs):
            if lang in known:
                np.add.at(count[:, self.names.index(lang)], np.unique(d) % buckets, 1)
        self.log = np.log(count / count.sum(axis=0)).astype(np.float32)

    def __call__(self, docs: list[np.ndarray]) -> np.ndarray:
        if len(self.names) == 1:
            return np.zeros(len(docs), int)
        total = np.zeros((len(docs), len(self.names)), np.float32)
        for k, d in enumerate(docs):
            for a in range(0, len(d), RUN):
                total[k] += self.log[d[a : a + RUN] % self.buckets].sum(axis=0)
        return total.argmax(axis=1)


def best_threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The threshold with the least weight of errors, in the middle of its gap; 0 if a class is missing."""
    if not len(logit) or label.min() == label.max():
        return 0.0
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], label[order]
    w = np.ones(len(y)) if weight is None else weight[order]
    clean, bad = np.where(y == 0, w, 0), np.where(y == 1, w, 0)
    wrong = np.round(np.concatenate([[clean.sum()], clean.sum() - np.cumsum(clean) + np.cumsum(bad)]), 6)
    wrong[1:-1][x[1:] == x[:-1]] = np.inf
    k = np.flatnonzero(wrong == wrong.min())
    k = k[len(k) // 2]
    return float(x[0] - 1 if k == 0 else x[-1] + 1 if k == len(x) else (x[k - 1] + x[k]) / 2)


@dataclass
class Model:
    net: Net | None
    guess: Guess | None
    shift: np.ndarray
    prior: float = 0.0

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.net is None or self.guess is None:
            return np.full(len(docs), self.prior)
        z = self.net.logits(docs) - self.shift[self.guess(docs)]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, params: Params = Params()) -> Model:
    """Train on labelled documents: ``docs`` has doc_id, text, lang; ``labels`` has doc_id and toxic, 0 or 1.

    ``usable``, a condition on doc_id, tells which labels may be seen. Labels are sampled before they
    meet the documents: about ``params.most`` of each class at most, by a hash of doc_id, so that the
    side sent to all executors is bounded; their documents are taken whole. Of several labels of one
    document the larger counts. Without both classes the model answers the one class it has seen, or 0.
    """
    seen = labels.filter(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    rates = key_rates(seen, "toxic", params.most)
    sampled = seen.filter(unit_hash(F.col("doc_id"), 5) < rate_column(rates, "toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= params.longest).select("doc_id", "text", "lang").join(F.broadcast(sampled), "doc_id")
    buckets = params.buckets
    text_rows(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(buckets)
        for b in batches:
            for part, texts in slices(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([words.ids(t).tobytes() for t in texts], pa.binary()), part.column(2), part.column(3)], names=["doc_id", "ids", "lang", "toxic"])

    got = taken.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.col("toxic").cast("int").alias("toxic")).mapInArrow(tidy(hashed), "doc_id long, ids binary, lang string, toxic int").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    model = _learn(got, rates, params)
    del got
    release()
    return model


def _learn(got: pa.Table, rates: dict, params: Params) -> Model:
    docs = [np.frombuffer(x, np.int32) for x in got.column("ids").to_pylist()]
    label = np.array(got.column("toxic").to_pylist(), np.int64)
    if not len(label) or label.min() == label.max():
        return Model(None, None, np.zeros(1), float(label[0]) if len(label) else 0.0)
    langs = got.column("lang").to_pylist()
    g = np.random.Generator(np.random.PCG64(params.seed))
    out = g.random(len(docs)) < params.calibrate
    fit_on, tune_on = np.flatnonzero(~out), np.flatnonzero(out)
    net = Net(params)
    net.train([docs[i] for i in fit_on], label[fit_on].astype(np.float32), np.ones(len(fit_on), np.float32))
    guess = Guess([docs[i] for i in fit_on], [langs[i] for i in fit_on])
    tune = [docs[i] for i in tune_on]
    logit = np.concatenate([net.logits(tune[k : k + 256]) for k in range(0, len(tune), 256)]) if tune else np.zeros(0)
    which = np.concatenate([guess(tune[k : k + 256]) for k in range(0, len(tune), 256)]) if tune else np.zeros(0, int)
    # The classes are sampled at rates of their own: an error counts as many rows as its row stands for.
    stands = np.array([1 / rates.get(int(x), 1.0) for x in label[tune_on]])
    everywhere = best_threshold(logit, label[tune_on], stands)
    of = [np.flatnonzero(which == k) for k in range(len(guess.names))]
    shift = np.array([best_threshold(logit[k], label[tune_on][k], stands[k]) if len(k) >= 50 else everywhere for k in of])
    return Model(net, guess, shift)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) with the score of each whole text."""
    keep = keep or ["doc_id"]
    shared = text_rows(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Words(m.net.p.buckets if m.net else 2)
        for b in batches:
            for part, texts in slices(b, b.num_columns - 1):
                s = m.scores([words.ids(t) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64())], names=[*keep, "score"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(tidy(run), schema)
