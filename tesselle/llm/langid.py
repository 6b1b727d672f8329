"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector drawn from its code point. A trigram's vector binds its
letters' vectors, each permuted (rotated) by its place; a document bundles (adds) the vectors of
its trigrams; a language's prototype bundles the unit vectors of its training documents. The
predicted language is that of the prototype with the largest cosine.

Letters are lower-cased; every run of other characters is one blank, also at both ends. Texts that
are null or have no letter are ``und`` with score 0. With no usable training row, all texts are ``und``.
Of equally near languages the first by name is predicted. Rows count one by one, so repeated rows and
null ids are predicted like others; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselle.llm.memory import tidy
from tesselle.llm.storage import text_rows

UND = "und"
DIM = 1024
#: Bounds of the training sample: about so many documents of each language, chosen by a hash of doc_id,
#: and so many languages, those with most documents.
SAMPLE_PER_LANG, MOST_LANGS = 1500, 256
#: Characters and texts whose trigrams are counted at once, and distinct trigrams whose vectors are made at once.
RUN, ROWS, GRAMS = 400_000, 512, 2048
#: Alphabets of a run beyond this size number their trigrams by sorting instead of by place.
DENSE_ALPHABET = 96


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=16384)
def letter_vector(code: int, dim: int) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64([7919, code])).integers(0, 2, dim) * 2 - 1).astype(np.int8)


def _last_two(s: str) -> str:
    """The last two characters of a text once its runs of other characters than letters are one blank each."""
    out, k = "", len(s)
    while k and len(out) < 2:
        k -= 1
        if s[k].isalpha():
            out = s[k] + out
        else:
            out = " " + out
            while k and not s[k - 1].isalpha():
                k -= 1
    return out


def _runs(texts: list[str | None], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """(documents, lower-cased texts) of about ``most`` characters; a longer text is cut, and each further run begins
    with the two characters that its first trigram needs."""
    own, run, size = [], [], 0
    for k, t in enumerate(texts):
        low = f" {(t or '').lower()} "
        at, before = 0, ""
        while at < len(low):
            part = before + low[at : at + most]
            at += most
            before = _last_two(part) if at < len(low) else ""
            own.append(k)
            run.append(part)
            size += len(part)
            if size >= most or len(own) == ROWS:
                yield own, run
                own, run, size = [], [], 0
    if own:
        yield own, run


def _grams(run: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram) by place, the letters that trigram numbers are made of, and letters per row."""
    rows = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in run]
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows), dtype=np.int64), [len(d) for d in rows])
    letter = _is_letter()[flat]
    n_letters = np.bincount(row[letter], minlength=len(rows))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    code, row = np.where(letter, flat, 32)[keep], row[keep]
    seen = np.unique(code)
    lut = np.zeros(int(seen[-1]) + 1, np.int64)
    lut[seen] = np.arange(len(seen))
    a, n = lut[code], len(seen)
    inside = row[2:] == row[:-2]
    return row[2:][inside], ((a[:-2] * n + a[1:-1]) * n + a[2:])[inside], seen, n_letters


def sums(texts: list[str | None], dim: int = DIM, run: int = RUN, step: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Bundled trigram vectors and letters of each text; memory is bounded by ``run`` and ``step``, whatever the alphabet."""
    total, letters = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), np.int64)
    for own, part in _runs(texts, run):
        own = np.array(own)
        row, key, seen, n_letters = _grams(part)
        np.add.at(letters, own, n_letters)
        if not len(key):
            continue
        n = len(seen)
        if n <= DENSE_ALPHABET:
            grams = np.flatnonzero(np.bincount(key, minlength=1))
            place = np.zeros(n**3, np.int64)
            place[grams] = np.arange(len(grams))
            at = place[key]
        else:
            grams, at = np.unique(key, return_inverse=True)
        if len(grams) > step:
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
        edges = np.searchsorted(at, np.arange(0, len(grams) + step, step)) if len(grams) > step else [0, len(at)]
        bundled = np.zeros((len(part), dim), np.float32)
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            g = grams[k * step : (k + 1) * step]
            parts = [letter_vectors(seen[x], dim) for x in (g // (n * n), g // n % n, g % n)]
            vectors = (np.roll(parts[0], 2, axis=1) * np.roll(parts[1], 1, axis=1) * parts[2]).astype(np.float32)
            counts = np.bincount(row[lo:hi] * len(g) + (at[lo:hi] - k * step), minlength=len(part) * len(g)).reshape(len(part), len(g))
            bundled += counts.astype(np.float32) @ vectors
        np.add.at(total, own, bundled)
    return total, letters


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    distinct, at = np.unique(codes, return_inverse=True)
    return np.stack([letter_vector(int(c), dim) for c in distinct])[at]


def profiles(texts: list[str | None], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Unit document vectors (zero without letters) and letters per document."""
    v, letters = sums(texts, dim)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=(norm > 0) & (letters[:, None] > 0)), letters


def slices(part: pa.RecordBatch, column: int, most_chars: int = RUN) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut a batch into runs of rows whose texts hold about ``most_chars`` characters together."""
    start = size = 0
    lengths = pa.compute.fill_null(pa.compute.utf8_length(part.column(column)), 0).to_pylist()
    for k, n in enumerate(lengths):
        size += n
        if size >= most_chars or k + 1 == len(lengths):
            run = part.slice(start, k + 1 - start)
            yield run, run.column(column).to_pylist()
            start, size = k + 1, 0


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def sample_rate(keys: DataFrame, column: str, most: int, most_keys: int = MOST_LANGS) -> Column:
    """Share of each key's rows to take so that about ``most`` remain, as a column over that key.

    Only the ``most_keys`` keys (language codes, classes) with most rows are taken from, of equals the
    first, so that what reaches the driver is bounded.
    """
    rates = key_rates(keys, column, most, most_keys)
    return rate_column(rates, column)


def key_rates(keys: DataFrame, column: str, most: int, most_keys: int = MOST_LANGS) -> dict:
    counts = keys.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most_keys)
    return {r[0]: min(1.0, most / r[1]) for r in counts.collect()}


def rate_column(rates: dict, column: str) -> Column:
    if not rates:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col(column)], F.lit(0.0))


def unit_hash(doc_id: Column, salt: int) -> Column:
    """A number in [0, 1) from a hash of the id."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


class Model:
    """Language prototypes; ``langs`` ascending."""

    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs, self.prototypes, self.dim = langs, prototypes, prototypes.shape[1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.compare(texts)[:2]

    def compare(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and the cosines with every prototype."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros((len(texts), 0))
        v, letters = profiles(texts, self.dim)
        cos = v @ self.prototypes.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        return [self.langs[b] if n else UND for b, n in zip(best, letters)], np.where(letters > 0, score, 0.0), cos


def fit(docs: DataFrame, usable: Column, per_lang: int = SAMPLE_PER_LANG, dim: int = DIM, tasks: int = 8) -> Model:
    """Prototypes from a bounded sample of the rows where ``usable`` holds and lang is not null.

    At most about ``per_lang`` documents of each of the MOST_LANGS most frequent languages are taken,
    whole; each of ``tasks`` tasks returns one vector for each language.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    taken = rows.filter(unit_hash(F.col("doc_id"), 8) < sample_rate(rows, "lang", per_lang)).select("lang", "text").repartition(tasks)

    text_rows(docs)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for part, texts in slices(b, 1):
                v, _ = profiles(texts, dim)
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_pylist([{"lang": k, "v": v.tobytes()} for k, v in sums.items()], schema=pa.schema([("lang", pa.string()), ("v", pa.binary())]))

    total: dict[str, np.ndarray] = {}
    for r in taken.mapInArrow(tidy(bundle), "lang string, v binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.v, np.float64)
    total = {k: v for k, v in total.items() if np.linalg.norm(v) > 0}
    langs = sorted(total)
    protos = np.array([total[k] / np.linalg.norm(total[k]) for k in langs], np.float32).reshape(len(langs), dim)
    return Model(langs, protos)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, declared: str | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) with lang_pred and score of each whole text.

    With ``declared``, a language column, ``declared_score`` is the cosine with that language's
    prototype, null where it is null or was not learned; prediction and score do not depend on it.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        place = {x: k for k, x in enumerate(m.langs)}
        for b in batches:
            for part, texts in slices(b, b.num_columns - 1):
                lang, score, cos = m.compare(texts)
                said = [place.get(x) for x in part.column(part.num_columns - 2).to_pylist()]
                own = [None if k is None else float(row[k]) for k, row in zip(said, cos)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(own, pa.float64())], names=[*keep, "lang_pred", "score", "declared_score"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("declared_score", T.DoubleType())])
    said = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    out = docs.select(*keep, said.alias("__said"), F.col("text").alias("__text")).mapInArrow(tidy(run), schema)
    text_rows(out)
    return out if declared else out.drop("declared_score")


def crc_fold(doc_id: int | None, of: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of
