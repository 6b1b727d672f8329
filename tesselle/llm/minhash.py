"""MinHash near-dedup by an inverted join over signature coordinates.

A document's signature has ``K`` coordinates, each the minimum of one hash over its shingles. A
(coordinate, value) pair is a token; documents are posted under their tokens. Two documents whose
sets are alike enough share at least ``T`` of ``K`` tokens (``least_matches``; a pair at the very threshold
misses that with a chance of at most 1 in 20,000), so

* tokens of one document only are dropped, and with them documents left with fewer than ``T``;
* the rest are ordered from rare to frequent, and a document is posted under its first m - T + 1
  only (prefix): two documents with T common tokens meet in at least one of these lists;
* collisions of a pair are counted over whole signatures, and pairs below T are skipped.

Every link is confirmed on full shingle sets. Since only reachability is asked for, lists are merged
in two passes. First each document is held against the most central member of its lists only;
members of one component need no further comparison. Then lists that still hold several components
are compared in full. For lists of any length the same pairs are found, those with T collisions and
a confirmed link: short lists make them by a join, long ones in blocks of bounded rows and shingles,
whose kernel returns a spanning forest, never the pairs. Lists of several blocks come last, and in them only
what lies outside the largest component meets others. Documents of equal sets are one item throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.components import connected_components
from tesselle.llm.langid import slices
from tesselle.llm.memory import Memory, tidy
from tesselle.llm.storage import discard, materialize, sweep, text_rows
from tesselle.llm.words import pieces

WIDTH = 5
K = 48
#: Links need 100 * intersection >= LINK * union.
LINK = 85
#: Chance at most that a pair at the very threshold shares fewer coordinates than are asked for.
MISS = 5e-5
#: Longest list whose pairs are made by a join; longer ones are cut into blocks of so many shingles and documents.
SHORT_LIST, BLOCK, BLOCK_ROWS = 8, 60_000, 1000
#: Rounds in which texts are dealt out for their shingle sets, so that only a part of them lies on the executors' disks at once.
ROUNDS = 4
#: Ids of items whose smallest doc_id stands for several texts.
EXTRA = 1 << 62

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_FACTORS = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(link: int, k: int = K, miss: float = MISS) -> int:
    """Most coordinates that may be asked for: pairs at the threshold fall short of them with a chance of ``miss`` at most."""
    p, below, t = link / 100, 0.0, 0
    while t < k:
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(Memory):
    """Word (bytes) to a 64-bit hash; bounded memory."""

    def make(self, w: bytes) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(w)

    def shingles(self, text: str | None, width: int = WIDTH) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a whole text's shingles.

        Words are runs of bytes other than ASCII white space, A-Z lower-cased; with fewer than
        ``width`` words the whole sequence is one shingle, with none the set is empty.
        """
        if not text:
            return np.zeros(0, np.uint64)
        runs = (t.encode("utf-8", "surrogatepass").lower().split() for t in pieces(text))
        h = np.concatenate([np.fromiter(map(self.__getitem__, words), np.uint64, len(words)) for words in runs])
        if not len(h):
            return h
        n = min(width, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            s = s * _STEP + h[j : len(h) - n + 1 + j]
        return np.unique(_mix(s))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Hash of a whole set, as two signed 64-bit integers."""
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(s.tobytes())
    return (h & (2**64 - 1)) - 2**63, (h >> 64) - 2**63


def signature(s: np.ndarray) -> np.ndarray:
    """K 32-bit coordinates of a set of hashes, in slices of bounded memory."""
    out = np.full(K, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(s), 4096):
        out = np.minimum(out, ((s[k : k + 4096, None] * _FACTORS) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, sig): set size, 128-bit hash of the set, and signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            for part, texts in slices(b, 1):
                n, h1, h2, sig = [], [], [], []
                for t in texts:
                    s = words.shingles(t)
                    lo, hi = set_hash(s)
                    n.append(len(s))
                    h1.append(lo)
                    h2.append(hi)
                    sig.append(signature(s))
                flat = pa.array(np.concatenate(sig), pa.int32())
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * K), flat)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "h1", "h2", "sig"])

    return text_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, sig array<int>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, shingles) of documents; h1 and h2 as in ``signatures``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            for part, texts in slices(b, 1):
                sets = [words.shingles(t) for t in texts]
                h1, h2 = zip(*map(set_hash, sets))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))], names=["doc_id", "h1", "h2", "shingles"])

    return text_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, h1 long, h2 long, shingles array<long>")


def _fits(a: str, b: str, link: int) -> str:
    """Sizes that leave a link possible."""
    return f"100 * least({a}, {b}) >= {link} * greatest({a}, {b})"


def _collisions(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _grows(df: DataFrame) -> DataFrame:
    """A side that grows with the corpus: joined by sorting at every size, never sent to all executors."""
    return df.hint("merge")


def _confirm(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) that are linked on full sets."""
    left = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    both = _grows(_grows(pairs.select("a", "b")).join(_grows(left), "b")).join(_grows(right), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u")).filter(f"100 * i >= {link} * u").select("a", "b")


def _candidates(data: pa.Table, least: int) -> np.ndarray:
    """Whether rows (comp, side, sig) of a block pair have ``least`` collisions, in two components, as a square."""
    comp, side = (data.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("comp", "side"))
    n = len(comp)
    sig = data.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    hits = np.zeros((n, n), np.uint8)
    for k in range(sig.shape[1]):
        hits += sig[:, k, None] == sig[None, :, k]
    ok = (hits >= least) & (comp[:, None] != comp[None, :])
    if side.max(initial=0) > 0:
        ok &= side[:, None] != side[None, :]
    return ok


#: Rows of block pairs, without signatures and shingles.
PLACED = ["rep", "comp", "token", "i", "j", "side"]


def _block_met(least: int) -> Callable[[pa.Table], pa.Table]:
    """Kernel: the rows of a block pair that collide often enough with another, so that only their shingles are sent."""

    def run(data: pa.Table) -> pa.Table:
        return data.select(PLACED).filter(pa.array(_candidates(data, least).any(axis=0)))

    return run


def _block_links(link: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """Kernel: spanning links between components of a block pair, rows (rep, comp, side, sig, shingles), sides 0 and 1, or 0 alone.

    Collisions of all pairs are counted first; what has ``least`` of them, in two components, is confirmed on full sets.
    """

    def run(data: pa.Table) -> pa.Table:
        reps, comp = (data.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "comp"))
        ok = _candidates(data, least)
        if not ok.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        own = np.flatnonzero(ok.any(axis=0))
        ok = ok[np.ix_(own, own)]
        reps, comp = reps[own], comp[own]
        lists = data.column("shingles").combine_chunks().take(pa.array(own))
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(own)), size)
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        row, at = row[shared], at[shared]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        _, at = np.unique(at, return_inverse=True)
        common = np.zeros((len(own), len(own)), np.float32)
        edges = np.searchsorted(at, np.arange(0, (at[-1] if len(at) else 0) + 2048, 2048))
        for lo, hi in zip(edges[:-1], edges[1:]):
            m = np.zeros((len(own), 2048), np.float32)
            m[row[lo:hi], at[lo:hi] % 2048] = 1
            common += m @ m.T
        ok &= 100 * common >= link * (size[:, None] + size[None, :] - common)
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1)))):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(int(reps[i]))
                b.append(int(reps[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(m, w, block: int, block_rows: int):
    """Number of blocks for ``m`` documents of ``w`` shingles."""
    return F.greatest(F.ceil(w / block), F.ceil(m / block_rows), F.lit(1)).cast("int")


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    """By ``key``: documents and shingles (m, w), and those outside the component ``top`` (mo, wo)."""
    out = (F.col("comp") != F.col("top")).cast("long")
    return rows.groupBy(key, "top").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.sum(out).alias("mo"), F.sum(out * F.col("n")).alias("wo"))


def _across(lists: DataFrame, block: int, block_rows: int) -> DataFrame:
    """Block pairs, rows PLACED, of the lists (token, rep, n, comp) that hold several components.

    Only documents outside a list's largest component meet all others; those of the largest are one component and meet the
    outer ones alone. Lists with one largest component, which share most of their documents, are taken as one list where
    that makes fewer pairs; so no pair of near copies is met in every list of theirs.
    """
    each = lists.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "comp")).alias("x"), F.sum("m").alias("m"))
    each = each.filter("m > x.m").select("token", F.col("x.comp").alias("top"), (F.col("m") * (F.col("m") - F.col("x.m"))).alias("pairs"))
    joint = _sizes(lists.join(each, "token").select("rep", "n", "comp", "top").distinct().withColumn("one", F.lit(1)), "one").join(each.groupBy("top").agg(F.sum("pairs").alias("pairs")), "top")
    keys = each.select("token", "top").join(joint.filter("m * mo <= pairs").select("top", F.col("top").alias("key")), "top", "left").select("token", "top", F.coalesce("key", "token").alias("key"))
    rows = lists.join(keys, "token").select("key", "top", "rep", "n", "comp").distinct()
    m, w, mo, wo = map(F.col, ("m", "w", "mo", "wo"))
    parts = _sizes(rows, "key").select("key", "top", _blocks(mo, wo, block, block_rows).alias("outer"), _blocks(m - mo, w - wo, block, block_rows).alias("inner"))
    met, hashed, inside = rows.join(parts, ["key", "top"]), F.xxhash64("rep"), F.col("comp") == F.col("top")
    own = F.when(inside, F.col("outer") + F.pmod(hashed, F.col("inner"))).otherwise(F.pmod(hashed, F.col("outer"))).cast("int")
    last = F.col("outer") + F.when(inside, 0).otherwise(F.col("inner")) - 1
    met = met.select(F.col("key").alias("token"), "rep", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select("rep", "comp", "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _blocked(placed: DataFrame, of: DataFrame, sets: DataFrame, link: int, least: int) -> DataFrame:
    """Spanning links of block pairs, rows PLACED: signatures are sent first, shingles only of rows that collide often enough."""
    placed = placed.select(*PLACED)
    met = materialize(placed.join(_grows(of), "rep").groupBy("token", "i", "j").applyInArrow(_block_met(least), placed.schema), "met")
    sweep(placed.sparkSession)
    links = materialize(met.join(_grows(sets.join(_grows(of), "rep")), "rep").groupBy("token", "i", "j").applyInArrow(_block_links(link, least), "a long, b long"), "blocked")
    discard(met)
    sweep(placed.sparkSession)
    return links


def _prefix_lists(items: DataFrame, least: int) -> DataFrame:
    """(token, rep, n, central) postings of the prefixes; ``central`` grows with how often a document's tokens occur."""
    tokens = items.select("rep", "n", F.posexplode("sig").alias("k", "v")).select("rep", "n", (F.shiftleft(F.col("k").cast("long"), 32) + (F.col("v").cast("long") + (1 << 31))).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    of_doc = tokens.join(_grows(often), "token").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x")).filter(F.size("x") >= least)
    central = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.log(x.df.cast("double")))
    return of_doc.select("rep", "n", central.alias("central"), F.explode(F.slice("x", F.lit(1), F.size("x") - (least - 1))).alias("p")).select(F.col("p.token").alias("token"), "rep", "n", "central")


def link_components(docs: DataFrame, link: int = LINK, block: int = BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and set_rep, the item of equal sets) of every document.

    Documents link with 100 * intersection >= ``link`` * union of their shingle sets. Null and blank
    texts have the empty set and link with nothing; equal sets always link, however many copies there
    are. Rows that share a doc_id are one node, linked by any of their texts; rows with a null doc_id
    link with nothing and have a null component. Other columns are ignored.
    """
    least, spark = least_matches(link), docs.sparkSession
    sig = materialize(signatures(docs), "signatures")
    usable = sig.filter("n > 0 and doc_id is not null")
    # Items are distinct sets, named by their smallest doc_id, or by a number beyond all ids where that id has several sets.
    several = usable.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("rep"))
    several = materialize(several, "several")
    items = usable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x")).select("h1", "h2", F.col("x.doc_id").alias("rep"), "x.n", "x.sig")
    again = several.select("rep", F.lit(True).alias("again"))
    items = items.join(again, "rep", "left").select("h1", "h2", F.col("rep").alias("first"), F.when(F.col("again"), F.monotonically_increasing_id() + EXTRA).otherwise(F.col("rep")).alias("rep"), "n", "sig")
    items = materialize(items, "items")
    same_id = usable.select("doc_id", "h1", "h2").join(several.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").distinct().join(items.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    lists = materialize(_prefix_lists(items.select("rep", "n", "sig"), least), "lists")
    sweep(spark)
    wanted = lists.select("rep").distinct().join(items.select("rep", "first", "h1", "h2"), "rep").select(F.col("first").alias("doc_id"), "rep", "h1", "h2")
    parts = []
    for k in range(ROUNDS):
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k
        own = wanted.filter(mine)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(mine).join(_grows(own.select("doc_id").distinct()), "doc_id", "left_semi")
        part = shingle_sets(texts).join(own, ["doc_id", "h1", "h2"]).select("rep", "shingles").dropDuplicates(["rep"])
        parts.append(materialize(part, "sets"))
        sweep(spark)
    sets = reduce(DataFrame.union, parts)
    of = items.select("rep", "sig")

    # First pass: each document against the most central member of its lists, the best of these by collisions.
    head = lists.groupBy("token").agg(F.max(F.struct("central", (-F.col("rep")).alias("r"))).alias("x"), F.count("*").alias("m")).filter("m > 1").select("token", (-F.col("x.r")).alias("b"))
    met = lists.select("token", F.col("rep").alias("a"), F.col("n").alias("na")).join(head, "token").filter("a <> b").select("a", "b").distinct()
    met = met.join(of.select(F.col("rep").alias("b"), F.col("sig").alias("tb")), "b").join(of.select(F.col("rep").alias("a"), F.col("sig").alias("ta")), "a")
    best = met.select("a", "b", _collisions("ta", "tb").alias("c")).filter(F.col("c") >= least).groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("r"))).alias("x")).select("a", (-F.col("x.r")).alias("b"))
    links = materialize(_confirm(best, sets, link).union(same_id), "links")
    sweep(spark)
    first = connected_components(links)

    # Second pass: lists that hold several components.
    labelled = lists.select("token", "rep", "n").join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    labelled = materialize(labelled, "labelled")
    discard(lists)
    open_lists = labelled.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token", "m", "w")
    rest = materialize(labelled.join(open_lists, "token"), "open")
    discard(labelled)
    sweep(spark)
    x, y = rest.filter(F.col("m") <= SHORT_LIST).alias("x"), rest.filter(F.col("m") <= SHORT_LIST).alias("y")
    near = x.join(y, F.expr(f"x.token = y.token and x.rep < y.rep and x.comp <> y.comp and {_fits('x.n', 'y.n', link)}")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    near = near.join(of.select(F.col("rep").alias("b"), F.col("sig").alias("tb")), "b").join(of.select(F.col("rep").alias("a"), F.col("sig").alias("ta")), "a").filter(_collisions("ta", "tb") >= least)
    pairs = materialize(_confirm(near, sets, link), "pairs")
    sweep(spark)

    # Long lists: those of one block first; what they unite need not meet in the lists of several blocks.
    long = rest.filter(F.col("m") > SHORT_LIST).select("token", "rep", "n", "comp", _blocks(F.col("m"), F.col("w"), block, block_rows).alias("blocks"))
    single = long.filter("blocks = 1").select("rep", "comp", "token", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    found, cut = [links, pairs, _blocked(single, of, sets, link, least)], long.filter("blocks > 1")
    if not cut.isEmpty():
        merged = connected_components(reduce(DataFrame.union, found))
        cut = cut.select("token", "rep", "n").join(merged.select(F.col("node").alias("rep"), "component"), "rep", "left")
        cut = materialize(cut.select("token", "rep", "n", F.coalesce("component", "rep").alias("comp")), "cut")
        discard(merged)
        found.append(_blocked(_across(cut, block, block_rows), of, sets, link, least))
        discard(cut)
    discard(rest, *parts)
    sweep(spark)
    everything = connected_components(reduce(DataFrame.union, found))
    discard(*found, first)

    groups = items.select("h1", "h2", "rep").join(everything.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("component"))
    found = sig.select("doc_id", "n", "h1", "h2").join(groups, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("rep", "doc_id").alias("set_rep")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = materialize(out, "components")
    discard(sig, several, items, everything)
    sweep(spark)
    return out
