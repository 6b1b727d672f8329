"""SentencePiece encoding and decoding by a max-plus scan.

The best segmentation of a text under a model's piece scores is a longest path. A text is cut every
``CHUNK`` characters; a chunk's transfer matrix holds, for every state at its left edge (how many of
its first characters a piece from the left already covers) and every state at its right edge (how
many characters its last piece reaches beyond it), the best score between them. Matrices combine
associatively in the (max, +) semiring, so a tree of products goes up over a document's chunks, the
boundary states of the best path come down the same tree, and then every chunk is traced back on its
own. Up to ``BLOCK`` characters of a document are scanned by one task; blocks of a longer one are
rows, scanned by the same tree over groups of ``FAN`` rows, so a giant document is encoded by many
tasks and none of them gathers more than ``FAN`` matrices.

Of equal scores the path wins whose last piece starts first, then the one before it, and so on, as
in the library's lattice. Each matrix entry therefore has a rank among the entries of its column,
and the ranks of a product follow from those of its factors.

Between two characters that no piece joins a cut is exact, so within a chunk the units between such
cuts are solved on their own, and short ones remembered. The segmentation is the one the library
gives for the same pieces loaded as a unigram model (sums here are in double precision; the
library's are in single, which shows after a character that no piece covers). Characters no piece
covers cost the lowest score less 10 and become byte pieces. The public vocabulary file was made by
pair merges; its merge order is no longest path, so ids differ from the library's merge encoding of
that file, while decoding gives back the same text.

Null texts encode like empty ones: no ids. Rows are encoded one by one: repeated rows and null ids
count like others; columns not named in ``keep`` are ignored.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.memory import Memory, tidy
from tesselle.llm.storage import materialize, text_rows

MARK = "▁"
#: Piece types of a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
#: Characters of a chunk and of a block; rows that one step of the scan over blocks combines.
CHUNK, BLOCK, FAN = 4096, 65536, 64

#: Entry state -> exit state -> (score, rank of the entry among the entries that lead to this exit).
Matrix = dict[int, dict[int, tuple[float, int]]]


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.pieces = [p.piece for p in m.pieces]
        self.kind = [p.type for p in m.pieces]
        self.score: dict[str, tuple[float, int]] = {p.piece: (p.score, i) for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER)}
        self.longest = max((len(p) for p in self.score), default=1)
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = [0] * 256
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        #: characters that are pieces themselves, and pieces by their characters
        self.single = {p for p in self.score if len(p) == 1}
        self.trie = self._branch(sorted(self.score), 0)

    def _branch(self, pieces: list[str], depth: int) -> dict | None:
        """Next character -> (branch or None, score, id or -1) of sorted pieces that agree in their first ``depth`` characters."""
        out, k = {}, 0
        while k < len(pieces):
            c, j = pieces[k][depth], k
            while j < len(pieces) and pieces[j][depth] == c:
                j += 1
            score, own = self.score[pieces[k]] if len(pieces[k]) == depth + 1 else (NEVER, -1)
            out[c] = (self._branch(pieces[k + (own >= 0) : j], depth + 1), score, own)
            k = j
        return out or None

    def prepare(self, text: str | None) -> str:
        """The text as pieces spell it: blanks as marks, one mark in front."""
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)


def combine(a: Matrix, b: Matrix) -> Matrix:
    """(max, +) product of two transfer matrices with ranks; associative."""
    out: Matrix = {}
    order: dict[int, list[tuple[int, int, int]]] = {}
    for i, row in a.items():
        got: dict[int, tuple[float, int, int]] = {}
        for k, (x, place) in row.items():
            for j, (y, rank) in b.get(k, {}).items():
                old = got.get(j)
                if old is None or (x + y, -rank) > (old[0], -old[1]):
                    got[j] = (x + y, rank, place)
        out[i] = {j: (z, 0) for j, (z, _, _) in got.items()}
        for j, (_, rank, place) in got.items():
            order.setdefault(j, []).append((rank, place, i))
    for j, entries in order.items():
        for place, (_, _, i) in enumerate(sorted(entries)):
            out[i][j] = (out[i][j][0], place)
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """Product of a run of matrices, as the root of a balanced tree."""
    level = matrices
    while len(level) > 1:
        level = [combine(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def states(matrices: list[Matrix], entry: int = 0, leave: int = 0) -> list[int]:
    """States at every boundary of a run of matrices on the best path from ``entry`` to ``leave``.

    Up: a tree of products. Down: a node that knows its outer states chooses the one between its halves.
    """
    if not matrices:
        return [entry]
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combine(*below[k : k + 2]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    at = [entry, leave]
    for below in levels[-2::-1]:
        wider = []
        for k in range(0, len(below), 2):
            i, j = at[k // 2], at[k // 2 + 1]
            wider.append(i)
            if k + 1 < len(below):
                left, right = below[k][i], below[k + 1]
                wider.append(min((s for s in left if j in right.get(s, {})), key=lambda s: (-(left[s][0] + right[s][j][0]), right[s][j][1])))
        at = [*wider, leave]
    return at


class Encoder(Memory):
    """Solves texts by a model; units between characters that no piece joins are remembered as packed ids."""

    def __init__(self, path: str, most: int = 100_000):
        super().__init__(most)
        self.v = v = Vocabulary(path)
        self.id_score = [
            v.score[p][0] if p in v.score else (0.0 if 0x80 <= int(p[3:-1], 16) < 0xC0 else v.unknown) if kind == BYTE else 0.0 for p, kind in zip(v.pieces, v.kind)
        ]
        self.spelled = [
            bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode("utf-8", "surrogatepass") if kind in (NORMAL, USER) else b""
            for p, kind in zip(v.pieces, v.kind)
        ]
        pairs = {ab for p in v.score for ab in zip(p, p[1:])}
        inner = sorted({c for ab in pairs for c in ab})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.width = len(inner) + 1
        self.joined = np.zeros(self.width * self.width, bool)
        self.joined[[int(self.classes[ord(a)]) * self.width + int(self.classes[ord(b)]) for a, b in pairs]] = True

    def cuts(self, s: str) -> list[int]:
        """Places between two characters that no piece joins."""
        c = self.classes[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        return (np.flatnonzero(~self.joined[c[:-1] * self.width + c[1:]]) + 1).tolist()

    def make(self, s: str) -> bytes:
        """Ids of a unit, solved as one lattice; of equal scores the earliest start wins."""
        n, trie, single, longest, unknown = len(s), self.v.trie or {}, self.v.single, self.v.longest, self.v.unknown
        if n == 1:
            got = self.v.score.get(s)
            ids = [got[1]] if got else [self.v.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
            return struct.pack(f"<{len(ids)}I", *ids)
        best, back, made = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, branch, j = best[i], trie, i
            for c in s[i : i + longest]:
                node = branch.get(c)
                if node is None:
                    break
                j += 1
                branch, score, piece = node
                if here + score > best[j]:
                    best[j], back[j], made[j] = here + score, i, piece
                if branch is None:
                    break
            if s[i] not in single and here + unknown > best[i + 1]:
                best[i + 1], back[i + 1], made[i + 1] = here + unknown, i, -1
        ids: list[int] = []
        j = n
        while j:
            i = back[j]
            if made[j] >= 0:
                ids.append(made[j])
            else:
                ids += [self.v.byte_ids[b] for b in reversed(s[i:j].encode("utf-8", "surrogatepass"))]
            j = i
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def units(self, s: str) -> bytes:
        """Ids of a prepared text whose edges are exact cuts."""
        if not s:
            return b""
        at = self.cuts(s)
        return b"".join(map(self.__getitem__, [s[a:b] for a, b in zip([0, *at], [*at, len(s)])]))

    def _forward(self, s: str, start: int, stop: int, base: tuple | None = None) -> tuple[dict[int, float], dict[int, int], float, int]:
        """Lattice from ``start``: scores, back pointers, and where and how far it runs apart from ``base``.

        Once as many scores in a row as the longest piece has characters differ from base's by the same
        amount, all that follows does, and the lattice ends.
        """
        trie, longest, unknown, n = self.v.trie or {}, self.v.longest, self.v.unknown, len(s)
        best: dict[int, float] = {start: 0.0}
        back: dict[int, int] = {}
        apart, run = 0.0, 0
        for i in range(start, stop):
            here = best[i]
            if base is not None:
                d = here - base[0][i]
                run = run + 1 if run and d == apart else 1
                apart = d
                if run >= longest:
                    return best, back, apart, i
            branch, j = trie, i
            for c in s[i : i + longest]:
                node = branch.get(c)
                if node is None:
                    break
                j += 1
                branch, score, _ = node
                if here + score > best.get(j, NEVER):
                    best[j], back[j] = here + score, i
                if branch is None:
                    break
            if s[i] not in self.v.single and here + unknown > best.get(i + 1, NEVER):
                best[i + 1], back[i + 1] = here + unknown, i
        return best, back, 0.0, n

    def transfer(self, s: str, length: int, entries: range | list[int]) -> Matrix:
        """Matrix of s[:length] solved as one lattice; s goes on by what a piece may reach."""
        entries = list(entries)
        base = self._forward(s, entries[0], length) if entries and entries[0] < length else None
        paths = {e: base if e == entries[0] else self._forward(s, e, length, base) if e < length else ({e: 0.0}, {}, 0.0, len(s)) for e in entries}
        common = max((p[3] for e, p in paths.items() if e != entries[0]), default=0)

        def trail(e: int, p: int) -> tuple[int, ...]:
            """Starts of the pieces back from p, below all differences; -1 stands for a piece from further left."""
            _, back, _, met = paths[e]
            out = [p]
            while p != e:
                p = base[1][p] if p > met else back[p]
                out.append(p)
            return (*out, -1)

        out: Matrix = {e: {} for e in entries}
        for j in range(length, len(s) + 1):
            score, low = {}, j
            for e, (best, _, apart, met) in paths.items():
                own = base[0].get(j) if base is not None and j > met else best.get(j)
                if own is not None and j >= e:
                    score[e] = own + apart if base is not None and j > met else own
            if not score:
                continue
            if base is not None:
                while low > common:
                    low = base[1][low]
            order = sorted(score, key=lambda e: trail(e, low)) if len(score) > 1 else score
            for place, e in enumerate(order):
                out[e][j - length] = (score[e], place)
        return out

    def _trace(self, s: str, length: int, entry: int, leave: int) -> bytes:
        """Ids of the best path through s[:length] between two states, solved as one lattice."""
        if entry >= length:
            return b""
        back, j = self._forward(s, entry, length)[1], length + leave
        ids: list[int] = []
        while j > entry:
            i = back[j]
            got = self.v.score.get(s[i:j])
            ids += [got[1]] if got is not None else [self.v.byte_ids[b] for b in reversed(s[i:j].encode("utf-8", "surrogatepass"))]
            j = i
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, s: str, length: int) -> tuple[Matrix, Callable[[int, int], bytes]]:
        """Transfer matrix of the chunk s[:length], and its trace between two boundary states.

        Only what stands before the first and behind the last exact cut depends on the states.
        """
        at = [0, *(k for k in self.cuts(s) if k <= length)] if length else [0]
        if len(s) == length and at[-1] != length:
            at.append(length)
        entries = range(min(self.v.longest, len(s) + 1))
        if len(at) < 2:
            return self.transfer(s, length, entries), lambda e, x: self._trace(s, length, e, x)
        first, last = at[1], at[-1]
        middle = b"".join(map(self.__getitem__, [s[a:b] for a, b in zip(at[1:-1], at[2:])]))
        left = {e: row for e, row in self.transfer(s[:first], first, entries).items() if row}
        m = combine(left, {0: {0: (self.total(middle), 0)}})
        tail = s[last:]
        if length > last:
            m = combine(m, self.transfer(tail, length - last, [0]))

        def trace(e: int, x: int) -> bytes:
            return self._trace(s[:first], first, e, 0) + middle + (self._trace(tail, length - last, 0, x) if length > last else b"")

        return m, trace

    def block(self, s: str, length: int, entry: int = 0, leave: int = 0, chunk: int = CHUNK) -> bytes:
        """Ids of s[:length] between two boundary states; s goes on by what a piece may reach."""
        if length <= chunk and length == len(s) and entry == 0:
            return self.units(s)
        parts = self._chunks(s, length, chunk)
        at = states([m for m, _ in parts], entry, leave)
        return b"".join(trace(*at[k : k + 2]) for k, (_, trace) in enumerate(parts))

    def matrix(self, s: str, length: int, chunk: int = CHUNK) -> Matrix:
        """Transfer matrix of the block s[:length], the product over its chunks."""
        return product([m for m, _ in self._chunks(s, length, chunk)])

    def _chunks(self, s: str, length: int, chunk: int) -> list[tuple[Matrix, Callable[[int, int], bytes]]]:
        reach = self.v.longest - 1
        return [self.chunk(s[k : min(length, k + chunk) + reach], min(chunk, length - k)) for k in range(0, length, chunk)]

    def encode(self, text: str | None, chunk: int = CHUNK) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        s = self.v.prepare(text)
        return self.block(s, len(s), chunk=chunk)

    def total(self, ids: bytes) -> float:
        """Score of a segmentation; a character in bytes counts once, at its first byte."""
        a = array("I")
        a.frombytes(ids)
        return math.fsum(map(self.id_score.__getitem__, a))

    def decode(self, ids: bytes) -> str:
        """The text that ids spell: marks become blanks, byte pieces join to characters, the first blank goes."""
        a = array("I")
        a.frombytes(ids)
        text = b"".join(map(self.spelled.__getitem__, a)).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text

    def digest(self, ids: bytes, text_crc: int | None) -> tuple[int, int, bool]:
        """Pieces, checksum of the ids, and whether they decode to a text of the stated checksum."""
        return len(ids) // 4, zlib.crc32(ids), zlib.crc32(self.decode(ids).encode("utf-8", "surrogatepass")) == text_crc


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def dump(m: Matrix) -> str:
    return json.dumps(m)


def load(m: str) -> Matrix:
    return {int(i): {int(j): (x, place) for j, (x, place) in row.items()} for i, row in json.loads(m).items()}


#: Rows of a batch that a worker handles and sends on together, at most.
ROWS = 64


def encode(docs: DataFrame, model_path: str, keep: list[str] | None = None, chunk: int = CHUNK, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Columns ``keep`` (default doc_id) with n_chunks and ids (binary) of each whole text."""
    return _encode(docs, model_path, keep or ["doc_id"], "ids binary", lambda enc, ids, part: [pa.array(ids, pa.binary())], chunk, block, fan)


def encode_digest(docs: DataFrame, model_path: str, chunk: int = CHUNK, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """doc_id, n_chunks, n_pieces, ids_crc32 and round_trip (the ids decode to the text) of each whole text."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc.alias("text_crc32"))

    def finish(enc: Encoder, ids: list[bytes], part: pa.RecordBatch) -> list[pa.Array]:
        got = [enc.digest(x, c) for x, c in zip(ids, part.column("text_crc32").to_pylist())]
        return [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))]

    return _encode(rows, model_path, ["doc_id", "text_crc32"], "n_pieces long, ids_crc32 long, round_trip boolean", finish, chunk, block, fan).drop("text_crc32")


def _encode(docs: DataFrame, model_path: str, keep: list[str], made: str, finish: Callable, chunk: int, block: int, fan: int) -> DataFrame:
    """Columns ``keep`` with n_chunks and what ``finish(encoder, ids, rows)`` makes of the ids, in the same worker."""
    size = F.coalesce(F.length("text"), F.lit(0))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    names = [*keep, "n_chunks", *(x.split()[0] for x in made.split(", "))]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        front = int(enc.v.dummy_prefix)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = [enc.encode(t, chunk) for t in texts]
                n = pa.array([max(1, -(-(len(t or "") + front) // chunk)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n, *finish(enc, ids, part)], names=names)

    text_rows(docs)
    one_task = docs.filter(size <= block).select(*keep, F.col("text").alias("__text")).mapInArrow(tidy(whole), f"{fields}, n_chunks long, {made}")
    return one_task.unionByName(_encode_long(docs.filter(size > block), model_path, keep, fields, names, made, finish, chunk, block, fan))


def _encode_long(docs: DataFrame, model_path: str, keep: list[str], fields: str, names: list[str], made: str, finish: Callable, chunk: int, block: int, fan: int) -> DataFrame:
    v = Vocabulary(model_path)
    reach, front = v.longest - 1, v.dummy_prefix

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                s = row.column(row.num_columns - 1)[0].as_py().replace(" ", MARK)
                s = MARK + s if front else s
                for j in range(0, len(s), block):
                    last = min(len(s), j + block)
                    yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([j // block], pa.int64()), pa.array([-(-len(s) // chunk)], pa.int64()), pa.array([last - j], pa.int64()), pa.array([s[j : last + reach]])], names=["__row", *keep, "__k", "n_chunks", "__len", "__s"])

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *keep, F.col("text").alias("__text"))
    blocks = materialize(rows.mapInArrow(cut, f"__row long, {fields}, __k long, n_chunks long, __len long, __s string"), "blocks")
    spread = blocks.select("__row", "__k", "__s", "__len").repartition("__row", "__k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in batches:
            for row, k, s, n in zip(*(b.column(c) for c in ("__row", "__k", "__s", "__len"))):
                m = enc.matrix(s.as_py(), n.as_py(), chunk)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([k.as_py()], pa.int64()), pa.array([dump(m)])], names=["__row", "__k", "m"])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["__row"]], pa.int64()), pa.array([r["__up"]], pa.int64()), pa.array([dump(product([load(x["m"]) for x in r["ms"]]))])], names=["__row", "__k", "m"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = states([load(x["m"]) for x in r["ms"]], r["entry"], r["leave"])
                k = pa.array([x["__k"] for x in r["ms"]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r["__row"]] * len(k), pa.int64()), k, pa.array(at[:-1], pa.int64()), pa.array(at[1:], pa.int64())], names=["__row", "__k", "entry", "leave"])

    # Up the tree until every document is one matrix, then its states down again.
    def groups(level: DataFrame) -> DataFrame:
        return level.withColumn("__up", F.floor(F.col("__k") / fan)).groupBy("__row", "__up").agg(F.array_sort(F.collect_list(F.struct("__k", "m"))).alias("ms"))

    levels = [materialize(spread.mapInArrow(matrices, "__row long, __k long, m string"), "matrices")]
    while (levels[-1].agg(F.max("__k")).first()[0] or 0) >= fan:
        levels.append(materialize(groups(levels[-1]).mapInArrow(up, "__row long, __k long, m string"), "matrices"))
    edges = levels[-1].select("__row", F.lit(0).cast("long").alias("__up"), F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("leave")).distinct()
    for level in levels[::-1]:
        known = groups(level).join(edges, ["__row", "__up"])
        edges = known.mapInArrow(down, "__row long, __k long, entry long, leave long").withColumnRenamed("__k", "__up")
    edges = edges.withColumnRenamed("__up", "__k")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in batches:
            for k in range(b.num_rows):
                part = b.slice(k, 1)
                s, n, e, x = (part.column(c)[0].as_py() for c in ("__s", "__len", "entry", "leave"))
                yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("__k"), pa.array([enc.block(s, n, e, x, chunk)], pa.binary())], names=["__row", "__k", "ids"])

    traced = spread.join(edges, ["__row", "__k"]).mapInArrow(tidy(trace), "__row long, __k long, ids binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: the ids of a document's blocks follow one another; the first row has its columns."""
        enc = encoder(model_path)
        doc, ids = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*doc.columns, *finish(enc, [b"".join(ids)], doc)], names=names)

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                if row.column("__k")[0].as_py() == 0:
                    if doc is not None:
                        yield done()
                    doc, ids = row.select([*keep, "n_chunks"]), []
                ids.append(row.column("ids")[0].as_py())
        if doc is not None:
            yield done()

    whole = traced.join(blocks.select("__row", "__k", *keep, "n_chunks"), ["__row", "__k"]).select("__row", "__k", *keep, "n_chunks", "ids")
    return whole.repartition("__row").sortWithinPartitions("__row", "__k").mapInArrow(tidy(join), f"{fields}, n_chunks long, {made}")
