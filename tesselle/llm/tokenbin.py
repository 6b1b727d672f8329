"""Token-id shards as seekable zstandard files.

A shard is a run of independent zstandard frames, one per document, followed by two skippable
frames: the ids of the documents in frame order, and a seek table (compressed size, raw size and
a checksum of every frame, then a fixed footer). A reader fetches the footer, the seek table and
then only the byte ranges of the frames it wants; each is verified by its own checksum. The seek
table has the published layout of the zstandard seekable format, so other readers of that format
can open the shards too.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.llm.memory import Memory, tidy
from tesselle.llm.storage import filesystem, new_path, text_rows

# Fixed values of the seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FLAG_CHECKSUM = 0x80

#: Fixed value: the split of a byte-level vocabulary's pre-tokenizer.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_table() -> dict[int, str]:
    """Printable stand-ins that byte-level vocabularies use for the 256 byte values."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BLANK = _byte_table()[32]


#: Kinds of characters that the split tells apart.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters of a text that are one run, and of the runs that are handled together, at most about.
RUN, GROUP = 1 << 18, 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point, by the classes of PRETOKEN."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def starts(text: str) -> np.ndarray:
    """Places where the pre-tokens of a text begin, the split of PRETOKEN found for all places at once.

    A pre-token is a run of one kind, with the blank before it if there is one. Of white space before
    another kind the last character stands apart, or is that blank. An apostrophe that begins a
    pre-token takes the endings s, t, m, d, re, ve and ll with it.
    """
    ch = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[ch]
    first = np.ones(len(ch), bool)
    before, own = kind[:-1], kind[1:]
    first[1:] = np.where(before == SPACE, np.where(own == SPACE, False, ch[:-1] != 32), before != own)
    first[:-1] |= (before == SPACE) & (own != SPACE)
    for i in np.flatnonzero((ch == 39) & first).tolist():
        if i and text[i - 1] == " " and not first[i]:
            continue
        n = 1 if text[i + 1 : i + 2] in ("s", "t", "m", "d") else 2 if text[i + 1 : i + 3] in ("re", "ve", "ll") else 0
        if n:
            first[i + 1 : i + 1 + n] = False
            first[i + 1 + n : i + 2 + n] = True
    return np.flatnonzero(first)


class UnitEncoder(Memory):
    """Encodes texts by a tokenizers file; pre-tokens are remembered as packed ids.

    Pre-tokens are encoded on their own by the library's model, as the library does. Texts are encoded
    together: each distinct pre-token of a group is looked up once, told by a hash and then compared
    character by character, and the ids are gathered in one step. Texts that hold a special token's
    string go through the library as a whole, which gives such a string the token's id.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__(most)
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)").search
        table = _byte_table()
        self.table = [table[b] for b in range(256)]

    def make(self, p: str) -> bytes:
        """Packed ids of one pre-token."""
        if p.isascii():
            spelled = p if p.isalpha() else BLANK + p[1:] if p[0] == " " and p[1:].isalpha() else "".join(map(self.table.__getitem__, p.encode()))
        else:
            spelled = "".join(map(self.table.__getitem__, p.encode("utf-8", "surrogatepass")))
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str, run: int = RUN) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text], run)[0]

    def encode_all(self, texts: list[str | None], run: int = RUN, group: int = GROUP) -> list[bytes]:
        """Ids of whole texts; null texts have none."""
        out: list[list[bytes]] = [[] for _ in texts]
        own, runs, size = [], [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.special(text):
                ids = self.tok.encode(text, add_special_tokens=False).ids
                out[k].append(struct.pack(f"<{len(ids)}I", *ids))
                continue
            for part in [text] if len(text) <= run else _runs(text, run):
                if runs and size + len(part) > group:
                    for j, ids in zip(own, self._group(runs)):
                        out[j].append(ids)
                    own, runs, size = [], [], 0
                own.append(k)
                runs.append(part)
                size += len(part)
        for j, ids in zip(own, self._group(runs) if runs else []):
            out[j].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _group(self, runs: list[str]) -> list[bytes]:
        text = "".join(runs)
        split = [starts(t) for t in runs]
        count, length = np.array([len(x) for x in split]), np.array([len(t) for t in runs])
        at = np.concatenate(split) + np.repeat(np.cumsum(length) - length, count)
        size = np.diff(at, append=len(text))
        ch = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        power, inverse = _powers(max(GROUP, 1 << (len(ch) - 1).bit_length()))
        total = np.cumsum((ch + np.uint64(1)) * power[: len(ch)], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), total])
        coded = pa.array((before[at + size] - before[at]) * inverse[at]).dictionary_encode()
        code = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        same = at[first][code]
        if (size != size[first][code]).any() or (ch[np.arange(len(ch)) + np.repeat(same - at, size)] != ch).any():
            bounds = [*at.tolist(), len(text)]  # two strings of one hash
            ids = list(map(self.__getitem__, (text[a:b] for a, b in zip(bounds, bounds[1:]))))
            ends = np.cumsum(count)
            return [b"".join(ids[b - n : b]) for n, b in zip(count, ends)]
        a = at[first]
        ids = [self[text[i:j]] for i, j in zip(a.tolist(), (a + size[first]).tolist())]
        flat, n = np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) for x in ids]) // 4
        wide = n[code]
        ends = np.cumsum(wide)
        packed = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(n) - n)[code] - (ends - wide), wide)].tobytes()
        last = 4 * ends[np.cumsum(count) - 1]
        return [packed[i:j] for i, j in zip([0, *last[:-1].tolist()], last.tolist())]


def _runs(text: str, most: int) -> Iterator[str]:
    """A text in runs of about ``most`` characters, cut before single blanks, where a pre-token always begins."""
    at = 0
    while len(text) - at > most:
        m = _BETWEEN.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(maxsize=1)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


class ShardWriter:
    """Streams frames to an open binary file; memory holds one document and 24 bytes for each earlier one."""

    def __init__(self, out, level: int = 1):
        import zstandard
        from xxhash import xxh64_intdigest

        self.out, self.hash, self.cctx = out, xxh64_intdigest, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.ids, self.table = [], bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.cctx.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table += struct.pack("<III", len(frame), len(ids), self.hash(ids) & 0xFFFFFFFF)

    def close(self) -> None:
        index = pa.array(self.ids, pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as w:
            w.write_batch(pa.record_batch([index], ["doc_id"]))
        body = self.cctx.compress(sink.getvalue())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        seek = bytes(self.table) + struct.pack("<IBI", len(self.ids), FLAG_CHECKSUM, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class ShardReader:
    """Random access to a shard; ``file`` needs seek, read and size."""

    def __init__(self, file):
        import zstandard
        from xxhash import xxh64_intdigest

        self.file, self.hash, self.dctx = file, xxh64_intdigest, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER_MAGIC or not flags & FLAG_CHECKSUM:
            raise ValueError("not a seekable shard with checksums")
        at = size - 9 - 12 * n - 8
        file.seek(at)
        head = struct.unpack("<II", file.read(8))
        if head != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype("int64")
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        file.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("the document index is damaged")
        with pa.ipc.open_stream(self.dctx.decompress(file.read(length))) as r:
            self.doc_ids = r.read_all().column(0).to_pylist()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def frame(self, k: int) -> bytes:
        """Ids of the k-th document; only its frame is read and decompressed."""
        size, raw, check = (int(x) for x in self.table[k])
        self.file.seek(int(self.at[k]))
        got = self.dctx.decompress(self.file.read(size), max_output_size=raw) if raw else b""
        if len(got) != raw or self.hash(got) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return got


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, batch: int = 512) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into seekable shards under ``out``; returns their manifest.

    Range partitions of doc_id become shards, so that shard number and frame number follow
    ascending doc_id; rows of one doc_id follow their text's hash. Null texts encode as empty,
    null ids come first, extra columns are ignored. Tasks write under a name of their own and
    rename at the end, so a repeated or speculative attempt leaves whole files only; drafts that
    failed attempts left are deleted. The manifest (shard, path, n_docs, n_ids, least and most doc_id;
    a row for each shard) is itself a table beside the shards.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, end = unit_encoder(tokenizer_path), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        fs, base = filesystem(out)
        writer = file = None
        n_docs = n_ids = 0
        lo = hi = None
        draft, final = f"{base}/draft-{uuid.uuid4().hex}", f"{base}/shard-{shard:06d}.zst"
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1).to_pylist())):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        file = fs.open_output_stream(draft)
                        writer = ShardWriter(file)
                    ids += end
                    writer.add(doc_id, ids)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4
                    lo, hi = (doc_id if lo is None else lo), doc_id
        if writer is not None:
            writer.close()
            file.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{out}/shard-{shard:06d}.zst", "n_docs": n_docs, "n_ids": n_ids, "least": lo, "most": hi}], schema=pa.schema([(c, pa.string() if c == "path" else pa.int64()) for c in ("shard", "path", "n_docs", "n_ids", "least", "most")]))

    ordered = text_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(tidy(encode), "shard long, path string, n_docs long, n_ids long, least long, most long").write.mode("overwrite").parquet(f"{out}/manifest")
    fs, base = filesystem(out)
    for f in fs.get_file_info(FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith("draft-"):
            fs.delete_file(f.path)
    return spark.read.parquet(f"{out}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens and a checksum of its ids.

    Starts come from a running sum over the manifest, which has one row for each shard.
    """
    n = max(1, manifest.count())
    base = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    r, start = ShardReader(f), row["base"]
                    for k in range(0, len(r), 4096):
                        out = {"doc_id": r.doc_ids[k : k + 4096], "start": [], "n_tokens": [], "ids_crc32": []}
                        for j in range(k, min(len(r), k + 4096)):
                            ids = r.frame(j)
                            out["start"].append(start)
                            out["n_tokens"].append(len(ids) // 4)
                            out["ids_crc32"].append(zlib.crc32(ids))
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    return base.select("path", "base").repartition(n).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few requested documents. Tasks open only the shards whose range holds one and read only its frames."""
    want = sorted(set(doc_ids))
    if not want:
        return {}
    holds = F.exists(F.array(*[F.lit(d).cast("long") for d in want]), lambda d: (d >= F.col("least")) & (d <= F.col("most")))
    holds = holds | F.col("least").isNull() & (F.col("most") >= want[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, path = filesystem(path)
                with fs.open_input_file(path) as f:
                    r = ShardReader(f)
                    got = [(d, r.frame(k)) for k, d in enumerate(r.doc_ids) if d in want]
                yield pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in got], "ids": [x for _, x in got]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    found = manifest.filter(holds).select("path").mapInArrow(read, "doc_id long, ids binary")
    return {r.doc_id: list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in found.toLocalIterator()}


def tokenize_to_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write shards to the shared folder and return what a reader finds in them."""
    spark: SparkSession = docs.sparkSession
    return read_shards(write_shards(docs, tokenizer_path, new_path(spark, "shards"), end_id))
