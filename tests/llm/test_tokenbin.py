import random
import struct
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from tesselle.llm import tokenbin
from tesselle.llm.queries import tokenizer_file
from tesselle.llm.storage import new_path

FILE = tokenizer_file("byte_bpe_50k.json")
TEXTS = ["a  b", " a b ", "a\n b", "x's don't 12 3  4 \x1c y", "", "  ", "\n", "é  ü", "<|endoftext|> hi", "a. b, c.. d,", "ab.\ncd ef", "日本 語 \U0001f600", "word " * 5000]


@lru_cache(maxsize=1)
def library():
    """The library as it is, loaded apart from the operator."""
    return Tokenizer.from_file(FILE)


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_units_equal_the_library():
    e = tokenbin.UnitEncoder(FILE, most=3)
    for t in TEXTS * 2:
        ids = whole(t)
        assert e.encode(t) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("alphabet", [["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "1", "日", "\t", "the", "_"], ["a", " ", ".", "\n", "<|endoftext|>", "<|", "|>", "endoftext", "x"]])
def test_random_strings_equal_the_library(alphabet):
    e, rng = tokenbin.UnitEncoder(FILE, most=500), random.Random(8)
    for _ in range(20_000):
        t = "".join(rng.choices(alphabet, k=rng.randrange(12)))
        ids = whole(t)
        assert e.encode(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_split_equals_the_pattern():
    import regex

    pattern, rng = regex.compile(tokenbin.PRETOKEN), random.Random(12)
    alphabet = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "'", "'s", "'re", "'ll", "'v", "s", "t", "re", "ll", "é", "日", "Ⅷ", "½", "7", "!", "--", "\x1c", "\u0301", "\U0001f600", "a"]
    for _ in range(30_000):
        t = "".join(rng.choices(alphabet, k=rng.randrange(1, 12)))
        assert tokenbin.starts(t).tolist() == [m.start() for m in pattern.finditer(t)], repr(t)


def test_runs_of_long_texts():
    e, rng = tokenbin.UnitEncoder(FILE), random.Random(13)
    for _ in range(300):
        t = "".join(rng.choices(["a", "b ", " ", "  c", "\n", "'s ", ". "], k=400))
        assert e.encode(t, 7) == e.encode(t) and "".join(tokenbin._runs(t, 7)) == t


def test_texts_together_equal_texts_alone(monkeypatch):
    e, rng = tokenbin.UnitEncoder(FILE, most=50), random.Random(14)
    texts = ["".join(rng.choices(["a", "b ", " ", "é", "\n", "the ", "\x00", "日本", "\U0001f600", "'s ", "<|endoftext|>", ". "], k=rng.randrange(30))) for _ in range(400)] + [None, "", *TEXTS]
    want = [struct.pack(f"<{len(whole(t))}I", *whole(t)) for t in texts]
    for group in (1, 40, 10**6):
        assert e.encode_all(texts, 25, group) == want
    monkeypatch.setattr(tokenbin, "_powers", lambda n: (np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)))  # hashes that collide
    assert e.encode_all(texts) == want


def test_shards_read_back(spark, odd):
    got = tokenbin.tokenize_to_shards(odd, FILE).collect()
    assert len(got) == 10
    start = 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*whole(texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert tokenbin.tokenize_to_shards(odd.limit(0), FILE).count() == 0


def test_lookup_reads_single_frames_and_damage_is_found(spark, documents, tmp_path):
    out = new_path(spark, "t")
    m = tokenbin.write_shards(documents([(i, t) for i, t in enumerate(TEXTS)]), FILE, out)
    assert tokenbin.lookup(m, [7, 3]) == {k: [*whole(TEXTS[k]), 0] for k in (3, 7)}
    assert tokenbin.lookup(m, []) == {} == tokenbin.lookup(m, [10**6]) and tokenbin.filesystem(out)[0].get_file_info(fs.FileSelector(tokenbin.filesystem(out)[1]))
    path = tokenbin.filesystem(m.first().path)[1]
    data = bytearray(open(path, "rb").read())
    data[12] ^= 255
    bad = tmp_path / "bad.zst"
    bad.write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(bad)) as f:
        r = tokenbin.ShardReader(f)
        with pytest.raises(Exception):
            [r.frame(k) for k in range(len(r))]


def test_frames_are_plain_zstandard(spark, documents):
    import zstandard

    m = tokenbin.write_shards(documents([(1, "hello world"), (2, "again")]), FILE, new_path(spark, "z"))
    raw = b"".join(open(tokenbin.filesystem(r.path)[1], "rb").read() for r in m.collect())
    got = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    ids = [*whole("hello world"), 0, *whole("again"), 0]
    assert got == struct.pack(f"<{len(ids)}I", *ids)
