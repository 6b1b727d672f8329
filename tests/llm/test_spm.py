import random
import struct

import pytest

from tesselle.llm import spm
from tesselle.llm.queries import tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def enc():
    return spm.Encoder(FILE)


@pytest.fixture(scope="module")
def library():
    """The same pieces as a unigram model; the sentinel scores of blank runs are made small enough for single precision."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(FILE, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def ids(b):
    return [x for (x,) in struct.iter_unpack("<I", b)]


TEXTS = ["the quick brown fox", "Internationalization, of course.", "x", "un deux trois élève", "aaaa bbbb"]


def test_ids_equal_the_library(enc, library):
    rng = random.Random(3)
    for t in TEXTS + [" ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 12))) for _ in range(60)) for _ in range(30)]:
        got, want = ids(enc.encode(t)), library.encode(t)
        score = lambda x: sum(library.get_score(i) for i in x)
        assert got == want or score(got) == score(want)


def test_decoding_gives_the_text(enc):
    for t in [*TEXTS, "", "a  b", "  a", "a ", "日本語 \U0001f600 ok", "x\ty\n\nz", "." * 50, "a,b. c"]:
        assert enc.decode(enc.encode(t)) == t


def plain(v, s):
    """The best path of a whole prepared text by one lattice; of equal scores the last piece starts as early as it can, and so on."""
    best, back = [0.0], [0]
    for j in range(1, len(s) + 1):
        got = [(best[i] + v.score[s[i:j]][0], -i) for i in range(max(0, j - v.longest), j) if s[i:j] in v.score]
        if s[j - 1] not in v.score:
            got.append((best[j - 1] + v.unknown, 1 - j))
        best.append(max(got)[0])
        back.append(-max(got)[1])
    out, j = [], len(s)
    while j:
        p = s[back[j] : j]
        out = ([v.score[p][1]] if p in v.score else [v.byte_ids[b] for b in p.encode()]) + out
        j = back[j]
    return out, best[-1]


def texts(seed):
    rng = random.Random(seed)
    letters = ["".join(rng.choices(a, k=rng.randrange(1, 90))) for a in ("ab", "etaoinshr", "0=-", " a", "日本the", "-- =") for _ in range(6)]
    return [*TEXTS, "foo.\nBar baz,\n\n\nqux.", "a.b,c. d", "x ,y .", "  two  blanks ", "end\n", "internationalization" * 8, "日本" * 30 + "the" * 40, "=" * 200, *letters]


@pytest.mark.parametrize("size", [1, 3, 5, 17, 64, 4096])
def test_chunks_equal_one_lattice(enc, size):
    for t in texts(size):
        s = enc.v.prepare(t)
        want, score = plain(enc.v, s)
        assert ids(enc.encode(t, size)) == want, (t, size)
        assert enc.matrix(s, len(s), size)[0][0][0] == score and enc.decode(enc.encode(t, size)) == t


def test_products_and_ranks_are_associative(enc):
    for t in texts(9):
        s, n = enc.v.prepare(t), enc.v.longest
        m = [enc.chunk(s[k : k + 7 + n - 1], min(7, len(s) - k))[0] for k in range(0, len(s), 7)]
        one = m[0]
        for x in m[1:]:
            one = spm.combine(one, x)
        assert {i: r for i, r in one.items() if r} == {i: r for i, r in spm.product(m).items() if r}
        assert spm.load(spm.dump(one)) == one


def test_states_within_blocks_equal_those_of_the_whole(enc):
    """What rows of a giant document do: products over runs of chunks, states between runs, states within them."""
    for t in texts(11):
        s, n = enc.v.prepare(t), enc.v.longest
        m = [enc.chunk(s[k : k + 5 + n - 1], min(5, len(s) - k))[0] for k in range(0, len(s), 5)]
        runs = [m[k : k + 4] for k in range(0, len(m), 4)]
        outer = spm.states([spm.product(r) for r in runs])
        inner = [x for k, r in enumerate(runs) for x in spm.states(r, outer[k], outer[k + 1])[:-1]]
        assert [*inner, 0] == spm.states(m)


def test_query_over_long_and_odd_texts(spark, odd, enc):
    """Blocks as rows (with several levels of the scan) and whole documents give the same ids."""
    got = {r.doc_id: r for r in spm.encode_digest(odd, FILE, chunk=100, block=700, fan=4).collect()}
    assert len(got) == 10 and all(r.round_trip for r in got.values()) and got[5].n_chunks > 1000
    one = {r.doc_id: r for r in spm.encode_digest(odd, FILE).collect()}
    assert {k: (r.ids_crc32, r.n_pieces) for k, r in one.items()} == {k: (r.ids_crc32, r.n_pieces) for k, r in got.items()}
    assert got[1].n_pieces == got[2].n_pieces == 0
    assert spm.encode_digest(odd.limit(0), FILE).count() == 0


def test_text_without_cuts_over_many_rows(spark, documents, enc):
    """Every boundary is within a run that pieces join, so that states other than 0 occur."""
    rows = [(1, "=" * 3000), (2, "ab" * 1500), (None, "internationalization" * 100), (3, "short")]
    got = {r.doc_id: ids(r.ids) for r in spm.encode(documents(rows), FILE, ["doc_id", "score"], chunk=30, block=90, fan=3).collect()}
    assert got == {i: plain(enc.v, enc.v.prepare(t))[0] for i, t in rows}


def test_memory_is_bounded():
    from tesselle.llm.memory import Memory

    class Lengths(Memory):
        def make(self, key):
            return len(key)

    m = Lengths(most=10, longest=5)
    for k in range(1000):
        assert m[f"{k}"] == len(f"{k}") and m["abc"] == 3 and m["longer than five"] == 16
        assert len(m) <= 10 and len(m.old) <= 10 and "longer than five" not in m
