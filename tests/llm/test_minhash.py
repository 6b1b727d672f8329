import random

import pyarrow as pa
import pytest

from tesselle.llm import minhash, storage


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, link=85):
    sets = {i: sets_of(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= link * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def group(rng, first, n, words, edits):
    """A text and copies of it with a few words changed each."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize("link, block, block_rows", [(85, 60_000, 1000), (85, 1500, 7), (80, 60_000, 1000)])
def test_components_equal_brute_force(spark, documents, link, block, block_rows):
    rng = random.Random(4)
    rows = group(rng, 0, 60, 120, 4) + group(rng, 100, 30, 40, 2) + group(rng, 200, 5, 300, 8)
    rows += [(300 + k, rows[k % 7][1].upper()) for k in range(20)]
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [(400 + k, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(15 + k))) for k in range(40)]
    rows += [(500 + k, t) for k, t in enumerate([None, "", " \n ", "a b c", "A b  c", "a b c d", "É b c", "é b c"])]
    got = minhash.link_components(documents(rows), link, block, block_rows).collect()
    want = brute(rows, link)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows_and_empty_table(spark, documents, odd):
    got = {r.doc_id: r for r in minhash.link_components(odd).collect()}
    assert len(got) == 10 and got[7].component_id == 6 and got[1].n_shingles == 0 and got[3].component_id == 3 and got[5].n_shingles == 1
    assert got[None].kept and got[None].component_id is None and got[9].n_shingles == 1
    assert minhash.link_components(documents([]).limit(0)).count() == 0


def test_repeated_ids(spark, documents):
    got = minhash.link_components(documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_one_id_with_several_texts(spark, documents):
    """Rows of one id are one node: its texts tie their groups together, and near copies of either text are found."""
    rng = random.Random(7)
    one, two = group(rng, 10, 4, 100, 1), group(rng, 20, 4, 100, 1)
    rows = [*one, *two, (1, one[0][1] + " x"), (1, two[0][1] + " y"), (30, "some other words that stand alone here")]
    got = {(r.doc_id, r.component_id) for r in minhash.link_components(documents(rows)).collect()}
    assert got == {(i, 1) for i, _ in [*one, *two, (1, "")]} | {(30, 30)}


def test_least_matches():
    assert minhash.least_matches(85) == 30 and minhash.least_matches(80) == 27 and minhash.least_matches(100) == 48


def test_texts_in_runs_have_the_same_shingles(monkeypatch):
    from tesselle.llm import words

    text = "  ".join(f"w{k % 37}" for k in range(500))
    want = minhash.WordHashes().shingles(text).tolist()
    assert [x for t in words.pieces(text, 10) for x in t.split()] == text.split() and "".join(words.pieces(text, 10)) == text
    monkeypatch.setattr(words.pieces, "__defaults__", (10,))
    assert minhash.WordHashes().shingles(text).tolist() == want


def test_only_rows_that_may_link_are_sent_with_their_shingles():
    sig = [[1] * 48, [1] * 30 + [2] * 18, [3] * 48, [1] * 48, [4] * 48]
    data = pa.table({"rep": [10, 11, 12, 13, 14], "comp": [10, 11, 12, 10, 14], "token": [7] * 5, "i": [0] * 5, "j": [0] * 5, "side": [0] * 5, "sig": pa.array(sig, pa.list_(pa.int32()))})
    met = minhash._block_met(30)(data)
    assert met.column_names == minhash.PLACED
    assert met.column("rep").to_pylist() == [10, 11, 13]


def test_few_bytes_stay_on_disk(spark, monkeypatch):
    """Tables that were written under the shared folder are gone when their steps are done, the texts' rounds too."""
    made, gone = [], []
    keep, drop = minhash.materialize, minhash.discard
    monkeypatch.setattr(minhash, "materialize", lambda df, tag: made.append((tag, out := keep(df, tag))) or out)
    monkeypatch.setattr(minhash, "discard", lambda *t: gone.extend(id(x) for x in t) or drop(*t))
    rng = random.Random(4)
    rows = group(rng, 0, 12, 60, 2) + group(rng, 100, 12, 60, 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(tag == "sets" for tag, _ in made) == minhash.ROUNDS
    assert [tag for tag, t in made if id(t) not in gone] == ["components"]


def test_near_copies_do_not_meet_in_every_block_of_every_list(spark, monkeypatch):
    """Rows that are sent to compare lists of near copies do not grow with the square of their number."""
    made, keep = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, tag: made.append((tag, (out := keep(df, tag)).count())) or out)
    rows = group(random.Random(6), 0, 200, 120, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 85, 10**6, 10).collect()}
    assert got == brute(rows)
    assert sum(n for tag, n in made if tag == "met") < 10_000


def test_outer_documents_meet_all_others_of_their_lists(spark):
    lists = [(t, rep, 5, 0 if rep < 100 else rep) for t in (1, 2, 3) for rep in range(100 + t)]
    placed = minhash._across(spark.createDataFrame(lists, "token long, rep long, n long, comp long"), 10**6, 10).collect()
    assert len(placed) == 100 + 3 * 11
    cells = {}
    for r in placed:
        cells.setdefault((r.token, r.i, r.j), []).append(r)
    met = {(a.rep, b.rep) for c in cells.values() for a in c for b in c if a.comp != b.comp and (a.side != b.side or not any(x.side for x in c))}
    assert met >= {(a, b) for a in range(100, 103) for b in range(103) if a != b}


def test_freed_memory_is_given_back_after_each_step(spark, monkeypatch):
    gone = []
    give = storage.give_back
    monkeypatch.setattr(storage, "give_back", lambda s: gone.append(give(s)))
    assert storage.materialize(spark.range(3), "three").count() == 3
    assert len(gone) == 1
