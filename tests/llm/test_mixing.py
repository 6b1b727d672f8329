import hashlib
import math
import re

import pytest

from tesselle.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(5, 2, 1)):
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    total = {s: sum(z for z, r in zip(size, rows) if r[3] == s) for s in names}
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * total[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    taken = [0] * len(rows)
    for s in names:
        own = sorted((k for k, r in enumerate(rows) if r[3] == s), key=lambda k: (hashlib.md5(("" if rows[k][0] is None else str(rows[k][0])).encode()).hexdigest(), -1 if rows[k][0] is None else rows[k][0], size[k]))
        budget = math.floor(target[s] + 1e-9)
        while budget > 0 and total[s]:
            for k in own:
                t = min(size[k], budget)
                taken[k] += t
                budget -= t
    return sorted((-1 if r[0] is None else r[0], z, t, round(target[r[3]], 6)) for r, z, t in zip(rows, size, taken))


def test_plan_equals_brute_force(spark, documents):
    rows = [(i, "w " * (i * 7 % 23), "en", f"s{i % 5 if i % 3 else 0}") for i in range(200)] + [(None, "a b", "en", None), (900, None, "en", None), (901, "x", "en", None), (901, "x", "en", None)]
    got = mixing.plan(documents(rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.taken, round(r.target, 6)) for r in got) == brute(rows)
    assert all(r.taken <= 2 * r.size for r in got)


def test_repeats_and_cut(spark, documents):
    rows = [(i, " one\ttwo  three\n" * 9, "en", "a" if i < 5 else "b") for i in range(30)]
    docs = documents(rows)
    plan = {r.doc_id: r for r in mixing.plan(docs).collect()}
    seen = {}
    for r in mixing.repeat_taken(docs).collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert rows[0][1].startswith(r.text) and r.n_chars == len(r.text)
    assert seen == {k: r.taken for k, r in plan.items() if r.taken}
    for s in "ab":
        own = [r for k, r in plan.items() if (k < 5) == (s == "a")]
        assert sum(r.taken for r in own) == math.floor(own[0].target)


def test_odd_and_empty(spark, odd):
    assert mixing.plan(odd).count() == 10
    assert mixing.plan(odd.limit(0)).count() == 0
    assert mixing.plan(odd.filter("doc_id in (1, 2)")).agg({"taken": "sum"}).first()[0] == 0


@pytest.mark.parametrize("text,n", [("a\x1cb", 1), ("a b c", 2), ("\x0b\x0ca", 1)])
def test_words(spark, text, n):
    from pyspark.sql import functions as F

    from tesselle.llm.words import split_words, word_count

    assert spark.createDataFrame([(text,)], "t string").select(word_count(F.col("t"))).first()[0] == n == len(split_words(text))


def test_many_sources(spark, documents):
    """As many sources as documents nearly, over several partitions of the running sums."""
    rows = [(i, "w " * (i * 13 % 29), "en", None if i % 97 == 0 else f"http://site{i * 7 % 150}.example/") for i in range(400)]
    got = mixing.plan(documents(rows).repartition(7)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.taken, round(r.target, 6)) for r in got) == brute(rows)
