import random

import numpy as np

from tesselle.llm import licenses as lic


def full_alignment(tpl, doc):
    """Longest common subsequence of the template and the document, the measure without candidates or bands."""
    row = [0] * (len(doc) + 1)
    for a in tpl:
        new = [0]
        for j, b in enumerate(doc):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def best_alignment(tpl, doc):
    """Over all ways to pair equal words in order: most pairs, fewest words skipped between the ends, earliest end, latest beginning."""
    best, cells = (0, 0, 0, 0), {}
    for i, a in enumerate(tpl):
        for j, b in enumerate(doc):
            if a == b:
                here = (1, 0, j)
                for (p, q), (m, skipped, first) in cells.items():
                    if p < i and q < j:
                        here = max(here, (m + 1, skipped - (i - p - 1) - (j - q - 1), first))
                cells[i, j] = here
                best = max(best, (here[0], here[1], -j, here[2]))
    return best[0], -best[1], best[3], -best[2]


def test_alignment_equals_all_pairings():
    rng = random.Random(3)
    for _ in range(300):
        tpl, doc = ([rng.randrange(6) for _ in range(rng.randrange(1, n))] for n in (9, 14))
        got = lic.align(np.array(tpl, np.uint64), np.array(doc, np.uint64), -len(tpl), len(doc))
        assert got == best_alignment(tpl, doc) or got[0] == 0 == best_alignment(tpl, doc)[0], (tpl, doc)


def test_scan_equals_full_alignment(spark, documents):
    rng = random.Random(5)
    rows, want = [], {}
    for i, (name, t) in enumerate(sorted(lic.TEMPLATES.items()) * 3):
        words = t.split()
        if i % 3 and len(words) > 20:
            for _ in range(3):
                words[rng.randrange(len(words))] = "changed"
            del words[10:12]
        noise = [f"n{rng.randrange(10**6)}" for _ in range(50)]
        rows.append((i, " ".join([*noise, *words, *noise[::-1]])))
        want[i] = name
    got = {}
    for r in lic.scan(documents(rows)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r
    h = lic.WordHashes()
    for i, name in want.items():
        doc, tpl = h.of(rows[i][1]).tolist(), h.of(lic.TEMPLATES[name]).tolist()
        r = got[i][name]
        assert r.n_matched == full_alignment(tpl, doc) and abs(r.coverage - r.n_matched / len(tpl)) < 1e-12
        span = lic.WORD.findall(rows[i][1][r.start_char : r.end_char].lower())
        assert span[0] in lic.TEMPLATES[name].lower() and len(span) >= r.n_matched
    clean = documents([(1, "nothing of the kind is written here at all"), (2, "the license of the work")])
    assert lic.scan(clean).count() == 0


def test_repeats_and_odd_rows(spark, documents, odd):
    line = lic.TEMPLATES["mit-notice"]
    got = lic.scan(documents([(1, f"{line}\n" * 5)])).collect()
    assert len(got) == 5 and {r.coverage for r in got} == {1.0}
    assert lic.scan(odd).count() == 0 and lic.scan(odd.limit(0)).count() == 0


def test_repeats_of_a_short_notice(spark, documents):
    text = "All rights reserved.\n" * 4
    got = sorted((r.start_char, r.end_char) for r in lic.scan(documents([(1, text), (2, "other words here")])).collect())
    assert [text[a:b] for a, b in got] == ["All rights reserved"] * 4 and len(set(got)) == 4


def test_adjacent_repeats_of_every_template(spark, documents):
    names = sorted(lic.TEMPLATES)
    rows = [(k, (lic.TEMPLATES[n] + "\n") * 3) for k, n in enumerate(names)] + [(100, "all rights reserved " * 500)]
    got = {}
    for r in lic.scan(documents(rows)).collect():
        got.setdefault((r.doc_id, r.license), []).append((r.start_char, r.coverage))
    for k, n in enumerate(names):
        step = len(lic.TEMPLATES[n]) + 1
        lead = lic.WORD.search(lic.TEMPLATES[n]).start()
        assert sorted(got[k, n]) == [(lead + j * step, 1.0) for j in range(3)], n
    assert len(got[100, "rights-reserved"]) == 500


def test_spans_are_those_of_the_text_as_it_stands(spark, documents):
    line = "All rights reserved"
    rows = [(1, "\u0130\u0130\u0130 " + line + "."), (2, "x" * 300_000 + " \u0130 " + line)]
    got = {r.doc_id: rows[r.doc_id - 1][1][r.start_char : r.end_char] for r in lic.scan(documents(rows)).collect()}
    assert got == {1: line, 2: line}


def test_a_repeated_gram_is_no_region_of_the_whole_text():
    index, hashes = lic.Index(), lic.WordHashes()
    h = hashes.of("permission is hereby " * 20_000 + lic.TEMPLATES["mit"])
    assert [(m.template, m.coverage) for m in index.matches(h)] == [("mit", 1.0)]
    assert all(hi - lo <= index.band(t) for t, lo, hi in index.regions(h))


def test_winnowing_keeps_one_of_every_window():
    g = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    picks = lic.winnow(g, 4)
    assert (np.diff(picks) <= 4).all() and picks[0] < 4 and len(lic.winnow(g[:0])) == 0
