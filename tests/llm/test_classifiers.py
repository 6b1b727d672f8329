import random

import numpy as np
from pyspark.sql import functions as F

from tesselle.llm import langid, toxicity
from tesselle.llm.langid import crc_fold, fold

LETTERS = {"xx": ["ka", "ri", "to", "me"], "yy": ["sch", "ung", "ein", "au"], "zz": ["oix", "que", "ére", "ç"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(n=240, bad=("vile", "grim")):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        lang = sorted(LETTERS)[i % 3]
        words = text(rng, lang).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice([".", "", "!!"]))
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    return rows, labels


def test_languages_on_held_out_documents(spark, documents):
    rows, _ = corpus()
    docs = documents(rows)
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if crc_fold(i, 4) == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) >= 0.98 and all(0 <= r.score <= 1 for r in got.values())
    shuffled = docs.withColumn("lang", F.lit("yy")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(langid.predict(shuffled, model).collect()) == sorted(got.values())


def test_language_profile_equals_plain_binding():
    v, letters = langid.profiles(["Ab b", None, "12 !"], 64)
    padded = " ab b "
    want = sum(1.0 * np.roll(langid.letter_vector(ord(a), 64), 2) * np.roll(langid.letter_vector(ord(b), 64), 1) * langid.letter_vector(ord(c), 64) for a, b, c in zip(padded, padded[1:], padded[2:]))
    assert np.allclose(v[0], want / np.linalg.norm(want)) and letters.tolist() == [3, 0, 0] and not v[1:].any()


def test_large_alphabets(spark):
    many = "".join(chr(0x4E00 + k) for k in range(400))
    v, letters = langid.profiles([many, "abc"], 64)
    assert letters.tolist() == [400, 3] and abs(np.linalg.norm(v[0]) - 1) < 1e-5


def test_profiles_do_not_depend_on_runs():
    rng = random.Random(6)
    texts = [text(rng, "zz", 60), None, "--- a" + "-" * 90 + "b c", "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(500)), "Ünd so İx ΣΑΣ" * 9]
    want, letters = langid.sums(texts, 64)
    for run, step in ((1, 1), (2, 7), (13, 64), (50, 5000)):
        got, n = langid.sums(texts, 64, run, step)
        assert np.array_equal(got, want) and ((n > 0) == (letters > 0)).all()


def test_letters_beyond_the_basic_planes(spark, documents):
    far = "".join(chr(0x30000 + k) for k in range(20))
    docs = documents([(1, far), (2, "abc def"), (3, far)])
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") == 2, "en").otherwise("hz")), F.lit(True))
    assert [r.lang_pred for r in langid.predict(docs, model).orderBy("doc_id").collect()] == ["hz", "en", "hz"]


def test_sample_of_many_languages(spark):
    keys = spark.range(300).selectExpr("concat('l', lpad(cast(id % 100 as string), 3, '0')) k")
    assert len(langid.key_rates(keys, "k", 2, 10)) == 10 and langid.key_rates(keys, "k", 2, 200)["l007"] == 2 / 3


def test_language_odd_rows(spark, odd):
    model = langid.fit(odd, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert len(got) == 10 and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3, 9)) and got[4].lang_pred == "en"
    assert langid.predict(odd.limit(0), model).count() == 0
    none = langid.fit(odd.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark, documents):
    rows, labels = corpus(400)
    docs = documents(rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, fold(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, t in labels if crc_fold(i, 5) == 0]
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in held]) >= 0.95 and all(0 <= s <= 1 for s in got.values())
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z"))
    assert {r.doc_id: r.score for r in toxicity.score(other, model).collect()} == got


def test_toxicity_odd_rows(spark, documents, odd):
    rows, labels = corpus(60)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.fit(documents(rows), lab, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    same = {r.doc_id: r.score for r in got}
    assert same[1] == same[2] and same[6] == same[7]
    none = toxicity.fit(documents(rows), lab.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def plain_logit(net, ids):
    """The network on one document, place by place."""
    h = [net.emb[i].astype(np.float64) for i in ids] + [np.zeros(net.p.dim)] * (max(toxicity.WIDTHS) - 1)
    x = []
    for w in toxicity.WIDTHS:
        z = [sum(h[k + j] @ net.w[w][j] for j in range(w)) for k in range(len(ids))]
        x.append(np.maximum(np.max(z, axis=0) + net.b[w], 0))
    return np.concatenate(x) @ net.out + net.bias[0]


def test_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = toxicity.Net(toxicity.Params(buckets=50, dim=3, filters=4))
    docs = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 2, 3, 7, 8, 9, 16, 30, 31)]
    want = [plain_logit(net, d) for d in docs]
    for most in (1, 2, 4, 8, toxicity.RUN):
        assert np.allclose(net.logits(docs, most), want, atol=1e-5)


def test_steps_follow_finite_differences():
    """One step moves every weight against the numeric derivative of the loss, by rate * g / sqrt(g * g + 1e-6)."""
    p = toxicity.Params(buckets=12, dim=2, filters=2, epochs=1, batch=4, rate=1e-3)
    docs = [np.array(d, np.int32) for d in ([1, 2, 3, 4], [5], [6, 7], [8, 9, 10])]
    label, weight = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    net = toxicity.Net(p)
    for a in (net.emb, net.out, *net.w.values(), *net.b.values()):
        a *= 3

    def loss():
        z = np.array([plain_logit(net, d) for d in docs])
        return np.mean(np.logaddexp(0, np.where(label > 0, -1, 1) * z)) + 0.5e-5 * float(net.out @ net.out)

    numeric = {}
    for name, a in [("emb", net.emb), ("out", net.out), ("bias", net.bias), *((f"w{w}", net.w[w]) for w in net.w), *((f"b{w}", net.b[w]) for w in net.b)]:
        g = np.zeros(a.shape)
        for i in np.ndindex(a.shape):
            was = a[i]
            ends = []
            for d in (1e-3, -1e-3):
                a[i] = was + np.float32(d)
                ends.append((loss(), float(a[i])))
            a[i] = was
            g[i] = (ends[0][0] - ends[1][0]) / (ends[0][1] - ends[1][1])
        numeric[name] = (a, a.copy(), g)
    net.train(docs, label, weight)
    for name, (a, was, g) in numeric.items():
        if name == "emb":
            g[0] = 0
        step = -p.rate * (3 if name == "emb" else 1) * g / np.sqrt(g * g + 1e-6)
        near = np.abs(g) > 1e-3
        assert near.any() and np.allclose((a - was)[near], step[near], rtol=0.05, atol=2e-5), name


def test_training_lowers_the_loss():
    p = toxicity.Params(buckets=50, dim=3, filters=2, epochs=1, batch=4, rate=1e-3)
    docs = [np.array(d, np.int32) for d in ([1, 2, 3, 4], [5], [6, 7], [8, 9, 10])]
    net, label = toxicity.Net(p), np.array([1, 0, 1, 0], np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(label > 0, -1, 1) * net.logits(docs))))
    was = loss()
    for _ in range(30):
        net.train(docs, label, np.ones(4, np.float32))
    assert loss() < was


def test_threshold():
    assert toxicity.best_threshold(np.array([-2.0, -1, 1, 3]), np.array([0, 0, 1, 1])) == 0.0
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.0
    logit, label = np.array([0.0, 1, 2, 3]), np.array([0, 1, 0, 1])
    assert toxicity.best_threshold(logit, label, np.array([1.0, 1, 9, 1])) == 2.5 and toxicity.best_threshold(logit, label, np.array([1.0, 9, 1, 1])) == 0.5
