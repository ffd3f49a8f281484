"""Operators with learnt models: planted differences must be found on held-out rows."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

import pytest

from emberline.llm import op04_langid, op08_quality, op10_toxicity

SYLLABLES = {"aa": "the and ing ion tha ent her".split(), "bb": "sch und ein ung der lich ver".split(), "cc": "qué ció mente los ado ñez lla".split()}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(1)
    rows = [(k, say(rng, "abc"[k % 3] * 2, rng.randint(5, 80)), "abc"[k % 3] * 2) for k in range(240)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ,. 5", "bb"), (1003, say(rng, "aa", 30) + " " + say(rng, "bb", 10), None), (None, say(rng, "bb", 9), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(speech, monkeypatch):
    monkeypatch.setattr(op04_langid, "STEPS", 15)
    model = op04_langid.learn(speech)
    got = {r.doc_id: r for r in op04_langid.identify(speech, model).collect()}
    held = [r for r in speech.collect() if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    for k in (1000, 1001, 1002):
        assert (got[k].lang_pred, got[k].score, got[k].n_switches) == ("und", 0.0, 0)
    assert got[1003].lang_pred == "aa" and 0.6 < got[1003].score < 0.9 and got[1003].n_switches >= 1
    assert got[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert op04_langid.identify(speech.where("false"), model).collect() == []
    nothing = op04_langid.learn(speech.where("false"))
    assert {r.lang_pred for r in op04_langid.identify(speech, nothing).collect()} == {"und"}


def test_spans_of_a_mixed_text(speech, monkeypatch):
    monkeypatch.setattr(op04_langid, "STEPS", 15)
    rows = op04_langid.identify(speech.where("doc_id >= 1000"), op04_langid.learn(speech), ("doc_id", "text")).collect()
    for r in rows:
        spans = [(s["lang"], s["first"], s["last"]) for s in r.spans]
        assert len(spans) == (r.n_switches + 1 if r.lang_pred != "und" else 0)
        assert all(a[2] + 1 == b[1] and a[0] != b[0] for a, b in zip(spans, spans[1:]))
        if r.doc_id == 1003:
            assert spans[0][:2] == ("aa", 0) and spans[-1][::2] == ("bb", 39)
            assert sum(b - a + 1 for x, a, b in spans if x == "aa") in range(26, 35)


def test_long_texts_in_segments_and_parts(speech, monkeypatch):
    monkeypatch.setattr(op04_langid, "STEPS", 15)
    model = op04_langid.learn(speech)
    rng = random.Random(4)
    texts = [say(rng, "aa", 300) + " " + say(rng, "bb", 200), say(rng, "bb", 7), None, "", say(rng, "cc", 41)]
    batch = lambda t: pa.RecordBatch.from_pydict({"_text": pa.array(t, pa.string())})
    whole = pa.Table.from_batches(list(op04_langid._predict(iter([batch(texts)]), model)))
    monkeypatch.setattr(op04_langid, "SEGMENT", 20)
    cut = pa.Table.from_batches(list(op04_langid._predict(iter([batch(texts)]), model)))
    assert cut.column("spans") == whole.column("spans") and cut.column("lang_pred") == whole.column("lang_pred")
    assert np.allclose(cut.column("score").to_numpy(), whole.column("score").to_numpy(), atol=1e-6)
    monkeypatch.setattr(op04_langid, "TILE_BYTES", 400)
    parts = pa.Table.from_batches(list(op04_langid._predict(iter([batch(texts[:1])]), model)))
    assert parts.column("lang_pred")[0].as_py() == "aa" and abs(parts.column("score")[0].as_py() - whole.column("score")[0].as_py()) < 0.02
    assert parts.column("spans")[0].as_py()[-1]["last"] == 499


def test_a_language_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(op04_langid, "STEPS", 8)
    monkeypatch.setattr(op04_langid, "SAMPLE_BYTES", 1 << 17)
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, say("the thing other nation her this".split(), 60), "en") for k in range(60)]
    rows += [(100 + k, say("schule und einung lichter verein".split(), 40_000).replace(" ", "\n"), "de") for k in range(3)]
    model = op04_langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    asked = spark.createDataFrame([(1, "verein und schule"), (2, "other nation")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in op04_langid.identify(asked, model).collect()} == {1: "de", 2: "en"}


def test_words_of_a_long_text_stay_whole(spark):
    model = op04_langid.fit(["the thing"] * 4 + ["und lichter"] * 4, ["en"] * 4 + ["de"] * 4)
    rows = [(k, text) for k, text in enumerate(("lichter\n" * 200_000, "the1thing," * 80_000, "x" * 700_000))]
    got = op04_langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, [(x.first, x.last) for x in r.spans][-1][1]) for r in got) == [(0, 199_999), (1, 159_999), (2, 0)]
    assert [len(x.spans) for x in got if x.doc_id == 0] == [1]


def test_marginals_match_a_sum_over_all_paths():
    rng = np.random.default_rng(9)
    sizes = [1, 5, 0, 4, 2]
    first = np.cumsum([0, *sizes])
    scores, transition = rng.normal(size=(sum(sizes), 3)) * 2, rng.normal(size=(3, 3))
    p, pairs = op04_langid.marginals(scores, first, transition, True)
    expected, joint = np.zeros_like(p), np.zeros((3, 3))
    for a, n in zip(first, sizes):
        paths = list(itertools.product(range(3), repeat=n))
        weight = [np.exp(sum(scores[a + k, y] for k, y in enumerate(path)) + sum(transition[x, y] for x, y in zip(path, path[1:]))) for path in paths]
        for path, w in zip(paths, np.array(weight) / sum(weight)):
            for k, y in enumerate(path):
                expected[a + k, y] += w
            for x, y in zip(path, path[1:]):
                joint[x, y] += w
    assert np.allclose(p, expected, atol=1e-12) and np.allclose(pairs, joint, atol=1e-12)


def test_every_language_is_learnt():
    names = [f"l{k:03}" for k in range(80)]
    texts = [" ".join(f"{a}{k % 9}x" for k, a in enumerate([n] * 12)) for n in names for _ in range(4)]
    model = op04_langid.fit([t.translate(str.maketrans("0123456789", "abcdefghij")) for t in texts], [n for n in names for _ in range(4)])
    assert model.languages == names and model.weights.size <= 80 * 4 * op04_langid.slots_for(80) <= 4 * op04_langid.ALL_SLOTS


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(400):
        text = say(rng, "aa", rng.randint(10, 60)).split()
        toxic, poor = k % 5 == 0, k % 7 == 0
        if toxic and not poor:
            for w in rng.sample(["scumbag", "wretch", "vermin", "filthy"], 2):
                text.insert(rng.randrange(len(text)), w)
        text = " ".join(text)
        if poor:
            text = " ".join([text.split()[0]] * 60)
        docs.append((k, text + ".", "site" + str(k % 4), "xy"[k % 2]))
        labels.append((k, int(not poor), int(toxic and not poor)))
    docs += [(900, None, None, None), (901, "", "site0", "x"), (None, "a b", "site1", None), docs[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels + [(901, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(rated):
    docs, labels = rated
    out = op10_toxicity.score(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.predicted for r in out if r.doc_id in (900, 901, None)} == {0}
    assert op10_toxicity.score(docs.where("false"), labels).collect() == []
    assert len({r.score for r in op10_toxicity.score(docs, labels.where("false")).collect()}) == 1


def test_toxic_words_outside_the_sample(spark):
    """Mining sees every labelled row: a word of few rows, hardly any of them in the fitted sample, makes a document toxic."""
    rng = random.Random(9)
    clean = [say(rng, "aa", 1) for _ in range(40)]
    rows = []
    for k in range(1200):
        toxic = "grobian" if k % 60 == 7 else "scumbag" if k % 6 == 0 else None
        rows.append((k, " ".join(rng.choice(clean) for _ in range(30)) + (f" {toxic}" if toxic else ""), int(toxic is not None)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in op10_toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=150).collect()}
    held = [k for k, _, _ in rows if k % 60 == 7 and zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(got[k] == 1 for k in held)
    assert sum(got[k] != toxic for k, _, toxic in rows) <= 12


def test_every_telling_voter_votes():
    words = [f"{a}{b}{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    assert len(op10_toxicity._chosen([(w, 100, 5.0) for w in words])) == 100
    assert op10_toxicity._chosen([("scum", 90, 5.0), ("scumbag ", 40, 4.5)]) == ["scum"]


def test_quality(rated):
    """Held-out rows, odd ones, and no table at all."""
    docs, labels = rated
    out = op08_quality.score(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [r for r in out if r.doc_id in truth and r.doc_id < 900 and r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(out) == docs.count() and len(own) > 40 and sum(r.kept == bool(truth[r.doc_id]) for r in own) >= 0.98 * len(own)
    assert all(0 <= r.path_score <= 1 and 0 <= r.host_score <= 1 for r in out)
    assert op08_quality.score(docs.where("false"), labels).collect() == []
    assert len(op08_quality.score(docs, labels.where("false")).collect()) == docs.count()


ADDRESSES = {
    "https://Blog.Example.com/en/7": (7, "blog.example.com", "/en"),
    "http://u:p@example.org:8080/en/a/8.html?x=/1#y": (8, "example.org", "/en"),
    "https://[2001:db8::1]:80/fr/9/": (9, "[2001:db8::1]", "/fr"),
    "ftp://example.net/10": (10, "example.net", ""),
    "https://example.org/en/about": None,
    "/en/11": None,
    "https:///en/12": None,
    "https://example.org/en/99999999999999999999": None,
    "": None,
    None: None,
}


def test_places_of_addresses(spark):
    pages = spark.createDataFrame([(u, "x") for u in ADDRESSES] + [("https://zzz.example/en/7", "later")], "url string, number string")
    assert sorted(tuple(r) for r in op08_quality.places(pages).collect()) == sorted(x for x in ADDRESSES.values() if x)
    assert op08_quality.places(pages.where("false")).collect() == []


def test_posteriors_match_a_loop(rated, spark):
    """Posteriors of hosts and paths from the documents' own evidence, summed by a loop; sparse hosts go to the mean."""
    docs, labels = rated
    pages = spark.createDataFrame([(f"https://h{k % 7 if k % 50 else k}.example/{'ab'[k % 2]}/{k}",) for k in range(0, 900, 2)] + [(None,)], "url string")
    at = {r.number: (r.host, r.path) for r in op08_quality.places(pages).collect()}
    got = op08_quality.score(docs, labels, pages).collect()
    place = {}
    for r in docs.collect():
        place.setdefault((r.doc_id, r.text), at.get(r.doc_id, (r.source, r.lang)))
    of = {k: v for (k, _), v in place.items()}
    assert len(got) == docs.count() and len({h for h, _ in of.values()}) > 10
    groups, hosts = {}, {}
    for r in got:
        for key, sums in ((of[r.doc_id], groups), (of[r.doc_id][0], hosts)):
            n, good = sums.get(key, (0, 0.0))
            sums[key] = (n + 1, good + r.doc_score)
    mean = sum(g for _, g in hosts.values()) / len(got)

    def strength(rows):
        rows = [(n, g, m) for n, g, m in rows if n > 1]
        seen = sum(n * (g / n - m) ** 2 for n, g, m in rows) - sum(m * (1 - m) for _, _, m in rows)
        share = max(seen, 0) / sum(n * m * (1 - m) for n, _, m in rows)
        return min(op08_quality.MOST_STRENGTH, max(op08_quality.LEAST_STRENGTH, 1 / share - 1 if share > 0 else op08_quality.MOST_STRENGTH))

    s = strength([(n, g, mean) for n, g in hosts.values()])
    prior = {h: (g + s * mean) / (n + s) for h, (n, g) in hosts.items()}
    t = strength([(n, g, prior[h]) for (h, _), (n, g) in groups.items()])
    for r in got:
        key = of[r.doc_id]
        n, good = groups[key]
        assert abs(r.host_score - prior[key[0]]) < 1e-4
        assert abs(r.path_score - (good - r.doc_score + t * prior[key[0]]) / (n - 1 + t)) < 1e-4
    alone = [prior[h] for h, (n, g) in hosts.items() if n == 1]
    assert alone and all(abs(x - mean) <= max(abs(g / n - mean) for n, g in hosts.values()) for x in alone)


def test_correlated_voters_share_their_evidence():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    a = np.where(rng.random(4000) < 0.8, y, ~y)
    b = np.where(rng.random(4000) < 0.8, y, ~y)
    votes = np.stack((a, a, b), 1).astype(float)
    model = op10_toxicity.LabelModel(votes[~y].sum(0), votes[y].sum(0), float((~y).sum()), float(y.sum()))
    for _ in range(8):
        p = model.posterior(votes, np.full(len(y), -1))
        w = np.stack((1 - p, p))
        model.update(w.sum(1), w @ votes, np.stack([votes.T @ (votes * x[:, None]) for x in w]))
    assert abs(model.weights[0] - 0.5) < 0.1 and model.weights[2] > 0.75


def test_sums_of_the_label_model_match_a_loop():
    """One task's sums, and the model refitted from them, against loops over rows and voters."""
    rng = np.random.default_rng(3)
    votes, gold, n = rng.random((60, 4)) < 0.3, rng.integers(-1, 2, 60), rng.integers(1, 5, 60)
    model = op10_toxicity.LabelModel(np.array([3.0, 9, 5, 2]), np.array([8.0, 1, 5, 4]), 40, 12)
    model.none, posterior = np.array([0.9, 0.2]), []
    for x, g in zip(votes, gold):
        odds = model.base / (1 - model.base)
        for k in np.flatnonzero(x):
            odds *= model.rates[1, k] / model.rates[0, k]
        odds *= 1 if x.any() else 0.2 / 0.9
        odds *= {1: 0.9 / 0.02, 0: 0.1 / 0.98, -1: 1}[g]
        posterior.append(odds / (1 + odds))
    packed = [np.flatnonzero(x).astype("<u2").tobytes() for x in votes]
    batch = pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(gold), pa.array(n)], ["votes", "gold", "n"])
    got = {(r["a"], r["b"]): (r["s0"], r["s1"]) for b in op10_toxicity._expect(iter([batch]), model) for r in b.to_pylist()}
    for y, p in ((1, np.array(posterior)), (0, 1 - np.array(posterior))):
        w = p * n
        assert np.isclose(got[-1, -1][y], w.sum()) and np.isclose(got[-1, 0][y], w[gold >= 0].sum()) and np.isclose(got[-1, 1][y], w[gold == 1].sum())
        assert np.isclose(got[-1, 2][y], w[~votes.any(1)].sum())
        for a in range(4):
            for b in range(a, 4):
                assert np.isclose(got.get((a, b), (0, 0))[y], w[votes[:, a] & votes[:, b]].sum())
