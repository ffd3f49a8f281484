import math
import random

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import op09_crosspolytope


def brute(rows, bound=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.sqrt(v @ v) for i, v in good.items()}
    ids = [i for i, _ in rows]
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= bound:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op09_crosspolytope, "TILE", 16)  # several tiles in the hot buckets
    rng = np.random.default_rng(0)
    rows = []
    add = lambda v: rows.append((len(rows) + 10, None if v is None else [None if x is None else float(np.float32(x)) for x in v]))
    base = rng.normal(size=(30, 24))
    for b in base:
        add(b)
    for _ in range(60):
        add(base[0] + rng.normal(size=24) * 0.02)
    for k in range(40):
        add(base[k % 8] + rng.normal(size=24) * 0.3)
    for _ in range(40):
        add(base[3])
    add(base[3] * 1e18), add(base[3] * 1e-18), add(-base[3]), add(base[3][:12])
    for v in (None, [], [0.0] * 24, [None] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23, [2.0], [3.0], [-1.0]):
        add(v)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("raw", F.lit("x")).repartition(3)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op09_crosspolytope.near_vectors(df).collect()}
    expected = brute(rows)
    assert set(out) == set(expected)
    found, there = sum(v[0] for v in out.values()), sum(v[0] for v in expected.values())
    assert all(out[i][0] <= expected[i][0] for i in out) and found >= 0.99 * there
    assert sum(out[i][1:] == expected[i][1:] for i in out) >= len(out) - 2
    assert op09_crosspolytope.near_vectors(df.where("false")).collect() == []


def test_pipeline_stages_keep_the_columns(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from emberline.llm import op04_langid

    monkeypatch.setattr(op04_langid, "STEPS", 8)
    rng = random.Random(6)
    words = {"en": "the and thing other nation her this that".split(), "de": "schule und einung der lichter verein das".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "er", "en", "s"]) for _ in range(n))
    rows = [(k, say("en" if k % 3 else "de", 60), "en" if k % 3 else "de", f"s{k % 3}", 0) for k in range(60)]
    passage = say("en", 70)
    rows += [rows[5], (None, say("en", 50), "en", "s1", 0)]
    rows += [(100, rows[0][1], "de", "s0", 0), (101, rows[1][1] + " extra", "en", "s1", 0), (102, None, None, None, None), (103, "12 34", "en", "s1", 5)]
    rows += [(200 + k, say("en", 60) + " " + passage + " " + say("en", 60), "en", "s2", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ("score", "size", "target", "taken", "spans", "kept", "rank", "shard", "bucket", "doc", "lang_pred", "_text")
    docs = docs.withColumns({c: F.lit(1) for c in clashes})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        rows_now = now.collect()
        left.append((name, rows_now))
        if name != "tokens":
            assert now.columns == docs.columns
    ids = [{r.doc_id for r in x} for _, x in left]
    assert ids[0] == {r[0] for r in rows} - {102, 103}
    assert ids[1] == ids[0] - {100, 101} and len(left[1][1]) == len(ids[1])
    assert not any(passage in r.text for r in left[2][1]) and ids[2] == ids[1]
    assert len(left[4][1]) == len(left[3][1])
    one, two = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    whole = one.collect()  # read after a second run in the same driver
    assert two.count() == len(whole)
    known = lambda x: sorted((r.doc_id is not None, r.doc_id or 0, r.ids_sha256) for r in x)
    assert known(whole) == known(left[4][1])


def test_pipeline_keeps_texts_of_several_languages(spark, monkeypatch):
    import corpus_pipeline
    from emberline.llm import op04_langid

    monkeypatch.setattr(op04_langid, "STEPS", 15)
    rng = random.Random(8)
    words = {"en": "the thing other nation her this".split(), "de": "schule und einung lichter verein".split(), "es": "qué cióno mentela losado ñezlla".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, say(x := ("en", "de", "es")[k % 3], 30), x) for k in range(120)]
    rows += [(500, " ".join(say(x, 20) for x in words), None), (501, "12 34", None), (502, None, None)]
    left = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert {r.doc_id for r in left} == {r[0] for r in rows} - {501, 502}


def test_pipeline_rows_of_one_id_with_unlike_texts_stay(spark):
    import corpus_pipeline

    rng = random.Random(4)
    say = lambda: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(40))
    a, b, c = say(), say(), say()
    rows = [(0, a), (0, b), (0, b), (0, say()), (7, a), (8, b + " more"), (9, c), (None, c), (None, say()), (5, ""), (5, ""), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_n", F.lit(1))
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(0, a), (0, b), (0, rows[3][1]), (9, c), rows[8], (5, ""), (5, None), (6, "")], key=str)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
