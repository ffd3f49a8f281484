import random
import json
import math

import pytest
from pyspark.sql import functions as F

from emberline.operators import evidence, search
from emberline.operators.inverted import BLOCK, Index


def technique(uid, name, **kw):
    return {"type": "attack-pattern", "name": name, "external_references": [{"source_name": "mitre-attack", "external_id": uid, "url": f"https://x/{uid}"}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": kw.pop("phase", "credential-access")}]} | kw


BUNDLE = {
    "type": "bundle",
    "objects": [
        {"type": "x-mitre-collection", "x_mitre_version": "17.0"},
        technique("T1110", "Brute Force", description="many wrong passwords tried at one door"),
        technique("T1003", "OS Credential Dumping", description="dump credentials from memory"),
        technique("T1021", "Remote Services", phase="lateral-movement", description="log into remote services"),
        technique("T1059.001", "PowerShell", phase="execution", description="scripts handed to the windows shell", x_mitre_is_subtechnique=True),
        technique("T9999", "Revoked", revoked=True),
        technique("T9998", "Old", x_mitre_deprecated=True),
        technique("X1", "Bad id"),
        {"type": "malware", "name": "m"},
    ],
}


def test_bundle_and_ranking(spark):
    kb = search.compile_bundle(spark.createDataFrame([(json.dumps(BUNDLE),)], "value string"))
    rows = {r.uid: r for r in kb.collect()}
    assert sorted(rows) == ["T1003", "T1021", "T1059.001", "T1110"]
    assert rows["T1021"].tactics == ["lateral movement"] and rows["T1110"].version == "17.0"
    queries = spark.createDataFrame([(1, "who tried so many wrong passwords"), (2, "a script for the shell of windows"), (3, "")], "query int, text string")
    best = {r.query: r.uid for r in search.bm25(queries, search.technique_documents(kb), 1).collect()}
    assert best == {1: "T1110", 2: "T1059.001"}
    assert search.bm25(queries, search.technique_documents(kb), 0).count() == 0


def test_cosine(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 3.0]), ("z", [0.0, 0.0])], "uid string, vector array<double>")
    got = search.cosine(v.withColumnRenamed("uid", "query"), v, 2).orderBy("query", "rank").collect()
    assert [(r.query, r.uid, r.score) for r in got if r.query != "z"] == [("a", "a", 1.0), ("a", "b", round(math.sqrt(0.5), 4)), ("b", "b", 1.0), ("b", "a", round(math.sqrt(0.5), 4))]


def test_grounding(spark):
    rows = spark.createDataFrame([(["t1110", "T1003", "nope", "T1110 "], ["T1110"], ["a", "b", "b"], ["a"], 90), ([], ["T1"], [], [], 90), (None, None, None, None, None)], "techniques array<string>, candidates array<string>, cited array<string>, evidence array<string>, confidence int")
    a, b, c = search.validate(rows).collect()
    assert (a.accepted, a.rejected, a.unverified, a.confidence) == (["T1110"], ["T1003", "nope"], ["b", "b"], 40)
    assert (b.accepted, b.rejected, b.confidence) == ([], [], 90) and c.confidence is None


def test_flattening(spark):
    row = {"a": {"b": 1}, "c": ["x", "y"], "d": [{"e": 2}], "n": None, "t": True, "l": [], "long": "v" * 400, "Z": {"HostName": "h1"}}
    df = spark.createDataFrame([(json.dumps(row),), (None,), ("broken",)], "j string")
    one, none, broken = df.select(evidence.flatten_payload("j").alias("p"), evidence.flatten_view("j").alias("v")).collect()
    pairs = {p.key: p.value for p in one.p}
    assert pairs == {"a.b": "1", "c": "x, y", "d[0].e": "2", "n": "null", "t": "true", "l": "", "long": "v" * 300 + "…", "Z.HostName": "h1"}
    assert none.p == [] and broken.p == []
    view = {p.key: p.value for p in one.v}
    assert view["d.0.e"] == "2" and "n" not in view and view["z.hostname"] == "h1"
    got = df.limit(1).select(evidence.first_by_suffix(evidence.flatten_view("j"), ["nothing", "hostname", "e"]).alias("x")).first().x
    assert got == "h1"


def test_payload_is_bounded_and_escaped(spark):
    pair = "struct<key:string,value:string>"
    df = spark.createDataFrame([("C1", [("e1", "a<b", [("k&", "v>1"), ("a", "1")])])], f"cluster_id string, alerts array<struct<uid:string,title:string,pairs:array<{pair}>>>")
    (r,) = evidence.payload(df, 5000).collect()
    assert 'title="a&lt;b"' in r.xml and "v&gt;1" in r.xml and not r.truncated and r.evidence == ["a", "k&"]
    (r,) = evidence.payload(df, 60).collect()
    assert r.truncated and len(r.xml) == 60 and r.xml.endswith("<!-- cut to fit -->")


def test_redaction_round_trip(spark):
    text = "from 203.0.113.9 via 192.168.1.50 and 192.168.1.50 to 10.0.0.7, 999.1.1.1 by ann@corp.example on web-01 as ann, CORP\\ann_admin; EMAIL_1"
    df = spark.createDataFrame([(text, {"ann": "USER", "web-01": "HOST", "-": "USER"}), (None, None), ("", {})], "t string, e map<string,string>")
    out = evidence.redact(df, "t", "e").select("redacted", "tokens", evidence.restore(F.col("redacted"), F.col("tokens")).alias("back")).collect()
    assert out[0].redacted == "from [IP_EXTERNAL_1] via [IP_INTERNAL_1] and [IP_INTERNAL_1] to [IP_INTERNAL_2], 999.1.1.1 by [EMAIL_1] on [HOST_1] as [USER_1], CORP\\[USER_1]_admin; EMAIL_1"
    assert out[0].back == text and out[1].redacted is None and out[2].redacted == ""


def test_redaction_matches_one_value_after_another():
    """Names that overlap and contain each other, against replacing them in turn by marks that nothing can match."""
    rng = random.Random(1)
    for _ in range(300):
        names = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 4))): rng.choice(("USER", "HOST")) for _ in range(rng.randint(0, 5))}
        text = "".join(rng.choice("aabb c.") for _ in range(40))
        redacted, tokens = evidence.redact_text(text, names)
        plain = text
        for k, name in enumerate(sorted(names, key=lambda v: (-len(v), v))):
            plain = plain.replace(name, chr(1000 + k))
        for k, name in enumerate(sorted(names, key=lambda v: (-len(v), v))):
            plain = plain.replace(chr(1000 + k), tokens.get(name, "?"))
        assert redacted == plain


def test_redaction_of_texts_with_tokens_and_full_stops(spark):
    cases = {
        "[EMAIL_1] wrote to bob@x.org, see [EMAIL_2].": "[EMAIL_1] wrote to [EMAIL_3], see [EMAIL_2].",
        "see 10.0.0.5.": "see [IP_INTERNAL_1].", "v1.2.3.4.5 and 1.2.3.4.5": "v1.2.3.4.5 and 1.2.3.4.5", "x=1.2.3.4;256.1.1.1": "x=[IP_EXTERNAL_1];256.1.1.1",
        "USER and srv": "USER and [HOST_1]", "a.b-c@d-e.co.uk.": "[EMAIL_1].", "no@mail, @x.org": "no@mail, @x.org",
    }
    df = spark.createDataFrame([(t, {"srv": "HOST"}) for t in cases], "t string, e map<string,string>")
    for r in evidence.redact(df, "t", "e").select("t", "redacted", evidence.restore(F.col("redacted"), F.col("tokens")).alias("back")).collect():
        assert (r.redacted, r.back) == (cases[r.t], r.t)


def test_distinct_texts_and_encoded_commands(spark):
    df = spark.createDataFrame([(["A", "a", "", "b", "B "],)], "x array<string>")
    assert df.select(evidence.distinct_texts(F.col("x")).alias("d")).first().d == ["A", "b", "B "]
    c = spark.createDataFrame([("powershell -enc SQBFAFgAKAA=",), ("x [Convert]::FromBase64String($a)",), ("powershell -File a.ps1",), ("powershell -EncodedCommand $x",), ("x -encrypt y",)], "c string")
    assert [r[0] for r in c.select(F.col("c").rlike(evidence.ENCODED)).collect()] == [True, True, False, True, False]


def test_a_verdict_function_is_plugged_in(spark):
    df = spark.createDataFrame([("C1",), ("C2",)], "cluster_id string")
    out = evidence.triage(df, lambda pdf: pdf.assign(confidence=len(pdf)), "cluster_id string, confidence long").collect()
    assert sorted(r.cluster_id for r in out) == ["C1", "C2"]


def test_names_to_redact(spark):
    pairs = [("User.Name", "ann"), ("host.name", "web-01"), ("account", "x9"), ("a.hostname", "-"), ("computer_name", "ann"), ("user.name", " n ")]
    df = spark.createDataFrame([(pairs,)], "p array<struct<key:string,value:string>>")
    assert df.select(evidence.seeds(F.col("p")).alias("s")).first().s == {"ann": "HOST", "web-01": "HOST"}


def corpus(rng, n, start=0):
    words = [f"w{k}" for k in range(400)]
    return [(i, rng.choice(words), " ".join(words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(start, start + n)]


def test_saved_index_ranks_like_a_scan_over_merged_and_replaced_documents(spark, tmp_path):
    rng, form = random.Random(3), "uid int, title string, body string"
    old, new = corpus(rng, 900), corpus(rng, 300, 750) + [(2000, None, None), (None, "w1", "w2"), (5, "w3", "W3 w3")]
    asked = [(1, "w1 w1 w1 w1 w399 w380"), (2, "w0 w2"), (3, ""), (4, None), (5, "nowhere"), (6, "w300 w0 w0"), (7, "w398")]
    queries = spark.createDataFrame(asked, "query int, text string")
    index = Index(spark, str(tmp_path / "a")).add(spark.createDataFrame(old, form)).add(spark.createDataFrame(new, form))
    now = {r[0]: r for r in old} | {r[0]: r for r in new if r[0] is not None}
    docs = spark.createDataFrame(list(now.values()), form)
    best = lambda df: sorted((r.query, r.rank, r.uid, r.score) for r in df.collect())
    expected = best(search.bm25(queries, docs, 7))
    assert expected and best(index.top(queries, 7)) == best(index.top(queries, 7, first=1)) == expected
    packed = index.compact(str(tmp_path / "b"))
    assert best(packed.top(queries, 7)) == expected and packed.table("dead").count() == 0 and len(packed.segments()) == 1
    assert best(packed.add(spark.createDataFrame([], form)).top(queries, 7)) == expected
    assert index.top(queries, 0).count() == 0


def test_saved_index_opens_few_ranges_and_ignores_what_failed(spark, tmp_path):
    docs = spark.range(6000).selectExpr("cast(id as int) uid", "'' title", "concat_ws(' ', 'common', if(id % 1500 = 7, 'rare', 'other'), repeat('filler ', cast(id % 50 as int))) body")
    index = Index(spark, str(tmp_path / "i")).add(docs)
    queries = spark.createDataFrame([(1, "rare common")], "query int, text string")
    opened = index.search(queries, 4)[1]
    every = index.blocks(index.weights(queries))
    assert every.count() >= 6000 / BLOCK and 0 < opened.count() < every.count() / 10
    assert [r.uid for r in index.top(queries, 4).orderBy("rank").collect()] == [r.uid for r in search.bm25(queries, docs, 4).orderBy("rank").collect()]
    before = index.top(queries, 4).collect()
    docs.limit(5).write.parquet(str(tmp_path / "i" / "000002" / "docs"))
    assert index.segments()[-1].endswith("000001") and index.top(queries, 4).collect() == before
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "none")).top(queries, 4)
    empty = Index(spark, str(tmp_path / "e")).add(docs.limit(0))
    assert empty.top(queries, 4).count() == 0


def test_techniques_are_saved_and_loaded(spark, tmp_path):
    kb = search.compile_bundle(spark.createDataFrame([(json.dumps(BUNDLE),)], "value string"))
    search.save_kb(kb, str(tmp_path / "kb"))
    assert sorted(search.load_kb(spark, str(tmp_path / "kb")).collect()) == sorted(kb.select(*search.load_kb(spark, str(tmp_path / "kb")).columns).collect())
    search.save_kb(kb.limit(0), str(tmp_path / "kb"))
    with pytest.raises(ValueError):
        search.load_kb(spark, str(tmp_path / "kb"))
    (tmp_path / "bad").write_text("{broken\n")
    with pytest.raises(ValueError):
        search.load_kb(spark, str(tmp_path / "bad"))


def test_cosine_in_tiles_is_that_of_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    rows = [(k, base[rng.randrange(30)] if k % 3 else [rng.gauss(0, 1) for _ in range(5)]) for k in range(400)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [0.0] * 5), (503, [2.0, 1.0]), (504, [float("nan")] * 5)]
    v = spark.createDataFrame(rows, "uid long, vector array<double>")
    q = v.where("uid % 7 = 0 or uid > 499").withColumnRenamed("uid", "query")
    p = q.select("query", search.normalized(F.col("vector")).alias("a")).crossJoin(v.select("uid", search.normalized(F.col("vector")).alias("b")))
    score = F.aggregate(F.zip_with("a", "b", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    shown = lambda df: sorted((r.query, r.rank, r.uid, repr(r.score)) for r in df.collect())
    for k, tiles in ((6, (16_384, 8_192, 1 << 21)), (40, (20, 50, 100)), (1, (7, 9, 1))):
        for name, size in zip(("TILE_QUERIES", "TILE_VECTORS", "HELD"), tiles):
            monkeypatch.setattr(search, name, size)
        assert shown(search.cosine(q, v, k)) == shown(search.top(p.select("query", "uid", score.alias("score")), k))
    plan = search.cosine(q, v, 3)._jdf.queryExecution().toString()
    assert "CoGroups" in plan and "Join" not in plan
    import numpy as np

    assert search._sixth(np.array([0.1234565, -0.1234565, 0.5, 1.0])).tolist() == [123457.0, -123457.0, 500000.0, 1000000.0]
