import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import op03_suffix, op06_bpe, op07_minhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    n = 200
    count = Counter(d[k : k + n] for d in data for k in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - n + 1):
            if count[d[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(docs, sample):
    out = op03_suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))
    expected = sorted((r[0], *b) for r, b in zip(sample, brute_repeats([r[1] for r in sample])))
    assert sorted(map(tuple, out.collect())) == expected
    assert sum(e[2] for e in expected) > 3000


def test_repeats_of_periodic_and_shifted_texts(spark):
    a = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(900))
    texts = ["ab" * 300, a[:500], a[17:420] + "zz", "q" + a[300:], a[250:449], "ab" * 101, a[200:400] + "|" + a[200:400]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = op03_suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).orderBy("doc_id")
    assert [tuple(r)[1:] for r in out.collect()] == brute_repeats(texts)


def test_repeats_in_small_chunks_and_tiles(spark, sample, monkeypatch):
    """Texts of many tiles, tables of many chunks and buckets."""
    monkeypatch.setattr(op03_suffix, "BUCKET_BYTES", 4000)
    rows = [(r[0], r[1]) for r in sample] + [(900, "z" + sample[12][1] * 3), (901, (sample[0][1] + sample[-2][1]) * 2)]
    out = op03_suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), chunk_bytes=3000, tile_bytes=700)
    expected = sorted((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows])))
    assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect())) == expected


def test_repeats_of_an_empty_table(docs):
    assert op03_suffix.remove_repeats(docs.where("false")).collect() == []


def test_kept_text_has_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 150 + "a"), (2, "b" + "é" * 150)], "doc_id long, text string")
    texts = [r.text for r in op03_suffix.with_text(op03_suffix.remove_repeats(docs)).orderBy("doc_id").collect()]
    assert texts == ["a", "b"]


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in SPACE.findall(t or "")]
        sets.setdefault(i, set()).update(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else sets.setdefault(i, {tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_match_brute_force(docs, sample):
    out = op07_minhash.near_duplicates(docs)
    rows = list(map(tuple, out.collect()))
    assert len(rows) == len(sample)
    assert set(rows) == brute_components(sample)
    assert sum(not r[3] for r in rows) > 8


def test_a_chain_of_links_is_one_component(spark, words):
    text = words[:100]
    rows = []
    for k in range(40):  # each differs from the next by two words, the ends share nothing
        rows.append((k, " ".join(text)))
        text = text[2:] + [f"n{k}a", f"n{k}b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in op07_minhash.near_duplicates(docs).collect()} == {0}


def test_near_duplicates_in_small_tiles(spark, words, monkeypatch):
    """Groups of near copies whose members are partly linked, with buckets of many tiles."""
    monkeypatch.setattr(op07_minhash, "TILE", 6)
    monkeypatch.setattr(op07_minhash, "TEXT_TILE", 4)
    rng = random.Random(8)
    rows = []
    for share in (4, 14, 17, 20):
        base = [rng.choice(words) + str(rng.randrange(99)) for _ in range(200)]
        for _ in range(30):
            near = list(base)
            for k in rng.sample(range(200), rng.randrange(share)):
                near[k] = rng.choice(words)
            rows.append((len(rows), " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = set(map(tuple, op07_minhash.near_duplicates(docs).collect()))
    assert got == brute_components(rows)
    assert 4 < sum(r[3] for r in got) < 80


def test_unlike_texts_of_one_id_stay_apart(spark, words):
    say = lambda n: " ".join(words[(n * 37 + k * k) % 400] for k in range(60))
    rows = [(1, say(1)), (1, say(2)), (2, say(2)), (3, say(3)), (0, say(1) + " end"), (1, say(1))]
    got = sorted(map(tuple, op07_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()))
    assert got == [(0, 0, True), (1, 0, False), (1, 0, False), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_sets_of_long_texts(words, monkeypatch):
    monkeypatch.setattr(op07_minhash, "TILE_BYTES", 50)
    for text in (" ".join(words), "\n " + "  ".join(words[:90]) + " ", "x" * 400, "a b " + "x" * 300 + " c d e f", "", " " * 200):
        data = np.frombuffer(text.encode(), np.uint8)
        assert op07_minhash.whole_set(data, 5).tolist() == op07_minhash.shingle_sets(data, np.array([0, len(data)]), 5)[0].tolist()


def test_near_duplicates_of_an_empty_table(docs):
    assert op07_minhash.near_duplicates(docs.where("false")).collect() == []


def test_tokens_match_the_library(docs, sample):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=op06_bpe.ranks(path), special_tokens={})
    out = op06_bpe.decode(op06_bpe.encode(docs, path, public.PATTERN), path)
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect())
    expected = []
    for r in sample:
        ids = whole.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), b"".join(i.to_bytes(4, "little") for i in ids), (r[1] or "").encode()))
    assert got == sorted(expected)
    assert op06_bpe.encode(docs.where("false"), path, public.PATTERN).collect() == []


@pytest.mark.parametrize("texts", [["a"] * 60_000, [None] * 4000 + ["ab cd ef gh ij kl " * 400_000]], ids=["many short texts", "a long text after empty ones"])
def test_sketches_take_bounded_memory(texts):
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(t))), pa.array(t, pa.string())], ["doc", "text"]) for k in range(0, len(texts), 4000) if (t := texts[k : k + 4000])]
    tracemalloc.start()
    rows = [r for b in op07_minhash._sketches(iter(batches), 5) for r in zip(b.column("doc").to_pylist(), b.column("n").to_pylist())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [(k, 0 if t is None else 1 if t == "a" else 6) for k, t in enumerate(texts)]
    assert peak < 200e6
