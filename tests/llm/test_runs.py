import hashlib
import random
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from emberline.llm import op11_runs

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=12):
    """Every maximal stretch of every period, by its smallest one."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(shortest, 2 * p):
                found.setdefault((start, i + p - start), p)
    return sorted((s, length, p) for (s, length), p in found.items())


def collapse(words, runs):
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(2)
    say = lambda n, k: [rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)]
    out = [None, "", " \n\t ", "one", "x " * 11, "x " * 12, "x\n" * 500, "é ß " * 40, "  a b " * 9, "ab\x0bab\x0cab\x0d" * 5]
    for k in (1, 2, 2, 2, 3, 4, 26):
        for n in (12, 13, 40, 90, 200):
            out.append(" ".join(say(n, k)))
    for p in (1, 2, 3, 5, 7, 12, 20, 64):
        block = say(p, 26)
        body = (block * 40)[: rng.randint(2 * p, 5 * p + 12)]
        out.append(" ".join(say(rng.randint(0, 9), 26) + body + say(9, 26) + body + body[:3]))
    nested = (["a"] * 13 + ["b"]) * 4
    out += [" ".join(nested + ["c"] + nested), " ".join(say(3000, 26)), " ".join((say(400, 26)) * 3), "a b " * 6 + "c " + "a b " * 6]
    return out


@pytest.mark.parametrize("chunk, at_once", [(4 << 20, 1 << 20), (1, 7), (900, 50)])
def test_runs_match_brute_force(spark, monkeypatch, chunk, at_once):
    monkeypatch.setattr(op11_runs, "AT_ONCE", at_once)
    rows = list(enumerate(texts())) + [(None, "z " * 30), (3, "y " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "id", "n_words", "w", "h")})
    got = op11_runs.periodic_runs(df.repartition(3), chunk_bytes=chunk).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    mine = sorted(((r.doc_id, [tuple(x) for x in r.runs], bytes(r.collapsed).decode(), r.n_words) for r in got), key=key)
    expected = []
    for i, text in rows:
        words = WORD.findall(text or "")
        found = brute(words)
        expected.append((i, found, collapse(words, found), len(words)))
    assert mine == sorted(expected, key=key)
    assert op11_runs.periodic_runs(df.where("false")).collect() == []


def test_shortest_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string")
    assert [tuple(x) for x in op11_runs.periodic_runs(df, shortest=4).first().runs] == [(0, 4, 2)]


def test_query_matches_the_contract(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts() * 3)] + [(None, "a " * 15), (12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op11_runs.query(spark, str(tmp_path)).collect()), key=str)
    expected, planted = [], 0
    for i, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        expected.append((i, len(found), *four, digest("".join("%d,%d,%d\n" % r for r in found)), digest(collapse(words, found))))
    assert planted > 5 and got == sorted(expected, key=str)
