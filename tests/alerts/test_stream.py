import json
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import fake_index  # noqa: E402
from test_run import MIN, T0, alerts  # noqa: E402

from emberline.config import Settings  # noqa: E402
from emberline.sources.paged import PagedIndex, distinct_hits, pages  # noqa: E402
from emberline.streaming.engine import AlertStream  # noqa: E402
from emberline.plans.run import correlate  # noqa: E402
from emberline.sources.sink import Results  # noqa: E402
from emberline.streaming.tables import Keyed, Versioned  # noqa: E402


def test_pages_lose_and_double_nothing():
    for size in (1, 2, 3, 10):
        got = [t for _, _, t in pages(fake_index.fetch, 0, 10_000, size)]
        assert got == [5000] * 5 + [6000], size
    assert len(list(pages(fake_index.fetch, 0, 6000, 2))) == 5


def test_the_paged_source(spark):
    spark.sparkContext.addPyFile(fake_index.__file__)
    spark.dataSource.register(PagedIndex)
    df = spark.read.format("paged_index").option("fetch", "fake_index:fetch").option("since", 0).option("until", 10_000).option("size", 2).option("partitions", 3).load()
    assert sorted(r.time for r in df.collect()) == [5000] * 5 + [6000]


def test_a_stream_of_pages_loses_and_doubles_nothing(spark, tmp_path):
    """Hits that come late, that are dated ahead, and a restart between batches."""
    index, out = tmp_path / "index", str(tmp_path / "out")
    hit = lambda k, t: {"_id": f"h{k}", "_source": {"@timestamp": 10**6 + t, "n": k}}
    hits = [hit(k, 1000 * k) for k in range(20)] + [hit(90, 45_000)]  # one is dated ahead
    spark.sparkContext.addPyFile(fake_index.__file__)
    spark.dataSource.register(PagedIndex)
    options = {"fetch": "tests.alerts.fake_index:stored", "clock": "tests.alerts.fake_index:clock", "on_cursor": "tests.alerts.fake_index:told", "source": str(index), "settle": 2000, "overlap": 10_000, "replay": 15_000, "size": 3, "partitions": 4}

    def run(now):
        index.write_text("\n".join([str(10**6 + now), *map(json.dumps, hits)]))
        stream = spark.readStream.format("paged_index").options(**options).load()
        query = distinct_hits(stream, 15_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        assert query.awaitTermination(120) is True
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run(12_500) == sorted(f"h{k}" for k in range(11))  # settled: before 10,500
    hits.extend([hit(91, 9_400), hit(92, 2_500)])  # indexed late
    assert run(25_000) == sorted(h["_id"] for h in hits if h["_id"] != "h90")
    hits.append(hit(93, 24_999))
    assert run(60_000) == sorted(h["_id"] for h in hits)
    assert {int(x) for x in (tmp_path / "index.cursor").read_text().split()} <= {1_010_500, 1_023_000, 1_058_000}


def test_a_stream_keeps_ids_state_and_late_rows(spark, tmp_path):
    settings = Settings(watermark_seconds=120)
    stream = AlertStream(spark, str(tmp_path / "state"), settings)
    row = lambda uid, t, **kw: {"uid": uid, "t": t, **kw}
    def show(s): return {c.cluster_id: c.alert_count for c in s.chains.read().collect()}  # noqa: E704

    first = stream.cycle(alerts(spark, [row("a1", 0, hostname="A"), row("a2", 1, hostname="A"), row("m1", 0, hostname="M"), row("n1", 30, hostname="N", severity_id=5), row("x", 40, hostname="A"), row("low", 2, hostname="A", severity_id=1)]), 0)
    assert {c.cluster_id for c in first.collect() if c.is_new} == {"CHAIN-2026-07-11-N-001"}
    assert show(stream) == {"CHAIN-2026-07-11-A-001": 2, "CHAIN-2026-07-11-M-001": 1, "CHAIN-2026-07-11-N-001": 1}  # x waits for the watermark
    assert stream.chains.read().where("surfaced").count() == 1

    stream = AlertStream(spark, str(tmp_path / "state"), settings)  # a restart
    rows = [row("late", 3, hostname="A"), row("a1", 0, hostname="A"), row("m2", 40, hostname="M", username="j"), row("n2", 45, hostname="N", username="j", severity_id=1), row("n3", 46, hostname="N", username="j"), row("a9", 300, hostname="A"), row("a10", 303, hostname="Z")]
    stream.cycle(alerts(spark, rows), 1)
    expected = {"CHAIN-2026-07-11-A-001": 4, "CHAIN-2026-07-11-A-002": 1, "CHAIN-2026-07-11-M-001": 4}
    assert show(stream) == expected
    assert [(r.cluster_id, r.merged_into) for r in stream.merged.read().collect()] == [("CHAIN-2026-07-11-N-001", "CHAIN-2026-07-11-M-001")]
    assert {c.cluster_id for c in stream.chains.read().where("surfaced").collect()} >= {"CHAIN-2026-07-11-M-001"}
    stream.cycle(alerts(spark, rows), 1)  # the batch again after a failure
    assert show(stream) == expected

    changed = stream.cycle(None, 2, flush=True)
    assert [c.cluster_id for c in changed.collect()] == ["CHAIN-2026-07-11-Z-001"]
    stream.cycle(alerts(spark, [row("later", 1440 * 3, hostname="Q")]), 3, flush=True)
    assert show(stream) == {"CHAIN-2026-07-14-Q-001": 1}
    assert [r.uid for r in stream.alerts.read().collect()] == ["later"]


def test_a_structured_stream(spark, tmp_path):
    alerts(spark, [{"uid": "a", "t": 0, "hostname": "A"}, {"uid": "b", "t": 90, "hostname": "B"}]).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    stream = AlertStream(spark, str(tmp_path / "state"))
    query = stream.start(source, str(tmp_path / "checkpoint"), availableNow=True)
    assert query.awaitTermination(120)
    assert {c.cluster_id for c in stream.chains.read().collect()} == {"CHAIN-2026-07-11-A-001"}


def test_upserts_keep_the_latest_version(spark, tmp_path):
    from pyspark.sql import functions as F

    t = Versioned(spark, str(tmp_path / "t"))
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0, "k", F.col("v"))
    for _ in range(2):
        t.upsert(spark.createDataFrame([("a", 3), ("b", 0), ("c", 1)], "k string, v int"), 1, "k", F.col("v"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 3), ("b", 1), ("c", 1)]
    assert T0 % MIN == 0


@pytest.fixture(autouse=True)
def _small(spark):
    """UTC, and no compiled code: a cycle is a hundred small jobs here."""
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    for k, v in {"spark.sql.session.timeZone": "UTC", **quick}.items():
        spark.conf.set(k, v)
    yield
    for k in quick:
        spark.conf.unset(k)


def _random_alerts(seed, n):
    """Hosts that lend addresses to each other, alerts that know only an address, and identifiers that meet late."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        one = {"uid": f"r{k:03d}", "t": rng.choice((rng.randint(0, 900), 60 * rng.randint(0, 15))), "severity_id": rng.choice((3, 4, 5))}
        if rng.random() < 0.7:
            one["hostname"] = f"H{rng.randint(0, 11)}"
        if rng.random() < 0.15:
            one["mac"] = f"00:00:00:00:00:{rng.randint(0, 3):02x}"
        if rng.random() < 0.3:
            one["username"] = f"u{rng.randint(0, 5)}"
        if rng.random() < 0.1:
            one["email"] = f"m{rng.randint(0, 2)}@x"
        if rng.random() < 0.5:
            one["device_ip"] = f"10.0.0.{rng.randint(0, 5)}"
        if rng.random() < 0.3:
            one["src_ip"] = f"10.0.0.{rng.randint(0, 7)}"
        rows.append(one)
    return rows


def test_state_in_parts_equals_a_whole_rebuild(spark, tmp_path):
    seed = 1
    rows = _random_alerts(seed, 60)
    settings = Settings(window_minutes=12, retention_minutes=10**6)
    random.Random(seed).shuffle(rows)
    stream = AlertStream(spark, str(tmp_path / "state"), settings, buckets=4)
    cuts = [0, 30, 48, 60]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        stream.cycle(alerts(spark, rows[a:b]), n, flush=True)
    whole = correlate(alerts(spark, rows), settings)
    one = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    facts = ("chain", "alert_count", "first_time", "last_time", "first_uid", "max_severity", "entity_count", "disposition", "primary_entity", "primary_name", "risk")
    assert one(stream.chains.read(), *facts) == one(whole.chains, *facts)
    assert one(stream.placed.read(), "uid", "chain") == one(whole.placed, "uid", "chain")
    facts = ("entity_uid", "domain", "name", "identifiers", "first_seen", "last_seen")
    assert one(stream.entities.read(), *facts) == one(whole.entities, *facts)
    assert one(stream.entities.read(), "entity_uid", "risk") == one(whole.risk, "entity_uid", "risk")
    ids = [r.cluster_id for r in stream.chains.read().collect()]
    assert len(ids) == len(set(ids)) and not {r.cluster_id for r in stream.merged.read().collect()} & set(ids)


def test_a_cycle_touches_only_its_components(spark, tmp_path):
    stream = AlertStream(spark, str(tmp_path / "state"), Settings(retention_minutes=10**6), buckets=16)
    many = [{"uid": f"a{k}", "t": k % 7, "hostname": f"H{k // 3}", "username": f"u{k // 3}"} for k in range(300)]
    stream.cycle(alerts(spark, many), 0, flush=True)
    changed = stream.cycle(alerts(spark, [{"uid": "new", "t": 5, "hostname": "H40", "username": "v"}]), 1, flush=True).collect()
    assert [(c.cluster_id, c.alert_count) for c in changed] == [("CHAIN-2026-07-11-H40-001", 4)]
    written = {t.path.rsplit("/", 1)[1]: spark.read.schema(t.schema).parquet(f"{t.path}/change/_v=2").count() for t in stream.tables if not t.path.endswith("merged")}
    assert written == {"alerts": 1, "labels": 2, "nodes": 2, "addresses": 0, "bridge": 2, "touches": 2, "entities": 2, "placed": 4, "members": 4, "chains": 1, "issued": 0}
    opened = stream.members.files(spark.createDataFrame([("a120",)], "chain string"), 1)
    assert len(opened) == 1 and spark.read.parquet(*opened).count() < 60
    stream.cycle(alerts(spark, [{"uid": "join", "t": 6, "hostname": "H1", "username": "u40"}]), 2, flush=True)
    assert spark.read.parquet(f"{stream.chains.path}/change/_v=4").count() == 2  # one chain of two, and the other's end
    assert sorted(c.alert_count for c in stream.chains.read().collect())[-1] == 8 and stream.merged.read().count() == 1


STORE = {f: f"tests.alerts.fake_index:{f}" for f in ("stage", "publish", "discard")}


def test_results_are_written_once_and_whole(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    results = Results(spark, str(tmp_path / "state"), STORE | {"source": str(store)}, buckets=2)
    rows = lambda *r: spark.createDataFrame(r, "cluster_id string, part string, block long, document string").repartition(3)
    log = lambda: (store / "log").read_text().split()
    first = rows(("C1", "chain", 0, '{"written_at":1,"n":1}'), ("C1", "alerts", 0, "[1]"), ("C1", "alerts", 1, "[2]"), ("C2", "chain", 0, "{}"))
    results.write(first, 0)
    before = fake_index.published(store)
    assert set(before) == {"C1#chain#0", "C1#alerts#0", "C1#alerts#1", "C2#chain#0"}
    results.write(first, 0)  # the batch again
    assert fake_index.published(store) == before
    done = len(log())
    results.write(rows(("C1", "chain", 0, '{"written_at":2,"n":1}'), ("C1", "alerts", 0, "[3]")), 1, spark.createDataFrame([("C2",)], "cluster_id string"))
    assert fake_index.published(store) == {"C1#chain#0": '{"written_at":1,"n":1}', "C1#alerts#0": "[3]"}
    assert sorted(log()[done:]) == ["C1#alerts#0", "C1#alerts#1", "C2#chain#0"]  # one changed, two went
    held = fake_index.published(store)
    with pytest.raises(Exception, match="the store is down"):
        results.write(rows(("C3", "chain", 0, "{}"), ("C4", "chain", 0, "poison"), ("C5", "chain", 0, "{}")), 2)
    assert fake_index.published(store) == held and "poison" not in "".join(p.read_text() for p in store.glob("staged-*"))
    results.write(rows(("C3", "chain", 0, "{}")), 2)
    assert set(fake_index.published(store)) == {*held, "C3#chain#0"}


def test_a_stream_writes_surfaced_chains(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    results = Results(spark, str(tmp_path / "state"), STORE | {"source": str(store)}, buckets=2)
    stream = AlertStream(spark, str(tmp_path / "state"), Settings(dashboard_url="https://soc"), buckets=2, results=results)
    rows = [{"uid": "a1", "t": 0, "hostname": "A", "severity_id": 5}, {"uid": "a2", "t": 1, "hostname": "A"}, {"uid": "b1", "t": 2, "hostname": "B", "severity_id": 1}]
    stream.cycle(alerts(spark, rows), 0, flush=True)
    got = {k: json.loads(v) for k, v in fake_index.published(store).items()}
    name = "CHAIN-2026-07-11-A-001"
    assert set(got) == {f"{name}#chain#0", f"{name}#alerts#0", f"{name}#entities#0"} and got[f"{name}#chain#0"]["chain"]["risk_score"] == 20.0
    assert [a["uid"] for a in got[f"{name}#alerts#0"]["alerts"]] == ["a1", "a2"] and got[f"{name}#chain#0"]["dashboard_url"] == f"https://soc/incident/{name}"


def test_keyed_tables_merge_and_replay(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k string, n int, v string")
    t = Keyed(spark, str(tmp_path / "t"), "k", ("k", "n"), rows(("", 0, "")).schema, buckets=3)
    show = lambda **kw: sorted(tuple(r) for r in t.read(**kw).collect())
    assert show() == []
    expected = {}
    for n in range(7):
        new = [("abc"[k % 3], k, f"{n}") for k in range(n, n + 4)]
        lost = [("abc"[k % 3], k) for k in (n - 2, n)]
        for _ in range(2):  # each batch again
            t.write(rows(*new), spark.createDataFrame(lost, "k string, n int"), n)
            t.write(None, spark.createDataFrame([("a", n)], "k string, n int"), n, 1)
            t.merge(n, after=5)
        before = dict(expected)
        expected = {key: v for key, v in expected.items() if key not in lost} | {(k, i): v for k, i, v in new}
        expected.pop(("a", n), None)
        assert show() == sorted((*key, v) for key, v in expected.items())
        assert show(batch=n) == sorted((*key, v) for key, v in before.items())
    asked = spark.createDataFrame([("b",), (None,), ("zz",)], "k string")
    assert sorted(tuple(r) for r in t.lookup(asked, 9).collect()) == sorted((*key, v) for key, v in expected.items() if key[0] == "b")
    assert len(list((tmp_path / "t" / "change").iterdir())) <= 12 and 1 <= len(list((tmp_path / "t" / "whole").iterdir())) <= 2
