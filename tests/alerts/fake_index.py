import json
from pathlib import Path

HITS = [{"_id": f"h{k}", "_source": {"@timestamp": t, "host": {"name": "A"}, "event": {"severity": "high"}}} for k, t in enumerate([5000] * 5 + [6000])]


def fetch(since, until, size, seen):
    return [h for h in HITS if since <= h["_source"]["@timestamp"] < until and h["_id"] not in seen][:size]


def stored(source, since, until, size, seen):
    """An index in a file: a hit for each line."""
    hits = sorted((json.loads(x) for x in Path(source).read_text().splitlines()[1:]), key=lambda h: h["_source"]["@timestamp"])
    return [h for h in hits if since <= h["_source"]["@timestamp"] < until and h["_id"] not in seen][:size]


def clock(source):
    """The time of the index: the file's first line."""
    return int(Path(source).read_text().splitlines()[0])


def told(source, cursor):
    with Path(source + ".cursor").open("a") as f:
        f.write(f"{cursor}\n")


def stage(source, token, documents):
    """A store in a folder: a file of staged documents for each task, and one of all that are published."""
    rows = list(documents)
    Path(source, f"staged-{token}").write_text(json.dumps(rows))
    if any("poison" in (r["document"] or "") for r in rows):
        raise RuntimeError("the store is down")


def publish(source, tokens):
    now = published(source)
    for token in tokens:
        for r in json.loads(Path(source, f"staged-{token}").read_text()):
            now.pop(r["id"], None)
            if r["document"] is not None:
                now[r["id"]] = r["document"]
            with Path(source, "log").open("a") as f:
                f.write(r["id"] + "\n")
    Path(source, "published").write_text(json.dumps(now))
    discard(source, tokens)


def discard(source, tokens):
    for token in tokens:
        Path(source, f"staged-{token}").unlink(missing_ok=True)


def published(source):
    p = Path(source, "published")
    return json.loads(p.read_text()) if p.exists() else {}
