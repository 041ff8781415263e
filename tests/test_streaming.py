"""The stream: bodies that a browser draws come later, first, twice or never."""

import itertools
import tempfile
from datetime import datetime, timedelta

from tests_support import S, page

from shelfscan.plans.catalogue import read_catalogues_of  # noqa: F401
from shelfscan.streaming.products import next_state, said, stream_products

START = datetime(2026, 1, 1)
SHELL = '<html><body><div id="root"></div></body></html>'


def fetch(path, minutes, body, via="http", status=200, error=None, attempt=0):
    return (S, S + path, attempt, START + timedelta(minutes=minutes), status, body, error, via)


def streamed(spark, batches, delay="1 hour"):
    """Products by name and the number of the batch, and the rows of state after each batch."""
    folder = tempfile.mkdtemp(prefix="run-")
    schema = "site STRING, url STRING, attempt INT, fetched_at TIMESTAMP, status INT, body STRING, error STRING, via STRING"
    kept = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        query = stream_products(stream, f"{folder}/out", f"{folder}/state", delay, available_now=True)
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r.name, r.url[len(S):]) for r in rows), kept


def test_bodies_that_come_later(spark):
    named = {n: page(f'"{n}"') for n in ("plain", "late", "early", "blocked", "failed", "dropped", "twice")}
    first = [
        fetch("/plain", 0, named["plain"]), fetch("/late", 0, SHELL), fetch("/early", 1, named["early"], "render"), fetch("/blocked", 0, "no", status=403),
        fetch("/failed", 0, None, status=None, error="timeout"), fetch("/dropped", 0, "no", status=404), fetch("/twice", 0, SHELL), fetch("/never", 0, SHELL),
    ]
    second = [
        fetch("/late", 20, named["late"], "render"), fetch("/early", 20, SHELL), fetch("/blocked", 20, named["blocked"], "render"), fetch("/plain", 20, named["twice"]),
        fetch("/failed", 20, named["failed"], "render"), fetch("/dropped", 20, named["dropped"], "render"), fetch("/twice", 20, named["twice"], "render"),
    ]
    third = [fetch("/twice", 25, named["plain"], "render"), fetch("/plain", 25, named["plain"], "render")]
    later = [[fetch("/clock", 300, "x", status=404)], [fetch("/clock", 700, "x", status=404)]]
    products, kept = streamed(spark, [first, second, third, *later])
    want = [("blocked", "/blocked"), ("early", "/early"), ("failed", "/failed"), ("late", "/late"), ("plain", "/plain"), ("twice", "/twice")]
    assert products == want
    assert kept[0] == kept[2] == 8 and kept[-1] <= 1


def test_a_late_plain_response_beats_earlier_failures():
    failed, drawn, shell, accept = ("failed", None), ("drawn", "D"), ("needs_render", None), ("accept", "A")
    new = (False, False, False, None)
    assert next_state([failed, accept], *new)[1] == "A"
    assert next_state([failed], *new) == ((False, True, False, None), None)
    for order in itertools.permutations([shell, drawn, failed]):
        known, out = new, []
        for row in order:
            known, html = next_state([row], *known)
            out += [html] if html else []
        assert out == ["D"] and known[2] and known[3] is None
    assert next_state([drawn], *new) == ((False, False, False, "D"), None)
    assert next_state([accept, drawn], *new)[1] == "A" and next_state([("drop", None), drawn], *new)[1] is None
    assert next_state([accept], False, False, True, None)[1] is None


def test_what_responses_say(spark):
    schema = "site STRING, url STRING, attempt INT, fetched_at TIMESTAMP, status INT, body STRING, error STRING, via STRING"
    rows = [
        fetch("/a", 0, "ok <h1>"), fetch("/b", 0, None), fetch("/c", 0, "x", status=429), fetch("/d", 0, None, "render"),
        fetch("/e", 0, "x", "render", error="crash"), fetch("/f", 0, "x", None), fetch("/g", 0, "x", status=None), fetch("/h", 0, "x", status=503),
    ]
    got = {r.url[len(S):]: (r.says, r.html) for r in said(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"/a": ("accept", "ok <h1>"), "/b": ("accept", ""), "/c": ("failed", None), "/f": ("accept", "x"), "/g": ("failed", None), "/h": ("needs_render", None)}


def test_a_group_costs_little():
    """A URL has one or two responses a batch; frames of so few rows cost far more than reading them as lists."""
    import time
    from datetime import datetime, timedelta
    from types import SimpleNamespace

    import pandas as pd

    from shelfscan.streaming.products import _remember

    at = datetime(2026, 1, 1)
    rows = pd.DataFrame({"says": ["needs_render"], "attempt": [0], "fetched_at": [pd.Timestamp(at)], "html": [None]})
    known: list = []
    state = SimpleNamespace(hasTimedOut=False, exists=False, update=known.append, setTimeoutTimestamp=known.append, getCurrentWatermarkMs=lambda: 0)
    run, start = _remember(timedelta(hours=1)), time.perf_counter()
    for _ in range(1000):
        assert list(run(("s", "u"), iter([rows]), state)) == []
    listed = time.perf_counter() - start
    start = time.perf_counter()
    for _ in range(1000):
        rows.assign(last=rows["says"].isin(["drawn"])).sort_values(["last", "attempt", "fetched_at"], kind="stable")
    assert listed < 0.5 * (time.perf_counter() - start)
    assert known[-2] == (True, False, False, None) and known[-1] == int(pd.Timestamp(at + timedelta(hours=1)).timestamp() * 1000)


class Remembered:
    """A group's state as Spark keeps it, with a watermark that a test sets."""

    def __init__(self):
        self.value, self.until, self.watermark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, until):
        assert until >= self.watermark
        self.until = until

    def getCurrentWatermarkMs(self):
        return self.watermark


def step(run, key, state, watermark, rows):
    """A batch as Spark runs it: a group with rows is called with them, one past its time without."""
    import pandas as pd

    state.watermark, state.hasTimedOut = watermark, not rows
    if not rows and (not state.exists or state.until >= watermark):
        return []
    frame = pd.DataFrame(rows, columns=["site", "url", "says", "attempt", "fetched_at", "html"]).astype({"fetched_at": "datetime64[ns]"})
    return list(run(key, iter([frame]), state))


def test_a_group_of_urls_goes_as_each_url_alone():
    """Rows, order, bodies held and the time that each URL is forgotten at."""
    import random

    import pandas as pd

    from shelfscan.streaming.products import _remember, _remember_groups

    rng, hour = random.Random(7), timedelta(hours=1)
    one, many = _remember(hour), _remember_groups(hour)
    urls = [(S if i % 3 else None, f"{S}/{i}" if i else None) for i in range(40)]
    alone, group = {url: Remembered() for url in urls}, Remembered()
    put_out, kept = 0, []
    for batch in range(60):
        now = START + timedelta(minutes=15 * batch)
        watermark = int(pd.Timestamp(now - hour).timestamp() * 1000) if batch else 0
        rows = []
        for url in rng.sample(urls, rng.choice([0, 1, 5, 12])):
            for _ in range(rng.choice([1, 1, 2, 3])):
                says = rng.choice(["accept", "drop", "needs_render", "failed", "drawn"])
                at = now + timedelta(minutes=rng.randrange(20))
                rows.append((*url, says, rng.randrange(3), at, f"{says} {batch}" if says in ("accept", "drawn") else None))
        want = [tuple(r) for url in urls for r in step(one, url, alone[url], watermark, [r for r in rows if r[:2] == url])]
        got = [tuple(r) for frame in step(many, (0,), group, watermark, rows) for r in frame.itertuples(index=False)]
        assert sorted(map(str, got)) == sorted(map(str, want))
        left = {url for url in urls if alone[url].exists}
        assert left == (set(zip(*group.value[:2])) if group.exists else set())
        put_out, kept = put_out + len(got), [*kept, len(left)]
    assert put_out > 20 and max(kept) > min(kept[5:])


def test_many_urls_share_a_row_of_state(spark, monkeypatch):
    from shelfscan.streaming import products

    monkeypatch.setattr(products, "GROUPS", 2)
    shells = [fetch(f"/{i}", i, SHELL if i % 2 else page(f'"N{i}"')) for i in range(12)]
    drawn = [fetch(f"/{i}", 20, page(f'"N{i}"'), "render") for i in range(12)]
    found, kept = streamed(spark, [shells, drawn])
    assert found == sorted((f"N{i}", f"/{i}") for i in range(12))
    assert 1 <= kept[0] <= 2 and 1 <= kept[1] <= 2


def test_parts_are_dealt_out_before_they_become_pages(spark, monkeypatch):
    """A file of one row group is one split; the pages of its rows are made in many tasks."""
    import pytest

    from checks import queries

    class Seen(Exception):
        pass

    def seen(fetches, *_, **__):
        raise Seen(fetches._jdf.queryExecution().analyzed().toString())

    folder = tempfile.mkdtemp(prefix="run-")
    row = (1, "p", "Brand#11", "t", 3, 1.5)
    spark.createDataFrame([row], "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE").write.parquet(f"{folder}/part.parquet")
    monkeypatch.setattr(queries, "stream_products", seen)
    with pytest.raises(Seen) as plan:
        queries.stream_catalogue(spark, folder)
    lines = [line.lstrip(" +-~") for line in str(plan.value).splitlines()]
    assert lines[0].startswith("Project") and lines[1].startswith("RepartitionByExpression [p_partkey")
