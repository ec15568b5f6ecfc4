"""Message logs, paged interfaces and keyed state: limits, restarts, and plain versions."""

import json
import threading
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import logs, pages
from weftgraph.streaming import consume as C
from weftgraph.streaming import state, streams

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_shares_of_a_poll():
    assert logs.advanced({"0": 5}, {"0": 100, "1": 3, "2": 100}, 50) == {"0": 29, "1": 3, "2": 23}
    assert logs.advanced({"0": 100, "1": 3, "2": 90}, {"0": 100, "1": 3, "2": 100}, 50) == {"0": 100, "1": 3, "2": 100}
    assert logs.advanced({}, {}, 50) == {}


def test_batches_are_acknowledged_and_survive_restarts(spark, tmp_path):
    log, out, point = (f"{tmp_path}/{n}" for n in ("log", "out", "point"))
    rows = events(spark).limit(400)
    logs.publish(logs.as_messages(rows, "user_id", "ts", {"kind": "event"}), log, 3)
    sizes, broken = {}, []

    def work(batch, number):
        sizes[number] = batch.count()
        if number in (2, 5) and number not in broken:
            broken.append(number)
            raise OSError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            C.consume(spark, log, "g", work, point)
    C.consume(spark, log, "g", work, point)
    assert sizes == dict.fromkeys(range(8), 50)
    got = spark.read.parquet(out)
    assert got.count() == 400 == got.select("partition", "offset").distinct().count()
    assert Counter(json.loads(r.value)["event_id"] for r in got.collect()) == Counter(r.event_id for r in rows.collect())
    ends = logs.Log(log).ends()
    assert logs.Folder(log).get("groups/g.json") == ends and sum(ends.values()) == 400
    # a group goes on behind what it has acknowledged, even with another checkpoint; a new group begins anew or at the end
    logs.publish(logs.as_messages(rows.limit(70), "user_id"), log, 3)
    for group, expected in (("g", 70), ("h", 470)):
        C.consume(spark, log, group, C.into(f"{tmp_path}/{group}"), f"{tmp_path}/point-{group}", C.STREAM_POLL)
        assert spark.read.parquet(f"{tmp_path}/{group}").count() == expected
    first = spark.read.parquet(f"{tmp_path}/h").filter("offset = 0").first()
    assert first.headers == {"kind": "event"} and first.timestamp is not None
    assert logs.StreamReader({"path": log, "startingOffsets": "latest"}).initialOffset() == logs.Log(log).ends()


def test_publications_count_once(spark, tmp_path):
    log = logs.Log(f"{tmp_path}/log")
    one = logs.write_segments(f"{tmp_path}/log", 2, iter([{"key": k, "value": str(k), "headers": None, "timestamp": None} for k in (None, "a", "b")]), size=1).segments
    log.commit(one, 2, ["w", 0])
    log.commit(one, 2, ["w", 0])  # the same batch after a restart
    log.commit([], 2, ["w", 1])
    assert sum(log.ends().values()) == 3
    with pytest.raises(FileExistsError):
        log.folder.put("commits/00000000000000000000.json", {}, replace=False)
    spark.dataSource.register(logs.MessageLog)
    rows = spark.read.format("messagelog").option("path", f"{tmp_path}/log").load().collect()
    assert sorted((r.key or "", r.value) for r in rows) == [("", "None"), ("a", "a"), ("b", "b")]
    assert spark.read.format("messagelog").option("path", f"{tmp_path}/none").load().count() == 0


def test_a_backlog_takes_many_polls_a_batch(spark, tmp_path):
    log, out, sizes, broken = f"{tmp_path}/log", f"{tmp_path}/out", {}, []
    logs.publish(logs.as_messages(events(spark).limit(400), "user_id", "ts"), log, 3)

    def work(batch, number):
        sizes[number] = batch.count()
        if number == 1 and not broken:
            broken.append(number)
            raise OSError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with pytest.raises(Exception, match="lost"):
        C.consume(spark, log, "g", work, f"{tmp_path}/point", 20, polls=9)
    C.consume(spark, log, "g", work, f"{tmp_path}/point", 20, polls=9)
    assert sizes == {0: 180, 1: 180, 2: 40}
    got = spark.read.parquet(out)
    assert got.count() == 400 == got.select("partition", "offset").distinct().count()
    part = logs.ranges(logs.Log(log), {}, logs.Log(log).ends())[0]
    polled = [b.num_rows for b in logs.messages(log, part, 20)]
    assert max(polled) <= 20 and sum(polled) == part.end




def test_documents_of_messages(spark):
    rows = [('{"title": "t", "content": "c", "tags": ["x"], "doc_type": "note"}',), ('{"text": "only text", "timestamp": "2024"}',), ('{"other": 1}',), ("no json",), (None,)]
    df = spark.createDataFrame(rows, "value string").withColumns({"partition": F.lit(0), "offset": F.lit(0)})
    got = [(r.title, r.content, r.tags, r.doc_type, r.published_at, r.source) for r in C.documents(df, "news").collect()]
    assert got[0] == ("t", "c", ["x"], "note", "", "kafka:news") and got[1][1] == "only text" and got[1][4] == "2024"
    assert [g[1] for g in got[2:]] == ['{"other": 1}', "no json", None]


def test_kafka_options():
    assert streams.kafka_options("a:1", "t,u") == {"kafka.bootstrap.servers": "a:1", "subscribe": "t,u", "maxOffsetsPerTrigger": "50", "startingOffsets": "latest"}
    assert streams.kafka_options("a:1", "t.*", 100, "earliest", "g", True) == {"kafka.bootstrap.servers": "a:1", "subscribePattern": "t.*", "maxOffsetsPerTrigger": "100", "startingOffsets": "earliest", "kafka.group.id": "g"}


class Pages(BaseHTTPRequestHandler):
    """Three chains of pages; the second page of chain 1 fails once."""

    failed: list = []
    asked: list = []

    def answer(self, code, data):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(data).encode())

    def do_GET(self):
        Pages.asked.append((self.path, self.headers.get("X-Key")))
        chain, page = (int(x) for x in self.path.split("?")[0].strip("/").split("/"))
        if (chain, page) == (1, 1) and not Pages.failed:
            Pages.failed.append(1)
            return self.answer(503, {})
        if chain == 9:
            return self.answer(200, {"rows": [], "next": "/9/0"})
        self.answer(200, {"rows": [{"id": 100 * chain + 10 * page + k} for k in range(3)], "next": f"/{chain}/{page + 1}" if page < chain else None})

    def do_POST(self):
        self.answer(200, [{"id": json.loads(self.rfile.read(int(self.headers["Content-Length"])))["n"]}])

    def log_message(self, *args):
        pass


def test_pages_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        got = pages.read_pages(spark, [f"{url}/{c}/0" for c in range(3)], "id int", items="rows", headers={"X-Key": "k"}, params={"q": "v"})
        assert sorted(r.id for r in got.collect()) == sorted(100 * c + 10 * p + k for c in range(3) for p in range(c + 1) for k in range(3))
        assert ("/2/0?q=v", "k") in Pages.asked and ("/2/1", "k") in Pages.asked and Pages.failed
        assert pages.read_pages(spark, [f"{url}/2/0"], items="rows", most="2").count() == 6
        assert pages.read_pages(spark, [f"{url}/2/0"], items="rows", paged="false").count() == 3
        assert pages.read_pages(spark, [f"{url}/post"], "id int", method="POST", params={"n": 5}).collect()[0].id == 5
        with pytest.raises(Exception, match="lead back"):
            pages.read_pages(spark, [f"{url}/9/0"], items="rows").count()
        with pytest.raises(Exception):
            pages.read_pages(spark, ["file:///nowhere/x.json"], items="rows").count()
    finally:
        server.shutdown()


# -- keyed state: rows in several batches, out of order within the delay, with a restart ---------------------------------


def batches_of(spark, tmp_path, rows, schema, n):
    """Files that come one a batch; rows go to the file of their time, or one before or after it."""
    folder = f"{tmp_path}/in"
    for k in range(n):
        some = [r for i, r in enumerate(rows) if min(max(i * n // len(rows) + (i * 7 % 3) - 1, 0), n - 1) == k]
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def run_twice(spark, tmp_path, rows):
    """The first batches, then the rest with the state that the first run left."""
    out, seen = f"{tmp_path}/out", []

    def work(batch, number):
        if number == 3 and not seen:
            seen.append(number)
            raise OSError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state.rocksdb(spark):
        for _ in range(2):
            query = rows.writeStream.foreachBatch(work).option("checkpointLocation", f"{tmp_path}/point").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception as e:
                assert "lost" in str(e)
    return spark.read.parquet(out).drop("batch").collect()


def sample(n, seed, keys=3):
    import random

    rng = random.Random(seed)
    at, rows = T0, []
    for i in range(n):
        at += timedelta(minutes=rng.choice([1, 5, 20, 50]))
        rows.append((rng.randrange(keys), at, f"v{i}"))
    return rows


def test_presence_over_batches(spark, tmp_path):
    rows = sample(120, 1)
    ttl, end = timedelta(minutes=90), rows[-1][1] - timedelta(hours=12)
    got = run_twice(spark, tmp_path, state.presence(batches_of(spark, tmp_path, rows, "k int, t timestamp, v string", 6), "k", "v", "t", ttl, "12 hours"))
    want = []
    for key in range(3):
        held = None
        for _, t, v in [r for r in rows if r[0] == key] + [(key, datetime(2030, 1, 1), "end")]:
            if held and t >= held[1] + ttl:
                want.append((key, held[0], held[1], held[1] + ttl, held[2], held[3]))
                held = None
            held = (held[0] if held else t, t, (held[2] if held else 0) + 1, v)
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[3] <= end)
    assert len(got) > 5


def test_escalations_over_batches(spark, tmp_path):
    rows = sample(150, 2)
    window, hold, end = timedelta(hours=2), timedelta(hours=5), rows[-1][1] - timedelta(hours=12)
    got = run_twice(spark, tmp_path, state.escalations(batches_of(spark, tmp_path, rows, "k int, t timestamp, v string", 6), "k", "v", "t", 3, window, hold, "12 hours"))
    want, recent, now = [], defaultdict(list), {}
    for key, t, _ in rows:
        if key in now and t >= now[key][0] + hold:
            want.append((key, now[key][0], now[key][0] + hold, now.pop(key)[1]))
        if key in now:
            now[key] = (now[key][0], now[key][1] + 1)
            continue
        recent[key] = [x for x in recent[key] if x >= t - window] + [t]
        if len(recent[key]) == 3:
            now[key], recent[key] = (t, 0), []
    want += [(k, at, at + hold, n) for k, (at, n) in now.items()]
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[2] <= end)
    assert len(got) > 3


def test_conversations_without_times_or_text(spark, tmp_path):
    rows = [(1, T0, 0, "user", "hi"), (1, T0, 1, None, None), (1, None, 2, "user", "no time"), (None, T0, 0, "user", "abc"), (2, T0 + timedelta(hours=9), 0, "x", "late")]
    stream = batches_of(spark, tmp_path, rows, "c int, t timestamp, n long, r string, x string", 1)
    with state.rocksdb(spark):
        got = streams.to_table(state.conversation_ends(stream, "c", "n", "r", "x", "t", timedelta(minutes=5), "0 seconds"), f"{tmp_path}/o", "append").collect()
    ended = T0 + timedelta(minutes=5)
    assert sorted(map(tuple, got), key=str) == [(1, ended, 2, "user", None, 2), (None, ended, 1, "user", "user", 3)]


def test_a_call_uses_the_state_a_few_times(monkeypatch):
    """Each use of a state is a round trip: their number doesn't follow the rows of a key."""
    import pandas as pd

    trips = []

    class Kept:
        def __init__(self, *_):
            self.now = None

        def __getattr__(self, name):
            def use(*args):
                trips.append(name)
                if name == "get":
                    return self.now if self.single else iter(self.now or [])
                if name == "exists":
                    return self.now is not None
                if name == "appendList":
                    self.now = [*(self.now or []), *args[0]]
                elif name == "appendValue":
                    self.now = [*(self.now or []), args[0]]
                else:
                    self.now = args[0] if args else None

            return use

    class Handle:
        getValueState = lambda self, *_: setattr(k := Kept(), "single", True) or k
        getListState = lambda self, *_: setattr(k := Kept(), "single", False) or k
        listTimers = lambda self: []
        registerTimer = deleteTimer = lambda self, at: None

    class Timers:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    start = pd.Timestamp(T0).value // 1_000_000
    rows = pd.DataFrame({"ts": [pd.Timestamp(T0) + pd.Timedelta(minutes=m) for m in range(300)], "value": ["v"] * 300, "alert": ["a"] * 300})
    rows = rows.assign(turn=range(300), role="user", text="t")
    hour = timedelta(hours=1)
    for processor, n in ((state.Presence(hour), 1), (state.Conversation(hour), 1), (state.Escalation(3, hour, hour), 5)):
        processor.init(Handle())
        trips.clear()
        assert list(processor.handleInputRows((1,), iter([rows]), Timers(0))) == []
        out = list(processor.handleExpiredTimer((1,), Timers(start + 10 * 3_600_000), None))
        assert sum(map(len, out)) == n and len(trips) < 20
        assert list(processor.handleExpiredTimer((1,), Timers(start + 20 * 3_600_000), None)) == []
