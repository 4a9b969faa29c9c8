import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmine.checks import all_checked
from quillmine.streaming import jobs as sj

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def plain_accept(rows, seconds, compare):
    state, taken = {}, []
    for key, value, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        last = state.get(key)
        if last is None or (ts - last[0]).total_seconds() >= seconds or (compare and value != last[1]):
            state[key] = (ts, value)
            taken.append(seq)
    return sorted(taken)


def events(n, step_seconds, rng):
    ts, out = START, []
    for seq in range(n):
        ts += dt.timedelta(seconds=rng.choice(step_seconds))
        out.append(("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 5)}", rng.choice("ab"), ts, seq))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, ts timestamp_ntz, seq long")


@pytest.mark.parametrize("block_lifetimes", [1, 2, 7, 500])
@pytest.mark.parametrize("steps", [[60, 3600, 7 * 3600], [0, 0, 300, 900], [40 * 3600, 24 * 3600, 300 * 3600, 0]])
def test_ttl_batch(spark, block_lifetimes, steps):
    rows = events(500, steps, random.Random(1)) + [(None, "a", START + i * HOUR, 9000 + i) for i in range(40)]
    got = sj.ttl_batch(frame(spark, rows), block_lifetimes=block_lifetimes)
    assert sorted(r.seq for r in got.collect()) == plain_accept(rows, 24 * 3600, False)


def test_cooldown_batch(spark):
    rows = events(3000, [0, 1, 2, 3, 900], random.Random(2))
    got = sj.cooldown_batch(frame(spark, rows))
    assert sorted(r.seq for r in got.collect()) == plain_accept(rows, 5, True)


def test_cooldown_bursts_cross_slices(spark):
    rows = [("u", "a", START + dt.timedelta(seconds=2 * i), i) for i in range(120)]
    got = sj.cooldown_batch(frame(spark, rows), slice_seconds=30)
    assert sorted(r.seq for r in got.collect()) == plain_accept(rows, 5, True)


def run_stream(spark, rows, tmp_path, job):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sj.STATE_STORE)
    source = str(tmp_path / "in")
    for day in range(3):
        part = [r for r in rows if r[2] < START + (day + 1) * 24 * HOUR and r[2] >= START + day * 24 * HOUR]
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema("key string, value string, ts timestamp_ntz, seq long")
        .option("maxFilesPerTrigger", 1).parquet(source)
    )
    query = (
        job(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_ttl_stream_equals_batch(spark, tmp_path):
    rows = [("u1", "", START + h * HOUR, h) for h in (0, 5, 25, 30, 50)] + [("u2", "", START + h * HOUR, 100 + h) for h in (1, 26)]
    got = run_stream(spark, rows, tmp_path, sj.ttl_stream)
    assert got == plain_accept(rows, 24 * 3600, False)
    assert sorted(r.seq for r in sj.ttl_batch(frame(spark, rows)).collect()) == got


def test_cooldown_stream(spark, tmp_path):
    rows = events(200, [0, 1, 2, 3, 400], random.Random(6))
    assert run_stream(spark, rows, tmp_path, sj.cooldown_stream) == plain_accept(rows, 5, True)


def test_ingest_writes_pages_and_links(spark, tmp_path):
    body = "<main><p>" + "word " * 50 + '<a href="https://team.atlassian.net/browse/AB-1">the design ticket</a></p></main>'
    df = spark.createDataFrame([("https://w.example.org/1", body), ("https://w.example.org/2", " ")], "url string, html string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    sj.ingest(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/pages_clean").select("page_url").collect()[0][0] == "https://w.example.org/1"
    link = spark.read.parquet(f"{out}/links").select("url", "type", "confidence").collect()
    assert [tuple(r) for r in link] == [("https://team.atlassian.net/browse/AB-1", "jira", "high")]
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_ingest_reads_a_file_or_a_folder(spark, tmp_path, files):
    """The pages table may be one file, or a folder of files as Spark writes it."""
    body = "<main><p>" + "word " * 50 + "</p></main>"
    rows = [(i, f"https://w.example.org/{i}", body) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if files:
        pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    else:
        pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    # another table beside it stays out
    spark.range(3).write.parquet(str(tmp_path / "part.parquet"))
    got = all_checked()["stream_ingest"].build(spark, str(tmp_path))
    assert sorted(r.page_url for r in got.collect()) == [url for _, url, _ in rows]


class Kept:
    """A key's state and timers that note what is asked of them."""

    def __init__(self):
        self.calls, self.state, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.state

    def update(self, value):
        self.calls.append("update")
        self.state = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def test_a_key_has_one_timer_and_asks_its_state_once():
    kept, job = Kept(), sj.AcceptAfter(5, False)
    job.init(kept)
    rows = [Row(key="a", value="", at=at, seq=seq) for at, seq in ((9_000_000, 4), (None, 5), (1_000_000, 2), (1_000_000, 1), (6_000_000, 3))]
    assert [(r.at, r.seq) for r in job.handleInputRows(("a",), iter(rows), None)] == [(1_000_000, 1), (6_000_000, 3)]
    assert kept.calls == ["get", "update", "register"] and kept.timers == {11_001}
    assert [r.seq for r in job.handleInputRows(("a",), iter([Row(key="a", value="", at=11_000_000, seq=6)]), None)] == [6]
    assert kept.calls[3:] == ["get", "update", "delete", "register"] and kept.timers == {16_001}
