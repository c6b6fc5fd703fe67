"""Envelopes, keyed tables, the whole pipeline, and batch against stream."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from gridledger.operators import islands, silver
from gridledger.plans import checks_flow, medallion
from gridledger.session import scratch_path
from gridledger.sources import envelopes, files, snapshots
from gridledger.streaming import feeds

START = dt.datetime(2026, 3, 23)
HOURS = [(START + dt.timedelta(hours=h), h % 24, float(h * 7 % 50 - 20)) for h in range(60)]


@pytest.fixture
def inbox(spark, rows):
    path = scratch_path(spark, "inbox")
    prices = rows([(int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000), h, p, p > 0, "NL", t.date()) for t, h, p in HOURS],
                  "delivery_ts bigint, hour int, price_eur_mwh double, is_negative boolean, market string, delivery_date date")
    out = envelopes.daily_envelopes(prices, order_by=["delivery_ts"], constants={"source_api": F.lit("a"), "market": F.lit("NL")})
    out.write.json(f"{path}/prices")
    generation = rows([(t.isoformat() + ".000Z", h, 1.0, 2.0, 3.0, 6.0, 8.0, 0.75, True, "NL", t.date()) for t, h, _ in HOURS],
                      "delivery_ts string, hour int, wind_onshore_mw double, wind_offshore_mw double, solar_mw double, "
                      "total_renewable_mw double, total_mw double, renewable_pct double, oversupply_flag boolean, country string, "
                      "delivery_date date")
    envelopes.daily_envelopes(generation, order_by=["delivery_ts"], constants={"country": F.lit("NL")}).write.json(f"{path}/generation")
    congestion = rows([("e1", "Z", "downward", "2026-03-23T01:00:00Z", "2026-03-23T02:00:00Z", 5.0, 1.0, "active", START.date()),
                       ("e2", "Z", "sideways", "2026-03-23T01:00:00Z", "2026-03-23T02:00:00Z", 5.0, 1.0, "active", START.date()),
                       ("e3", "Z", "upward", "2026-03-23T03:00:00Z", "2026-03-23T03:00:00Z", 5.0, 1.0, "active", START.date())],
                      "event_id string, dso_zone string, direction string, start_time string, end_time string, mw_needed double, "
                      "price_eur_mwh double, status string, day date")
    once = envelopes.daily_envelopes(congestion, date_col="day", order_by=["event_id"], max_rows=2, constants={"source": F.lit("c")})
    once.write.json(f"{path}/congestion")
    once.write.mode("append").json(f"{path}/congestion")
    return path


def test_flag_in_payload_is_not_trusted(spark, inbox):
    got = silver.silver_prices(envelopes.read_envelopes(spark, f"{inbox}/prices"))
    assert got.filter("is_negative <> (price_eur_mwh < 0)").count() == 0
    assert got.filter("delivery_ts IS NULL").count() == 0 and got.count() == len(HOURS)


def test_batch_and_stream_give_the_same_tables(spark, inbox):
    batch, stream = scratch_path(spark, "batch"), scratch_path(spark, "stream")
    medallion.run(spark, inbox, batch)
    medallion.run_streams(spark, inbox, stream)
    for name, n in (("prices", 60), ("generation", 60), ("congestion", 1)):
        # Of two deliveries the batch keeps the later one and the stream the first: only their times differ.
        a, b = (spark.read.parquet(f"{p}/silver/{name}").drop("ingestion_ts") for p in (batch, stream))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) and a.count() == n
    for name in ("market_risk_signals", "hourly_price_features"):
        a, b = (spark.read.parquet(f"{p}/gold/{name}") for p in (batch, stream))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    # A second run finds no new files and changes nothing.
    medallion.run_streams(spark, inbox, stream)
    assert spark.read.parquet(f"{stream}/silver/prices").count() == 60


def test_bad_payload_is_kept_by_the_outer_form(rows):
    from gridledger.schemas import PRICE_ROW

    env = rows([("2026-03-23", "not json"), ("2026-03-24", '[{"hour": 1}]')], "fetch_date string, raw_payload string")
    assert silver.payload_rows(env, PRICE_ROW, ["fetch_date"]).count() == 1
    assert silver.payload_rows(env, PRICE_ROW, ["fetch_date"], outer=True).count() == 2


def test_upsert_replaces_and_adds(spark, rows):
    path = scratch_path(spark, "keyed")
    snapshots.upsert(spark, path, rows([("a", 1), ("b", 2)], "k string, v int"), key=["k"])
    snapshots.upsert(spark, path, rows([("b", 3), ("c", 4)], "k string, v int"), key=["k"])
    assert sorted(map(tuple, snapshots.read_snapshot(spark, path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(Exception, match="several source rows"):
        snapshots.upsert(spark, path, rows([("d", 1), ("d", 2)], "k string, v int"), key=["k"])
    assert snapshots.read_snapshot(spark, path).count() == 3


def test_upsert_leaves_other_buckets_alone(spark, rows):
    path, schema = scratch_path(spark, "keyed"), "k bigint, v int"
    held = lambda: {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}
    snapshots.upsert(spark, path, rows([(i, 0) for i in range(100)], schema), key=["k"], buckets=8)
    before = held()
    snapshots.upsert(spark, path, rows([(7, 1)], "k int, v int"), key=["k"])
    assert len(before) == 8 and len(before - held()) == 1 and len(held()) == 8
    want = sorted((i, int(i == 7)) for i in range(100))
    assert sorted(map(tuple, snapshots.read_snapshot(spark, path).collect())) == want
    # Run again after a loss, a merge gives the same table.
    snapshots.upsert(spark, path, rows([(7, 1), (200, 2)], "k int, v int"), key=["k"])
    snapshots.upsert(spark, path, rows([(7, 1), (200, 2)], "k int, v int"), key=["k"])
    assert sorted(map(tuple, snapshots.read_snapshot(spark, path).collect())) == [*want, (200, 2)]


def test_upsert_of_nothing_and_of_null_keys(spark, rows):
    path = scratch_path(spark, "keyed")
    snapshots.upsert(spark, path, rows([], "k string, v int"), key=["k"])
    assert snapshots.read_snapshot(spark, path).columns == ["k", "v"]
    for v in (1, 2):
        snapshots.upsert(spark, path, rows([(None, v), ("a", v)], "k string, v int"), key=["k"])
    snapshots.upsert(spark, path, rows([], "k string, v int"), key=["k"])
    assert sorted(map(str, snapshots.read_snapshot(spark, path).collect())) == ["Row(k='a', v=2)", "Row(k=None, v=2)"]


def test_streamed_merge_takes_the_latest_of_a_batch(spark, rows):
    inbox, table, state = (scratch_path(spark, n) for n in ("in", "keyed", "state"))
    rows([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, seq int, v int").coalesce(1).write.parquet(inbox)
    source = feeds.parquet_stream(spark, inbox, "k string, seq int, v int")
    feeds.run_to_end(feeds.stream_upsert(source, table, key=["k"], order=["seq"], checkpoint=state))
    got = snapshots.read_snapshot(spark, table).select("k", "v")
    assert sorted(map(tuple, got.collect())) == [("a", 20), ("b", 5)]


def test_a_replayed_batch_changes_nothing(spark, rows):
    inbox, out, late, state = (scratch_path(spark, n) for n in ("in", "out", "late", "state"))
    schema = "id int, ts timestamp"
    how = {"event_time": "ts", "delay": "1 day", "path": out, "late_path": late}
    counts = []
    for i, hours in enumerate((100, 10, 90)):
        rows([(i, START + dt.timedelta(hours=hours)), (9, None)], schema).coalesce(1).write.mode("append").parquet(inbox)
        feeds.run_to_end(feeds.split_late(feeds.parquet_stream(spark, inbox, schema), checkpoint=state, **how))
        counts.append((spark.read.parquet(out).count(), spark.read.parquet(late).count()))
    assert counts == [(2, 0), (3, 1), (5, 1)]
    # The last batch is handed out again.
    feeds.split_batch(rows([(2, START + dt.timedelta(hours=90)), (9, None)], schema), 2, bounds=f"{state}-bounds", **how)
    assert (spark.read.parquet(out).count(), spark.read.parquet(late).count()) == (5, 1)


def test_snapshot_diff(rows):
    old = rows([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    new = rows([("b", 3), ("c", None), ("d", None)], "k string, v int")
    got = sorted((r["k"], r["_change"]) for r in snapshots.snapshot_diff(old, new, key=["k"]).collect())
    assert got == [("a", "delete"), ("b", "update"), ("d", "insert")]


def test_missing_chunk_table_is_empty(spark):
    got = files.read_chunks(spark, scratch_path(spark, "none"))
    assert got.count() == 0 and "risk_category" in got.columns


def test_html_table_stops_at_the_first(rows):
    html = ("<table><tr><th>Zone</th><th>MW</th></tr><tr><td>A &amp; B</td><td>5</td></tr><tr><td>C</td></tr></table>"
            "<table><tr><th>Zone</th></tr><tr><td>no</td></tr></table>")
    df = rows([(1, html), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    got = files.parse_html_tables(df, key="page_id", html_col="html", columns=["Zone", "MW"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, "A & B", "5"), (1, 1, "C", None)]


def test_html_table_of_untidy_pages(rows):
    pages = [
        (1, "<TABLE class='a'><thead><TR><TH> Zone</TH><th>MW</th></tr></thead><!-- <tr><td>no</td></tr> -->"
            "<tr><td>caf&eacute;&nbsp;<b>x</b> &#8364;&#x1F600; &unknown; &#xD800; a&b<td>5 &lt; 6</tr><tr></tr></TABLE>"),
        (2, "<table><tr><th>Zone<th>MW<tr><td><table><tr><td>in</td></tr></table></td><td>7</td></tr><tr><td>last</td></tr></table><tr><td>out"),
        (3, "<table><tr><th>MW</th></tr></table>"), (4, "<table></table>"), (5, "<table><tr><td>Other</td></tr><tr><td>1</td></tr>"), (6, ""),
        (7, "<p>first</p><table><tr><th>Zone</th></tr>" + "".join(f"<tr><td>z{i}</td></tr>" for i in range(5000)) + "</table>"),
    ]
    got = files.parse_html_tables(rows(pages, "page_id int, html string"), key="page_id", html_col="html", columns=["Zone", "MW"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.row_no, r.Zone, r.MW))
    assert by.pop(7) == [(i, f"z{i}", None) for i in range(5000)]
    assert by.pop(1) == [(0, "café\xa0x €\U0001F600 &unknown; &#xD800; a&b", "5 < 6"), (1, None, None)]
    assert by.pop(5) == [(0, None, None)]
    assert [r[1] for r in by[2]] == ["", "in", "last"] and set(by) == {2}


def test_normalised_rows_are_repeatable(rows):
    raw = rows([("Z", "up", "2026-03-23 01:00:00", "later", "x", "7.5")],
               "Zone string, Direction string, Start string, End string, MW string, `Price (€/MWh)` string")
    a, b = (silver.normalise_columns(raw).first() for _ in range(2))
    assert a["event_id"] == b["event_id"] and a["end_time"] is None and (a["mw_needed"], a["price_eur_mwh"]) == (0.0, 7.5)


def test_watermark_drops_and_counts_late_rows(spark, rows):
    path, state, out = (scratch_path(spark, n) for n in ("in", "state", "out"))
    schema = "market string, delivery_ts timestamp, price_eur_mwh double, is_negative boolean"
    for day in (0, 20, 1, 40):
        rows([("NL", START + dt.timedelta(days=day), -1.0, True)], schema).coalesce(1).write.mode("append").parquet(path)
        query = feeds.append_stream(
            feeds.stream_tumbling_negative(feeds.parquet_stream(spark, path, schema)), out, checkpoint=state)
        feeds.run_to_end(query)
        if day == 1:
            assert feeds.dropped_by_watermark(query) == 1
    starts = sorted(r["window_start"] for r in spark.read.parquet(out).collect())
    assert starts == [START, START + dt.timedelta(days=20)]


def test_batch_sessions_equal_streamed_sessions(spark, rows):
    schema = "market string, delivery_ts timestamp, price_eur_mwh double, is_negative boolean"
    data = [("NL", t, p, p < 0) for t, _, p in HOURS]
    path, state, out = (scratch_path(spark, n) for n in ("in", "state", "out"))
    df = rows(data, schema)
    df.unionByName(rows([("end", START + dt.timedelta(days=60), -1.0, True)], schema)).write.parquet(path)
    feeds.run_to_end(feeds.append_stream(
        feeds.stream_session_negative(feeds.parquet_stream(spark, path, schema)), out, checkpoint=state))
    streamed = spark.read.parquet(out).filter("market = 'NL'").select("market", "window_start", "window_end", "min_price", "hours_count")
    batch = islands.negative_windows(df).select("market", "window_start", "window_end", "min_price", "hours_count")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_trigger_of_the_market_feed():
    assert feeds.MARKET_REFRESH == {"processingTime": "15 minutes"}


def test_snapshot_diff_sees_nulls_that_move(rows):
    old = rows([("k", None, "x"), ("s", None, None)], "k string, a string, b string")
    new = rows([("k", "x", None), ("s", None, None)], "k string, a string, b string")
    assert [(r["k"], r["_change"]) for r in snapshots.snapshot_diff(old, new, key=["k"]).collect()] == [("k", "update")]


def test_a_large_day_does_not_split_others(rows):
    events = rows([("2024-01-01", i) for i in range(40)] + [("2024-01-02", i) for i in range(3)], "day string, event_id int")
    out = envelopes.daily_envelopes(events, date_col="day", order_by=["event_id"], max_rows=4).collect()
    assert sum(r["fetch_date"] == "2024-01-02" for r in out) == 1 and sum(r["fetch_date"] == "2024-01-01" for r in out) > 5


def test_latest_delivery_wins_in_batch_and_stream(spark, inbox):
    row = '[{"event_id": "e1", "dso_zone": "Z", "direction": "%s", "start_time": "2026-03-23T01:00:00Z", ' \
          '"end_time": "2026-03-23T02:00:00Z", "mw_needed": %s, "price_eur_mwh": 1.0, "status": "active"}]'
    stream, batch = scratch_path(spark, "lake"), scratch_path(spark, "lake")
    medallion.run_streams(spark, inbox, stream)
    for seen, mw, way in (("2999-01-02", 9.0, "downward"), ("2999-01-01", 7.0, "downward")):  # the later one first
        new = spark.createDataFrame([("c", f"{seen}T00:00:00Z", row % (way, mw))], "source string, ingestion_ts string, raw_payload string")
        new.write.mode("append").json(f"{inbox}/congestion")
        medallion.run_streams(spark, inbox, stream)
    medallion.run(spark, inbox, batch)
    for lake in (stream, batch):
        assert [(r.event_id, r.mw_needed) for r in spark.read.parquet(f"{lake}/silver/congestion").collect()] == [("e1", 9.0)]


def test_null_keys_are_no_change(rows):
    old = rows([(None, None, 1), (None, "x", 2), ("a", None, 3)], "k string, l string, v int")
    assert snapshots.snapshot_diff(old, old, key=["k", "l"]).count() == 0
    new = rows([(None, None, 5), ("a", None, 3), ("b", None, None)], "k string, l string, v int")
    got = [tuple(r) for r in snapshots.snapshot_diff(old, new, key=["k", "l"]).collect()]
    assert sorted(got, key=str) == sorted([(None, None, "update", 5), (None, "x", "delete", None), ("b", None, "insert", None)], key=str)


def test_changes_bring_derived_vectors_up_to_date(rows):
    from gridledger.operators import search

    old = rows([(1, "a b"), (2, "c"), (None, "n"), (4, None)], "k int, t string")
    new = rows([(1, "a b"), (2, "c d"), (None, "m m n"), (5, "e"), (6, "")], "k int, t string")
    derive = lambda d: search.embed_text(d, key="k", text="t", dim=8)
    changes = snapshots.snapshot_diff(old, new, key=["k"])
    got = snapshots.apply_changes(derive(old), changes, derive, key=["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, derive(new).collect()))
    made = []
    snapshots.apply_changes(derive(old), changes, lambda d: made.append(d) or derive(d), key=["k"])
    assert made[0].count() == 4  # what did not change is not derived again


@pytest.mark.parametrize("name", ["files_sorted", "src_document_stream"])
def test_every_page_is_a_file(spark, rows, name):
    folder = scratch_path(spark, "pages")
    rows([(i, None if i == 3 else "x" * i) for i in range(50)], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    got = sorted((r.file, r.file_size_bytes) for r in checks_flow.QUERIES[name](spark, folder).collect())
    assert got == [(i, 1 if i == 3 else i + 1) for i in range(50)]


TEXTS = [("a", 2, "two"), (None, 0, "no key"), ("b c", 0, None), ("a", 1, "eins\u00e9"), ("", 1, "empty key"), ("a", 3, None), ("x=y%é", 0, "z")]


@pytest.mark.parametrize("where", ["disk", "store"])
def test_texts_are_written_as_a_file_a_key(spark, rows, monkeypatch, where):
    if where == "store":  # Spark's writer, as for a path that is on no disk
        monkeypatch.setattr(files, "_shared_disk", lambda *_: None)
    path = scratch_path(spark, "texts")
    files.write_texts(rows(TEXTS, "k string, n int, t string"), path, key="k", text="t", order=["n"])
    found = files.read_documents(spark, path, glob="*.txt", id_pattern=r"k=([^/]+)/", content=True).collect()
    assert {r.contract_id: bytes(r.content).decode() for r in found} == {
        "a": "eins\u00e9\ntwo\n\n", files.NO_KEY: "no key\nempty key\n", "b c": "\n", "x%3Dy%25é": "z\n"}
    assert len(found) == 4 and all("/folder=" in r.path for r in found)


def test_texts_on_a_disk_are_written_by_the_tasks(spark, rows):
    # A file a key and nothing beside it: Hadoop's local file system adds a checksum file and starts processes for each.
    path = scratch_path(spark, "texts")
    files.write_texts(rows([(i, "x") for i in range(600)], "k long, t string"), path, key="k", text="t")
    made = [f for f in glob.glob(f"{path}/**", recursive=True, include_hidden=True) if os.path.isfile(f)]
    assert sorted(os.path.basename(f) for f in made) == ["text.txt"] * 600
    assert len(os.listdir(path)) <= files.TEXT_FOLDERS


def test_many_files_share_the_tasks_that_read_their_metadata(spark, rows):
    path, size = scratch_path(spark, "texts"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    files.write_texts(rows([(i, "x") for i in range(600)], "k long, t string"), path, key="k", text="t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a task
    try:
        found = files.read_documents(spark, path, glob="*.txt")
        assert found.rdd.getNumPartitions() <= files.METADATA_TASKS and found.count() == 600
        assert files.read_documents(spark, path, glob="*.txt", content=True).rdd.getNumPartitions() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_stream_of_files_writes_no_file_a_few_files(spark, rows):
    folder, out, state = (scratch_path(spark, n) for n in ("texts", "out", "state"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    files.write_texts(rows([(i, "x" * i) for i in range(600)], "file long, html string"), folder, key="file", text="html")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = files.read_documents(spark, folder, stream=True, glob="*.txt", id_pattern=r"file=([^/]+)/")
        feeds.run_to_end(feeds.append_stream(found, out, checkpoint=state))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(glob.glob(f"{out}/*.parquet")) <= files.METADATA_TASKS
    got = spark.read.parquet(out).selectExpr("cast(contract_id as int) AS file", "file_size_bytes").collect()
    assert sorted(map(tuple, got)) == [(i, i + 1) for i in range(600)]
