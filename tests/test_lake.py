"""The lake: raw tables, documents, replays, and counts of broken rules."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridledger import fixed_values as V
from gridledger.operators import gold, sections
from gridledger.operators.quality import expect
from gridledger.plans import medallion
from gridledger.session import scratch_path
from gridledger.sources import envelopes, files
from gridledger.streaming import feeds

PRICE = '[{"hour": %d, "delivery_ts": "2026-03-2%dT0%d:00:00Z", "price_eur_mwh": %s, "is_negative": false, "market": "NL"}]'


def envelope(day, hour, price):
    return json.dumps({"source_api": "a", "market": "NL", "fetch_date": f"2026-03-2{day}", "ingestion_ts": "2026-04-01T00:00:00Z",
                       "raw_payload": PRICE % (hour, day, hour, price)})


def drop(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", encoding="utf-8") as file:
        file.write("\n".join(lines))


@pytest.fixture
def inbox(spark):
    path = scratch_path(spark, "inbox")
    drop(f"{path}/prices", "a.json", [envelope(3, 1, 5.0), "#" + envelope(3, 2, -7.0), envelope(3, 3, 9000.0)])
    for feed in ("generation", "congestion"):  # no rows that count
        drop(f"{path}/{feed}", "a.json", ['{"ingestion_ts": "2026-04-01T00:00:00Z", "raw_payload": "[]"}'])
    drop(f"{path}/contracts", "one.txt", ["ARTICLE 1 — Price", "The price floor shall apply to the fixed price.", "more words of it"])
    drop(f"{path}/contracts", "two.txt", ["ARTICLE 2 — Force majeure", "Force majeure and change in law are borne by the Seller."])
    return path


RUNS = {
    "batch": lambda *a, **k: medallion.run(*a, **k),
    "stream": lambda *a, **k: medallion.run_streams(*a, **k),
}
TEXT = {"extractor": medallion.plain_text, "glob": "*.txt"}


def prices(spark, lake):
    return sorted((r.hour, r.price_eur_mwh) for r in medallion.read_table(spark, f"{lake}/silver/prices").collect())


@pytest.mark.parametrize("how", sorted(RUNS))
def test_imbalance_prices_are_a_feed(spark, inbox, how):
    row = '[{"delivery_ts": "2026-03-23T01:00:00Z", "market": "NL", "imbalance_price": %s}, {"market": "NL", "imbalance_price": 1.0}]'
    made = {"source_api": "a", "market": "NL", "fetch_date": "2026-03-23"}
    lines = [json.dumps(made | {"ingestion_ts": f"2026-04-0{day}T00:00:00Z", "raw_payload": row % price}) for day, price in ((2, 9.5), (1, 8.5))]
    drop(f"{inbox}/imbalance", "a.json", [*lines, "# broken"])
    lake = scratch_path(spark, "lake")
    RUNS[how](spark, inbox, lake, feeds=(*medallion.CORE, "imbalance"))
    assert spark.read.parquet(f"{lake}/bronze/imbalance").filter("_rescued IS NOT NULL").count() == 1
    kept = medallion.read_table(spark, f"{lake}/silver/imbalance")
    assert sorted(r.imbalance_price for r in kept.collect()) == [8.5, 9.5]
    both = gold.imbalance_prices(medallion.read_table(spark, f"{lake}/silver/prices"), kept).collect()
    assert [(r.price_eur_mwh, r.imbalance_price) for r in both] == [(5.0, 9.5)]


@pytest.mark.parametrize("how", sorted(RUNS))
def test_raw_rows_are_kept_and_replayed(spark, inbox, how):
    lake = scratch_path(spark, "lake")
    RUNS[how](spark, inbox, lake)
    raw = spark.read.parquet(f"{lake}/bronze/prices")
    assert raw.count() == 3 and raw.filter("_source_file LIKE '%a.json'").count() == 3
    assert [r[0][:2] for r in raw.filter("_rescued IS NOT NULL").select("_rescued").collect()] == ["#{"]
    assert prices(spark, lake) == [(1, 5.0)]  # one line unreadable, one out of range
    # The parser learns to read the line; what was delivered is still there.
    medallion.rebuild(spark, lake, "prices", repair=lambda line: F.regexp_replace(line, "^#", ""))
    assert prices(spark, lake) == [(1, 5.0), (2, -7.0)]
    signals = spark.read.parquet(f"{lake}/gold/market_risk_signals").filter("is_negative")
    assert signals.count() == 1
    # New files come on top, old ones are not read again, raw rows are never rewritten.
    drop(f"{inbox}/prices", "b.json", [envelope(4, 4, 1.0)])
    RUNS[how](spark, inbox, lake)
    assert spark.read.parquet(f"{lake}/bronze/prices").count() == 4
    assert (4, 1.0) in prices(spark, lake) and len(prices(spark, lake)) == (2 if how == "batch" else 3)


def chunks(spark, lake):
    return sorted((r.contract_id, r.clause_id, r.risk_category, r.chunk_text) for r in medallion.contract_chunks(spark, lake).collect())


@pytest.mark.parametrize("how", sorted(RUNS))
def test_documents_become_chunks(spark, inbox, how):
    lake = scratch_path(spark, "lake")
    drop(f"{inbox}/contracts", "bad.txt", ["x"])
    with open(f"{inbox}/contracts/bad.txt", "wb") as file:
        file.write(b"ARTICLE 3 \xe9 Collateral\nCollateral or a letter of credit is due.")
    RUNS[how](spark, inbox, lake, **TEXT)
    assert [(c, k, r) for c, k, r, _ in chunks(spark, lake)] == [
        ("one", "ARTICLE 1", "price_risk"), ("two", "ARTICLE 2", "legal_regulatory")]
    errors = medallion.document_errors(spark, lake).collect()
    assert [r.contract_id for r in errors] == ["bad"] and "UnicodeDecodeError" in errors[0].error
    assert sorted(r.contract_id for r in medallion.current_documents(spark, lake).collect()) == ["bad", "one", "two"]
    counts = {r.rule: r.failed for r in spark.read.parquet(f"{lake}/metrics").collect()}
    assert counts == dict.fromkeys(V.CHUNK_RULES, 0)
    # A decoder that reads the file: only failed files are decoded again.
    medallion.replay_documents(spark, inbox, lake, extractor=lambda data: [(1, x) for x in data.decode("latin-1").split("\n")], glob="*.txt")
    assert medallion.document_errors(spark, lake).count() == 0
    assert [c for c, *_ in chunks(spark, lake)] == ["bad", "one", "two"]
    assert spark.read.parquet(f"{lake}/bronze/documents").count() == 4


def test_batch_and_stream_give_the_same_chunks(spark, inbox):
    lakes = [scratch_path(spark, "lake") for _ in RUNS]
    for lake, how in zip(lakes, sorted(RUNS), strict=True):
        RUNS[how](spark, inbox, lake, **TEXT)
    assert chunks(spark, lakes[0]) == chunks(spark, lakes[1]) and len(chunks(spark, lakes[0])) == 2


def test_a_changed_file_replaces_its_chunks_and_a_replayed_batch_changes_nothing(spark, inbox):
    lake = scratch_path(spark, "lake")
    medallion.drain_documents(spark, inbox, lake, **TEXT)
    time.sleep(1.1)
    drop(f"{inbox}/contracts/v2", "one.txt", ["ARTICLE 9 — Term", "The annual quantity is subject to take-or-pay."])
    medallion.drain_documents(spark, inbox, lake, max_files=1, **TEXT)
    before = chunks(spark, lake)
    assert [(c, k) for c, k, *_ in before] == [("one", "ARTICLE 9"), ("two", "ARTICLE 2")]
    # The last batch was written, but its commit is lost: it runs again over its own folders.
    commits = sorted(glob.glob(f"{lake}/_checkpoints/documents/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    assert len(commits) >= 2
    for p in (commits[-1], f"{os.path.dirname(commits[-1])}/.{os.path.basename(commits[-1])}.crc"):
        if os.path.exists(p):
            os.remove(p)
    medallion.drain_documents(spark, inbox, lake, **TEXT)
    assert chunks(spark, lake) == before
    assert spark.read.parquet(f"{lake}/silver/contract_chunks").count() == 3  # the old version stays in its batch


def test_expressions_are_built_once_a_stream_not_once_a_batch(spark, inbox, monkeypatch):
    built = []
    for name in ("tag_chunk", "detect_clause"):
        make = getattr(sections.X, name)
        monkeypatch.setattr(sections.X, name, lambda *a, n=name, f=make: built.append(n) or f(*a))
    drop(f"{inbox}/contracts", "three.txt", ["ARTICLE 3 — Fee", "Collateral or a letter of credit is due."])
    lake = scratch_path(spark, "lake")
    medallion.drain_documents(spark, inbox, lake, max_files=1, **TEXT)
    assert len(glob.glob(f"{lake}/silver/contract_chunks/batch=*")) == 3
    assert [c for c, *_ in chunks(spark, lake)] == ["one", "three", "two"]
    assert sorted(built) == ["detect_clause", "tag_chunk"]


def test_metadata_of_a_bounded_batch_are_one_file(spark, inbox):
    for i in range(12):
        drop(f"{inbox}/contracts", f"c{i}.txt", ["ARTICLE 3 — Fee", "Collateral or a letter of credit is due."])
    lake = scratch_path(spark, "lake")
    medallion.drain_documents(spark, inbox, lake, max_files=40, **TEXT)
    assert len(glob.glob(f"{lake}/bronze/documents/batch=0/*.parquet")) == 1
    assert spark.read.parquet(f"{lake}/bronze/documents").count() == 14


def test_plain_text_pages():
    assert medallion.plain_text("a\n\nb\fc".encode()) == [(1, "a"), (1, "b"), (2, "c")]


def test_warnings_are_counted_in_batch_and_stream(spark, rows):
    data = [(None, "c1"), ("t", None), (None, None), ("t", "c2"), ("", "c3")]
    schema = "chunk_text string, contract_id string"
    seen = Observation()
    assert expect(rows(data, schema), V.CHUNK_RULES, action="warn", observation=seen).count() == 5
    assert seen.get == {"non_null_chunk_text": 2, "non_null_contract_id": 2}
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    for part in (data[:2], data[2:]):
        rows(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = expect(feeds.parquet_stream(spark, path, schema, max_files=1), V.CHUNK_RULES, action="warn", observation="chunk_rules")
    query = feeds.append_stream(stream, out, checkpoint=state)
    feeds.run_to_end(query)
    assert feeds.observed(query, "chunk_rules") == {"non_null_chunk_text": 2, "non_null_contract_id": 2}
    assert spark.read.parquet(out).count() == 5 and feeds.observed(query, "other") == {}


def test_rescued_lines_do_not_change_other_reads(spark, inbox):
    plain = envelopes.read_envelopes(spark, f"{inbox}/prices")
    assert "_rescued" not in plain.columns and plain.count() == 3
    named = files.read_documents(spark, f"{inbox}/contracts", glob="*.txt", id_pattern=r"contracts/(\w)")
    assert sorted(r.contract_id for r in named.collect()) == ["o", "t"]
