"""Headings, chunks, tags, phrases, search, reranking, scoring and reports on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from gridledger import fixed_values as V
from gridledger.functions import text as X
from gridledger.operators import corpus, evaluation, report, rerank, risk, search, sections, token_index, vector_index


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_headings(rows):
    lines = {
        "ARTICLE 7 — NEGATIVE PRICE": ("ARTICLE 7", "NEGATIVE PRICE"),
        "Article 12": ("Article 12", "Article 12"),
        "7.2 Negative Price Floor\nbody": ("7.2", "Negative Price Floor"),
        "7.2.1 Scope": ("7.2.1", "Scope"),
        "7.2 lower case": None,
        "7 Single number": None,
        "SCHEDULE 3: Profiles": ("SCHEDULE 3", "Profiles"),
        "Annex B - Map": ("Annex B", "Map"),
        "(iv) the Buyer": ("iv", "the Buyer"),
        "(xyz) other": None,
        "The Seller shall deliver.": None,
        "  8.1 Basis Risk": ("8.1", "Basis Risk"),
        "Édition 4": None,
        "": None,
    }
    df = rows([(t,) for t in lines], "t string")
    got = [None if h is None else tuple(h) for h in column(df, X.detect_clause(F.col("t")))]
    assert got == list(lines.values())


def docs(rows, *blocks):
    return rows([("d", [{"page": p, "text": t} for p, t in blocks])], "contract_id string, blocks array<struct<page:int,text:string>>")


def test_sections_and_both_forms_agree(rows):
    d = docs(rows, (1, "Cover page"), (1, "x"), (2, "7.1 Price Floor"), (2, "Text one"), (3, "Text two"), (4, "ARTICLE 8"), (4, "  Tail end  "))
    got = [tuple(r)[1:] for r in sections.split_sections(d).orderBy("section_ord").collect()]
    assert got == [
        (0, "PREAMBLE", "Preamble", 1, "Cover page"),
        (1, "7.1", "Price Floor", 2, "7.1 Price Floor Text one Text two"),
        (2, "ARTICLE 8", "ARTICLE 8", 4, "ARTICLE 8 Tail end"),
    ]
    flat = d.select("contract_id", F.posexplode("blocks").alias("block_no", "b")).select("contract_id", "b.page", "block_no", "b.text")
    carried = sections.section_carry_forward(flat).orderBy("block_no").collect()
    assert [r["clause_id"] for r in carried] == ["PREAMBLE", "7.1", "7.1", "7.1", "ARTICLE 8", "ARTICLE 8"]
    assert [tuple(r) for r in sections.split_sections(sections.gather_blocks(flat)).orderBy("section_ord").collect()] == [
        tuple(r) for r in sections.split_sections(d).orderBy("section_ord").collect()]


@pytest.mark.parametrize("n, starts", [(0, []), (1, [0]), (393, [0]), (394, [0, 344]), (442, [0, 344]), (800, [0, 344, 688])])
def test_chunk_windows(rows, n, starts):
    text = " ".join(f"w{i}" for i in range(n))
    df = rows([("d", 0, "7.1", "Title", 1, text)], "contract_id string, section_ord int, clause_id string, section_title string, page_number int, section_text string")
    got = sorted(sections.chunk_words(df).collect(), key=lambda r: r["char_start"])
    assert [r["char_start"] // 5 for r in got] == starts
    assert [r["token_count"] for r in got] == [min(393, n - s) for s in starts]


def test_repeated_clause_numbers_keep_distinct_ids(rows):
    d = docs(rows, (1, "(i) first"), (1, "(i) second"))
    ids = sections.chunk_words(sections.split_sections(d))
    assert ids.select("chunk_id").distinct().count() == 2
    legacy = sections.chunk_words(sections.split_sections(d), legacy_ids=True)
    assert legacy.select("chunk_id").distinct().count() == 1


def test_failed_files_become_rows(rows):
    def extract(data):
        if data == b"bad":
            raise ValueError("broken")
        yield 1, data.decode()

    files = rows([("a", bytearray(b"7.1 Price floor text")), ("b", bytearray(b"bad"))], "contract_id string, content binary")
    chunks, failed = sections.parse_documents(files, extractor=extract)
    assert [r["risk_category"] for r in chunks.collect()] == ["price_risk"]
    assert [tuple(r) for r in failed.collect()] == [("b", "ValueError: broken")]


TAGS = {
    "Only 50 EUR/MWh is named": None,
    "A fixed price of 55 EUR/MWh": "price_risk",
    "The PRICE FLOOR applies": "price_risk",
    "A pricefloor or price floors": None,
    "Curtailment and annual quantity": "curtailment_risk",
    "no compensation for curtailments": None,
    "No compensation; deemed output": "curtailment_risk",
    "take-or-pay": "volume_risk",
    "the betting sets": None,
    "ETS and subsidy": "legal_regulatory",
    "éprice floor": None,
    "price floor_": None,
    "«price floor»": "price_risk",
    "congestion, congestion": None,
    "": None,
}


def test_tags(spark, rows):
    df = rows([(t,) for t in TAGS], "t string")
    assert column(df, X.tag_chunk(F.col("t"))) == list(TAGS.values())
    X.register_tag_text(spark)
    assert column(df, F.expr("tag_text(t)")) == list(TAGS.values())
    many = rows([("Insolvency, delivery point, force majeure and curtailment",)], "t string")
    assert column(many, X.tag_all(F.col("t"))) == [["curtailment_risk", "basis_risk", "counterparty_risk", "legal_regulatory"]]


def test_tags_keep_what_is_there(rows):
    df = rows([("price floor", None), ("price floor", "volume_risk")], "chunk_text string, risk_category string")
    assert [r["risk_category"] for r in sections.tag_batch(df).collect()] == ["price_risk", "volume_risk"]


def test_floor_phrases(rows):
    df = rows([("No price floor applies",), ("Price Floor shall apply automatically",), ("floor shall apply",), (None,), ("",)], "t string")
    assert column(df, X.has_floor(F.col("t"))) == [False, True, True, False, False]


def test_tags_run_without_python(rows):
    plan = sections.chunk_documents(docs(rows, (1, "text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def brute_overlap(queries, chunks, k):
    out = set()
    for qid, q in queries:
        words = set(q.lower().split())
        scored = sorted((-len(words & set(t.lower().split())) / max(len(words), 1), c) for c, t in chunks)
        out |= {(qid, c, round(-s, 9), i + 1) for i, (s, c) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("bits", [10, 2, 0])
def test_search_equals_brute_force(rows, bits):
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(30)] + ["the"] * 15
    chunks = [(f"c{i:03d}", " ".join(rnd.choices(pool, k=rnd.randint(0, 12)))) for i in range(120)]
    queries = [(i, " ".join(rnd.choices(pool, k=rnd.randint(0, 6)))) for i in range(9)]
    corpus_df = rows([(c, "k", "7", "T", None, t) for c, t in chunks],
                     "chunk_id string, contract_id string, clause_id string, section_title string, risk_category string, chunk_text string")
    index = token_index.index_of(corpus_df, key="chunk_id", text="chunk_text", columns=["contract_id"], block_bits=bits)
    got = token_index.search_index(rows(queries, "query_id int, query string"), index, k=5).collect()
    assert {(r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in got} == brute_overlap(queries, chunks, 5)


def test_search_filters(rows):
    df = rows([("a", "x", "7", "T", "price_risk", "one"), ("b", "y", "7", "T", "volume_risk", "one")],
              "chunk_id string, contract_id string, clause_id string, section_title string, risk_category string, chunk_text string")
    asked = rows([(1, "one")], "query_id int, query string")
    ids = lambda **f: [r["chunk_id"] for r in search.token_overlap_search(asked, df, **f).orderBy("rank").collect()]
    assert ids() == ["a", "b"] and ids(contract_ids=[]) == ["a", "b"]
    assert ids(contract_ids=["y"]) == ["b"] and ids(categories=["price_risk"]) == ["a"]
    assert ids(contract_ids=rows([("x",)], "contract_id string")) == ["a"]


def hits(rows, *texts, query="price floor"):
    return rows([(1, query, f"c{i}", t, i + 1) for i, t in enumerate(texts)], "query_id int, query string, chunk_id string, chunk_text string, rank int")


def test_rerank_variants(rows):
    h = hits(rows, "nothing here", "price floor floor", "price only of many many words", "floor")
    ids = lambda **k: [r["chunk_id"] for r in rerank.rerank(h, **k).orderBy("rerank_rank").collect()]
    assert ids(n=2)[0] == "c1"
    assert ids(n=3, scorer="identity") == ["c0", "c1", "c2"]
    assert [r["rerank_score"] for r in rerank.rerank(h, n=2, scorer="identity").orderBy("rerank_rank").collect()] == pytest.approx([0.99, 0.98])
    by_length = lambda q, p: p.str.len().astype(float)
    assert ids(n=2, scorer=by_length) == ["c2", "c1"] and ids(n=2, scorer=by_length, keep_order=True) == ["c1", "c2"]


def clause(category, text, neg=168, avg=-28.7, congestion=False, contract="k", clause_id="7.2", rank=1):
    return (1, contract, clause_id, category, text, neg, avg, congestion, rank)


CLAUSE = ("query_id int, contract_id string, clause_id string, risk_category string, chunk_text string, "
          "negative_hours_90d bigint, avg_negative_price double, has_congestion boolean, rerank_rank int")


def test_scoring_table(rows):
    cases = [
        (clause("price_risk", "No price floor applies"), ("HIGH", 195543.0)),
        (clause("price_risk", "floor applies, not fall below zero"), ("LOW", None)),
        (clause("price_risk", "text", neg=0, avg=0.0), ("MEDIUM", None)),
        (clause("curtailment_risk", "No compensation", congestion=True), ("HIGH", 29099.0)),
        (clause("curtailment_risk", "No compensation"), ("MEDIUM", None)),
        (clause("curtailment_risk", "paid"), ("LOW", None)),
        (clause("volume_risk", ""), ("MEDIUM", None)),
        (clause("counterparty_risk", ""), ("MEDIUM", None)),
        (clause("basis_risk", ""), ("LOW", None)),
        (clause("legal_regulatory", ""), ("LOW", None)),
    ]
    got = risk.score_clauses(rows([c for c, _ in cases], CLAUSE)).select("severity", "exposure_eur").collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, [e for _, e in cases]))
    dropped = rows([clause("price_risk", "floor applies", neg=0, avg=0.0), clause(None, "x"), clause("other", "x")], CLAUSE)
    assert risk.score_clauses(dropped).count() == 0


def test_high_price_sentence(rows):
    said = risk.score_clauses(rows([clause("price_risk", "text")], CLAUSE)).first()["description"]
    assert said == ("No negative price floor in contract. Market had 168 negative price hours "
                    "(avg -28.7 EUR/MWh) in last 90 days.")


def test_first_flag_per_contract_and_category_then_severity(rows):
    df = rows([clause("basis_risk", "", rank=1), clause("price_risk", "", rank=2, clause_id="7.1"),
               clause("price_risk", "", rank=3, clause_id="7.9"), clause("volume_risk", "", rank=4)], CLAUSE)
    got = risk.risk_flags(df).orderBy("flag_order").collect()
    assert [(r["severity"], r["clause_id"]) for r in got] == [("HIGH", "7.1"), ("MEDIUM", "7.2"), ("LOW", "7.2")]
    none = rows([clause("volume_risk", "")], CLAUSE)
    assert risk.exposure_total(risk.risk_flags(none), by=["query_id"]).first()["total_exposure_eur"] is None


def test_reports_without_flags_and_with_markup(rows):
    sessions = rows([(1, "<b>?</b>", "NL", None, None, None)],
                    "query_id int, query string, market string, negative_hours_90d bigint, avg_negative_price double, created_at timestamp")
    no_clauses = rows([], CLAUSE + ", chunk_id string")
    no_flags = risk.risk_flags(rows([], CLAUSE))
    built = report.build_report(sessions, no_clauses, no_flags)
    row = built.first()
    assert row["narrative"] == V.NARRATIVE_EMPTY and row["risk_flags"] == [] and row["report_kind"] == "minimal"
    page = report.render_html(built).first()["html"]
    assert "&lt;b&gt;?&lt;/b&gt;" in page and "<b>" not in page and V.NO_FLAGS in page
    assert report.report_summary(built).first()["highest_severity"] is None
    assert report.get_report(built, "2").count() == 0


def test_market_without_negatives_reads_na(rows):
    signals = rows([("NL", "2026-03-23", 12, 50.0, 0.8, "LOW")],
                   "market string, delivery_date string, hour int, price_eur_mwh double, renewable_pct double, severity string")
    stats = rows([], "market string, negative_hours_90d bigint, avg_negative_price double, min_price double")
    rollup = rows([], "market string, negative_days bigint")
    said = report.market_context(signals, stats, rollup).first()["market_context"]
    assert "n/a €/MWh" in said and "2026-03-23 H12: 50.0 €/MWh (LOW)" in said


def test_overlap_scores(rows):
    df = rows([("1", "q one", "a b", "", [" "]), ("2", "q", "a b", "a c", ["a x"])],
              "id string, question string, answer string, ground_truth string, contexts array<string>")
    got = {r["id"]: tuple(r)[1:] for r in evaluation.ragas_token_overlap(df).collect()}
    assert got == {"1": (0.5, 0.0, 0.5), "2": (0.5, 0.5, 0.0)}
    gate = evaluation.eval_gate(evaluation.eval_heuristics(df))
    assert {r["status"] for r in gate.collect()} == {"FAIL"}
    with pytest.raises(Exception, match="gate failed"):
        evaluation.enforce_gate(gate).collect()


def test_retrieval_metrics(rows):
    df = rows([(1, "a", 1), (2, "a", 4), (3, "b", None)], "query_id int, category string, first_rank int")
    got = {r["category"]: r for r in evaluation.retrieval_metrics(df).collect()}
    assert got["overall"]["hit1"] == pytest.approx(1 / 3) and got["a"]["hit5"] == 1.0 and got["b"]["mrr"] == 0.0
    assert got["overall"]["mrr"] == pytest.approx(1.25 / 3)
    assert [tuple(r) for r in evaluation.retrieval_failures(df).collect()] == [("b", 1, 1, 1.0), ("a", 2, 1, 0.5)]


def test_chunk_stats_tell_untagged_from_totals(rows):
    df = rows([("k1", "price_risk"), ("k1", None), ("k2", None)], "contract_id string, risk_category string")
    got = {(r["level"], r["name"]): (r["n_chunks"], r["pct"]) for r in corpus.chunk_stats(df).collect()}
    assert got == {("total", ""): (3, 100.0), ("contract", "k1"): (2, 66.7), ("contract", "k2"): (1, 33.3),
                   ("category", "price_risk"): (1, 33.3), ("untagged", ""): (2, 66.7)}


@pytest.mark.parametrize("block", [1024, 2])
def test_answers_follow_their_questions(rows, block):
    df = rows([(1, 0, "user", "q0"), (1, 1, "assistant", "a1"), (1, 3, "user", "q3"), (1, 9, "assistant", "a9"),
               (1, 10, "user", "q10"), (2, 0, "assistant", "a0"), (2, 1, "user", "q1"), (2, 2, "user", "q2")],
              "conv_id bigint, turn bigint, role string, text string")
    got = sorted(tuple(r) for r in evaluation.question_answer_pairs(df, block_turns=block).collect())
    assert got == [("1-0", "q0", "a1"), ("1-3", "q3", "a9")]


def test_long_contracts_split_in_linear_space(spark):
    for lines in (8_000, 32_000):
        block = "struct(1 AS page, CASE WHEN i % 2 = 0 THEN concat('ARTICLE ', i, ' - Heading') ELSE concat('body line ', i) END AS text)"
        d = spark.sql(f"SELECT 'c' AS contract_id, transform(sequence(0, {lines - 1}), i -> {block}) AS blocks")
        got = sections.split_sections(d).selectExpr("count(*) AS n", "max(length(section_text)) AS longest").first()
        assert got["n"] == lines // 2 and got["longest"] < 100


def test_token_intersect_takes_all_documents(rows):
    asked = rows([(1, "Power price power"), (2, "nothing else"), (3, None)], "query_id long, query string")
    docs = rows([("doc-1", "else"), ("doc-7", "the price of POWER\nprice"), ("doc-8", None)], "contract_id string, text string")
    got = sorted(map(tuple, search.token_intersect(asked, docs).collect()))
    assert got == [(1, "doc-7", 2), (2, "doc-1", 1)]


def test_bad_contexts_score_low(rows):
    hits = rows([(1, "price floor", 2, "floor of the price"), (1, "price floor", 1, "price a"), (2, "price floor", 1, "grid works")],
                "query_id long, query string, rank int, chunk_text string")
    samples = evaluation.retrieved_samples(hits).withColumn("answer", F.element_at("contexts", 1))
    assert {r["id"]: r["contexts"] for r in samples.collect()} == {1: ["price a", "floor of the price"], 2: ["grid works"]}
    got = {r["id"]: tuple(r)[1:] for r in evaluation.ragas_token_overlap(samples).collect()}
    assert got == {1: (0.4, 0.5, 1.0), 2: (1.0, 0.0, 0.0)}


def vectors(rows, n=600, dim=8, seed=4):
    import numpy as np

    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, dim)).round(2)
    data[5] = 0
    data[7:11] = data[6]  # ties
    frame = rows([(f"v{i:04d}", v.tolist(), i % 3) for i, v in enumerate(data)] + [("none", None, 0)], "id string, v array<double>, g int")
    return data, frame


def brute_cosine(data, asked, k):
    import numpy as np

    norm = lambda m: m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
    out = set()
    for q, scores in enumerate(norm(asked) @ norm(data).T):
        order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 12), i))[:k]
        out |= {(q, f"v{i:04d}", i % 3, r + 1) for r, i in enumerate(order)}
    return out


@pytest.mark.parametrize("cells, part_rows", [(None, 4096), (5, 16), (1, 50)])
def test_all_cells_give_the_exact_neighbours(rows, cells, part_rows):
    data, frame = vectors(rows)
    asked = data[::60].round(1)
    queries = rows([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, None)], "query_id int, query_vector array<double>")
    got = search.vector_search(queries, frame, k=7, row_key="id", vector="v", columns=["g"], cells=cells, part_rows=part_rows)
    assert {(r.query_id, r.id, r.g, r["rank"]) for r in got.collect()} == brute_cosine(data, asked, 7)
    index = vector_index.build_cells(frame, key="id", vector="v", columns=["g"], spill=3, cells=9, part_rows=part_rows)
    assert {(r.query_id, r.id, r.g, r["rank"]) for r in search.vector_search(queries, index, k=7).collect()} == brute_cosine(data, asked, 7)


def test_near_cells_find_most_neighbours_of_each_query(rows):
    data, frame = vectors(rows, n=2000)
    index = vector_index.build_cells(frame, key="id", vector="v", spill=3)
    assert len(index.centroids) == 45 and index.rows.filter("turn = 0").count() == 2000 and index.rows.count() == 6000
    queries = rows([(i, v.tolist()) for i, v in enumerate(data[::50])], "query_id int, query_vector array<double>")
    want = {x[:2] for x in brute_cosine(data, data[::50], 10)}
    got = {(r.query_id, r.id) for r in search.vector_search(queries, index, k=10, probes=23).collect()}
    hit = [sum((q, i) in got for p, i in want if p == q) for q in range(40)]
    assert len(got) == 400 and min(hit) >= 9


def test_search_of_little(rows):
    none = rows([], "id string, v array<double>")
    queries = rows([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert search.vector_search(queries, none, row_key="id", vector="v").count() == 0
    chunks = rows([("b", None), ("a", "x y")], "chunk_id string, chunk_text string")
    index = token_index.index_of(chunks, key="chunk_id", text="chunk_text", columns=[])
    asked = rows([("p", "X"), ("q", None), ("r", "zzz")], "query_id string, query string")
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in token_index.search_index(asked, index, k=5).collect())
    assert got == [("p", 1, "a", 1.0), ("p", 2, "b", 0.0)] + [(q, i + 1, "ab"[i], 0.0) for q in "qr" for i in (0, 1)]


def test_search_collects_no_query(rows):
    chunks = rows([("a", "x y")], "chunk_id string, chunk_text string")
    index = token_index.index_of(chunks, key="chunk_id", text="chunk_text", columns=[])
    many = chunks.sparkSession.range(6_000).selectExpr("id AS query_id", "concat('x w', id) AS query")
    got = token_index.search_index(many, index, k=1)
    assert got.count() == 6_000 and got.agg(F.min("score")).first()[0] == 0.5


def test_hashed_counts_are_unit_vectors(rows):
    import hashlib

    got = {r.k: r.embedding for r in search.embed_text(rows([(1, "A a b"), (2, None), (3, "")], "k int, t string"), key="k", text="t", dim=16).collect()}
    want = [0.0] * 16
    for w in ("a", "a", "b"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
    size = sum(x * x for x in want) ** 0.5
    assert got[1] == pytest.approx([x / size for x in want]) and got[2] == got[3] == [0.0] * 16


def test_long_lists_are_reranked_in_linear_work(spark):
    many = spark.range(1).selectExpr("1 AS query_id", "'price floor of power' AS query",
                                     "transform(sequence(1, 10000), i -> concat('word', i, IF(i % 100 = 0, ' floor', ''), IF(i = 700, ' price', ''))) AS texts")
    got = rerank.rerank_texts(many, n=3).orderBy("rerank_rank").collect()
    assert [r["orig_index"] for r in got] == [699, 99, 199]
    plan = rerank.rerank_texts(many)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_tf" not in plan


def test_search_with_packs_small_blocks_null_and_repeated_keys(rows, monkeypatch):
    """Several packs, cut tables of words and blocks, keys that repeat or are null, and text that is not shown."""
    monkeypatch.setattr(token_index, "HELD", 3)
    rnd = random.Random(7)
    pool = [f"w{i}" for i in range(20)]
    chunks = [(None if i % 29 == 0 else f"c{i % 70:03d}", " ".join(rnd.choices(pool, k=rnd.randint(0, 9)))) for i in range(100)]
    queries = [(i, " ".join(rnd.choices(pool, k=rnd.randint(0, 5)))) for i in range(20)]
    index = token_index.index_of(rows(chunks, "chunk_id string, body string"), key="chunk_id", text="body", columns=[], block_bits=3)
    got = token_index.search_index(rows([*queries, (None, "w1")], "query_id int, query string"), index, k=6).collect()
    want = []
    for q, text in queries:
        words = set(text.split())
        shared = sorted((-len(words & set(t.split())), c is not None, c or "") for c, t in chunks)
        want += [(q, i + 1, c or None, -s / max(len(words), 1)) for i, (s, _known, c) in enumerate(shared[:6])]
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in got) == sorted(want)


def test_search_writes_no_table_of_postings(rows, spark):
    chunks = rows([("a", "x y"), ("b", "y")], "chunk_id string, chunk_text string")
    plan = token_index.search_index(rows([(1, "x")], "query_id int, query string"), token_index.index_of(
        chunks, key="chunk_id", text="chunk_text", columns=[]), k=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "explode(_words" not in plan


def test_best_words_cut_tables(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_index, "CELLS", 4)
    monkeypatch.setattr(token_index, "COUNTS", 2)
    held = token_index._Best(2, 4)
    held.ask(pa.array(["p", "q", "p", "r"]), pa.array([["a", "b"], ["b"], ["c"], []], pa.list_(pa.string())))
    texts = [["a"], ["b", "c"], ["a", "b"], [], ["c"], ["b"]]
    keys = pa.array(["6", "5", "4", "3", "2", "1"])
    held.see(pa.array(texts, pa.list_(pa.string())), keys, [keys])
    got = {}
    for batch in held.rows():
        for q, n, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(q, set()).add((n, key))
    assert got == {"p": {(2, "4"), (1, "1")}, "q": {(1, "1"), (1, "4")}, "r": {(0, "1"), (0, "2")}}


def test_tags_replace_the_long_s_without_a_look_at_each_character(spark, rows):
    df = rows([("A \u017fecurity DEPO\u017fIT, a performance bond and a default",), ("securityx depositx",), (None,)], "t string")
    X.register_tag_text(spark)
    df.createOrReplaceTempView("long_s")
    tagged = df.select(X.tag_chunk(F.col("t")).alias("c"))
    by_sql = spark.sql("SELECT tag_text(t) AS c FROM long_s")
    for frame in (tagged, by_sql):
        assert [r.c for r in frame.collect()] == ["counterparty_risk", None, None]
        assert "translate(" not in frame._jdf.queryExecution().toString()


def test_a_search_over_joined_words_splits_at_the_space(rows):
    texts = rows([("a", "Price Floor applies"), ("b", "price price of OIL"), ("c", ""), ("d", None), ("e", "no\u00a0break")], "id string, t string")
    asked = rows([(1, "price\t floor\nof"), (2, "no break"), (3, ""), (4, None)], "query_id long, query string")

    def found(**how):
        index = token_index.index_of(texts, key="id", text="t", columns=["id"], **how)
        return sorted(map(tuple, token_index.search_index(asked, index, k=4).collect()))

    plain, joined = found(), found(joined=True)
    # The text of "e" is not joined by spaces: told that it is, the search takes it as one word.
    assert [r for r in joined if r[0] != 2] == [r for r in plain if r[0] != 2]
    assert [r[2] for r in plain if r[:2] == (2, "e")] == [1.0] and max(r[2] for r in joined if r[0] == 2) == 0.0
