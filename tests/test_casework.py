from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest, SourceUnavailable
from lexloom.operators import documents, ledger, matters, ordering
from lexloom.plans.envelope import answer
from lexloom.sources import rows


def test_running_total_spans_partitions_and_hot_groups(spark):
    data = [("hot" if i % 3 else f"g{i % 5}", i, i % 7) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    got = ordering.running_total(df, ["g"], ["i"], F.col("v").cast("bigint"), "total", 16).collect()
    want, sums = {}, {}
    for g, i, v in data:
        sums[g] = sums.get(g, 0) + v
        want[(g, i)] = sums[g]
    assert {(r.g, r.i): r.total for r in got} == want


def test_dense_number(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = {r.k: r.n for r in ordering.dense_number(df, ["k"], "n", 5).collect()}
    assert got == {k: k + 5 for k in range(1000)}


def greedy(calls, cap):
    spent, out = {}, {}
    for i, day, _, cost in sorted(calls, key=lambda c: (c[1], c[2], c[0])):
        fits = spent.get(day, 0) + cost <= cap
        out[i] = fits
        if fits:
            spent[day] = spent.get(day, 0) + cost
    return out


@pytest.mark.parametrize("budget", [0.0, 0.5, 7.03, 40.0, 1000.0])
def test_admitted_calls_equal_the_one_by_one_walk(spark, budget):
    prices = [50, 20, 5, 5, 50, 20]
    calls = [(i, date(2024, 1, 1 + (i * i) % 3), i // 4, prices[(i * 5 + i // 7) % 6]) for i in range(400)]
    df = spark.createDataFrame(calls, "id int, day date, ts int, cost_paise int")
    got = {r.id: r.admitted for r in ledger.admit_calls(df, budget).collect()}
    assert got == greedy(calls, round(budget * 100))


@pytest.mark.parametrize("budget", [1.0, 3.33])
def test_admitted_calls_at_many_prices(spark, budget):
    calls = [(i, date(2024, 1, 1 + i % 2), i, 3 + (i * 37) % 131) for i in range(160)]
    df = spark.createDataFrame(calls, "id int, day date, ts int, cost_paise int")
    got = {r.id: r.admitted for r in ledger.admit_calls(df, budget).collect()}
    assert got == greedy(calls, round(budget * 100))


def test_admitted_calls_take_as_many_jobs_at_any_prices(spark):
    def jobs(n):
        df = spark.createDataFrame(
            [(i, date(2024, 1, 1 + i % 2), i, 1 + (i * 7919) % n) for i in range(3 * n)], "id int, day date, ts int, cost_paise int"
        )
        spark.sparkContext.setJobGroup(f"prices {n}", "")
        rows = ledger.admit_calls(df, 40.0).collect()
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"prices {n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        want = greedy([(r.id, r.day, r.ts, r.cost_paise) for r in rows], 4000)
        assert {r.id: r.admitted for r in rows} == want
        return done

    assert abs(jobs(1000) - jobs(5)) <= 2


def test_calls_without_a_price_and_a_bad_price(spark):
    schema = "id int, day date, ts int, cost_paise int, last int"
    rows = [(1, date(2024, 1, 1), 1, None, 9), (2, date(2024, 1, 1), 2, 0, 9), (3, date(2024, 1, 1), 3, 5, 9), (4, None, 4, 5, 9)]
    got = {r.id: (r.admitted, r.last) for r in ledger.admit_calls(spark.createDataFrame(rows, schema), 1.0).collect()}
    assert got == {1: (False, 9), 2: (True, 9), 3: (True, 9), 4: (False, 9)}
    assert ledger.admit_calls(spark.createDataFrame([], schema), 1.0).collect() == []
    with pytest.raises(Exception, match="negative price"):
        ledger.admit_calls(spark.createDataFrame([(1, date(2024, 1, 1), 1, -5, 0)], schema), 1.0).collect()


def matter(i, status="open", expiry=None, title="t"):
    return (i, title, "civil_suit", status, None, None, None, expiry, None)


MATTER = (
    "id bigint, title string, matter_type string, status string, court string, cause_of_action_date date, "
    "filing_date date, limitation_expiry date, updated_at timestamp"
)


def test_lists_and_alerts(spark):
    df = spark.createDataFrame(
        [matter(1, expiry=date(2026, 3, 1)), matter(2), matter(3, "closed", date(2026, 1, 1)),
         matter(4, expiry=date(2025, 12, 1)), matter(5, expiry=date(2027, 1, 1))], MATTER,
    )
    assert [r.id for r in matters.list_matters(df, "open").collect()] == [4, 1, 5, 2]
    assert [r.id for r in matters.list_matters(df, limit=0).collect()] == [4]
    alerts = {r.matter_id: (r.days_remaining, r.expired) for r in matters.limitation_alerts(df, date(2026, 2, 1)).collect()}
    assert alerts == {1: (28, False), 4: (-62, True)}
    status = {r.id: r.s for r in df.select("id", matters.limitation_status(F.col("limitation_expiry"), date(2026, 2, 1)).alias("s")).collect()}
    assert status == {1: "CRITICAL", 2: None, 3: "EXPIRED", 4: "EXPIRED", 5: "OK"}
    with pytest.raises(InvalidRequest):
        matters.list_matters(df, "lost")


def test_patch_leaves_omitted_fields(spark):
    base = spark.createDataFrame([(1, "a", "x", datetime(2020, 1, 1)), (2, "b", "y", datetime(2020, 1, 1))], "id int, title string, court string, updated_at timestamp")
    patch = spark.createDataFrame([(1, None, "z")], "id int, title string, court string")
    got = {r.id: (r.title, r.court, r.updated_at) for r in matters.apply_patch(base, patch, "id", F.lit(datetime(2026, 1, 1))).collect()}
    assert got == {1: ("a", "z", datetime(2026, 1, 1)), 2: ("b", "y", datetime(2020, 1, 1))}
    with pytest.raises(InvalidRequest):
        matters.apply_patch(base, patch.withColumnRenamed("court", "nowhere"), "id", F.lit(None))


def test_timeline_ties_keep_the_order_of_sources(spark):
    d = date(2026, 1, 1)
    ms = spark.createDataFrame([(1, d, d)], "id bigint, cause_of_action_date date, filing_date date")
    hs = spark.createDataFrame([(7, 1, d, "", None, None), (6, 1, d, "For order", "Allowed", "B")], "id bigint, matter_id bigint, hearing_date date, purpose string, outcome string, bench string")
    es = spark.createDataFrame([(9, 1, d, "note", "n"), (8, 2, d, "note", "other")], "id bigint, matter_id bigint, event_date date, event_type string, description string")
    got = [(r.kind, r.description) for r in matters.timeline(ms, hs, es).collect()]
    assert got == [
        ("cause_of_action", "Cause of action arose"), ("filed", "Matter filed"), ("note", "n"),
        ("hearing", "For order - Allowed"), ("hearing", "Hearing"),
    ]


def test_tables_round_trip(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(SourceUnavailable):
        rows.read_table(spark, root, "matters")
    rows.create_tables(spark, root)
    assert rows.read_table(spark, root, "saved_research").count() == 0
    one = rows.read_table(spark, root, "matters").limit(0)
    new = spark.createDataFrame(
        [(1, "R", "T", "rti", "open", None, None, None, '[{"name": "A", "role": "petitioner"}]', date(2026, 1, 2), None, None, Decimal("12.50"), None, None, None, None)],
        one.schema,
    )
    rows.append_table(new, root, "matters")
    shown = rows.serialised(rows.read_table(spark, root, "matters")).first()
    assert (shown.cause_of_action_date, shown.parties[0].name, shown.claim_value) == ("2026-01-02", "A", 12.5)
    added = matters.append_rows(
        rows.read_table(spark, root, "matters").select("id"),
        spark.createDataFrame([(5, 1), (6, 9), (7, 1)], "n int, matter_id bigint"), ["n"], rows.read_table(spark, root, "matters"),
    )
    assert {(r.n, r.id) for r in added.collect()} == {(5, 2), (7, 3)}


def test_unavailable_is_not_empty(spark, tmp_path):
    gone = answer("get_matter", lambda: rows.read_table(spark, str(tmp_path), "matters"))
    assert gone.status == "unavailable" and gone.data is None
    bad = answer("list_matters", lambda: matters.list_matters(spark.range(1), "lost"))
    assert bad.status == "error"


def test_first_copies_of_a_hot_content(spark):
    data = [(i, "same" if i % 3 else f"t{i % 10}") for i in range(300)]
    df = spark.createDataFrame(data, "id int, text string")
    got = {(r.id, r.text) for r in documents.first_copies(df, "id", "text").collect()}
    first = {}
    for i, t in data:
        first.setdefault(t, i)
    assert got == {(i, t) for t, i in first.items()}


def test_fusion_ties_and_modes(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id int, score double")
    b = spark.createDataFrame([(3, 0.9), (1, 0.8), (4, 0.1)], "id int, score double")
    got = documents.fuse(a, b, "id", 10).collect()
    assert [(r.id, r.matched_by) for r in got] == [(1, ["fulltext", "semantic"]), (3, ["semantic"]), (2, ["fulltext"]), (4, ["semantic"])]
    assert got[0].relevance == round(1 / 61 + 1 / 62, 5) and got[0].search_mode == "hybrid"
    only = documents.fuse(a, None, "id", 10).collect()
    assert [r.id for r in only] == [1, 2] and only[0].search_mode == "fulltext_only"


def fold(text):
    """Chunks by the written rules, one unit after another."""
    import re

    from lexloom.rules import drafts

    cuts = sorted({0, len(text), *[m.start() for m in re.finditer(drafts.STRUCTURE_BREAK, text, re.M)]})
    units = [u for u in (text[a:b].strip() for a, b in zip(cuts, cuts[1:])) if u] or [text.strip()]
    out, held = [], ""
    for unit in units:
        if len(unit) > drafts.MAX_CHUNK_CHARS:
            out += [held] if held else []
            held, part = "", ""
            for p in re.split(drafts.PARAGRAPH_BREAK, unit):
                if part and len(part) + len(p) > drafts.MAX_CHUNK_CHARS:
                    out.append(part.strip())
                    part = p
                else:
                    part = part + "\n\n" + p if part else p
            out += [part.strip()] if part.strip() else []
        elif len(held) + len(unit) < drafts.MIN_CHUNK_CHARS:
            held = held + "\n\n" + unit if held else unit
        else:
            out += [held] if held else []
            held = unit
    return out + ([held] if held else [])


def test_chunks(spark):
    long_clause = "\n".join(f"{i}. Clause number {i} " + "says a good deal about it. " * 20 for i in range(1, 6))
    texts = {
        1: long_clause, 2: "1. A b\n2. B c\n3. C d", 3: "plain words only", 4: "TERMS AND CONDITIONS\n" + "para one. " * 120 + "\n\n" + "para two. " * 150 + "\n \n" + "z" * 2500,
        5: "", 7: "1. Alpha \u0001 beta" + " word" * 60 + "\n\u0001\n2. Gamma" + " word" * 60, 6: "1.\nSECTION 5 begins\n\n\n(a) Also here\nदायित्व खंड\nARTICLE IV x",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for r in documents.chunk_documents(df, "id", "text").orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got == {k: fold(v) for k, v in texts.items() if fold(v)}
    assert len(got[1]) == 5 and len(got[2]) == 1


def test_passages(spark):
    text = "é" * 400 + " Alpha beta ALPHA " + "x" * 400 + " a.b aXb " + "alpha " * 40
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = documents.passages(df, "id", "text", "alpha a.b").orderBy("position").collect()
    assert len(got) == 20
    assert (got[0].position, got[0].matched) == (401, "Alpha")
    assert got[2].matched == "a.b" and got[2].position == text.index("a.b")
    assert got[0].passage == text[101 : 401 + 5 + 300].strip()
    with pytest.raises(InvalidRequest):
        documents.passages(df, "id", "text", "  ")


def test_ingest_files(spark, tmp_path):
    from lexloom.plans.documents import ingest_files
    from lexloom.sources.files import read_binary

    folder, root = tmp_path / "in", str(tmp_path / "db")
    folder.mkdir()
    (folder / "a.txt").write_text("1. First clause " + "word " * 60 + "\n2. Second clause " + "word " * 60)
    (folder / "b.txt").write_text("short note")
    (folder / "copy.txt").write_text("short note")
    rows.create_tables(spark, root)

    def once():
        docs, chunks = rows.read_table(spark, root, "documents"), rows.read_table(spark, root, "document_chunks")
        new_docs, new_chunks = ingest_files(
            read_binary(spark, str(folder)), docs, chunks, "2026-01-01", matter_id=7,
            provider=lambda: lambda texts: [[float(len(t)), 1.0] for t in texts],
        )
        rows.append_table(new_chunks, root, "document_chunks")
        rows.append_table(new_docs, root, "documents")
        return rows.read_table(spark, root, "documents"), rows.read_table(spark, root, "document_chunks")

    docs, chunks = once()
    assert {(r.id, r.title, r.matter_id) for r in docs.collect()} == {(1, "a.txt", 7), (2, "b.txt", 7)}
    got = [(r.id, r.document_id, r.chunk_index, r.embedding[0] == len(r.content)) for r in chunks.orderBy("id").collect()]
    assert got == [(1, 1, 0, True), (2, 1, 1, True), (3, 2, 0, True)]
    docs, chunks = once()
    assert docs.count() == 2 and chunks.count() == 3
    with pytest.raises(SourceUnavailable):
        documents.with_embeddings(chunks, "content", None)


def test_packed_files_are_read_as_single_ones(spark, tmp_path):
    from lexloom.sources.files import document_text, read_binary, read_packed, write_packed

    folder, packs = tmp_path / "in", tmp_path / "packs"
    folder.mkdir()
    for i in range(50):
        (folder / f"{i}.txt").write_text(f"note {i} \u00e9\n")
    write_packed(read_binary(spark, str(folder)).coalesce(2), str(packs))
    assert len(list(packs.glob("*.parquet"))) == 2
    columns = ["path", "length", "content"]
    single, packed = read_binary(spark, str(folder)).select(*columns), read_packed(spark, str(packs)).select(*columns)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, single.collect()))
    assert sorted(map(tuple, document_text(packed).collect())) == sorted(map(tuple, document_text(single).collect()))


def test_ingested_chunks_makes_no_file_per_document(spark, tmp_path, monkeypatch):
    from workload import case_queries

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = [(i, f"text {i % 90}", "en", "s", 9) for i in range(300)]
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(case_queries, "shared_folder", lambda spark: str(tmp_path / "shared"))
    got = case_queries.ingested_chunks(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in got}) == 90
    assert len(list((tmp_path / "shared").rglob("*.parquet"))) < 100


def test_long_document_is_chunked_in_linear_time(spark):
    text = "\n".join(f"{i % 90}. Clause {i} " + "words of the clause " * 12 for i in range(4000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    chunks = documents.chunk_documents(df, "id", "text").orderBy("chunk_index").collect()
    assert len(chunks) == 4000 and chunks[-1].content.startswith("39. Clause 3999")
