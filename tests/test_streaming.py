from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from lexloom.streaming import budget, ingest
from lexloom.streaming.hashes import HashStore


def test_ingest_takes_each_content_once_across_runs(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "doc_id bigint, text string"

    def run():
        stream = ingest.read_new_files(spark, src, schema)
        ingest.ingest_documents(stream, out, ck, "doc_id", "text").awaitTermination()
        return {(r.doc_id, r.text) for r in spark.read.parquet(out).select("doc_id", "text").collect()}

    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema).write.parquet(src)
    assert run() == {(1, "a"), (3, "b")}
    spark.createDataFrame([(4, "b"), (5, "c"), (6, "c")], schema).write.mode("append").parquet(src)
    assert run() == {(1, "a"), (3, "b"), (5, "c")}
    assert run() == {(1, "a"), (3, "b"), (5, "c")}


def test_stream_totals_equal_batch_totals(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "ts timestamp, paise bigint"
    days = [(datetime(2024, 1, 1 + i % 3, i % 24), i) for i in range(60)]
    spark.createDataFrame(days[:30], schema).write.parquet(src)
    stream = ingest.read_new_files(spark, src, schema)
    args = ("ts", "paise", str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest.run_daily_totals(stream, *args).awaitTermination()
    spark.createDataFrame(days[30:], schema).write.mode("append").parquet(src)
    ingest.run_daily_totals(stream, *args).awaitTermination()
    kept = {tuple(r) for r in ingest.read_daily_totals(spark, str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in ingest.daily_totals(spark.createDataFrame(days, schema), "ts", "paise").collect()}
    assert kept == batch


def test_repeats_are_dropped_within_the_delay(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "key string, ts timestamp"
    spark.createDataFrame([("a", datetime(2024, 1, 1, 1)), ("a", datetime(2024, 1, 1, 2)), ("b", datetime(2024, 1, 1, 3))], schema).write.parquet(src)
    stream = ingest.drop_repeats(ingest.read_new_files(spark, src, schema), "key", "ts", "6 hours")
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_a_repeated_batch_loses_nothing(spark, tmp_path):
    folder = str(tmp_path / "hashes")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None)], "doc_id bigint, text string")
    for _ in range(2):
        with HashStore(spark, folder, buckets=4) as store:
            new = store.new_documents(docs, 7, "doc_id", "text")
            assert sorted(r.doc_id for r in new.collect()) == [1, 2, 4]
            store.add(new.select("sha256"), 7)
    with HashStore(spark, folder, buckets=4) as store:
        later = spark.createDataFrame([(9, "b"), (8, "c"), (7, "c")], "doc_id bigint, text string")
        assert [r.doc_id for r in store.new_documents(later, 8, "doc_id", "text").collect()] == [7]
        assert store.new_documents(later.limit(0), 8, "doc_id", "text").collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexloom_hashes")]


def test_stored_hashes_are_read_in_place(spark, tmp_path):
    with HashStore(spark, str(tmp_path / "h"), buckets=4) as store:
        many = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
        store.add(many, 1)
        batch = spark.createDataFrame([(1, "5"), (2, "unheard")], "doc_id bigint, text string")
        new = store.new_documents(batch, 2, "doc_id", "text")
        assert [r.doc_id for r in new.collect()] == [2]
        plan = new._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "lexloom_hashes" in line)
        at = plan.splitlines().index(scan)
        depth = lambda line: len(line) - len(line.lstrip(" :+-*|()0123456789"))
        above = [line for line in plan.splitlines()[:at][::-1]]
        chain, level = [], depth(scan)
        for line in above:
            if depth(line) < level:
                chain.append(line)
                level = depth(line)
            if "SortMergeJoin" in line:
                break
        assert chain and not any("Exchange" in line for line in chain)
        assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
        # Two leading digits at most are asked for.
        asked = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
        assert any("prefix#" in filters for filters in asked)


def greedy(calls, cap):
    spent, out = {}, {}
    for i, ts, cost in sorted(calls, key=lambda c: (c[1], c[0])):
        day = ts.date()
        fits = cost is not None and spent.get(day, 0) + cost <= cap
        out[i] = fits
        spent[day] = spent.get(day, 0) + (cost if fits else 0)
    return out


def test_budget_is_kept_over_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "id bigint, ts timestamp, cost_paise int"
    calls = [(i, datetime(2024, 1, 1 + i % 3, (i // 3) % 24, i % 60), [0, 5, 90, 17, None, 700, 31][(i * 5) % 7]) for i in range(400)]
    for low in (0, 6, 12, 18):
        part = [c for c in calls if low <= c[1].hour < low + 6]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ingest.read_new_files(spark, src, schema, files_per_batch=1)
        budget.run_admitted(stream, 6.5, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == greedy(calls, 650)


def test_budget_holds_no_more_than_can_be_admitted():
    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    made = budget._Budget(100, None)
    made.spent = Value()
    calls = [(i, datetime(2024, 1, 1, 0, 0, i % 60), 1 + i % 40) for i in range(5000)]
    parts = [pd.DataFrame(calls[a : a + 500], columns=["id", "ts", "cost_paise"]).assign(day=None) for a in range(0, 5000, 500)]
    out = pd.concat(made.handleInputRows(None, iter(parts), None))
    assert len(out) == 5000 and dict(zip(out.id, out.admitted)) == greedy(calls, 100)
    assert list(made.handleInputRows(None, iter([parts[0].iloc[:1]]), None))[0].admitted.tolist() == [False]


def test_a_table_is_streamed_as_a_folder_and_as_one_file(spark, tmp_path):
    from workload.review_queries import stream_documents

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    rows.repartition(2).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "single").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "single" / "documents.parquet")
    for folder in ("parts", "single"):
        assert sorted(r.doc_id for r in stream_documents(spark, str(tmp_path / folder)).collect()) == [1, 3]
