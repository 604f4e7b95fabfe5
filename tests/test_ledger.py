"""Golden cases and invariants of the ledger, its maintenance and its plans."""

from pyspark.sql import functions as F

from tallyspark.operators import ledger, maintenance, origin
from tallyspark.operators.ranks import ranked
from tallyspark.plans import catalog
from tallyspark.schemas import SESSIONS
from tallyspark.sources.snapshots import Ledger, write_log

ROW = dict(finished_at=0, skipped=0, failed=0, output_bytes=100, output_mode="replace", strength="identical", can_undo=True, undone=False)


def session(**values):
    return tuple({**ROW, **values}[f.name] for f in SESSIONS.fields)


def two(spark):
    return spark.createDataFrame(
        [session(id="1000", started_at=1000, photos=2, optimized=2, original_bytes=200, saved_bytes=100), session(id="2000", started_at=2000, photos=2, optimized=2, original_bytes=100, saved_bytes=50)], SESSIONS
    )


def files(spark, rows):
    return spark.createDataFrame(rows, "session_id string, idx long, path string, status string, converted boolean, original_bytes long, output_bytes long")


def test_totals_follow_updates(spark):
    t = ledger.totals(two(spark)).first()
    assert (t.saved_bytes, t.original_bytes, t.photos, t.sessions, t.since) == (150, 300, 4, 2, 1000)
    empty = ledger.totals(two(spark).filter("false")).first()
    assert (empty.saved_bytes, empty.sessions, empty.since) == (0, 0, None)


def test_history_is_newest_first_and_plans_top_k(spark):
    many = spark.range(300).select(F.col("id").cast("string").alias("id"), F.col("id").alias("started_at"))
    page = ledger.history_page(many)
    assert page.count() == 50 and page.first().id == "299"
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
    ties = spark.createDataFrame([("9", 5), ("10", 5)], "id string, started_at long")
    assert [r.id for r in ledger.history_page(ties).collect()] == ["9", "10"]


def test_summary_and_live_differ_where_a_file_grew(spark):
    f = files(spark, [("s", 0, "/a", "done", False, 100, 60), ("s", 1, "/b", "done", False, 100, 120), ("s", 2, "/c", "done", True, 50, 90)])
    assert ledger.session_summary(f).first().saved_bytes == 20
    live = ledger.live_stats(f, "session_id").first()
    assert (live.saved_bytes, live.optimized, live.converted) == (40, 2, 1)


def test_origin_golden(spark):
    rows = [("a", i, f"/Users/ana/Boda Ana/JPG/{i}.jpg") for i in range(10)]
    rows += [("b", 0, "/Users/ana/Proyectos/X/1.jpg"), ("b", 1, "/Users/ana/Proyectos/Y/1.jpg"), ("b", 2, "/Users/ana/Proyectos/Y/Z/1.jpg")]
    rows += [("c", 0, "/Volumes/SD/1.jpg"), ("c", 1, "/Users/a/2.jpg"), ("d", 0, "/Users/a/1.jpg"), ("d", 1, "/Users/b/1.jpg"), ("e", 1, "/p/q/2.jpg"), ("e", 0, "/p/q/1.jpg")]
    found = {r.session_id: r for r in origin.session_origins(spark.createDataFrame(rows, "session_id string, idx long, path string")).collect()}
    assert (found["a"].origin_kind, found["a"].origin_name) == ("folder", "JPG")
    assert (found["b"].origin_kind, found["b"].origin_name, found["b"].origin_count) == ("folders", "Proyectos", 3)
    assert found["c"].origin_kind == found["d"].origin_kind == "scattered" and found["c"].origin_path is None
    assert (found["e"].origin_kind, found["e"].origin_name, found["e"].origin_count, found["e"].origin_path) == ("files", "1.jpg", 1, "/p/q")


def test_prune_is_strict_and_skips_names(spark):
    day = maintenance.DAY_MS
    folders = spark.createDataFrame([("1000",), ("2000",), (str(10 * day),), (str(3 * day + 1),), ("abc",)], "id string")
    assert {r.id for r in maintenance.expired(folders, 10 * day + 1, 7).collect()} == {"1000", "2000"}


def test_discard_keeps_totals_and_is_idempotent(spark):
    s = two(spark)
    b = spark.createDataFrame([("1000", 0, "x"), ("2000", 0, "y")], "session_id string, idx long, backup string")
    ids = spark.createDataFrame([("1000",)], "id string")
    s1, b1 = maintenance.discard(s, b, ids)
    s2, b2 = maintenance.discard(s1, b1, ids)
    assert ledger.totals(s1).collect() == ledger.totals(s).collect()
    assert sorted(s1.collect()) == sorted(s2.select(*s1.columns).collect()) and b1.collect() == b2.collect()


def test_reconcile_twice_changes_nothing(spark):
    s = two(spark)
    b = spark.createDataFrame([("1000", 0, "x"), ("1000", 1, "z"), ("2000", 0, "y")], "session_id string, idx long, backup string")
    disk = spark.createDataFrame([("x", "1000", 5)], "path string, session_id string, bytes long")
    s1, b1 = maintenance.reconcile(s, b, disk)
    s2, b2 = maintenance.reconcile(s1, b1, disk)
    assert {r.backup for r in b1.collect()} == {"x"} == {r.backup for r in b2.collect()}
    assert {r.id: r.can_undo for r in s1.collect()} == {"1000": True, "2000": False} == {r.id: r.can_undo for r in s2.collect()}


def test_recovery_golden(spark):
    journal = spark.createDataFrame([("77", "/a", "b1", (9, 1))], "session_id string, original string, backup string, written struct<bytes: long, modifiedMs: long>")
    disk = spark.createDataFrame([("b1", "77", 20)], "path string, session_id string, bytes long")
    got = maintenance.recover(journal, two(spark), disk)
    assert got.first().saved_bytes == 11
    assert maintenance.recover(journal, two(spark).select("id").unionByName(got.select("id")), disk).count() == 0


def test_ids(spark):
    ids = spark.createDataFrame([("../../etc",), ("a/b",), ("x' OR '1'='1",), ("1700-ab",), ("",), ("a" * 33,)], "id string")
    assert [r.id for r in maintenance.valid_ids(ids).collect()] == ["1700-ab"]


def test_snapshots_commit_and_carry_over(spark, tmp_path):
    books = Ledger(spark, str(tmp_path / "ledger"))
    assert books.current() is None
    first = books.commit(sessions=two(spark), backups=spark.createDataFrame([("1000", "x")], "session_id string, backup string"))
    second = books.commit(sessions=maintenance.upsert(books.read("sessions"), two(spark).limit(1).withColumn("undone", F.lit(True)), "id"))
    assert first != second == books.current()
    assert books.read("sessions").count() == 2 and books.read("sessions").filter("undone").count() == 1 and books.read("backups").count() == 1
    write_log(spark.createDataFrame([(1, "b"), (0, "a")], "idx long, line string"), str(tmp_path / "log"), "head")
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["head", "a", "b"]


def test_filters_reach_the_scan(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey = 5").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo" in plan and "o_comment" not in plan


def test_places_in_groups_of_any_size(spark):
    rows = [("hot", i) for i in range(700)] + [("b", i) for i in (5, 3)] + [(None, 9), (None, 8), ("c", 1)]
    got = {(r.k, r.v): r.place for r in ranked(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], ["v"], "place").collect()}
    assert len(got) == len(rows) and got == {(k, v): 1 + sum(1 for kk, vv in rows if kk == k and vv < v) for k, v in rows}
    plan = ranked(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k" not in plan.split("row_number")[1].split("]")[0]


def test_a_page_reads_only_its_sessions(spark, sf_dir):
    page = catalog.QUERIES["history_overview"](spark, sf_dir)
    plan = page._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert page.count() == 50 and all("In(" in s or "IN (" in s or "INSET" in s or "InSet" in s or "l_orderkey" not in s for s in scans)
    assert all("PushedFilters: [" in s and "PushedFilters: []" not in s for s in scans)
