import os

from pyspark.sql import functions as F

from chargelens.operators import ledgers, reports
from chargelens.streaming import intake
from tests.test_sources import JSON, TALL


def test_outcomes(spark):
    from pyspark.sql import functions as F

    cases = [(None, 1, None, "error"), (404, 9999, "text/csv", "http_404"), (200, 9000, "text/html; x", "too_small"), (200, 20000, "TEXT/HTML", "html_response"), (200, 500, "text/csv", "too_small"), (200, 1024, None, "ok"), (200, None, None, "too_small")]
    df = spark.createDataFrame(cases, "h int, s int, c string, want string")
    assert df.filter(~ledgers.download_outcome(F.col("h"), F.col("s"), F.col("c")).eqNullSafe(F.col("want"))).count() == 0
    links = [(200, "text/csv;x", "u", True), (200, None, "u", True), (200, "image/png", "a.ZIP?x=.y", True), (200, "image/png", "a.png", False), (200, "text/html", "a.csv", False), (403, "text/csv", "a.csv", False), (None, None, None, False)]
    df = spark.createDataFrame(links, "h int, c string, u string, want boolean")
    assert df.filter(ledgers.link_is_file(F.col("h"), F.col("c"), F.col("u")) != F.col("want")).count() == 0
    states = [("json", True, False, "resume_skip"), ("html", False, False, "skip:html"), ("xlsx", False, True, "xlsx_failed"), ("json", False, True, "parse_failed"), ("json", False, False, "ok")]
    df = spark.createDataFrame(states, "f string, d boolean, e boolean, want string")
    assert df.filter(ledgers.parse_status(F.col("f"), F.col("d"), F.col("e")) != F.col("want")).count() == 0


def test_merges(spark):
    shape = "ccn string, mrf_url string, discovery_method string"
    new = spark.createDataFrame([("1", "n", "seed"), ("2", None, "seed_invalid"), ("3", None, "seed_invalid"), ("4", "n", "seed"), ("6", None, "seed_invalid")], shape)
    old = spark.createDataFrame([("1", "o", "exempt:x"), ("2", "o", "seed"), ("3", "o", "seed"), ("5", "o", "seed")], shape)
    have = spark.createDataFrame([("2", "ok"), ("3", "http_404"), ("6", "ok")], "ccn string, status string")
    got = {r.ccn: (r.mrf_url, r.discovery_method) for r in ledgers.seed_merge(new, old, have).collect()}
    assert got == {"1": ("o", "exempt:x"), "2": ("o", "seed"), "3": (None, "seed_invalid"), "4": ("n", "seed"), "5": ("o", "seed")}
    heads = spark.createDataFrame([("2", " <!DOCTYPE html>"), ("3", "<html>")], "ccn string, head string")
    downloads, links = ledgers.reclassify_landing(have, old, heads)
    assert {r.ccn: r.status for r in downloads.collect()} == {"2": "html_landing", "3": "http_404", "6": "ok"}
    assert {r.ccn: r.discovery_method for r in links.collect()} == {"1": "exempt:x", "2": "exempt:portal_landing", "3": "seed", "5": "seed"}
    assert sorted(r.ccn for r in ledgers.exempt(old, spark.createDataFrame([("9", "", "exempt:y"), ("2", "", "exempt:y")], shape), old).filter("discovery_method = 'exempt:y'").collect()) == ["2"]
    up = spark.createDataFrame([("1", "a", 5), ("1", "b", 5), ("8", "a", 5)], "ccn string, file string, size int")
    there = spark.createDataFrame([("1", "a", 5), ("1", "b", 6)], "ccn string, file string, size int")
    assert sorted(tuple(r) for r in ledgers.upload_actions(up, there, old).collect()) == [("1", "a", 5, "duplicate"), ("1", "b", 5, "move"), ("8", "a", 5, "unknown")]


def test_report(spark):
    import pytest

    df = spark.createDataFrame([("a|b", 1234, 2.5), (None, None, None)], "k string, n int, x double").coalesce(1)
    assert reports.report("T", {"S": df}) == "# T\n\n## S\n\n| k | n | x |\n|---|---|---|\n| a\\|b | 1,234 | 2.50 |\n|  |  |  |\n"
    with pytest.raises(ValueError):
        reports.table(df, 1)


def test_intake_runs_once(spark, tmp_path):
    def put(name, text):
        (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name / "f.csv").write_text(text)

    def run():
        intake.start(intake.stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.ccn for r in spark.read.parquet(str(tmp_path / "out" / "log")).collect()), spark.read.parquet(str(tmp_path / "out" / "gross")).count()

    put("050001", TALL)
    put("050002", JSON)
    assert run() == (["050001", "050002"], 4)
    put("050003", TALL)
    assert run() == (["050001", "050002", "050003"], 6)


def test_failed_files_are_tried_again(spark, tmp_path):
    """A file fails twice and is whole at the third attempt; another never is; a third is new in between."""
    out = str(tmp_path / "out")

    def put(name, data):
        (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name / "f.csv").write_bytes(data if isinstance(data, bytes) else data.encode())

    def run():
        intake.start(intake.stream(spark, str(tmp_path / "in")), out, str(tmp_path / "cp"), wait=0.0).awaitTermination()

    def state():
        log = spark.read.parquet(f"{out}/log").groupBy("ccn").agg(F.count("*").alias("n"), F.max(F.col("status") == "ok").alias("ok")).collect()
        waiting = {r.path.split("/")[-2]: (r.attempts, r.due is not None) for r in intake.queue(spark, out).collect()}
        return {r.ccn: (r.n, r.ok) for r in log}, waiting, spark.read.parquet(f"{out}/gross").groupBy("ccn").count().count()

    put("050001", TALL)
    put("050002", b"PK\x03\x04cut off")
    put("050003", b"PK\x03\x04never whole")
    run()
    assert state() == ({"050001": (1, True), "050002": (1, False), "050003": (1, False)}, {"050002": (1, True), "050003": (1, True)}, 1)
    put("050004", JSON)
    put("050005", b"PK\x03\x04soon gone")
    run()  # a new file brings the queue with it
    assert state()[:2] == ({"050001": (1, True), "050002": (2, False), "050003": (2, False), "050004": (1, True), "050005": (1, False)}, {"050002": (2, True), "050003": (2, True), "050005": (1, True)})
    os.remove(tmp_path / "in" / "050005" / "f.csv")
    put("050002", TALL)
    os.utime(tmp_path / "in" / "050002" / "f.csv", (0, 0))  # not new to the stream
    assert intake.drain(spark, out, wait=0.0) == 3
    assert state() == ({"050001": (1, True), "050002": (3, True), "050003": (3, False), "050004": (1, True), "050005": (2, False)}, {"050003": (3, False), "050005": (2, True)}, 3)
    rows = spark.read.parquet(f"{out}/gross")
    assert rows.where("ccn = '050002'").count() == rows.where("ccn = '050001'").count()
