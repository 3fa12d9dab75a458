"""The runnable jobs: two runs over growing input, runs repeated, the command line, and the stateful consumer behind the drain."""

import json
import os
import random
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

from jobs import common, drain_channel, term_matrix  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, j long, one long, i long"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def sql_rows(sql, name, rows, kinds):
    con = duckdb.connect()
    con.execute(f"create table {name} ({kinds})")
    if rows:
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)


# ---- the term matrix ----

TEXTS = [None, "", " \n ", "One two TWO.", "two\x0bthree é É", "a " * 500, "x", "x x x\ty", "Ünï ünï z"]


def documents(rng, n):
    rows = [(rng.choice([k, k, k, 7]), rng.choice(TEXTS), rng.choice(["en", "en", "de", "", None])) for k in range(n)]
    return rows + [(None, "no id", "en"), (3, "one two", "en"), (3, "one two", "en")]


def stored(spark, rows, path):
    spark.createDataFrame([(i, t, lang, "s", 1, "9", 9, 9, 9) for i, t, lang in rows], DOCS).repartition(3).write.parquet(path)


@pytest.mark.parametrize("n", [0, 40])
def test_term_matrix_is_the_sql_and_repeats(spark, tmp_path, n):
    rows = documents(random.Random(n), n) if n else []
    stored(spark, rows, f"{tmp_path}/documents.parquet")
    want = sql_rows(term_matrix.ORACLE, "documents", [(i, t, lang) for i, t, lang in rows], "doc_id bigint, text varchar, lang varchar")
    for _ in range(2):
        got = term_matrix.run(spark, f"{tmp_path}/documents.parquet", f"{tmp_path}/out", {"blocks": 3})
        assert rows_of(got) == want
    if n:
        terms, entries = (spark.read.parquet(f"{tmp_path}/out/{t}") for t in ("terms", "entries"))
        by_row = entries.groupBy("lang", "i").count()
        assert rows_of(by_row) == rows_of(got.where("n > 0").select("lang", "i", got["n"].alias("count")))
        back = entries.join(terms, ["lang", "j"]).join(got.select("lang", "i", "doc_id"), ["lang", "i"])
        assert ("en", 3, "one", 2) in {(r["lang"], r["doc_id"], r["term"], r["v"]) for r in back.collect() if r["doc_id"] == 3} or any(r[0] in (3, 7) for r in rows)
        assert {r["block"] for r in entries.select("block").distinct().collect()} == {0, 1, 2}


def test_term_matrix_of_one_language_leaves_the_others(spark, tmp_path):
    stored(spark, [(1, "a b", "en"), (2, "c", "de")], f"{tmp_path}/one.parquet")
    stored(spark, [(1, "a b d", "en"), (2, "c c", "de")], f"{tmp_path}/two.parquet")
    term_matrix.run(spark, f"{tmp_path}/one.parquet", f"{tmp_path}/out")
    got = term_matrix.run(spark, f"{tmp_path}/two.parquet", f"{tmp_path}/out", {"languages": ["en"]})
    assert {(r["lang"], r["words"]) for r in got.collect()} == {("en", 3), ("de", 1)}


def shuffled_records(spark):
    """What all stages so far have written to shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_term_matrix_sends_no_entries_and_its_blocks_are_equal_runs(spark, tmp_path):
    """Words of a part are numbered where they are: what is sent is documents and the words that differ in a part."""
    stored(spark, [(k, " ".join(f"w{(k + m) % 97}" for m in range(90)), "en" if k % 3 else "de") for k in range(500)], f"{tmp_path}/documents.parquet")
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before, asked = shuffled_records(spark), spark.conf.get(key)
    term_matrix.run(spark, f"{tmp_path}/documents.parquet", f"{tmp_path}/out", {"blocks": 7})
    assert shuffled_records(spark) - before < 500 * 90 / 2
    assert spark.conf.get(key) == asked and not [t for t in spark.catalog.listTables() if t.name.startswith("term_matrix")]
    entries = spark.read.parquet(f"{tmp_path}/out/entries").select("lang", "i", "j", "block").collect()
    blocks = [r["block"] for r in sorted(entries)]
    size, rest = divmod(500 * 90, 7)
    assert blocks == [k for k in range(7) for _ in range(size + (k < rest))]


# ---- the drain ----


def batches(spark, folder, groups):
    for k, rows in enumerate(groups):
        spark.createDataFrame(rows, "event_id long, value double, user_id long").coalesce(1).write.mode("append").parquet(folder)


def test_drain_over_growing_input_is_in_order(spark, tmp_path):
    rng = random.Random(4)
    events = [(k, None if k % 50 == 3 else rng.randint(1, 999) / 8, 1) for k in range(700) if k != 655]
    rng.shuffle(events)  # whatever the order in which they arrive
    first, second = events[:300], events[300:] + rng.sample(events, 40)  # some come again
    sql = drain_channel.ORACLE.replace("round(sum(value) over (partition by channel order by number), 4)", "sum(value) over (partition by channel order by number)")
    kinds = "event_id bigint, value double, user_id bigint"
    paths = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    config = {"max_files": 1}
    batches(spark, paths[0], [first[:100], first[100:]])
    assert rows_of(drain_channel.run(spark, *paths, config)) == sql_rows(sql, "events", first, kinds)
    files = lambda: {str(r[0]) for r in spark.read.parquet(paths[1]).selectExpr("_metadata.file_path").distinct().collect()}
    before = files()
    assert rows_of(drain_channel.run(spark, *paths, config)) == sql_rows(sql, "events", first, kinds)
    assert files() == before  # nothing new, nothing written
    batches(spark, paths[0], [second[:350], second[350:]])
    got = drain_channel.run(spark, *paths, config)
    want = sql_rows(sql, "events", list({r[0]: r for r in events}.values()), kinds)
    assert rows_of(got) == want
    assert before < files()
    assert got.where("event_id > 655 and event_id % 16 = 15").count() == 0 < got.where("event_id > 655").count()  # held behind the gap


def test_settings_and_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"blocks": 5}))
    assert common.read_config(str(tmp_path / "c.json"), term_matrix.DEFAULTS) == {"languages": None, "blocks": 5}
    (tmp_path / "c.json").write_text(json.dumps({"block": 5}))
    with pytest.raises(ValueError):
        common.read_config(str(tmp_path / "c.json"), term_matrix.DEFAULTS)
    for job in (term_matrix, drain_channel):
        assert common.read_config(f"{ROOT}/jobs/{job.__name__.split('.')[1]}.json", job.DEFAULTS) == job.DEFAULTS
    batches(spark, f"{tmp_path}/events", [[(k, 1.0, 1) for k in range(64)]])
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    told = subprocess.run(
        [sys.executable, "-m", "jobs.drain_channel", "--events", f"{tmp_path}/events", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/state"],
        cwd=ROOT, env=env, capture_output=True, text=True, timeout=240,
    )
    assert told.returncode == 0, told.stderr[-2000:]
    assert "read 64 messages" in told.stderr
    assert spark.read.parquet(f"{tmp_path}/out").count() == 64


def test_jobs_stand_alone():
    """Jobs and this file take nothing of the training-data operators."""
    for name in (*os.listdir(f"{ROOT}/jobs"), os.path.basename(__file__)):
        if name.endswith(".py"):
            where = f"{ROOT}/jobs/{name}" if os.path.exists(f"{ROOT}/jobs/{name}") else f"{ROOT}/tests/{name}"
            lines = [x for x in open(where, encoding="utf-8").read().splitlines() if x.startswith(("import ", "from "))]
            assert not any(".llm" in x or "corpus" in x for x in lines)
