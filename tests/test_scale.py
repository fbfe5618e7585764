import time

from pyspark.sql import functions as F

from turnwise.llm import common
from turnwise.model import KEY
from turnwise.operators import normalize as N
from turnwise.operators import ordered
from turnwise.sources import files
from turnwise.sources import lines as S


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(1 for i in range(blocks.size()) if blocks.apply(i).name().startswith("shuffle_"))


def test_a_saved_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    back = common.saved(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count())
    for _ in range(100):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert back.count() == 5 and spark.conf.get(common.CLEANUP) == "false"


def test_stem_looks_at_the_name_only(spark):
    names = {"a/b.c.d": "b.c", "a.b/.x": ".x", "a/b.": "b", "a/": "", "plain": "plain", "a/..": "."}
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", S.session_stem(F.col("p")).alias("s"))
    assert {r.p: r.s for r in rows.collect()} == names
    began = time.time()
    deep = spark.range(16).select(F.concat(F.repeat(F.lit("x"), 40_000), F.col("id"), F.lit("/n.txt")).alias("p"))
    assert {r.s for r in deep.select(S.session_stem(F.col("p")).alias("s")).collect()} == {"n"}
    assert time.time() - began < 10


def test_fingerprint_asks_once_for_a_type(spark):
    assert str(N.fingerprint(F.col("v"))).count("schema_of_variant") == 1
    text = ['{"b":1,"a":"x"}', '{"a":"y","b":2.5}', '{"é\\"":null,"z z":[1],"k":{"x":1}}', "{}", "[1]"]
    rows = spark.createDataFrame([(t,) for t in text], "t string").select(N.fingerprint(F.parse_json("t")).alias("f"))
    want = [{"a": "str", "b": "int"}, {"a": "str", "b": "float"}, {'é"': "NoneType", "z z": "list", "k": "dict"}, {}]
    assert [r.f for r in rows.collect()] == [N._shape_hash(w) for w in want] + [None]


def test_rows_of_sessions_are_not_broadcast(spark):
    lines = spark.createDataFrame([("a", 0, 1, True, False, 1, ["text"], "flat")], f"{KEY} string, chunk long, line_no long, ok boolean, duplicate boolean, parsed_events int, missing array<string>, line_class string")
    stats = N.parse_stats(lines)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    # the last lines of a chunk are found by a join of its own
    assert plan.count("SortMergeJoin [session_key") >= 2
    assert [(r.total_lines, r.missing_fields) for r in stats.collect()] == [(1, {"text": 1})]
    assert ordered.beside(lines, lines.select(KEY).distinct()).count() == 1


def test_rows_of_chunks_are_not_broadcast(spark):
    rows = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 2, 7), ("a", 1, 3, 1)], f"{KEY} string, chunk long, seq long, n long")
    keys = [KEY]
    for made, want in (
        (ordered.running_sum(rows, F.col("n"), "x"), [5, 12, 13]),
        (ordered.last_before(rows, F.col("seq"), "x", keys=keys), [None, 1, 2]),
        (ordered.with_key_minimum(rows, F.col("n"), "x"), [1, 1, 1]),
        (ordered.newest(rows, 2).withColumn("x", F.col("n")), [7, 1]),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [session_key" in plan and "BroadcastHashJoin" not in plan
        assert [r.x for r in made.orderBy("seq").collect()] == want


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / "a.txt").write_text("x\ny\n")
    cores = spark.sparkContext.defaultParallelism
    tracker = spark.sparkContext.statusTracker()
    for group, read in (("read", lambda: S.read_lines(spark, str(tmp_path), glob="*.txt")), ("list", lambda: files.list_files(spark, str(tmp_path), glob="*.txt"))):
        spark.sparkContext.setJobGroup(group, group)
        rows = read()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        spark.sparkContext._jsc.clearJobGroup()
        assert sum(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds) <= min(8 * cores, 99)
        assert rows.count() == (200 if group == "read" else 100)
    assert spark.conf.get(S.LISTING) == "10000"
