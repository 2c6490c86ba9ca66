"""File fixtures written under tmp_path: CSV layouts, newest file, prompt lists, résumés."""

import os
import time

import pytest
from pyspark.sql import functions as F

from panelscore.config import METRICS
from panelscore.sources import files, sinks


def _evals(spark):
    row = {
        "prompt": 'line one\nline "two", with comma',
        "target_model": "m1",
        "evaluator": "m2",
        "response": "  leading spaces and a \\ backslash",
        "explainability": "because",
        "reasoning": "NA",
        "notes": "",
    }
    for i, m in enumerate(METRICS):
        row[m] = i / 10
        row[f"avg_{m}"] = 0.5
    cols = list(row)
    return spark.createDataFrame([tuple(row[c] for c in cols)], ", ".join(
        f"{c} {'double' if c in METRICS or c.startswith('avg_') else 'string'}" for c in cols))


def test_csv_layouts_round_trip(spark, tmp_path):
    ev = _evals(spark)
    out = str(tmp_path / "results")
    assert sinks.write_comprehensive(ev, out, "20240101_000000") is not None
    assert sinks.write_batch_evaluation(ev, out, "20240102_000000") is not None
    assert sinks.write_comprehensive(ev.limit(0), out, "20240103_000000") is None  # empty -> no file
    runs = files.read_runs(spark, out).orderBy("run_id").collect()
    assert [r["layout"] for r in runs] == ["comprehensive", "batch"]
    a, b = runs
    assert a["prompt"] == 'line one\nline "two", with comma'
    assert a["response"] == "  leading spaces and a \\ backslash"
    assert a["notes"] == "" and a["reasoning"] == "NA"
    assert b["explainability"] == "because" and b["notes"] is None
    assert str(a["eval_ts"]) == "2024-01-01 00:00:00"
    assert [a[m] for m in METRICS] == [i / 10 for i in range(8)]


def test_missing_file_gives_empty_frame(spark, tmp_path):
    df = files.read_eval_csv(spark, str(tmp_path / "nope.csv"))
    assert df.count() == 0 and "helpfulness" in df.columns


def test_latest_file_by_mtime(spark, tmp_path):
    ev = _evals(spark)
    out = str(tmp_path / "results")
    for ts, note in (("20240101_000000", "old"), ("20240102_000000", "new"), ("20240103_000000", "middle")):
        sinks.write_comprehensive(ev.withColumn("notes", F.lit(note)), out, ts)
    now = time.time()
    for ts, age in (("20240101_000000", 300), ("20240102_000000", 10), ("20240103_000000", 100)):
        d = os.path.join(out, f"comprehensive_eval_{ts}.csv")
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (now - age, now - age))
    # a newer file in a sub-folder must be ignored (non-recursive)
    sinks.write_comprehensive(ev.withColumn("notes", F.lit("nested")), out + "/batch_x", "20240104_000000")
    got = {r["notes"] for r in files.latest_eval_csv(spark, out).collect()}
    assert got == {"new"}


def test_prompt_text_file(spark, tmp_path):
    p = tmp_path / "prompts.txt"
    p.write_bytes(b"\t first prompt  \r\n\r\n   \nsecond\n\xc2\xa0third\xc2\xa0")
    rows = files.read_prompts_text(spark, str(p)).orderBy("line_no").collect()
    assert [r["prompt"] for r in rows] == ["first prompt", "second", "third"]
    assert [r["line_no"] for r in rows] == [1, 4, 5]


def test_prompt_csv(spark, tmp_path):
    p = tmp_path / "prompts.csv"
    p.write_text('prompt,other\n"multi\nline ""quoted""",1\n,2\nNA,3\nplain,4\n', encoding="utf-8")
    rows = [r["prompt"] for r in files.read_prompts_csv(spark, str(p)).collect()]
    assert rows == ['multi\nline "quoted"', "NA", "plain"]


def test_resume_files(spark, tmp_path):
    d = tmp_path / "resumes"
    d.mkdir()
    (d / "a.txt").write_text("Python and Spark", encoding="utf-8")
    (d / "b.TXT").write_text("Upper suffix", encoding="utf-8")
    (d / "c.pdf").write_bytes(b"%PDF-1.4")
    (d / "d.md").write_text("markdown", encoding="utf-8")
    got = {os.path.basename(r["path"]): (r["resume"], r["unsupported"]) for r in files.read_resumes(spark, str(d)).collect()}
    assert got == {"a.txt": ("Python and Spark", False), "b.TXT": ("Upper suffix", False),
                   "c.pdf": ("", True), "d.md": ("", False)}
    kinds = spark.createDataFrame([("x.csv",), ("x.CSV",), ("cv.PDF",), ("cv.docx",), ("a.md",)], "n string")
    assert [r[0] for r in kinds.select(files.input_kind(F.col("n"))).collect()] == ["batch", "none", "resume", "resume", "none"]


def test_batch_output_bundle_and_report(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "p1", "| t |"), (2, "p2", None)], "prompt_id long, prompt string, ats_summary string")
    path = sinks.write_batch_prompts(prompts, str(tmp_path / "run"))
    back = spark.read.options(**files.CSV_OPTIONS).csv(path)
    assert "ATS Summary" in back.columns and back.count() == 2
    t = spark.createDataFrame([("m1", 0.5)], "target_model string, helpfulness double")
    written = sinks.write_bundle({"evaluation": t, "heatmap": t}, str(tmp_path / "bundle"), "20240101_000000")
    got = spark.read.parquet(written["heatmap"]).collect()
    assert got[0]["run_id"] == "20240101_000000"
    lines = spark.createDataFrame([(2, "line a"), (1, "line b")], "line_no long, value string")
    rp = sinks.write_report_text(lines, str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(rp).collect()] == ["line b", "line a"]


def test_bundle_rewrite_is_idempotent(spark, tmp_path):
    t = spark.createDataFrame([("m1", 0.5), ("m2", 0.7)], "target_model string, helpfulness double")
    out = str(tmp_path / "bundle")
    sinks.write_bundle({"heatmap": t}, out, "r1")
    sinks.write_bundle({"heatmap": t}, out, "r2")
    sinks.write_bundle({"heatmap": t}, out, "r1")  # same run again: replaced, not appended
    back = sinks.read_bundle(spark, out, "heatmap")
    assert back.count() == 4
    assert {r["run_id"] for r in back.collect()} == {"r1", "r2"}
    assert sinks.read_bundle(spark, out, "heatmap", "r2").count() == 2


def test_bundle_appears_as_a_whole(spark, tmp_path):
    """A run that was written but not published, or whose writing broke off, is not read."""
    t = spark.createDataFrame([("m1", 0.5)], "target_model string, helpfulness double")
    out = str(tmp_path / "bundle")
    assert sinks.read_bundle(spark, out, "heatmap") is None
    staged = sinks.stage_bundle({"heatmap": t, "bar": t}, out, "r1")
    assert sinks.read_bundle(spark, out, "heatmap") is None
    broken = t.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_bundle({"heatmap": t, "bar": broken}, out, "r2")
    assert sinks.read_bundle(spark, out, "heatmap") is None
    sinks.publish_bundle(spark, staged, out, "r1")
    assert sinks.read_bundle(spark, out, "heatmap").count() == sinks.read_bundle(spark, out, "bar").count() == 1
    # the same run again replaces all its tables at once
    sinks.write_bundle({"heatmap": t.union(t)}, out, "r1")
    assert sinks.read_bundle(spark, out, "heatmap").count() == 2 and sinks.read_bundle(spark, out, "bar") is None


def test_line_numbers_continue_across_files(spark, tmp_path):
    d = tmp_path / "prompts"
    d.mkdir()
    (d / "a.txt").write_text("one\ntwo\n\nthree\n", encoding="utf-8")
    (d / "b.txt").write_text("four\nfive\n", encoding="utf-8")
    rows = files.read_prompts_text(spark, str(d)).orderBy("line_no").collect()
    assert [(r["line_no"], r["prompt"]) for r in rows] == [(1, "one"), (2, "two"), (4, "three"), (5, "four"), (6, "five")]


def test_newest_run_is_complete_and_read_alone(spark, tmp_path):
    """A run is a folder of part files; all of them belong to it."""
    schema = files.COMPREHENSIVE_SCHEMA
    cols = [f.name for f in schema.fields]
    base = str(tmp_path / "results")
    for run, n in (("20240101_000000", 40), ("20240102_000000", 60)):
        df = spark.range(n).select(*[F.col("id").cast("string").alias(c) for c in cols]).withColumn("timestamp", F.lit(run))
        df.repartition(5).write.option("header", "true").csv(f"{base}/comprehensive_eval_{run}.csv")
    got = files.latest_eval_csv(spark, base)
    assert got.count() == 60 and {r[0] for r in got.select("timestamp").distinct().collect()} == {"20240102_000000"}


def test_empty_folder_and_swapped_header(spark, tmp_path):
    empty = tmp_path / "none"
    empty.mkdir()
    assert files.latest_eval_csv(spark, str(empty)).count() == 0
    assert files.read_runs(spark, str(empty)).count() == 0
    f = tmp_path / "swapped.csv"
    f.write_text("clarity,helpfulness,prompt\n0.1,0.9,p\n")
    row = files.read_eval_csv(spark, str(f)).first()
    assert (row["helpfulness"], row["clarity"], row["prompt"], row["evaluator"]) == (0.9, 0.1, "p", None)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    """Unlike column orders, missing and extra columns, quoted names with breaks, a byte-order mark."""
    base = tmp_path / "results"
    base.mkdir()
    texts = {
        "comprehensive_eval_20240101_000000.csv": "prompt,target_model,helpfulness,clarity\np,m,0.9,0.2\n",
        "comprehensive_eval_20240102_000000.csv": "target_model,clarity,helpfulness,prompt\nm,0.2,0.9,p\n",
        "comprehensive_eval_20240103_000000.csv": "\ufeff\"prompt\",\"two\nlines, quoted\",helpfulness\n\"a\nb\",x,0.5\n",
        "comprehensive_eval_20240104_000000.csv": "",
        "comprehensive_eval_20240105_000000.csv": "prompt,helpfulness,helpfulness\n",
        "comprehensive_eval_20240106_000000.csv": "prompt,helpfulness,helpfulness\nq,0.1,0.7\n",
    }
    for name, text in texts.items():
        (base / name).write_text(text, encoding="utf-8")
    got = {r["run_id"]: r for r in files.read_runs(spark, str(base)).collect()}
    assert sorted(got) == ["20240101_000000", "20240102_000000", "20240103_000000", "20240106_000000"]
    for run in ("20240101_000000", "20240102_000000"):
        assert (got[run]["prompt"], got[run]["target_model"], got[run]["helpfulness"], got[run]["clarity"]) == ("p", "m", 0.9, 0.2)
    assert (got["20240103_000000"]["prompt"], got["20240103_000000"]["helpfulness"], got["20240103_000000"]["clarity"]) == ("a\nb", 0.5, None)
    assert got["20240106_000000"]["helpfulness"] == 0.1
    heads = {r["file_path"].rsplit("/", 1)[1]: r["names"] for r in files.file_headers(spark, str(base)).collect()}
    assert heads["comprehensive_eval_20240103_000000.csv"] == ["prompt", "two\nlines, quoted", "helpfulness"]
    assert "comprehensive_eval_20240104_000000.csv" not in heads


def test_headers_of_split_files_are_read_once(spark, tmp_path):
    from panelscore.session import conf_override

    base = tmp_path / "results"
    base.mkdir()
    for k, head in enumerate(("prompt,helpfulness,target_model", "target_model,prompt,helpfulness")):
        lines = [("p,0.5,m" if k == 0 else "m,p,0.5")] * 20_000
        (base / f"comprehensive_eval_2024010{k + 1}_000000.csv").write_text("\n".join([head, *lines]) + "\n")
    with conf_override(spark, {"spark.sql.files.maxPartitionBytes": "16384"}):
        assert files.file_headers(spark, str(base)).count() == 2
        df = files.read_eval_csv(spark, str(base))
        assert df.where("prompt = 'p' and target_model = 'm' and helpfulness = 0.5").count() == 40_000 == df.count()


def test_prompt_files_of_unlike_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("prompt,topic\nhello,x\n")
    (tmp_path / "b.csv").write_text("topic,prompt\ny,world\n")
    got = {tuple(r) for r in files.read_prompts_csv(spark, str(tmp_path)).select("prompt", "topic").collect()}
    assert got == {("hello", "x"), ("world", "y")}


def test_numbering_neither_shuffles_nor_sorts_lines(spark, tmp_path):
    from panelscore.session import conf_override

    d = tmp_path / "lines"
    d.mkdir()
    expected = []
    for k in range(4):
        lines = [f"f{k} line {i} " + "x" * (i % 50) for i in range(3000 + k)]
        (d / f"{k}.txt").write_text("\n".join(lines) + "\n")
        expected += lines
    with conf_override(spark, {"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "10"}):
        df = files.number_rows(spark.read.text(str(d)), "line_no")
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {r["line_no"]: r["value"] for r in df.collect()}
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan
    assert [got[i + 1] for i in range(len(expected))] == expected


def test_resume_kinds_and_bytes(spark, tmp_path):
    for name, data in {"a.txt": "é one".encode(), "b.TXT": b"two", "c.pdf": b"%PDF", "d.Docx": b"PK", "e.md": b"# x", "f": b"y"}.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r["path"]): (r["resume"], r["suffix"], r["unsupported"]) for r in files.read_resumes(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": ("é one", ".txt", False), "b.TXT": ("two", ".txt", False), "c.pdf": ("", ".pdf", True),
        "d.Docx": ("", ".docx", True), "e.md": ("", ".md", False), "f": ("", "", False),
    }


def test_resume_folders_are_listed_by_few_tasks(spark, tmp_path):
    """A folder for each résumé does not make a listing task for each folder."""
    for i in range(120):
        (tmp_path / f"id={i}").mkdir()
        (tmp_path / f"id={i}" / "cv.txt").write_text(f"text {i}", encoding="utf-8")
    sc, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    sc.setJobGroup("listing-of-resumes", "listing")
    got = files.read_resumes(spark, str(tmp_path))
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing-of-resumes") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * sc.defaultParallelism
    assert {r["resume"] for r in got.collect()} == {f"text {i}" for i in range(120)}
    assert spark.conf.get(name) == before


def test_a_file_for_each_row_in_few_folders(spark, tmp_path):
    """Files of any names, equal ones too, without a folder or a checksum file (a process each) for every file; nothing half-written is left."""
    from panelscore.sources import sinks

    rows = [(f"id={i:03d}", f"text é {i}\nend") for i in range(300)] + [("id=007", "again"), ("id=007", "again"), ("null", None)]
    df = spark.createDataFrame(rows, "name string, value string").repartition(3)
    sinks.write_text_files(df, f"file:{tmp_path}/out")
    found = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "out") for f in names]
    got = sorted((os.path.basename(f).rsplit("-", 1)[0], open(f, encoding="utf-8").read()) for f in found)
    assert got == sorted((n, (v or "") + "\n") for n, v in rows)
    folders = [d for d, _, _ in os.walk(tmp_path / "out")]
    assert len(folders) <= 7 and not any("_attempt" in d for d in folders)
    # in a store that Python can't reach, Spark writes them
    assert sinks._store("viewfs://store/out") is None


def test_small_resume_files_are_read_by_few_tasks(spark, tmp_path):
    """Opening a file counts as 4 MB by default: four small files a task."""
    from panelscore.session import conf_override

    for i in range(400):
        (tmp_path / f"{i}.txt").write_text(f"text {i}", encoding="utf-8")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    sc = spark.sparkContext
    with conf_override(spark, {"spark.sql.files.maxPartitionBytes": "16m"}):
        sc.setJobGroup("reading-of-resumes", "reading")
        got = [(r["resume"], r["unsupported"]) for r in files.read_resumes(spark, str(tmp_path)).collect()]
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("reading-of-resumes") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 4 * sc.defaultParallelism
    assert sorted(got) == sorted([(f"text {i}", False) for i in range(400)] + [("", True)])


def test_resume_files_where_only_spark_writes(spark, monkeypatch):
    from data_dirs import SF_SMALL
    from panelscore.plans.catalog import QUERIES
    from panelscore.sources import sinks

    want = sorted(map(str, QUERIES["resume_files"](spark, SF_SMALL).collect()))
    monkeypatch.setattr(sinks, "_store", lambda path: None)
    assert sorted(map(str, QUERIES["resume_files"](spark, SF_SMALL).collect())) == want
