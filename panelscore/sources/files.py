"""File sources: evaluation CSVs, prompt lists, résumé files, search JSON (SRC-1..6, SET-2, SRT-2, TOP-3).

Readers never infer schemas: every layout has an explicit StructType, and a
missing path yields an empty DataFrame of that schema (FLT-9) instead of None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from ..config import METRICS, RUN_TS_FORMAT
from ..functions.text import strip
from ..operators.joins import bounded_broadcast
from ..session import conf_override, materialize

# 23-column layout written per prompt by the command-line flow.
COMPREHENSIVE_COLUMNS = (
    ["timestamp", "prompt", "target_model", "evaluator", "response"]
    + METRICS
    + ["reasoning", "notes"]
    + [f"avg_{m}" for m in METRICS]
)
# 21-column layout written per batch by the interactive flow.
BATCH_COLUMNS = (
    ["prompt", "target_model", "evaluator", "response", "explainability"] + METRICS + [f"avg_{m}" for m in METRICS]
)
_NUMERIC = set(METRICS) | {f"avg_{m}" for m in METRICS}


def layout_schema(columns) -> StructType:
    return StructType([StructField(c, DoubleType() if c in _NUMERIC else StringType()) for c in columns])


COMPREHENSIVE_SCHEMA = layout_schema(COMPREHENSIVE_COLUMNS)
BATCH_SCHEMA = layout_schema(BATCH_COLUMNS)
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    # An unquoted empty field is null; a quoted "" stays an empty string. (With
    # the default nullValue "" both would become null.)
    "nullValue": "\u0000",
}


SMALL_FILE_BYTES = 64 << 10  # what opening a small file counts as when files are dealt to tasks


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) names anything, asked of its own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _first_records(batches):
    """The header record of the file that a partition starts with: (file_path, names)."""
    import csv

    import pyarrow as pa

    lines, path = [], None
    for batch in batches:
        for value, file_path in zip(batch.column(0), batch.column(1)):
            if path is None:
                path = file_path.as_py()
            lines.append(value.as_py())
            # a line break inside quotes goes on
            if sum(line.count('"') for line in lines) % 2 == 0:
                names = next(csv.reader(["\n".join(lines).removeprefix("\ufeff")]), [])
                yield pa.RecordBatch.from_pylist([{"file_path": path, "names": names}], pa.schema([("file_path", pa.string()), ("names", pa.list_(pa.string()))]))
                return


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, names`` of every file with a header record; tasks stop reading after it.

    Each file split is a partition of its own, so one task reads the start of one file.
    """
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    start = (F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"))
    with conf_override(spark, {"spark.sql.files.openCostInBytes": most}):
        lines = spark.read.text(path).select("value", *start).where("start = 0").select("value", "file_path")
        return materialize(lines.mapInArrow(_first_records, "file_path string, names array<string>"), "headers")


def read_csv_by_name(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """CSV files as text columns taken by each file's own header, with ``file_path`` and ``file_mtime``.

    Files may order their columns differently: cells are read by position and named through the
    header of their file (one small row per file; no join where all headers agree). A column that a
    header lacks is null; of a repeated name the first column counts. Without ``columns``, all names that occur.
    """
    headers = file_headers(spark, path)
    if columns is None:
        seen = headers.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
        columns = [r["name"] for r in seen.orderBy("at", "name").collect()]
    width = headers.agg(F.max(F.size("names"))).first()[0] or 0
    cells = [f"_c{i}" for i in range(width)]
    file_columns = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_mtime")]
    # the header record of each file is skipped; names come from it by file
    raw = spark.read.options(**CSV_OPTIONS).schema(", ".join(f"{c} string" for c in cells) or "_c0 string").csv(path).select("*", *file_columns)
    layouts = headers.select("names").distinct().limit(2).collect()
    if len(layouts) == 1:
        names = layouts[0]["names"]
        take = {c: F.col(cells[names.index(c)]) if c in names else F.lit(None).cast("string") for c in columns}
    else:
        # 1-based place of each wanted column in the file's header, nought where it lacks
        places = headers.select("file_path", *[F.array_position("names", c).cast("int").alias(f"_p{i}") for i, c in enumerate(columns)])
        raw = raw.join(bounded_broadcast(places, 100_000), "file_path", "left").select("*", F.array(*cells).alias("_cells"))
        missing = F.raise_error(F.concat(F.lit("no header was read from "), F.col("file_path")))
        take = {c: F.when(F.col(f"_p{i}").isNull(), missing.cast("string")).when(F.col(f"_p{i}") > 0, F.get("_cells", F.col(f"_p{i}") - 1)) for i, c in enumerate(columns)}
    return raw.select(*[v.alias(c) for c, v in take.items()], "file_path", "file_mtime")


def read_eval_csv(spark: SparkSession, path: str, schema: StructType = COMPREHENSIVE_SCHEMA) -> DataFrame:
    """SRC-1: evaluation CSVs (a file, folder or glob) with the given layout; missing -> empty.

    Columns are taken by the names of each file's own header, whatever their order; a column that
    a header lacks is null. Metric text that is not a number ('nan', 'NA', junk) becomes null.
    """
    if not path_exists(spark, path):
        return _empty(spark, StructType(schema.fields + [StructField("file_path", StringType()), StructField("file_mtime", TimestampType())]))
    raw = read_csv_by_name(spark, path, [f.name for f in schema.fields])
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
        cols.append(c.alias(f.name))
    return raw.select(*cols, "file_path", "file_mtime")


def newest_csv(spark: SparkSession, results_dir: str) -> str | None:
    """Path of the newest ``results_dir/*.csv``: a file, or a run's folder of part files.

    Only file metadata is read; a run's age is that of its latest part (ties: larger path).
    """
    pattern = f"{results_dir.rstrip('/')}/*.csv"
    if not path_exists(spark, pattern):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", "modificationTime")
    run = F.regexp_extract("path", r"^(.*?/[^/]*\.csv)(?:/[^/]*)?$", 1)
    runs = files.where(~F.col("path").rlike(r"/[._][^/]*$")).groupBy(run.alias("run")).agg(F.max("modificationTime").alias("at"))
    row = runs.agg(F.max_by("run", F.struct("at", "run")).alias("run")).first()
    return row["run"]


def latest_eval_csv(spark: SparkSession, results_dir: str, schema: StructType = COMPREHENSIVE_SCHEMA) -> DataFrame:
    """SRC-2 + TOP-3: all rows of the newest run under ``results_dir``; only that run is read."""
    path = newest_csv(spark, results_dir)
    if path is None:
        return read_eval_csv(spark, f"{results_dir.rstrip('/')}/*.csv", schema)
    return read_eval_csv(spark, path, schema)


def run_id_from_path(path_col) -> F.Column:
    """The run's timestamp id: ``yyyyMMdd_HHmmss`` (+ optional suffix) from the file or folder name."""
    return F.regexp_extract(path_col, r"(?:comprehensive_eval_|batch_)(\d{8}_\d{6}(?:_prompt_\d+)?)", 1)


def read_runs(spark: SparkSession, results_dir: str) -> DataFrame:
    """SET-2: all runs of both layouts as one table, with ``run_id`` and ``eval_ts`` (DTE-1)."""
    base = results_dir.rstrip("/")
    a = read_eval_csv(spark, f"{base}/comprehensive_eval_*.csv", COMPREHENSIVE_SCHEMA).withColumn("layout", F.lit("comprehensive"))
    b = read_eval_csv(spark, f"{base}/batch_*/evaluation.csv", BATCH_SCHEMA).withColumn("layout", F.lit("batch"))
    u = a.unionByName(b, allowMissingColumns=True)
    rid = run_id_from_path(F.col("file_path"))
    # a run id is a wall-clock stamp without zone: TIMESTAMP_NTZ
    return u.withColumn("run_id", rid).withColumn(
        # parsed and converted back in the session zone, so the wall clock is kept
        "eval_ts", F.try_to_timestamp(F.substring(rid, 1, 15), F.lit(RUN_TS_FORMAT)).cast("timestamp_ntz")
    )


def read_prompts_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3 + FLT-1: batch prompts from the ``prompt`` column (all columns kept as text)."""
    if not path_exists(spark, path):
        return _empty(spark, StructType([StructField("prompt", StringType())]))
    df = read_csv_by_name(spark, path).drop("file_path", "file_mtime")
    if "prompt" not in df.columns:
        raise ValueError("batch file needs a 'prompt' column")
    return df.where(F.col("prompt").isNotNull())


def number_rows(df: DataFrame, name: str = "row_no") -> DataFrame:
    """SRT-2: 1-based numbering in file order; the rows are neither shuffled nor sorted.

    A first pass counts the rows of each file split (and notes where the split starts in its scan
    partition); the counts are added up over the splits in file order, and a second pass over the
    same scan adds each split's offset to the places inside it.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    t = df.select("*", *split, F.monotonically_increasing_id().alias("_mid"))
    sizes = t.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("_start"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    # one short row per split
    offsets = sizes.select("_file", "_block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_add"))
    j = t.join(bounded_broadcast(materialize(offsets, "splits"), 1_000_000), ["_file", "_block"])
    return j.withColumn(name, F.col("_mid") + F.col("_add")).drop("_file", "_block", "_mid", "_add")


def read_prompts_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4 + FLT-2 + STR-9: one prompt per line, stripped, blanks dropped, numbered."""
    lines = spark.read.text(path)  # \n, \r\n and \r all end a line
    numbered = number_rows(lines, "line_no")
    return numbered.select("line_no", strip(F.col("value")).alias("prompt")).where(F.length("prompt") > 0)


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5 + STR-14: résumé files; .txt decoded as UTF-8, .pdf/.docx unsupported, others empty.

    Files are listed once and bytes are read of .txt files only; of all others the listing is enough.
    Folders are listed by a few tasks a core: the default is a task for each folder, up to ten thousand.
    A task reads hundreds of small files, by the default it would be a few; as that is settled where the
    files are read, their texts are written once.
    """
    settings = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism, "spark.sql.files.openCostInBytes": SMALL_FILE_BYTES}
    with conf_override(spark, settings):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
        # by their names, files are left out before tasks are planned
        is_text = F.lower(F.col("_metadata.file_name")).endswith(".txt")
        texts = files.where(is_text).select("path", suffix.alias("suffix"), F.decode("content", "UTF-8").alias("resume"))
        others = files.where(~is_text).select("path", suffix.alias("suffix"), F.lit("").alias("resume"))
        return materialize(texts.unionByName(others).select("*", F.col("suffix").isin(".pdf", ".docx").alias("unsupported")).select("path", "suffix", "resume", "unsupported"), "texts")


def input_kind(name_col) -> F.Column:
    """STR-14: '.csv' (case-sensitive) -> batch; .pdf/.docx/.txt (any case) -> resume; else none."""
    lower = F.lower(name_col)
    return (
        F.when(name_col.endswith(".csv"), F.lit("batch"))
        .when(lower.endswith(".pdf") | lower.endswith(".docx") | lower.endswith(".txt"), F.lit("resume"))
        .otherwise(F.lit("none"))
    )


SIMPLE_COLUMNS = ["model", "helpfulness", "correctness", "coherence", "clarity"]


def read_eval_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 + PRJ-6 for any layout: the files' headers decide the schema (no data inference).

    Known metric / average columns are typed DOUBLE, everything else STRING.
    """
    if not path_exists(spark, path):
        return _empty(spark, COMPREHENSIVE_SCHEMA)
    names = read_csv_by_name(spark, path).drop("file_path", "file_mtime").columns
    return read_eval_csv(spark, path, layout_schema(names)) if names else _empty(spark, COMPREHENSIVE_SCHEMA)
