"""Sources and sinks of files: page corpora, reports, configurations; Markdown and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "`fixture-id` string, `page-type` string, `expected-conversion-result` string, `input-size-bytes` long, `source-description` string, `failure-corpus` boolean, `source-encoding` string, archetype string"
FIXTURE = "struct<`fixture-id`:string,`page-type`:string,`conversion-result`:string,`input-bytes`:long,`output-bytes`:long,`latency-ms`:double,`token-reduction-percent`:double,`failure-corpus`:boolean>"
REPORT = (
    "`schema-version` string, metadata map<string,string>, "
    "summary struct<`total-fixtures`:long,`converted-count`:long,`skipped-count`:long,`failed-open-count`:long,`fallback-rate`:double,`token-reduction-percent`:double,"
    "`input-bytes-total`:long,`output-bytes-total`:long,`p50-latency-ms`:double,`p95-latency-ms`:double,`p99-latency-ms`:double>, "
    f"fixtures array<{FIXTURE}>"
)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Pages x.html under a folder that have a description x.meta.json: path, content and the description's fields."""
    read = lambda pattern: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    stem = lambda c, end: F.regexp_replace(c, end, "")
    pages = read("*.html").format("binaryFile").load(folder).select("path", "content", F.col("length").alias("bytes"), stem(F.col("path"), r"\.html$").alias("stem"))
    # both paths come from the binary source, so that they are spelt alike
    metas = read("*.meta.json").format("binaryFile").load(folder).select(stem(F.col("path"), r"\.meta\.json$").alias("stem"), F.from_json(F.make_valid_utf8(F.col("content").cast("string")), META).alias("m"))
    return pages.join(metas, "stem").select("path", "content", "bytes", "m.*")


def reports(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON reports, one a file, with the path each came from."""
    return spark.read.schema(REPORT).option("multiLine", "true").json(list(paths)).withColumn("path", F.col("_metadata.file_path"))


def fixtures(report: DataFrame) -> DataFrame:
    """A report's fixtures as rows with plain names."""
    f = F.col("f")
    return report.select("path", F.explode("fixtures").alias("f")).select(
        "path", f["fixture-id"].alias("fixture_id"), f["page-type"].alias("page_type"), f["conversion-result"].alias("result"), f["input-bytes"].alias("input_bytes"),
        f["output-bytes"].alias("output_bytes"), f["latency-ms"].alias("latency_ms"), F.coalesce(f["failure-corpus"], F.lit(False)).alias("failure_corpus"),
    )


def settings(spark: SparkSession, path: str) -> DataFrame:
    """key=value lines of configuration files: path, key, value, error (not null for a line that is no setting). Blank lines and
    those that begin with # are left out. A stream reads it anew in each foreachBatch."""
    line = F.trim("value")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    ok = F.col("line").rlike("^[A-Za-z_][A-Za-z0-9_.-]*[ \t]*=")
    return rows.select(
        "path", F.when(ok, F.trim(F.substring_index("line", "=", 1))).alias("key"), F.when(ok, F.trim(F.regexp_replace("line", "^[^=]*=", ""))).alias("value"),
        F.when(~ok, F.concat(F.lit("no setting: "), "line")).alias("error"),
    )


def write_markdown(converted: DataFrame, path: str, method: str | None = None) -> None:
    """Converted pages as Parquet. method names a column: rows of HEAD requests keep their other columns, not the body."""
    body = F.col("markdown") if method is None else F.when(F.col(method) != "HEAD", F.col("markdown"))
    converted.withColumn("markdown", body).write.mode("overwrite").parquet(path)


def write_report(summary: DataFrame, path: str) -> None:
    """Rows as JSON lines with kebab-case keys."""
    summary.toDF(*[c.replace("_", "-") for c in summary.columns]).write.mode("overwrite").json(path)
