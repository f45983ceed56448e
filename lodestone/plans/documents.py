"""One ordered JSON or CSV document over many part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.crawl import numbered
from lodestone.plans.work import Work
from lodestone.sources import export

ORDER = ("discovered_at", "title", "id")
ROWS_A_PART = 1_000_000


def write_document(postings: DataFrame, path: str, kind: str, rows_a_part: int = ROWS_A_PART, work: Work | None = None) -> int:
    """Postings in listing order as part files that, joined by name, are one document; gives the number of rows.

    ``kind`` is ``json`` (one array) or ``csv`` (one header, lines end in CRLF).
    Rows get numbers from the sizes of their ranges, so the first and the last
    one carry what opens and closes the document and no task sees all rows.
    Without postings it is an empty array or the header alone. The files appear
    when all tasks are done; a job that fails leaves none.
    """
    if kind not in ("json", "csv"):
        raise ValueError(f"no such document: {kind}")
    work = work or Work(postings.sparkSession, "document")
    line = F.to_json(export.json_record(), {"ignoreNullFields": "false"}) if kind == "json" else export.csv_row()
    rows, total = numbered(work, postings.select(*ORDER, line.alias("line")), list(ORDER), 1, "lines")
    n, nothing = F.col("number"), F.lit("")
    if kind == "json":
        value = F.concat(F.when(n == 1, "[").otherwise(","), F.col("line"), F.when(n == total, "]").otherwise(nothing))
        empty = "[]"
    else:
        value = F.concat(F.when(n == 1, export.CSV_HEADER + "\r\n").otherwise(nothing), F.col("line"), F.lit("\r"))
        empty = export.CSV_HEADER + "\r"
    if total:
        place = F.floor((n - 1) / rows_a_part).cast("int")  # known, so no sample of the numbers is taken
        out = rows.repartitionById(-(-total // rows_a_part), place).sortWithinPartitions("number").select(value.alias("value"))
    else:
        out = postings.sparkSession.createDataFrame([(empty,)], "value string")
    out.write.mode("overwrite").text(path, lineSep="\n")
    work.drop("lines")
    return total


def document_lines(spark: SparkSession, path: str, work: Work | None = None) -> DataFrame:
    """``(number, line)`` of a written document, in its order, from 1; line ends are left out.

    A piece of a file comes in its order, so the sizes of the pieces, a row
    each, number the lines where they are.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.rtrim("value", F.lit("\r")).alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = (work or Work(spark, "lines")).save(lines, "read")
    pieces = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return lines.join(F.broadcast(pieces), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("number"), "line")
