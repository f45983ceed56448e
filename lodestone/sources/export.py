"""JSON and CSV export of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_HEADER = "title,company,location,skills,experience,employmentType,sourceUrl,extractionMethod"
CSV_COLUMNS = ("title", "company", "location", "skills", "experience", "employment_type", "source_url", "extraction_method")
JSON_NAMES = {
    "id": "id", "scan_id": "scanId", "page_id": "pageId", "source_url": "sourceUrl", "title": "title", "company": "company", "location": "location", "skills": "skills",
    "experience": "experience", "employment_type": "employmentType", "description": "description", "extraction_method": "extractionMethod", "discovered_at": "discoveredAt",
}


def csv_field(value: Column) -> Column:
    """Always quoted; quotes doubled, line breaks as spaces, null as empty."""
    plain = F.translate(F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), "\r\n", "  ")
    return F.concat(F.lit('"'), plain, F.lit('"'))


def csv_row(columns: tuple[str, ...] = CSV_COLUMNS) -> Column:
    fields = [F.array_join("skills", " | ") if c == "skills" else F.col(c) for c in columns]
    return F.concat_ws(",", *(csv_field(f) for f in fields))


def csv_rows(postings: DataFrame) -> DataFrame:
    return postings.select("id", csv_row().alias("line"))


def write_csv(postings: DataFrame, path: str) -> None:
    """One file per partition, each with the header; lines end in CRLF."""
    lines = postings.orderBy("discovered_at", "title").select(F.concat(csv_row(), F.lit("\r")).alias("value"))
    lines.write.mode("overwrite").text(path, lineSep="\n")


def csv_document(postings: DataFrame) -> DataFrame:
    """One row ``(filename, mime, payload)``, for a download of one scan."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("discovered_at", "title", "id", csv_row().alias("line")))), lambda r: F.concat(r["line"], F.lit("\r\n")))
    body = F.concat(F.lit(CSV_HEADER + "\r\n"), F.array_join(ordered, ""))
    return postings.agg(F.encode(body, "UTF-8").alias("payload")).select(F.lit("jobs.csv").alias("filename"), F.lit("text/csv").alias("mime"), "payload")


def json_record(epoch: bool = False) -> Column:
    """A posting as a struct with the exported field names.

    Instants are ISO text, or seconds with ``epoch``.
    """
    at = F.unix_micros("discovered_at") / 1_000_000 if epoch else F.date_format("discovered_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.struct(*((at if c == "discovered_at" else F.col(c)).alias(n) for c, n in JSON_NAMES.items()))


def json_lines(postings: DataFrame, epoch: bool = False) -> DataFrame:
    return postings.select("id", F.to_json(json_record(epoch), {"ignoreNullFields": "false"}).alias("line"))


def json_document(postings: DataFrame, epoch: bool = False) -> DataFrame:
    """One row with a pretty array, for a download of one scan."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("discovered_at", "title", "id", json_record(epoch).alias("r")))), lambda x: x["r"])
    body = F.to_json(ordered, {"pretty": "true", "ignoreNullFields": "false"})
    return postings.agg(F.encode(body, "UTF-8").alias("payload")).select(F.lit("jobs.json").alias("filename"), F.lit("application/json").alias("mime"), "payload")
