"""Hosts in texts: which ones, how often, whose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.text import under

URL = r"https?://([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++)"
# Endings that are file types rather than domains, and hosts of development platforms.
FILE_ENDINGS = ("js", "ts", "json", "md", "py", "html", "css", "png", "svg", "txt", "yml", "yaml", "xml", "map", "lock")
PLATFORM = ("github.com", "githubusercontent.com", "microsoft.com", "visualstudio.com", "vscode.dev", "npmjs.org", "npmjs.com", "nodejs.org", "w3.org", "json-schema.org", "schemastore.org", "google.com", "googleapis.com", "mozilla.org")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([A-Za-z0-9.-]+)", 1))


def inventory(texts: DataFrame, *, id_col: str = "pkg_id", text_col: str = "text", file_col: str | None = None, own_col: str | None = None) -> DataFrame:
    """(id_col, host, kind, n, first_file, first_line): hosts of URLs, without addresses and file names.

    kind: first-party if the host is, or is below, a domain in the array own_col; platform; third-party.
    """
    file = F.col(file_col) if file_col else F.lit(None).cast("string")
    own = F.col(own_col) if own_col else F.array().cast("array<string>")
    rows = texts.where(F.col(text_col).contains("://")).select(id_col, file.alias("file"), own.alias("own"), F.posexplode(F.split(text_col, "\n")).alias("line", "body")).where(F.col("body").contains("://"))
    found = rows.select(id_col, "file", "own", "line", F.explode(F.regexp_extract_all("body", F.lit(URL), F.lit(1))).alias("host")).withColumn("host", F.lower("host"))
    found = found.where(~F.col("host").rlike(r"^[0-9.]+$") & ~F.substring_index("host", ".", -1).isin(*FILE_ENDINGS))
    mine = F.exists("own", lambda d: (F.col("host") == d) | F.endswith(F.col("host"), F.concat(F.lit("."), d)))
    kind = F.when(mine, "first-party").when(under(F.col("host"), list(PLATFORM)), "platform").otherwise("third-party")
    first = F.min(F.struct("file", "line"))
    out = found.withColumn("kind", kind).groupBy(id_col, "host", "kind").agg(F.count("*").alias("n"), first.alias("first"))
    return out.select(id_col, "host", "kind", "n", F.col("first.file").alias("first_file"), F.col("first.line").alias("first_line"))
