"""Reports as a Python data source: tasks write parts, the commit joins them to one run.

``findings.write.format("sarif").mode("overwrite").save(folder)`` writes ``run.sarif``, whose results lie in external property files (SARIF
2.1.0, section 3.15.3), one for each task; ``format("report")`` writes ``report.json``, which counts findings by severity and rule and
names its parts of JSON lines. A task holds one line at a time, the driver counts by rule and the names of parts. Parts of
attempts that failed are not in the run, and are deleted. Paths are what ``pyarrow.fs`` knows: local or shared folders, hdfs.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from riskframe.shipping import ship

LEVELS = {"error": "error", "warning": "warning"}
NEEDED = ("rule_id", "severity", "message", "line", "col")


def file_system(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    # Hadoop writes local paths with one slash
    folder = re.sub("^file:/(?!//)", "file:///", folder)
    return fs.FileSystem.from_uri(folder) if re.match("[a-z0-9]+://", folder) else (fs.LocalFileSystem(), folder)


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote."""

    name: str
    rules: dict[str, int]
    severities: dict[str, int]


class ReportWriter(DataSourceWriter):
    def __init__(self, kind: str, folder: str, uri: str, tool: str, overwrite: bool):
        self.kind, self.folder, self.uri, self.tool, self.overwrite = kind, folder.rstrip("/"), uri, tool, overwrite
        self.run = uuid.uuid4().hex[:12]

    def result(self, row: Row) -> dict:
        place = {"artifactLocation": {"uri": str(row[self.uri])}, "region": {"startLine": (row["line"] or 0) + 1, "startColumn": (row["col"] or 0) + 1}}
        return {"ruleId": row["rule_id"], "level": LEVELS.get(row["severity"], "note"), "message": {"text": row["message"] or ""}, "locations": [{"physicalLocation": place}]}

    def write(self, iterator: Iterator[Row]) -> Part:
        fs, path = file_system(self.folder)
        fs.create_dir(path, recursive=True)
        name = f"{self.run}-{uuid.uuid4().hex[:12]}." + ("sarif-external-properties" if self.kind == "sarif" else "jsonl")
        rules, severities = Counter(), Counter()
        with fs.open_output_stream(f"{path}/{name}") as out:
            if self.kind == "sarif":
                out.write(b'{"version": "2.1.0", "results": [\n')
            for k, row in enumerate(iterator):
                line = self.result(row) if self.kind == "sarif" else row.asDict(recursive=True)
                between = b"" if not k else b",\n" if self.kind == "sarif" else b"\n"
                out.write(between + json.dumps(line, ensure_ascii=False, default=str).encode())
                rules[row["rule_id"]] += 1
                severities[row["severity"]] += 1
            out.write(b"\n]}\n" if self.kind == "sarif" else b"\n" if rules else b"")
        return Part(name, dict(rules), dict(severities))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        fs, path = file_system(self.folder)
        fs.create_dir(path, recursive=True)
        rules, severities = Counter(), Counter()
        for p in parts:
            rules.update(p.rules)
            severities.update(p.severities)
        filled = [p for p in parts if p.rules]
        if self.kind == "sarif":
            refs = [{"location": {"uri": p.name}, "itemCount": sum(p.rules.values())} for p in filled]
            run = {"tool": {"driver": {"name": self.tool, "rules": [{"id": r} for r in sorted(rules, key=str)]}}, "externalPropertyFileReferences": {"results": refs}}
            name, text = "run.sarif", {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}
        else:
            name = "report.json"
            text = {"tool": self.tool, "findings": sum(rules.values()), "bySeverity": dict(sorted(severities.items(), key=str)), "byRule": dict(sorted(rules.items(), key=str)), "parts": [p.name for p in filled]}
        old = {f.base_name for f in fs.get_file_info(selector(path))}
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(json.dumps(text, ensure_ascii=False, indent=1).encode())
        kept = {p.name for p in filled} | {name}
        for other in old - kept:
            # earlier runs go where they are overwritten; parts of this run that no message names are of lost attempts
            if other.startswith(self.run) or self.overwrite and re.search(r"\.(sarif-external-properties|jsonl)$", other):
                fs.delete_file(f"{path}/{other}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, path = file_system(self.folder)
        for f in fs.get_file_info(selector(path)):
            if f.base_name.startswith(self.run):
                fs.delete_file(f.path)


def selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path, allow_not_found=True)


class SarifSource(DataSource):
    """Writes findings(rule_id, severity, message, line, col, and the column of option ``uri``, by default ``path``)."""

    kind = "sarif"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        uri = self.options.get("uri", "path")
        missing = [c for c in (*NEEDED, uri) if c not in schema.names]
        if missing:
            raise ValueError(f"findings lack {', '.join(missing)}")
        return ReportWriter(self.kind, self.options["path"], uri, self.options.get("tool", "riskframe"), overwrite)


class ReportSource(SarifSource):
    """Writes findings as JSON lines and a report that counts them."""

    kind = "report"


def register(spark: SparkSession) -> None:
    """Makes the formats ``sarif`` and ``report`` known to a session."""
    ship(spark)
    spark.dataSource.register(SarifSource)
    spark.dataSource.register(ReportSource)
