"""Queries of the text rules over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions import text as tx
from riskframe.operators import hosts, pack_scan, rules
from riskframe.operators.rules import Rule

W = (tx.WORD_START, tx.WORD_END)
PAN = Rule("pci/pan", f"{W[0]}[0-9]{{13,19}}{W[1]}", severity="error", message="card number {{value}}", validate="luhn")
IP = Rule("net/ip", f"{W[0]}[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}{W[1]}", message="address {{value}}", validate="publicIpv4")
# An address begins where its characters do: else each of a long run would be tried as a beginning.
EMAIL = Rule("pii/email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", severity="info", message="address {{value}}")
TOKEN = Rule("secret/token", r"(?:token|password) ?= ?\"?[0-9a-f]{16,}", severity="error")
LICENSE = Rule("doc/license", r"[Ll]icensed? under|MIT License", kind="absent", severity="hint", unless=r"\|")
ANGRY = Rule("doc/shout", r"[A-Z]{4,}!!", when=r"!!", unless=r"\$\$\$", severity="hint")
RULES = [PAN, IP, EMAIL, TOKEN]

#: Rules about documents that run beside the shipped pack.
DOCUMENT_PACK = {
    "word/license": r"(?i)licen[cs]ed? under", "word/copyright": r"(?i)copyright \(c\)", "word/warranty": r"WARRANTY|WARRANTIES", "word/permission": r"Permission is hereby", "word/apache": r"Apache License",
    "word/password": r"(?i)\b(?:password|passwd)\b", "word/token": r"(?i)\btoken\b", "word/secret": r"\bsecret\b", "word/key": r"\bapi_?key\b", "word/access": r"AKIA[A-Z0-9]{16}",
    "shape/mail": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+", "shape/link": r"https?://[a-z0-9.-]+", "shape/hex": r"\b[0-9a-f]{32,}\b", "shape/phone": r"\+[0-9]{1,3} [0-9]+", "shape/table": r"\| [^|\n]* \|",
    "shape/shout": r"[A-Z]{5,}", "shape/repeat": r"!!+|\?\?+", "shape/date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "shape/money": r"[$€][0-9]+", "shape/version": r"(?i)version [0-9]+",
}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def per_line(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "line", "value").agg(F.count("*").alias("n"))


def pan_findings(spark, d):
    """Card numbers by source (the flagship)."""
    found = rules.scan(docs(spark, d), [PAN], keep=("source",))
    return found.groupBy("source").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("f")).select("source", "n_findings", "n_docs", F.col("f.doc_id").alias("first_doc"), F.col("f.line").alias("first_line"))


LUHN = "list_sum(list_transform(range(len(v)), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN 2 * v[len(v) - i]::INT > 9 THEN 2 * v[len(v) - i]::INT - 9 ELSE 2 * v[len(v) - i]::INT END) ELSE v[len(v) - i]::INT END)) % 10 = 0"
LINES = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents"


def lines_sql(pattern: str, test: str = "true") -> str:
    return rf"WITH l AS ({LINES}), m AS (SELECT doc_id, source, lang, line::INT AS line, unnest(regexp_extract_all(body, '{pattern}')) AS v FROM l), h AS (SELECT * FROM m WHERE {test})"


PAN_RE2, IP_RE2 = r"\b[0-9]{13,19}\b", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
EMAIL_RE2 = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
TOKEN_RE2 = r'(?:token|password) ?= ?"?[0-9a-f]{16,}'
OCTETS = ", ".join(f"TRY_CAST(string_split(v, '.')[{i + 1}] AS INT) AS {c}" for i, c in enumerate("abce"))
PUBLIC = f"""(SELECT a <= 255 AND b <= 255 AND c <= 255 AND e <= 255 AND a > 2 AND NOT (a < 32 AND b < 32 AND c < 32 AND e < 32) AND NOT (b = 0 AND c = 0 AND e = 0)
  AND NOT (a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 192 AND b = 0 AND c IN (0, 2))
  OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224)
  AND v NOT IN ('1.0.0.1', '1.1.1.1', '4.2.2.1', '4.2.2.2', '8.8.4.4', '8.8.8.8', '9.9.9.9', '208.67.220.220', '208.67.222.222', '149.112.112.112')
  FROM (SELECT {OCTETS}))"""
PER_LINE = " SELECT doc_id, line, v AS value, count(*) AS n FROM h GROUP BY ALL"


def pack_findings(spark, d):
    """Findings of the rules about documents in a scan with all shipped rules."""
    own = [Rule(k, p, severity="info", message="{{match}}") for k, p in DOCUMENT_PACK.items()]
    found = pack_scan.scan_pack(docs(spark, d), [*pack_scan.shipped_rules(spark), *own])
    found = found.where(F.col("rule_id").isin(*DOCUMENT_PACK))
    return found.groupBy("rule_id", "doc_id").agg(F.count("*").alias("n"), F.min(F.struct("start", "line", "col", "matched")).alias("f")).select("rule_id", "doc_id", "n", F.col("f.line").alias("first_line"), F.col("f.matched").alias("first_match"))


def ip_findings(spark, d):
    return per_line(rules.scan(docs(spark, d), [IP]))


def email_findings(spark, d):
    return per_line(rules.scan(docs(spark, d), [EMAIL]))


def absent_rule(spark, d):
    return rules.scan(docs(spark, d), [LICENSE]).select("doc_id", "rule_id", "line", "col")


def when_unless_rules(spark, d):
    return rules.scan(docs(spark, d), [ANGRY]).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("value").alias("first_value"))


def with_directives(spark, d) -> DataFrame:
    """Every seventh document suppresses a rule for all of it, every fifth on its first line, every third on the second."""
    head = F.when(F.col("doc_id") % 7 == 0, "# lint-ignore-file pii/email, net/ip").when(F.col("doc_id") % 5 == 0, "# lint-ignore *").when(F.col("doc_id") % 3 == 0, "# lint-ignore-next-line pci/pan secret/token").otherwise("#")
    return docs(spark, d).withColumn("text", F.concat(head, F.lit(" "), F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), head, F.lit(" ")))))


def suppression(spark, d):
    kept = pack_scan.scan_pack(with_directives(spark, d), RULES, mark="lint-")
    return kept.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"))


def finding_summary(spark, d):
    return rules.summary(pack_scan.scan_pack(docs(spark, d), RULES, keep=("lang", "source")), "lang", "rule_id", "severity")


def fail_gate(spark, d):
    return rules.gate(pack_scan.scan_pack(docs(spark, d), RULES, keep=("source",)), "warning", "source")


def disabled_rules(spark, d):
    return rules.summary(pack_scan.scan_pack(docs(spark, d), RULES, disabled=("net/ip", "pci/pan")), "rule_id")


def shannon_by_source(spark, d):
    """Entropy of the words of each source: character counts of all texts, not of samples."""
    chars = docs(spark, d).select("source", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("source", "c").agg(F.count("*").alias("n"))
    total = chars.groupBy("source").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return chars.join(total, "source").groupBy("source").agg(F.round(F.sum(-p * F.log2(p)), 9).alias("bits"), F.count("*").alias("n_chars"))


def host_inventory(spark, d):
    """Hosts by page, of its address and its source; example.com is the first party."""
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("body", F.concat_ws("\n", "url", "html")).withColumn("own", F.array(F.lit("example.com")))
    return hosts.inventory(pages, id_col="page_id", text_col="body", own_col="own").select("page_id", "host", "kind", "n", "first_line")


def page_hosts(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.groupBy(hosts.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


def escape_reasons(spark, d):
    """Escape-density and name markers over documents, a third of them written as escapes, and pages."""
    text, k = F.col("text"), F.col("doc_id") % 3
    escaped = F.concat(F.lit('"'), F.regexp_replace(F.lower(F.hex(F.encode(text, "UTF-8"))), "(....)", r"\\u$1"), F.lit('"'))
    d1 = docs(spark, d).select(F.lit("documents").alias("origin"), F.when(k == 0, escaped).when(k == 1, F.regexp_replace(text, " ([a-f]{1,2})", " _0xab12$1")).otherwise(text).alias("text"))
    both = d1.unionByName(spark.read.parquet(f"{d}/pages.parquet").select(F.lit("pages").alias("origin"), F.col("html").alias("text")))
    reason = F.coalesce(tx.escape_density(text), F.when(tx.obfuscator_names(text), "names"), F.lit("none"))
    return both.groupBy("origin", reason.alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pan_findings, pack_findings, ip_findings, email_findings, absent_rule, when_unless_rules, suppression, finding_summary, fail_gate, disabled_rules, shannon_by_source, host_inventory, page_hosts, escape_reasons)}

ALL_RULES = f"""
WITH l AS ({LINES}), m AS (
  SELECT doc_id, source, lang, line::INT AS line, 'pci/pan' AS rule_id, 'error' AS severity, unnest(regexp_extract_all(body, '{PAN_RE2}')) AS v FROM l
  UNION ALL SELECT doc_id, source, lang, line::INT, 'net/ip', 'warning', unnest(regexp_extract_all(body, '{IP_RE2}')) FROM l
  UNION ALL SELECT doc_id, source, lang, line::INT, 'pii/email', 'info', unnest(regexp_extract_all(body, '{EMAIL_RE2}')) FROM l
  UNION ALL SELECT doc_id, source, lang, line::INT, 'secret/token', 'error', unnest(regexp_extract_all(body, '{TOKEN_RE2}')) FROM l),
h AS (SELECT * FROM m WHERE CASE rule_id WHEN 'pci/pan' THEN {LUHN} WHEN 'net/ip' THEN {PUBLIC} ELSE true END)
"""
FILE_LIKE = ", ".join(f"'{x}'" for x in hosts.FILE_ENDINGS)
PACK_SQL = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, doc_id, line, regexp_extract_all(body, '{p}') AS m FROM l" for k, p in DOCUMENT_PACK.items())
ORACLES = {
    "pack_findings": f"WITH l AS ({LINES}), x AS ({PACK_SQL}) SELECT rule_id, doc_id, sum(len(m))::BIGINT AS n, min(line)::INT AS first_line, arg_min(m[1], line) AS first_match FROM x WHERE len(m) > 0 GROUP BY ALL",
    "pan_findings": lines_sql(PAN_RE2, LUHN) + " SELECT source, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs, min((doc_id, line))[1] AS first_doc, min((doc_id, line))[2] AS first_line FROM h GROUP BY source",
    "ip_findings": lines_sql(IP_RE2, PUBLIC) + PER_LINE,
    "email_findings": lines_sql(EMAIL_RE2) + PER_LINE,
    "absent_rule": "SELECT doc_id, 'doc/license' AS rule_id, 0 AS line, 0 AS col FROM documents WHERE NOT regexp_matches(text, '[Ll]icensed? under|MIT License') AND NOT contains(text, '|')",
    "when_unless_rules": "SELECT doc_id, len(v) AS n, list_min(v) AS first_value FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z]{4,}!!') AS v FROM documents WHERE contains(text, '!!') AND NOT contains(text, '$$$')) WHERE len(v) > 0",
    "suppression": ALL_RULES + """SELECT rule_id, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM h WHERE NOT CASE
      WHEN doc_id % 7 = 0 THEN rule_id IN ('pii/email', 'net/ip') WHEN doc_id % 5 = 0 THEN true
      WHEN doc_id % 3 = 0 THEN rule_id IN ('pci/pan', 'secret/token') AND line > 0 ELSE false END GROUP BY rule_id""",
    "finding_summary": ALL_RULES + "SELECT lang, rule_id, severity, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY ALL",
    "fail_gate": ALL_RULES + "SELECT source, count(*) FILTER (severity IN ('error', 'warning')) AS n_grave, bool_or(severity IN ('error', 'warning')) AS failed FROM h GROUP BY source",
    "disabled_rules": ALL_RULES + "SELECT rule_id, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM h WHERE rule_id NOT IN ('net/ip', 'pci/pan') GROUP BY ALL",
    "shannon_by_source": "WITH c AS (SELECT source, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT source, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM n) SELECT source, round(sum(-(n / total) * log2(n / total)), 9) AS bits, count(*) AS n_chars FROM t GROUP BY source",
    "page_hosts": "SELECT lower(regexp_extract(url, '^[a-z]+://([A-Za-z0-9.-]+)', 1)) AS host, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1",
    "host_inventory": rf"""WITH t AS (SELECT page_id, string_split(url || chr(10) || html, chr(10)) AS b FROM pages), l AS (SELECT page_id, unnest(b) AS body, unnest(range(len(b))) AS line FROM t),
      m AS (SELECT page_id, line::INT AS line, unnest(regexp_extract_all(body, 'https?://([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1)) AS h FROM l),
      k AS (SELECT page_id, lower(h) AS host, line FROM m WHERE NOT regexp_matches(h, '^[0-9.]+$') AND list_last(string_split(lower(h), '.')) NOT IN ({FILE_LIKE}))
      SELECT page_id, host, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'first-party' WHEN {" OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in hosts.PLATFORM)} THEN 'platform' ELSE 'third-party' END AS kind, count(*) AS n, min(line) AS first_line FROM k GROUP BY page_id, host""",
    "escape_reasons": r"""WITH t AS (SELECT 'documents' AS origin, CASE doc_id % 3 WHEN 0 THEN '"' || regexp_replace(lower(hex(encode(text))), '(....)', '\\u\1', 'g') || '"' WHEN 1 THEN regexp_replace(text, ' ([a-f]{1,2})', ' _0xab12\1', 'g') ELSE text END AS text FROM documents UNION ALL SELECT 'pages', html FROM pages)
      SELECT origin, CASE WHEN regexp_matches(text, '[''"`](?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}){40,}') THEN 'run of escapes'
      WHEN len(regexp_extract_all(text, '"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}){4,}"')) >= 150 THEN 'literals of escapes' WHEN regexp_matches(text, '[\[\]()!+]{500,}') THEN 'code of brackets'
      WHEN len(regexp_extract_all(text, '_0x[0-9a-f]{4,6}')) >= 20 AND len(list_distinct(regexp_extract_all(text, '_0x[0-9a-f]{4,6}'))) >= 5 THEN 'names' ELSE 'none' END AS reason, count(*) AS n FROM t GROUP BY ALL""",
}
