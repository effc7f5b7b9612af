"""Queries of signals, lists and detection over orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import changes, detect, lives, names, score
from riskframe.operators.detect import DetectionRule
from riskframe.streaming.detect import rate_stream

HOUR = 3_600_000
# Weights of event types as signals, and the category of each.
VECTORS = (("click", 1.0, "network"), ("view", 0.5, "process"), ("error", 3.0, "data"), ("signup", 2.0, "data"), ("purchase", -1.0, "manifest"))
RULES = (("errors after signup", 2.0, (("error",), ("signup",))), ("clicks or views", 1.0, (("click", "view"), ("purchase",))))


def events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def process_events(spark, d) -> DataFrame:
    """Events as process events: the user is the process, the kind the type, t in ms."""
    e = events(spark, d)
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.lit("all").alias("scenario"), F.col("event_id").alias("idx"), t.alias("t"), F.col("event_type").alias("type"), F.col("user_id").alias("process"), "value")


def vectors(spark) -> DataFrame:
    return spark.createDataFrame(list(VECTORS), "signal_id string, weight double, category string")


def signals(spark, d) -> DataFrame:
    """One raw signal for each user, kind and day; the largest values weigh more."""
    e = events(spark, d).groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("count"), F.max("value").alias("top"), F.min("event_id").alias("ord"))
    weight = F.col("weight") + F.when(F.col("top") > 150, 1.0).otherwise(0.0)
    force = F.when(F.col("top") > 250, "high").when(F.col("top") > 200, "medium")
    rows = e.join(F.broadcast(vectors(spark)), e["event_type"] == F.col("signal_id"))
    return rows.select(F.col("user_id").alias("pkg_id"), "signal_id", weight.alias("weight"), F.concat_ws(" ", "signal_id", F.col("day").cast("string")).alias("message"), "count", force.alias("force"), "ord")


VECTOR_SQL = "v(signal_id, weight, category) AS (VALUES " + ", ".join(f"('{a}', {w}::DOUBLE, '{c}')" for a, w, c in VECTORS) + ")"
SIGNALS_SQL = f"""WITH {VECTOR_SQL}, e AS (SELECT user_id, event_type, ts::DATE AS day, count(*) AS count, max(value) AS top, min(event_id) AS ord FROM events GROUP BY ALL),
s AS (SELECT user_id AS pkg_id, signal_id, weight + CASE WHEN top > 150 THEN 1.0 ELSE 0.0 END AS weight, signal_id || ' ' || day AS message, count,
      CASE WHEN top > 250 THEN 'high' WHEN top > 200 THEN 'medium' END AS force, ord FROM e JOIN v ON event_type = signal_id),
m AS (SELECT pkg_id, signal_id, sum(count)::BIGINT AS count, max_by(weight, (weight, -ord)) AS weight, max_by(message, (weight, -ord)) AS message,
      CASE max(CASE force WHEN 'high' THEN 2 WHEN 'medium' THEN 1 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' END AS force FROM s GROUP BY ALL),
i AS (SELECT m.pkg_id, category, m.weight, row_number() OVER (PARTITION BY m.pkg_id, category ORDER BY m.weight DESC, signal_id) - 1 AS i FROM m JOIN v USING (signal_id)),
c AS (SELECT pkg_id, category, floor(sum(CASE WHEN weight > 0 AND category IN ('process', 'data', 'network') THEN weight / power(2, i) ELSE weight END) * 10 + 0.5) / 10 AS score FROM i GROUP BY ALL),
ids AS (SELECT pkg_id, list(signal_id) AS ids, max(CASE force WHEN 'high' THEN 2 WHEN 'medium' THEN 1 END) AS force FROM m GROUP BY ALL),
b AS (SELECT pkg_id, 'errors after signup' AS label, 2.0::DOUBLE AS weight, ['error', 'signup'] AS because FROM ids WHERE list_contains(ids, 'error') AND list_contains(ids, 'signup')
  UNION ALL SELECT pkg_id, 'clicks or views', 1.0::DOUBLE, [CASE WHEN list_contains(ids, 'click') THEN 'click' ELSE 'view' END, 'purchase'] FROM ids WHERE list_has_any(ids, ['click', 'view']) AND list_contains(ids, 'purchase')),
t AS (SELECT ids.pkg_id, coalesce(ids.force, -1) AS force, x.boost, floor((coalesce(y.base, 0) + coalesce(x.boost, 0)) * 10 + 0.5) / 10 AS raw, ids.pkg_id % 11 = 0 AS ok FROM ids
  LEFT JOIN (SELECT pkg_id, sum(weight) AS boost FROM b GROUP BY 1) x USING (pkg_id) LEFT JOIN (SELECT pkg_id, sum(score) AS base FROM c GROUP BY 1) y USING (pkg_id)),
u AS (SELECT *, greatest(0.0::DOUBLE, raw) AS total, CASE WHEN raw >= 9 THEN 2 WHEN raw >= 5 THEN 1 ELSE 0 END AS own FROM t),
w AS (SELECT *, own = 2 AND boost IS NULL AND force < 0 AS cap, ok AND force < 0 AS quiet FROM u),
r AS (SELECT pkg_id, CASE WHEN quiet THEN 0 ELSE total END AS score, (['low', 'medium', 'high'])[CASE WHEN quiet THEN 0 ELSE greatest(CASE WHEN cap THEN 1 ELSE own END, force) END + 1] AS level,
      cap AND NOT quiet AS capped, ok AS allowlisted, ok AND force >= 0 AS allowlist_overridden FROM w)
"""


def merged(spark, d) -> DataFrame:
    return score.merge(signals(spark, d))


def signal_rollup(spark, d):
    """Events as findings: the kind is the rule, the day the file, the hour the line."""
    e = events(spark, d)
    found = e.select(F.col("user_id").alias("pkg_id"), F.concat(F.lit("ev/"), "event_type", F.lit(".x")).alias("rule_id"), F.col("event_type").alias("message"), F.to_date("ts").cast("string").alias("file"), F.hour("ts").alias("line"))
    v = vectors(spark).withColumn("signal_id", F.concat(F.lit("ev/"), "signal_id"))
    rolled = score.roll_up(found, v)
    return rolled.select("pkg_id", "signal_id", "weight", "count", "n_files", "message", F.size("locations").alias("n_kept"), F.get("locations", F.lit(0))["file"].alias("first_file"))


def merge_signals(spark, d):
    return merged(spark, d)


def category_scores(spark, d):
    return score.category_scores(merged(spark, d), vectors(spark))


def boosts(spark, d):
    return score.boosts(merged(spark, d), rules=RULES)


def risk(spark, d) -> DataFrame:
    allowed = events(spark, d).select(F.col("user_id").alias("pkg_id")).where(F.col("pkg_id") % 11 == 0)
    return score.score(merged(spark, d), vectors(spark), allowed=allowed, rules=RULES)


def risk_ranking(spark, d):
    return score.ranking(risk(spark, d))


def signal_prevalence(spark, d):
    return score.prevalence(merged(spark, d), risk(spark, d))


def score_summary(spark, d):
    return score.score_summary(risk(spark, d))


def level_inventory(spark, d):
    return score.inventory(risk(spark, d).withColumn("parity", F.col("pkg_id") % 2), "parity")


def population_outliers(spark, d):
    """Customers whose orders of a priority sum to far more than others'."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    scores = o.groupBy(F.col("o_custkey").alias("pkg_id"), F.col("o_orderpriority").alias("category")).agg(F.round(F.sum("o_totalprice") / 1e4, 2).alias("score"))
    everyone = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("pkg_id"))
    return score.outliers(scores, everyone)


def external_signals(spark, d):
    """Events as signals of another engine; the confidence falls with the value."""
    e = events(spark, d).where("value > 100")
    rows = e.select(F.col("user_id").alias("pkg_id"), F.col("event_type").alias("signal_id"), F.round(100 / F.col("value"), 3).alias("confidence"))
    v = vectors(spark).withColumn("engines", F.when(F.col("category") == "data", F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))))
    own, rejected = score.external(rows, v, engine="b")
    return own.groupBy("signal_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")).unionByName(rejected.groupBy("signal_id").agg(F.count("*").alias("n"), F.lit(0.0).alias("weight")))


def allowlist(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("id"), (F.col("s_nationkey") % 3).cast("string").alias("version"), "s_suppkey")
    entries = s.where("s_suppkey % 3 = 0").select(F.upper("id").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "1").alias("version"))
    return score.is_allowlisted(s.select("id", "version"), entries, pkg="id")


def known_bad(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("Malware", "Impersonation", "Spam"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    bad = c.where(F.col("c_nationkey") == 3).select(F.upper("c_name").alias("id"), kind.alias("type"))
    return names.known_bad_signals(c.select(F.col("c_name").alias("pkg_id")), bad)


def trusted_publisher(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("pkg_id"), F.lower("c_mktsegment").alias("publisher"), F.when(F.col("c_custkey") % 4 == 0, "vsix").otherwise("gallery").alias("source"))
    return names.publisher_signals(c, ["automobile", "building"])


def typosquat(spark, d):
    """Words of part names against the list of the most common ones."""
    p = spark.read.parquet(f"{d}/part.parquet")
    words = p.select(F.explode(F.split("p_name", " ")).alias("w")).where(F.length("w") >= 3).groupBy("w").agg(F.count("*").alias("n"))
    ids = words.select(F.concat(F.lit("x."), F.regexp_replace("w", "(.)(.)$", "$2$1")).alias("id"))
    popular = words.select(F.xxhash64("w").alias("h"), F.concat(F.lit("y."), "w").alias("id"), "w", "n").withColumn("ord", F.rank().over(names.order_by_name()))
    return names.typosquats(ids, popular.select("ord", "id"))


def list_diff(spark, d):
    """Clerks' customers in the first and the second half of the orders; the version is the last priority."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("late", F.col("o_orderkey") % 8 >= 4)
    e = o.groupBy("late", "o_custkey").agg(F.max("o_orderpriority").alias("version"), F.min("o_orderkey").alias("line"), F.min("o_orderstatus").alias("status"))
    e = e.select("late", F.concat(F.lit("C."), "o_custkey").alias("id"), F.when(F.col("status") != "P", F.col("version")).alias("version"), F.lit("orders").alias("file"), "line", (F.col("line") % 13 == 0).alias("remove"))
    return changes.diff_lists(e.where("not late"), e.where("late"))


def bench_judge(spark, d):
    """Customers' orders by year as benchmark runs."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("odd", F.col("o_orderkey") % 2 == 1)
    runs = o.groupBy("odd", F.col("o_custkey").alias("name")).agg(F.round(F.avg("o_totalprice"), 3).alias("median_ns"), F.count("*").alias("memory"))
    judged = changes.by_verdict(changes.judge(runs.where("not odd"), runs.where("odd")))
    return judged.withColumn("ratio", F.round("ratio", 6))


def content_diff(spark, d):
    """Documents of even ids as published files, the next odd ones as installed; the hash is of the whole text."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    files = docs.select("source", F.concat_ws("/", "lang", F.floor(F.col("doc_id") / 2)).alias("rel"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 2 == 0).alias("even"))
    side = lambda test: files.where(test).select(F.col("source").alias("pkg_id"), "rel", "sha256")
    return changes.diff_files(side("even"), side("not even"))


def guard_verdict(spark, d):
    """Parts with a brand policy."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.lit("."), "p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("verified"), "p_size", "p_retailprice")
    state = F.when(F.col("p_size") % 3 == 0, "added").when(F.col("p_size") % 3 == 1, "changed").otherwise("unchanged")
    level = F.when(F.col("p_retailprice") > 1700, "high").when(F.col("p_retailprice") > 1200, "medium").otherwise("low")
    broken = changes.violations(p, blocked=("Brand#11.*", "Brand#22.5"), verified=True, verified_col="verified")
    return changes.guard(p.select("id", state.alias("status")), p.where("p_size <> 7").select("id", level.alias("level")), broken)


ERRORS = DetectionRule("errors", "threshold", match={"type": "^error$"}, count=3, within=24 * HOUR)
SEQUENCE = DetectionRule("buy-fail", "sequence", steps=({"type": "^signup$"}, {"type": "^purchase$"}, {"type": "^error$"}), within=48 * HOUR)


def threshold_detect(spark, d):
    found = detect.threshold_firings(process_events(spark, d), ERRORS)
    return found.select(F.col("grp").cast("long").alias("process"), "t", "idx", "total")


def threshold_windows(spark, d):
    found = detect.detect_threshold(process_events(spark, d), ERRORS)
    return found.select(F.get("processes", F.lit(0)).alias("process"), "t", F.size("events").alias("n"), F.array_min("events").alias("first_event"))


def sequence_detect(spark, d):
    """Signup, purchase and error of one user within two days."""
    e = process_events(spark, d)
    found = detect.detect_sequence(e, SEQUENCE, key=("process",))
    return found.select(F.get("processes", F.lit(0)).alias("process"), F.get("events", F.lit(0)).alias("first_event"), F.get("events", F.lit(2)).alias("last_event"), "t")


def sequence_unbounded(spark, d):
    """Purchase, error and signup of one user, however far apart."""
    rule = DetectionRule("ever", "sequence", steps=({"type": "^purchase$", "process": "$U"}, {"type": "^error$", "process": "$U"}, {"type": "^signup$", "process": "$U"}))
    found = detect.detect_sequence(process_events(spark, d), rule)
    return found.select(F.get("processes", F.lit(0)).alias("process"), *(F.get("events", F.lit(k)).alias(f"event{k}") for k in range(3)), "t")


def tree_events(spark, d) -> DataFrame:
    """Events as those of a process tree: a signup is a spawn by the process that its properties name, a click a change of image, a purchase ends that process."""
    e = events(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("signup", "spawn", "click", "exec", "purchase", "terminate"))), F.col("event_type")), "event_type")
    image = F.when(kind == "spawn", F.concat(F.lit("v"), F.floor("value").cast("string"))).when(kind == "exec", F.concat(F.lit("c"), k.cast("string")))
    none = F.lit(None).cast("string")
    return e.select(F.lit("all").alias("scenario"), F.col("event_id").alias("idx"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), kind.alias("type"), F.col("user_id").cast("long").alias("process"), F.when(kind == "spawn", k).alias("parent"), F.when(kind == "terminate", k).alias("target"), image.alias("image"), none.alias("cmdline"), F.when(kind == "spawn", "u").alias("user"))


SCOPES = (
    DetectionRule("below-changed", "match", match={"type": "^(view|error)$", "ancestor.image": "^c[1-3]"}),
    DetectionRule("ends-changed", "match", match={"type": "^terminate$", "target.image": "^c", "parent.image": ["^v1", "^c[45]"]}),
)


def scope_detect(spark, d):
    """Conditions on parents, targets and ancestors as of each event."""
    e = tree_events(spark, d)
    none = e.select("scenario", "process", "image", "cmdline", "user", "parent").where("false")
    rules = list(SCOPES)
    found = detect.detect(lives.scoped(e, none, rules), rules, column=lives.scope_column(rules))
    return found.select("rule_id", F.get("events", F.lit(0)).alias("idx"), F.get("processes", F.lit(0)).alias("process"))


def match_detect(spark, d):
    rule = DetectionRule("large", "match", match={"type": ["^purchase$", "(?i)^ERROR$"]})
    found = detect.detect_match(process_events(spark, d).where("value > 100"), rule)
    return found.select("rule_id", "t", F.get("events", F.lit(0)).alias("idx"), F.get("processes", F.lit(0)).alias("process"))


def asof_state(spark, d):
    """The state of each user as of each error: a signup starts anew, a click changes the command."""
    e = process_events(spark, d)
    kind = F.when(F.col("type") == "signup", "spawn").when(F.col("type") == "click", "exec").otherwise(F.col("type"))
    e = e.select("scenario", "process", "t", "idx", kind.alias("type"), F.col("type").alias("image"), F.col("value").cast("string").alias("cmdline"), F.lit("u").alias("user"), F.lit(None).cast("long").alias("parent"))
    empty = e.select("scenario", "process", "image", "cmdline", "user", "parent").where("false")
    return detect.enrich(e, empty).where("type = 'error'").select("idx", "process", "p_image", "p_cmdline")


def ancestor_chain(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.lit("all").alias("scenario"), F.col("p_partkey").alias("process"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return detect.ancestors(p).select("process", "ancestor", "depth")


def clipboard_rate(spark, d):
    e = events(spark, d).where("event_type = 'click'").select(F.col("user_id").alias("process"), F.col("ts").cast("timestamp").alias("ts"))
    found = rate_stream(e, width="1 hour").where("n > 1")
    return found.select(F.col("process").alias("user_id"), F.unix_seconds("start").alias("hour"), "n")


QUERIES = {f.__name__: f for f in (signal_rollup, merge_signals, category_scores, boosts, risk_ranking, signal_prevalence, score_summary, level_inventory, population_outliers, external_signals, allowlist, known_bad, trusted_publisher, typosquat, list_diff, bench_judge, content_diff, guard_verdict, threshold_detect, threshold_windows, sequence_detect, sequence_unbounded, scope_detect, match_detect, asof_state, ancestor_chain, clipboard_rate)}

FOLD = "regexp_replace(translate(replace(replace(lower({0}), 'rn', 'm'), 'vv', 'w'), '01i|5_ ', 'ollls--'), '-+', '-', 'g')"
PE = "WITH pe AS (SELECT event_id AS idx, epoch_us(ts) // 1000 AS t, event_type AS type, user_id AS process, value FROM events)"
FIRED = PE + """, x AS (SELECT a.process, a.t, a.idx, (SELECT count(*) FROM pe b WHERE b.type = 'error' AND b.process = a.process AND b.t >= a.t - 86400000 AND (b.t, b.idx) <= (a.t, a.idx)) AS total FROM pe a WHERE a.type = 'error'),
f AS (SELECT process, min((t, idx, total)) AS f FROM x WHERE total >= 3 GROUP BY 1)"""
ORACLES = {
    "signal_rollup": f"""WITH {VECTOR_SQL}, f AS (SELECT user_id AS pkg_id, event_type, ts::DATE::VARCHAR AS file FROM events)
      SELECT pkg_id, 'ev/' || event_type AS signal_id, any_value(weight) AS weight, count(*) AS count, count(DISTINCT file) AS n_files,
      CASE WHEN count(*) > 1 THEN event_type || ' (' || count(*) || ' hits in ' || count(DISTINCT file) || ' files)' ELSE event_type END AS message, least(count(*), 20)::INT AS n_kept, min(file) AS first_file
      FROM f JOIN v ON signal_id = event_type GROUP BY pkg_id, event_type""",
    "merge_signals": SIGNALS_SQL + "SELECT pkg_id, signal_id, weight, message, count, force FROM m",
    "category_scores": SIGNALS_SQL + "SELECT * FROM c",
    "boosts": SIGNALS_SQL + "SELECT * FROM b",
    "risk_ranking": SIGNALS_SQL + "SELECT * FROM r",
    "signal_prevalence": SIGNALS_SQL + "SELECT signal_id, count(DISTINCT pkg_id) AS n, round(100 * count(DISTINCT pkg_id) / (SELECT count(*) FROM r), 6) AS percent FROM m GROUP BY 1",
    "score_summary": SIGNALS_SQL + "SELECT count(*) AS n, min(score) AS least, list_sort(list(score))[count(*) // 2 + 1] AS median, max(score) AS most FROM r",
    "level_inventory": SIGNALS_SQL + "SELECT pkg_id % 2 AS parity, count(*) AS n, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low FROM r GROUP BY 1",
    "population_outliers": """WITH s AS (SELECT o_custkey AS pkg_id, o_orderpriority AS category, round(sum(o_totalprice) / 1e4, 2) AS score FROM orders GROUP BY ALL),
      g AS (SELECT c_custkey AS pkg_id, k.category, coalesce(s.score, 0) AS score FROM customer CROSS JOIN (SELECT DISTINCT category FROM s) k LEFT JOIN s ON s.pkg_id = c_custkey AND s.category = k.category),
      m AS (SELECT category, median(score) AS med, count(*) AS n FROM g GROUP BY 1), a AS (SELECT g.category, median(abs(score - med)) AS mad, avg(abs(score - med)) AS ad FROM g JOIN m USING (category) GROUP BY 1),
      z AS (SELECT pkg_id, g.category, score, n, CASE WHEN mad > 0 THEN 0.6745 * (score - med) / mad WHEN ad > 0 THEN (score - med) / (1.253314 * ad) ELSE 0 END AS z FROM g JOIN m USING (category) JOIN a USING (category))
      SELECT pkg_id, category, score, round(z, 6) AS z FROM z WHERE n >= 5 AND score >= 3 AND z >= 3.5""",
    "external_signals": f"""WITH {VECTOR_SQL}, e AS (SELECT event_type AS signal_id, round(100 / value, 3) AS confidence FROM events WHERE value > 100)
      SELECT signal_id, count(*) AS n, round(sum(CASE WHEN category = 'data' THEN 0 WHEN confidence < 0.5 THEN weight / 2 ELSE weight END), 6) AS weight FROM e JOIN v USING (signal_id) GROUP BY signal_id""",
    "list_diff": """WITH e AS (SELECT o_orderkey % 8 >= 4 AS late, o_custkey, max(o_orderpriority) AS version, min(o_orderkey) AS line, min(o_orderstatus) AS status FROM orders GROUP BY ALL),
      x AS (SELECT late, 'C.' || o_custkey AS id, CASE WHEN status <> 'P' THEN version END AS version, line FROM e WHERE line % 13 <> 0), b AS (SELECT * FROM x WHERE NOT late), h AS (SELECT * FROM x WHERE late)
      SELECT coalesce(h.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN h.version IS NOT DISTINCT FROM b.version THEN 'unchanged' ELSE 'changed' END AS status,
      h.version AS version, b.version AS base_version, 'orders' AS file, coalesce(h.line, b.line) AS line FROM h FULL JOIN b ON h.id = b.id""",
    "bench_judge": """WITH r AS (SELECT o_orderkey % 2 = 1 AS odd, o_custkey AS name, round(avg(o_totalprice), 3) AS ns, count(*) AS mem FROM orders GROUP BY ALL), b AS (SELECT * FROM r WHERE NOT odd), c AS (SELECT * FROM r WHERE odd),
      j AS (SELECT coalesce(c.name, b.name) AS name, b.name AS bn, c.name AS cn, c.ns / b.ns AS ratio, c.mem / b.mem AS mr FROM c FULL JOIN b ON c.name = b.name)
      SELECT name, CASE WHEN bn IS NULL THEN 'added' WHEN cn IS NULL THEN 'removed' WHEN ratio > 1 + 0.05 THEN 'regression' WHEN ratio < 1 - 0.05 THEN 'improvement' ELSE 'invariant' END AS verdict,
      CASE WHEN bn IS NULL THEN 'added' WHEN cn IS NULL THEN 'removed' WHEN mr > 1 + 0.01 THEN 'regression' WHEN mr < 1 - 0.01 THEN 'improvement' ELSE 'invariant' END AS memory_verdict, round(ratio, 6) AS ratio FROM j""",
    "content_diff": """WITH f AS (SELECT source, lang || '/' || (doc_id // 2) AS rel, sha256(text) AS h, doc_id % 2 AS odd FROM documents), a AS (SELECT * FROM f WHERE odd = 0), b AS (SELECT * FROM f WHERE odd = 1)
      SELECT coalesce(a.source, b.source) AS pkg_id, coalesce(a.rel, b.rel) AS rel, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'missing' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.rel = b.rel AND a.source = b.source WHERE a.h IS DISTINCT FROM b.h""",
    "guard_verdict": """WITH p AS (SELECT p_brand || '.' || p_partkey AS id, p_brand, p_size, p_retailprice, CASE p_size % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'changed' ELSE 'unchanged' END AS status,
      (p_brand = 'Brand#11' OR p_brand || '.' || p_partkey = 'Brand#22.5')::INT + (p_size % 2 <> 0)::INT AS n, CASE WHEN p_size = 7 THEN NULL WHEN p_retailprice > 1700 THEN 'high' WHEN p_retailprice > 1200 THEN 'medium' ELSE 'low' END AS level FROM part)
      SELECT id, status, level, n::BIGINT AS n_violations, CASE WHEN n > 0 THEN 'fail' WHEN level IS NULL THEN 'error' WHEN level = 'high' THEN 'fail' ELSE 'pass' END AS verdict FROM p WHERE status <> 'unchanged'""",
    "threshold_detect": FIRED + " SELECT process, f[1] AS t, f[2] AS idx, f[3] AS total FROM f",
    "threshold_windows": FIRED + """ SELECT f.process, f.f[1] AS t, count(*)::INT AS n, min(pe.idx) AS first_event FROM f JOIN pe ON pe.process = f.process AND pe.type = 'error' AND pe.t >= f.f[1] - 86400000 AND (pe.t, pe.idx) <= (f.f[1], f.f[2]) GROUP BY ALL""",
    "sequence_detect": PE + """, j AS (SELECT a.process, a.idx AS first_event, min((c.t, c.idx)) AS c FROM pe a JOIN pe b ON b.process = a.process AND b.type = 'purchase' AND (b.t, b.idx) > (a.t, a.idx) AND b.t <= a.t + 172800000
      JOIN pe c ON c.process = a.process AND c.type = 'error' AND (c.t, c.idx) > (b.t, b.idx) AND c.t <= a.t + 172800000 WHERE a.type = 'signup' GROUP BY ALL) SELECT process, first_event, c[2] AS last_event, c[1] AS t FROM j""",
    "sequence_unbounded": PE + """, n AS (SELECT process, type, idx, t, row_number() OVER (PARTITION BY process ORDER BY t, idx) AS o FROM pe),
      a AS (SELECT *, min(o) FILTER (type = 'signup') OVER w AS next_signup FROM n WINDOW w AS (PARTITION BY process ORDER BY o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      b AS (SELECT *, min(o) FILTER (type = 'error' AND next_signup IS NOT NULL) OVER w AS next_error FROM a WINDOW w AS (PARTITION BY process ORDER BY o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT b.process, b.idx AS event0, e.idx AS event1, s.idx AS event2, s.t FROM b JOIN b e ON e.process = b.process AND e.o = b.next_error JOIN b s ON s.process = b.process AND s.o = e.next_signup WHERE b.type = 'purchase'""",
    "scope_detect": """WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS o, event_id AS idx, user_id AS process, (props->>'k')::BIGINT AS k, event_type AS type, value FROM events),
      f AS (SELECT process, min(o) AS o FROM e GROUP BY process),
      c AS (SELECT e.o, e.process, e.k, e.type, e.type = 'signup' OR f.o IS NOT NULL AS begins, CASE e.type WHEN 'signup' THEN 'v' || floor(value)::BIGINT WHEN 'click' THEN 'c' || k ELSE '?' END AS image
        FROM e LEFT JOIN f ON f.process = e.process AND f.o = e.o WHERE e.type IN ('signup', 'click') OR f.o IS NOT NULL),
      v AS (SELECT *, max(o) FILTER (begins) OVER (PARTITION BY process ORDER BY o) AS life FROM c),
      spans AS (SELECT life, image, o AS since, coalesce(lead(o) OVER (PARTITION BY life ORDER BY o), 1e18::BIGINT) AS until FROM v),
      born AS (SELECT life, process, CASE WHEN type = 'signup' THEN k END AS parent FROM v WHERE o = life),
      up AS (SELECT b.life, p.life AS up FROM born b JOIN LATERAL (SELECT max(life) AS life FROM born x WHERE x.process = b.parent AND x.life < b.life) p ON true WHERE p.life IS NOT NULL),
      above AS (SELECT life, up FROM up UNION ALL SELECT a.life, u.up FROM above a JOIN up u ON u.life = a.up),
      own AS (SELECT e.*, v.life, b.parent FROM e ASOF JOIN v ON v.process = e.process AND e.o >= v.o JOIN born b ON b.life = v.life)
      SELECT DISTINCT 'below-changed' AS rule_id, own.idx, own.process FROM own JOIN above a ON a.life = own.life JOIN spans s ON s.life = a.up AND own.o >= s.since AND own.o < s.until WHERE own.type IN ('view', 'error') AND regexp_matches(s.image, '^c[1-3]')
      UNION ALL SELECT 'ends-changed', x.idx, x.process FROM (SELECT own.*, p.image AS parent_image FROM own ASOF JOIN v p ON p.process = own.parent AND own.o >= p.o WHERE own.type = 'purchase') x ASOF JOIN v t ON t.process = x.k AND x.o >= t.o
      WHERE regexp_matches(t.image, '^c') AND regexp_matches(x.parent_image, '^v1|^c[45]')""",
    "match_detect": PE + " SELECT 'large' AS rule_id, t, idx, process FROM pe WHERE type IN ('purchase', 'error') AND value > 100",
    "asof_state": PE + """, s AS (SELECT e.idx, e.process, max((t0.t, t0.idx)) AS s FROM pe e LEFT JOIN pe t0 ON t0.process = e.process AND t0.type = 'signup' AND (t0.t, t0.idx) < (e.t, e.idx) WHERE e.type = 'error' GROUP BY ALL),
      x AS (SELECT s.idx, s.process, s.s, max((c.t, c.idx)) AS c FROM s JOIN pe e ON e.idx = s.idx LEFT JOIN pe c ON c.process = s.process AND c.type = 'click' AND (c.t, c.idx) < (e.t, e.idx) AND (s.s[2] IS NULL OR (c.t, c.idx) > s.s) GROUP BY ALL)
      SELECT x.idx, x.process, CASE WHEN x.c[2] IS NOT NULL THEN 'click' WHEN x.s[2] IS NOT NULL THEN 'signup' ELSE '?' END AS p_image, p.value::VARCHAR AS p_cmdline FROM x LEFT JOIN pe p ON p.idx = coalesce(x.c[2], x.s[2])""",
    "ancestor_chain": "WITH RECURSIVE a AS (SELECT p_partkey AS process, p_partkey // 2 AS ancestor, 1 AS depth FROM part WHERE p_partkey > 1 UNION ALL SELECT process, ancestor // 2, depth + 1 FROM a WHERE ancestor > 1) SELECT process, ancestor, depth FROM a",
    "clipboard_rate": "SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) > 1",
    "allowlist": "WITH e AS (SELECT s_name AS id, CASE WHEN s_suppkey % 2 = 0 THEN '1' END AS v FROM supplier WHERE s_suppkey % 3 = 0) SELECT s_name AS id, (s_nationkey % 3)::VARCHAR AS version FROM supplier WHERE EXISTS (FROM e WHERE e.id = s_name AND (v IS NULL OR v = (s_nationkey % 3)::VARCHAR))",
    "typosquat": f"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) >= 3 GROUP BY w), p AS (SELECT lower('y.' || w) AS target, rank() OVER (ORDER BY n DESC, w) AS ord FROM w),
      i AS (SELECT DISTINCT lower('x.' || regexp_replace(w, '(.)(.)$', '\\2\\1')) AS id FROM w), j AS (SELECT id, target, ord, {FOLD.format("id")} = {FOLD.format("target")} AS alike, damerau_levenshtein(id, target) AS dist, CASE WHEN length(target) < 10 THEN 1 ELSE 2 END AS most FROM i CROSS JOIN p),
      k AS (SELECT id, target, CASE WHEN alike THEN 'homoglyph' ELSE 'distance' END AS reason, CASE WHEN alike THEN 0 ELSE dist END::INT AS distance, row_number() OVER (PARTITION BY id ORDER BY alike DESC, CASE WHEN alike THEN 0 ELSE dist END, ord) AS r FROM j WHERE alike OR dist <= most) SELECT id, target, reason, distance FROM k WHERE r = 1""",
    "known_bad": "SELECT c_name AS pkg_id, 'known-bad' AS signal_id, CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 0 END AS weight, CASE c_custkey % 3 WHEN 0 THEN 'high' END AS force FROM customer WHERE c_nationkey = 3",
    "trusted_publisher": "SELECT c_name AS pkg_id, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'trusted-publisher' ELSE 'unknown-publisher' END AS signal_id, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN -2 ELSE 0 END AS weight FROM customer WHERE NOT (c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AND c_custkey % 4 = 0)",
}
