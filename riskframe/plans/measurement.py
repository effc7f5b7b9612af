"""Queries of entropy, PUF, profile, supply-chain and content operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import content, entropy, profiles, puf, runtime, supply


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def symbols(spark, d) -> DataFrame:
    """Quantities modulo 16 as symbols, a source for each return flag."""
    return t(spark, d, "lineitem").select(F.col("l_returnflag").alias("source_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("int(l_quantity) % 16").alias("sym"))


def samples(spark, d) -> DataFrame:
    """symbols in key order. Places are numbered by ranges of orders, so that a source of any size is in many tasks."""
    from pyspark.sql import Window

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sym"]
    li = symbols(spark, d).withColumn("part", F.floor(F.col("l_orderkey") / 20_000))
    before = Window.partitionBy("source_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = li.groupBy("source_id", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select("source_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("source_id", "part").orderBy(*keys))
    return li.withColumn("k", place).join(sizes, ["source_id", "part"]).select("source_id", (F.col("first") + F.col("k") - 1).cast("long").alias("i"), "sym")


SAMPLES = "s AS (SELECT l_returnflag AS source_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT % 16) - 1 AS i, l_quantity::INT % 16 AS sym FROM lineitem)"
UPPER = "least(1.0, {p} + 2.5758293035489008 * sqrt({p} * (1 - {p}) / ({n} - 1)))"


def mcv(spark, d):
    return entropy.mcv(symbols(spark, d)).select("source_id", F.round("h", 9).alias("h"))


def markov(spark, d):
    bits = samples(spark, d).select("source_id", "i", (F.col("sym") % 2).alias("bit"))
    return entropy.markov(bits).select("source_id", F.round("h", 9).alias("h"))


def tuple_stats(spark, d):
    return entropy.tuple_counts(samples(spark, d)).select("source_id", "w", "n", "q", F.col("s").cast("long").alias("s"))


def tuple_estimates(spark, d):
    return entropy.tuples(entropy.tuple_counts(samples(spark, d))).select("source_id", F.round("t_tuple", 9).alias("t_tuple"), F.round("lrs", 9).alias("lrs"))


def sequential_estimates(spark, d):
    """Collision, compression and the four predictors on the low bits of each source."""
    return entropy.sequential(samples(spark, d).withColumn("sym", F.col("sym") % 2))


def restart_rows(spark, d):
    return entropy.restart_counts(samples(spark, d), 100)


def sym_histogram(spark, d):
    return puf.histogram(symbols(spark, d).withColumn("x", F.col("sym") / 15), "x", 10)


def bits(spark, d) -> DataFrame:
    """Signs of embeddings as responses: the label is the device, the place in it the read."""
    from pyspark.sql import Window

    e = t(spark, d, "embeddings")
    read = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return e.select(F.col("label").alias("device"), read.alias("read"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))


BITS = "r AS (SELECT label AS device, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS read, embedding FROM embeddings), b AS (SELECT device, read, unnest(range(len(embedding)))::INT AS pos, unnest(list_transform(embedding, lambda x: (x > 0)::INT)) AS bit FROM r), f AS (SELECT * FROM b WHERE read = 1)"


def puf_uniqueness(spark, d):
    return puf.uniqueness(puf.exploded(bits(spark, d))).select(F.round("uniqueness", 9).alias("uniqueness"))


def puf_reliability(spark, d):
    return puf.reliability(puf.exploded(bits(spark, d))).select("device", "read", F.round("errors", 9).alias("errors"))


def bit_aliasing(spark, d):
    return puf.aliasing(puf.exploded(bits(spark, d))).select("pos", F.round("p", 9).alias("p"), F.round("h_min", 9).alias("h_min"))


def puf_uniformity(spark, d):
    return puf.uniformity(puf.exploded(bits(spark, d))).select("device", "read", F.round("ones", 9).alias("ones"))


def puf_unstable(spark, d):
    return puf.unstable(puf.exploded(bits(spark, d)))


def self_time(spark, d):
    """Order lines as calls: the ship mode of a call is its return flag and status, its self time the quantity."""
    li = t(spark, d, "lineitem")
    nodes = li.select(F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("parent_id"), F.concat("l_returnflag", "l_linestatus").alias("method"), (F.col("l_partkey") % 10).alias("file"), (F.col("l_suppkey") % 7).alias("line"), F.col("l_quantity").alias("self"))
    return profiles.self_time(nodes)


def triggers_by_site(spark, d):
    li = t(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("a.jl:"), F.col("l_suppkey") % 50)).alias("site"), F.when(F.col("l_suppkey") % 3 == 1, F.lit("REPL[1]")).otherwise(F.concat(F.lit("b.jl:"), F.col("l_suppkey") % 9)).alias("caller"), F.concat("l_returnflag", "l_linestatus").alias("callee"), F.col("l_quantity").alias("time"))
    return profiles.triggers_by_site(rows).withColumn("callees", F.array_join("callees", ","))


def tree_totals(spark, d):
    """Parts as a binary tree by key; sizes as self times."""
    nodes = t(spark, d, "part").select(F.lit("p").alias("profile_id"), F.col("p_partkey").alias("node_id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent_id"), F.col("p_size").cast("long").alias("self"))
    return profiles.tree_totals(nodes).select("node_id", "total", "size")


def tag_points(spark, d):
    """Orders with a low priority define tags, lines refer to them."""
    defs = t(spark, d, "orders").where("o_orderpriority like '1%'").select((F.col("o_orderkey") % 5000).alias("id"), F.lit(False).alias("ref"))
    refs = t(spark, d, "lineitem").where("l_quantity > 45").select((F.col("l_orderkey") % 5000).alias("id"), F.lit(True).alias("ref"))
    return profiles.tag_points(defs.unionByName(refs))


def npm(spark, d) -> DataFrame:
    """Lines as dependencies of orders: the part is the name, the size its version."""
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    v = F.concat(F.col("p_size") % 4, F.lit("."), F.col("p_size") % 10, F.lit(".0"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("pkg_id"), F.col("p_name").alias("name"), v.alias("version"), "l_partkey", "l_linenumber")


NPM = "n AS (SELECT l_orderkey AS pkg_id, p_name AS name, (p_size % 4) || '.' || (p_size % 10) || '.0' AS version, l_partkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)"


def advisory_signals(spark, d):
    n = npm(spark, d)
    known = n.where("l_partkey % 50 = 0").select("name", "version", F.concat(F.when(F.col("l_partkey") % 100 == 0, "MAL-").otherwise("CVE-"), "l_partkey").alias("advisory")).distinct()
    return supply.advisory_signals(n.where("l_linenumber < 5"), n.where("l_linenumber >= 5"), known, sep=",")


def protestware(spark, d):
    n = npm(spark, d)
    listed = n.where("l_partkey % 97 = 0").select("name", F.when(F.col("l_partkey") % 2 == 0, "*").otherwise("1.1.0").alias("version")).distinct()
    return supply.protestware(n, listed).distinct()


def pick_versions(spark, d):
    """Orders as versions that customers publish."""
    o = t(spark, d, "orders")
    published = o.select(F.concat(F.lit("C"), "o_custkey").alias("id"), F.concat(F.col("o_orderkey") % 7, F.lit("."), F.col("o_orderkey"), F.lit(".0")).alias("version"), F.when(F.col("o_orderkey") % 3 == 0, "linux").when(F.col("o_orderkey") % 3 == 1, "win").alias("platform"), (F.col("o_orderstatus") == "P").alias("prerelease"))
    refs = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(None).cast("string").alias("version"))
    return supply.pick_versions(refs, published, "linux").select("id", "picked", "platform")


def tamper_verdict(spark, d):
    """Documents of sources as files: two registries hold some of them, one with a change."""
    docs = t(spark, d, "documents").select(F.col("source").alias("pkg_id"), F.concat("doc_id", F.lit(".js")).alias("rel"), F.sha2("text", 256).alias("sha256"), "doc_id")
    a = docs.where("doc_id % 11 <> 0").select(F.lit("a").alias("origin"), "pkg_id", "rel", "sha256")
    b = docs.select(F.lit("b").alias("origin"), "pkg_id", "rel", F.when(F.col("doc_id") % 40 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return supply.tamper_signals(a.unionByName(b), docs.select("pkg_id", "rel", "sha256"))


def verify_hashes(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("pkg_id"), F.col("lang").alias("version"), F.sha2("text", 256).alias("sha256"))
    published = docs.where("pkg_id % 5 <> 0").withColumn("sha256", F.when(F.col("pkg_id") % 7 == 0, F.lit("0")).otherwise(F.upper("sha256")))
    return supply.verify_hashes(docs, published).groupBy("integrity").agg(F.count("*").alias("n"))


def evidence_chain(spark, d):
    """Errors and signups as static signals of users, clicks and views of large value as what was seen."""
    e = t(spark, d, "events")
    static = e.where("event_type in ('error', 'signup', 'purchase') and value > 20").select(F.col("user_id").alias("pkg_id"), F.col("event_type").alias("signal_id"), F.lit(1.0).alias("weight"))
    seen = e.where("event_type in ('click', 'view') and value > 150").select(F.col("user_id").alias("pkg_id"), F.col("event_type").alias("signal_id"))
    mapping = spark.createDataFrame([("error", "click"), ("signup", "click")], "signal_id string, runtime_id string")
    return runtime.evidence_chain(static, seen, mapping).withColumn("evidence", F.array_join("evidence", ","))


def runtime_signals(spark, d):
    """Events as what a user's run did: errors start processes, purchases touch files, signups run code, views go to hosts, clicks read the clipboard."""
    e = t(spark, d, "events")
    k, of = F.col("event_id"), lambda kind: F.col("event_type") == kind
    kind = F.when(of("error"), "spawn").when(of("purchase"), "fs").when(of("signup"), "eval").when(of("view"), F.when(k % 10 == 0, "udp-send").otherwise("http")).otherwise("clipboard")
    path = F.when(of("error"), F.when(k % 2 == 0, "/bin/sh").otherwise("/usr/bin/git")).when(of("purchase"), F.when(k % 3 == 0, "/home/u/.ssh/id").when(k % 3 == 1, "/box/tmp").otherwise("/etc/x"))
    host = F.when(of("view") & (k % 10 != 0), F.when(k % 4 == 0, "a.example.net").when(k % 4 == 1, "x.duckdns.org").when(k % 4 == 2, "93.184.216.34").otherwise("far.example.org"))
    rows = e.select(F.col("user_id").alias("run_id"), kind.alias("kind"), path.alias("path"), F.when(k % 2 == 0, "write").otherwise("read").alias("op"), host.alias("host"), (F.col("value") * 400).cast("long").alias("bytes"), F.repeat(F.lit("x"), (F.col("value") * 20).cast("int")).alias("text"))
    return runtime.runtime_signals(rows, declared=("example.net",), sandbox=("/box/",)).select("run_id", "signal_id", "weight", "n", "force")


def page_connections(spark, d):
    """Pages as a run's connections, their hosts' last labels as the run."""
    p = t(spark, d, "pages")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([A-Za-z0-9.-]+)", 1))
    e = p.select(F.substring_index(host, ".", -2).alias("run_id"), F.lit("http").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("op"), host.alias("host"), F.length("html").alias("bytes"), F.lit(None).cast("string").alias("text"))
    return runtime.runtime_signals(e, declared=("example.net",)).select("run_id", "signal_id", "weight", "n", "force")


def indicator_hits(spark, d):
    rules = [content.IndicatorRule("nav-and-ad", ("<NAV>", 'class="ad"', "track(")), content.IndicatorRule("two-of", ("href=\"/the", "<b>", "&amp;", "nothing at all"), 3)]
    return content.indicator_hits(t(spark, d, "pages"), rules, keys=("page_id",), text_col="html")


def flow_reach(spark, d):
    """Orders as edges from customers to order keys, lines from orders to parts; large parts are sinks."""
    o, li, p = t(spark, d, "orders"), t(spark, d, "lineitem"), t(spark, d, "part")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst")).unionByName(li.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))
    edges = edges.withColumn("pkg_id", F.lit("x"))
    sources = t(spark, d, "customer").select(F.lit("x").alias("pkg_id"), F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("label"))
    sinks = p.where("p_size > 30").select(F.lit("x").alias("pkg_id"), F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("sink"))
    mapping = spark.createDataFrame([("BUILDING", "Brand#11", "a", 0.9), ("BUILDING", "Brand#12", "a", 0.5), ("MACHINERY", "Brand#11", "b", 0.7)], "label string, sink string, signal_id string, confidence double")
    return content.flow_signals(edges, sources, sinks, mapping)


QUERIES = {f.__name__: f for f in (mcv, markov, tuple_stats, tuple_estimates, sequential_estimates, restart_rows, sym_histogram, puf_uniqueness, puf_reliability, bit_aliasing, puf_uniformity, puf_unstable, self_time, triggers_by_site, tree_totals, tag_points, advisory_signals, protestware, pick_versions, tamper_verdict, verify_hashes, evidence_chain, runtime_signals, page_connections, indicator_hits, flow_reach)}

# No tuple of 20 repeats at the size at which results are compared.
TUPLES = """g AS (SELECT source_id, i, list(sym) OVER (PARTITION BY source_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS t FROM s),
      wt AS (SELECT source_id, w, t[1:w] AS t FROM g, (SELECT unnest(range(1, 21)) AS w) WHERE len(t) >= w), k AS (SELECT source_id, w, t, count(*) AS c FROM wt GROUP BY ALL),
      tuples AS (SELECT source_id, w::INT AS w, sum(c)::BIGINT AS n, max(c) AS q, sum(c * (c - 1) // 2)::BIGINT AS s FROM k GROUP BY source_id, w HAVING max(c) > 1)"""
ORACLES = {
    "mcv": f"WITH {SAMPLES}, c AS (SELECT source_id, sym, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT source_id, max(c) / sum(c) AS p, sum(c) AS n FROM c GROUP BY 1) SELECT source_id, round(-log2({UPPER.format(p='p', n='n')}), 9) AS h FROM m",
    "markov": f"""WITH {SAMPLES}, x AS (SELECT source_id, sym % 2 AS a, lead(sym % 2) OVER (PARTITION BY source_id ORDER BY i) AS b FROM s), c AS (SELECT source_id, avg(a) AS p1, avg(b) FILTER (a = 0) AS p01, avg(b) FILTER (a = 1) AS p11 FROM x GROUP BY 1)
      SELECT source_id, round(least(1.0, -greatest(log2(1 - p1) + 127 * log2(1 - p01), log2(1 - p1) + 64 * log2(p01) + 63 * log2(1 - p11), log2(1 - p1) + log2(p01) + 126 * log2(p11), log2(p1) + log2(1 - p11) + 126 * log2(1 - p01), log2(p1) + 64 * log2(1 - p11) + 63 * log2(p01), log2(p1) + 127 * log2(p11)) / 128), 9) AS h FROM c""",
    "tuple_stats": f"WITH {SAMPLES}, {TUPLES} SELECT * FROM tuples",
    "tuple_estimates": f"""WITH {SAMPLES}, {TUPLES}, e AS (SELECT source_id, max(n) FILTER (w = 1) AS total, max(power(q / n, 1 / w)) FILTER (q >= 35) AS p, max(power(s / (n * (n - 1) / 2), 1 / w)) FILTER (q < 35) AS r FROM tuples GROUP BY 1)
      SELECT source_id, round(-log2({UPPER.format(p="p", n="total")}), 9) AS t_tuple, round(-log2({UPPER.format(p="r", n="total")}), 9) AS lrs FROM e""",
    "restart_rows": f"WITH {SAMPLES}, a AS (SELECT source_id, i // 10000 AS matrix, i % 10000 // 100 AS k, sym, count(*) AS c FROM s GROUP BY ALL UNION ALL SELECT source_id, i // 10000, i % 100, sym, count(*) FROM s GROUP BY ALL) SELECT source_id, matrix, max(c) AS x_max FROM a GROUP BY ALL",
    "sym_histogram": "SELECT least(9, floor((l_quantity::INT % 16) / 15 * 10))::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "puf_uniqueness": f"WITH {BITS} SELECT round(avg((x.bit <> y.bit)::INT), 9) AS uniqueness FROM f x JOIN f y ON x.pos = y.pos AND x.device < y.device",
    "puf_reliability": f"WITH {BITS} SELECT b.device, b.read, round(avg((b.bit <> f.bit)::INT), 9) AS errors FROM b JOIN f ON b.device = f.device AND b.pos = f.pos WHERE b.read > 1 GROUP BY ALL",
    "bit_aliasing": f"WITH {BITS}, p AS (SELECT pos, avg(bit) AS p FROM f GROUP BY 1) SELECT pos, round(p, 9) AS p, round(-log2(greatest(p, 1 - p)), 9) AS h_min FROM p",
    "puf_uniformity": f"WITH {BITS} SELECT device, read, round(avg(bit), 9) AS ones FROM b GROUP BY ALL",
    "puf_unstable": f"WITH {BITS}, m AS (SELECT device, pos, (min(bit) <> max(bit))::INT AS moved FROM b GROUP BY ALL) SELECT avg(moved) AS unstable FROM m",
    "self_time": "SELECT l_returnflag || l_linestatus AS method, l_partkey % 10 AS file, l_suppkey % 7 AS line, sum(l_quantity) AS self, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL",
    "triggers_by_site": "WITH r AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'a.jl:' || (l_suppkey % 50) WHEN l_suppkey % 3 = 2 THEN 'b.jl:' || (l_suppkey % 9) END AS site, l_returnflag || l_linestatus AS callee, l_quantity FROM lineitem) SELECT site, count(*) AS n, array_to_string(list_sort(list_distinct(list(callee))), ',') AS callees, sum(l_quantity) AS time FROM r WHERE site IS NOT NULL GROUP BY site",
    "tree_totals": "WITH RECURSIVE a AS (SELECT p_partkey AS node_id, p_size, p_partkey AS up FROM part UNION ALL SELECT node_id, p_size, up // 2 FROM a WHERE up > 1) SELECT up AS node_id, sum(p_size)::BIGINT AS total, count(*) AS size FROM a GROUP BY up",
    "tag_points": "WITH x AS (SELECT o_orderkey % 5000 AS id, 0 AS ref FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT l_orderkey % 5000, 1 FROM lineitem WHERE l_quantity > 45), n AS (SELECT id, count(*) FILTER (ref = 0) AS defs, count(*) FILTER (ref = 1) AS refs FROM x GROUP BY id) SELECT *, CASE WHEN defs > 1 THEN 'duplicate' WHEN defs = 0 THEN 'orphan' WHEN refs = 0 THEN 'not analysed' ELSE 'ok' END AS state FROM n",
    "advisory_signals": f"WITH {NPM}, k AS (SELECT DISTINCT name, version, CASE WHEN l_partkey % 100 = 0 THEN 'MAL-' ELSE 'CVE-' END || l_partkey AS adv FROM n WHERE l_partkey % 50 = 0), e AS (SELECT DISTINCT pkg_id, name, version FROM n WHERE l_linenumber < 5 UNION SELECT pkg_id, name, version FROM n WHERE l_linenumber >= 5 AND pkg_id NOT IN (SELECT pkg_id FROM n WHERE l_linenumber < 5)) SELECT pkg_id, CASE WHEN adv LIKE 'MAL-%' THEN 'malicious-dependency' ELSE 'vulnerable-dependency' END AS signal_id, count(DISTINCT (name, version)) AS n, array_to_string(list_sort(list_distinct(list(adv))), ',') AS ids FROM e JOIN k USING (name, version) GROUP BY 1, 2",
    "protestware": f"WITH {NPM}, k AS (SELECT DISTINCT name, CASE WHEN l_partkey % 2 = 0 THEN '*' ELSE '1.1.0' END AS v FROM n WHERE l_partkey % 97 = 0) SELECT DISTINCT pkg_id, n.name, version FROM n JOIN k ON n.name = k.name AND (v = '*' OR v = version)",
    "pick_versions": "WITH v AS (SELECT o_custkey, o_orderkey % 7 AS a, o_orderkey AS b, CASE o_orderkey % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'win' ELSE 'universal' END AS platform, o_orderstatus = 'P' AS pre FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pre, a DESC, b DESC) AS k FROM v WHERE platform <> 'win') SELECT 'c' || c_custkey AS id, r.a || '.' || r.b || '.0' AS picked, platform FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k = 1",
    "tamper_verdict": """WITH i AS (SELECT source AS pkg_id, doc_id, sha256(text) AS h FROM documents), n AS (SELECT 'a' AS origin, pkg_id, 0 AS m, count(*) FILTER (doc_id % 11 = 0) AS a FROM i GROUP BY ALL UNION ALL SELECT 'b', pkg_id, count(*) FILTER (doc_id % 40 = 0), 0 FROM i GROUP BY ALL),
      b AS (SELECT pkg_id, min((m, a, origin)) AS b, min(m + a) AS least FROM n GROUP BY 1) SELECT pkg_id, b[3] AS origin, b[1] AS n_modified, b[2] AS n_added_code FROM b WHERE least > 0""",
    "verify_hashes": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'unverified' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS integrity, count(*) AS n FROM documents GROUP BY 1",
    "evidence_chain": """WITH s AS (SELECT DISTINCT user_id AS pkg_id, event_type AS sig FROM events WHERE event_type IN ('error', 'signup', 'purchase') AND value > 20), r AS (SELECT DISTINCT user_id AS pkg_id, event_type AS rid FROM events WHERE event_type IN ('click', 'view') AND value > 150)
      SELECT s.pkg_id, sig AS signal_id, CASE WHEN sig = 'purchase' THEN 'no-runtime-check' WHEN r.rid IS NOT NULL THEN 'confirmed' ELSE 'not-observed' END AS verdict, coalesce(r.rid, '') AS evidence FROM s LEFT JOIN r ON r.pkg_id = s.pkg_id AND r.rid = 'click' AND sig <> 'purchase'
      UNION ALL SELECT pkg_id, rid, 'runtime-only', rid FROM r WHERE rid = 'view' OR pkg_id NOT IN (SELECT pkg_id FROM s WHERE sig <> 'purchase')""",
    "runtime_signals": """WITH e AS (SELECT user_id AS run_id, event_type AS y, event_id AS k, trunc(value * 400) AS bytes, trunc(value * 20) AS len FROM events),
      s AS (SELECT run_id, 'child-process-spawned' AS signal_id, CASE WHEN k % 2 = 0 THEN 7 ELSE 2 END AS w FROM e WHERE y = 'error'
        UNION ALL SELECT run_id, 'fs-access-violation', CASE WHEN k % 3 = 0 THEN 8 WHEN k % 2 = 0 THEN 6 ELSE 3 END FROM e WHERE y = 'purchase' AND k % 3 <> 1
        UNION ALL SELECT run_id, 'dynamic-eval-execution', CASE WHEN len > 2000 THEN 6 ELSE 2 END FROM e WHERE y = 'signup'
        UNION ALL SELECT run_id, 'dns-and-http-destinations', CASE WHEN bytes >= 65536 THEN 10 WHEN k % 4 = 1 THEN 6 WHEN k % 4 = 2 THEN 5 ELSE 2 END FROM e WHERE y = 'view' AND k % 10 <> 0 AND k % 4 <> 0
        UNION ALL SELECT run_id, 'network-raw-socket', 4 FROM e WHERE y = 'view' AND k % 10 = 0 UNION ALL SELECT run_id, 'clipboard-poll-frequency', 3 FROM e WHERE y = 'click'),
      g AS (SELECT run_id, signal_id, count(*) AS n, max(w) AS w FROM s GROUP BY ALL), x AS (SELECT run_id, signal_id, n, (CASE WHEN signal_id = 'clipboard-poll-frequency' AND n > 1 THEN 6 ELSE w END)::DOUBLE AS weight FROM g) SELECT *, CASE WHEN weight >= 7 THEN 'high' END AS force FROM x""",
    "page_connections": "WITH h AS (SELECT lower(regexp_extract(url, '^[a-z]+://([A-Za-z0-9.-]+)', 1)) AS host, length(html) AS bytes FROM pages), x AS (SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS run_id, host, bytes FROM h WHERE host <> 'example.net' AND NOT ends_with(host, '.example.net')) SELECT run_id, 'dns-and-http-destinations' AS signal_id, max(CASE WHEN bytes >= 65536 THEN 10.0::DOUBLE ELSE 2.0::DOUBLE END) AS weight, count(*) AS n, CASE WHEN max(bytes) >= 65536 THEN 'high' END AS force FROM x GROUP BY run_id",
    "indicator_hits": """WITH p AS (SELECT page_id, lower(html) AS h FROM pages) SELECT page_id, 'nav-and-ad' AS rule_id FROM p WHERE contains(h, '<nav>') AND contains(h, 'class="ad"') AND contains(h, 'track(') UNION ALL SELECT page_id, 'two-of' FROM p WHERE contains(h, 'href="/the')::INT + contains(h, '<b>')::INT + contains(h, '&amp;')::INT >= 3""",
    "flow_reach": """WITH m(label, sink, signal_id, confidence) AS (VALUES ('BUILDING', 'Brand#11', 'a', 0.9::DOUBLE), ('BUILDING', 'Brand#12', 'a', 0.5::DOUBLE), ('MACHINERY', 'Brand#11', 'b', 0.7::DOUBLE)), r AS (SELECT DISTINCT p_partkey, p_brand AS sink, c_mktsegment AS label FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 30)
      SELECT signal_id, 'x' AS pkg_id, max(confidence) AS confidence, count(DISTINCT (p_partkey, label)) AS n FROM r JOIN m USING (label, sink) GROUP BY signal_id""",
}
