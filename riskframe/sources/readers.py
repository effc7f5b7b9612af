"""Readers: source trees, packages, lists, logs, samples, profiles. Each gives a DataFrame with a fixed schema."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Language by file ending, folders that are skipped, and the size from which files are.
LANGUAGES = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "ts": "typescript", "tsx": "typescriptreact",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascriptreact", "py": "python", "jl": "julia", "rs": "rust",
    "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "sh": "shellscript", "yaml": "yaml", "yml": "yaml", "json": "json",
}
SKIPPED = ("node_modules", "dist", "out", "build", "target", "vendor", "__pycache__")
LARGEST = 5 * 1024 * 1024


def glob_pattern(glob: str) -> str:
    """A regular expression on relative paths: without a slash any segment, with one from the top; what is below a match matches."""
    anchored = "/" in glob.rstrip("/")
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob.strip("/")))
    return ("^" if anchored else "(?:^|/)") + body + "(?:/|$)"


def ignore_filter(files: DataFrame, globs: list[str], *, rel: str = "rel") -> DataFrame:
    """Files that no pattern hides."""
    out = files
    for g in globs:
        out = out.where(~F.col(rel).rlike(glob_pattern(g)))
    return out


def language_of(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(name.startswith("sdkconfig"), "properties").otherwise(F.try_element_at(known, F.substring_index(name, ".", -1)))


def read_documents(spark: SparkSession, path: str, *, ignore: list[str] | None = None) -> DataFrame:
    """(path, rel, language, text, size) of the text files below a folder: not above 5 MB, without NUL in the first 4096 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= LARGEST)
    root = re.sub(r"^[a-z]+:/*(?=/)", "", path.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), "^" + re.escape(root) + "/", "")
    files = files.withColumn("rel", rel).where(~F.col("rel").rlike(r"(?:^|/)(?:\.[^/]+|" + "|".join(SKIPPED) + ")/"))
    files = ignore_filter(files, ignore or [])
    text = files.where(~F.contains(F.substring("content", 1, 4096), F.lit(b"\x00")))
    return text.select("path", "rel", language_of(F.col("rel")).alias("language"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"))


def dot_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, text) of the files of a hidden name in a folder or in those just below it.

    Spark's listings leave hidden files out, so the driver reads them: one small file for each install folder.
    """
    found = []
    for glob in (f"{path}/{name}", f"{path}/*/{name}"):
        place = spark._jvm.org.apache.hadoop.fs.Path(glob)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.globStatus(place) or ():
            stream = system.open(status.getPath())
            found.append((status.getPath().toString(), spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(found, "path string, text string")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(pkg_id, publisher, name, version, path, manifest) of install folders; folders that are not active (extensions.json, else .obsolete) and bad JSON are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "package.json").load(path)
    text = F.decode("content", "UTF-8")
    rows = files.select(F.regexp_replace("path", "/package\\.json$", "").alias("path"), text.alias("manifest")).where(~F.col("path").contains("/node_modules/"))
    field = lambda k: F.get_json_object("manifest", f"$.{k}")
    rows = rows.select(F.lower(F.concat_ws(".", field("publisher"), field("name"))).alias("pkg_id"), field("publisher").alias("publisher"), field("name").alias("name"), field("version").alias("version"), "path", "manifest").where("name is not null and publisher is not null")
    # where a folder lists what is active, that counts, else what is obsolete
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "extensions.json").load(path)
    listed = listed.select(F.regexp_replace("path", "/extensions\\.json$", "").alias("folder"), F.from_json(F.decode("content", "UTF-8"), "array<struct<relativeLocation:string>>").alias("entries")).where("entries is not null")
    active = listed.select("folder", F.explode("entries.relativeLocation").alias("name")).select(F.concat_ws("/", "folder", "name").alias("path"))
    folder = F.regexp_replace("path", "/[^/]+$", "")
    rows = rows.withColumn("folder", folder)
    chosen = rows.join(listed.select("folder"), "folder", "left_semi").join(active, "path", "left_semi")
    rows = rows.join(listed.select("folder"), "folder", "left_anti").unionByName(chosen).drop("folder")
    gone = dot_files(spark, path, ".obsolete")
    gone = gone.select(F.regexp_replace("path", "/\\.obsolete$", "").alias("folder"), F.explode(F.from_json("text", "map<string,boolean>")).alias("name", "flag")).where("flag").select(F.concat_ws("/", "folder", "name").alias("path"))
    return rows.join(gone, "path", "left_anti")


def read_list_entries(spark: SparkSession, path: str, rev: str) -> DataFrame:
    """(rev, id, version, file, line, kind, remove): extension lists as plain text (id, id@version, -id) or recommendations in JSON with comments."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    entry = r"^(-)?([A-Za-z0-9][\w-]*\.[\w.-]+?)(?:@([\w.+-]+))?$"
    # strings are kept, comments and commas before an end go
    bare = F.regexp_replace(F.regexp_replace("text", r'("(?:[^"\\]++|\\.)*+")|//[^\n]*|/\*[\s\S]*?\*/', "$1"), r",(\s*[}\]])", "$1")
    found = lambda key: F.transform(F.from_json(F.get_json_object(bare, key), "array<string>"), lambda x: x)
    lists = files.where(F.col("file").endswith(".json")).select("file", F.lit("json").alias("kind"), F.explode(F.concat(F.coalesce(found("$.recommendations"), F.array().cast("array<string>")), F.transform(F.coalesce(found("$.unwantedRecommendations"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("-"), x)))).alias("body"), "text")
    lists = lists.withColumn("line", F.lit(0)).drop("text")
    plain = files.where(~F.col("file").endswith(".json")).select("file", F.lit("plain").alias("kind"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    rows = plain.select("file", "kind", "body", "line").unionByName(lists.select("file", "kind", "body", "line"))
    rows = rows.withColumn("body", F.trim(F.regexp_replace("body", r"\s*#.*$", ""))).where(F.col("body").rlike(entry))
    part = lambda g: F.regexp_extract("body", entry, g)
    return rows.select(F.lit(rev).alias("rev"), part(2).alias("id"), F.nullif(part(3), F.lit("")).alias("version"), "file", "line", "kind", (part(1) == "-").alias("remove"))


def read_known_bad(spark: SparkSession, path: str) -> DataFrame:
    """(id, removed_on, type) of a Markdown table | id | MM/DD/YYYY | type |."""
    parts = F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|")
    rows = spark.read.text(path).select(*(F.trim(F.get(parts, k)).alias(n) for k, n in enumerate(("id", "date", "type"))))
    rows = rows.where(F.col("id").rlike(r"^[\w-]+\.[\w.-]+$") & F.col("date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"))
    return rows.select("id", F.to_date("date", "M/d/yyyy").alias("removed_on"), "type")


def newest_known_bad(snapshots: DataFrame) -> DataFrame:
    """(id, removed_on, type) of the newest of snapshots(fetched, id, removed_on, type); a later one replaces all of an earlier one. Of an id's rows in it the last removal counts."""
    # one row
    newest = snapshots.agg(F.max("fetched").alias("__newest"))
    rows = snapshots.join(F.broadcast(newest), F.col("fetched") == F.col("__newest"))
    best = rows.groupBy("id").agg(F.max_by(F.struct("removed_on", "type"), F.struct("removed_on", "type")).alias("r"))
    return best.select("id", "r.*")


GALLERY = "struct<results:array<struct<extensions:array<struct<publisher:struct<publisherName:string,displayName:string,flags:string,isDomainVerified:boolean>,extensionName:string,lastUpdated:string,statistics:array<struct<statisticName:string,value:double>>>>>>>"


def read_gallery(responses: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found, verified, installs, last_updated) for ids(id) from responses(body)."""
    e = responses.select(F.inline(F.flatten(F.from_json("body", GALLERY)["results"]["extensions"])))
    installs = F.get(F.filter("statistics", lambda s: s["statisticName"] == "install"), F.lit(0))["value"].cast("long")
    found = e.select(F.lower(F.concat_ws(".", "publisher.publisherName", "extensionName")).alias("key"), (F.col("publisher.isDomainVerified") | F.coalesce(F.col("publisher.flags").contains("verified"), F.lit(False))).alias("verified"), installs.alias("installs"), F.try_to_timestamp("lastUpdated").alias("last_updated"))
    return ids.withColumn("key", F.lower("id")).join(found, "key", "left").withColumn("found", F.col("verified").isNotNull()).drop("key")


# The types of process events.
EVENT_TYPES = ("spawn", "exec", "terminate", "inject", "file", "registry", "network", "module")
EVENT = "scenario string, idx long, t long, type string, process string, parent string, target string, image string, cmdline string, user string, op string, path string, key string, value string, remote string, count long"


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, event, problem) of JSON lines: what is wrong with a line, or null. Lines count from 1 within a file's part."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
    event = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    rows = rows.select("file", "value", F.try_parse_json("value").alias("v"), event.alias("event"))
    of = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    problem = (
        F.when(F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "event must be an object")
        .when(of("type").isNull() | ~of("type").isin(*EVENT_TYPES), F.concat(F.lit("unknown event type "), F.coalesce(of("type"), F.lit("null"))))
        .when(of("process").isNull(), "event needs a process")
    )
    return rows.select("file", "value", "event", problem.alias("problem"))


def read_process_events(spark: SparkSession, path: str) -> DataFrame:
    """Process events from JSON lines: only valid ones (see ``event_rejects``), missing times filled."""
    from riskframe.operators.detect import fill_time

    return fill_time(event_lines(spark, path).where("problem is null").select("event.*"))


def event_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, problem) of the lines that are no process events."""
    return event_lines(spark, path).where("problem is not null").select("file", "value", "problem")


def read_runtime_events(spark: SparkSession, path: str) -> DataFrame:
    """(t, kind, at, body) of a JSON-lines log; malformed lines are dropped."""
    body = F.try_parse_json("value")
    rows = spark.read.text(path).select("value", body.alias("body")).where("body is not null")
    field = lambda k, t: F.try_variant_get("body", f"$.{k}", t)
    return rows.select(field("t", "double").alias("t"), field("kind", "string").alias("kind"), field("at", "string").alias("at"), "body").where("kind is not null")


def read_kernel_trace(spark: SparkSession, path: str) -> DataFrame:
    """(kind, pid, family, call, len, comm) of lines RAWSOCK pid family comm and RWX call pid len comm."""
    raw, rwx = r"^RAWSOCK (\d+) (\d+) (\S+)", r"^RWX (\w+) (\d+) (\d+) (\S+)"
    part = lambda p, g: F.regexp_extract("value", p, g)
    is_raw, is_rwx = F.col("value").rlike(raw), F.col("value").rlike(rwx)
    rows = spark.read.text(path).where(is_raw | is_rwx)
    pick = lambda a, b, kind: F.when(is_raw, part(raw, a) if a else None).otherwise(part(rwx, b) if b else None).try_cast(kind)
    return rows.select(F.when(is_raw, "RAWSOCK").otherwise("RWX").alias("kind"), pick(1, 2, "long").alias("pid"), pick(2, 0, "int").alias("family"), pick(0, 1, "string").alias("call"), pick(0, 3, "long").alias("len"), pick(3, 4, "string").alias("comm"))


#: Bytes of a sample file that are one row of work.
RANGE = 32 * 1024 * 1024
#: Samples of a batch.
SAMPLES = 100_000
#: What parts numbers in a text of samples, and what bytes are raw samples.
APART, RAW_SAMPLES = rb"[\s,;]+", r"\.(bin|dat|raw)$"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, i, sym): bytes of .bin, .dat and .raw files, else whole numbers from 0 to 255, decimal or 0x.

    Files are read by ranges, so one of any size is spread over tasks. A number belongs to the range in which it begins; the
    numbers of each range are counted first, so that each knows the place of its first one. An empty file has no rows.
    """
    from riskframe.shipping import ship

    ship(spark)
    size = RANGE
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("at"))
    tasks = max(1, ranges.count())
    # as many tasks as ranges, up to a bound that keeps them worth starting
    ranges = ranges.repartition(min(tasks, 10_000), "path", "at")

    def count(batches):
        for batch in batches:
            rows = [(p, at, sum(len(x) for x in range_samples(p, at, min(at + size, length), length))) for p, length, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield range_batch(rows)

    text = ~F.col("path").rlike(RAW_SAMPLES)
    counted = ranges.where(text).mapInArrow(count, "path string, at long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counted.select("path", "at", before.alias("first"))
    placed = ranges.join(first, ["path", "at"], "left").select("path", "length", "at", F.coalesce("first", "at").alias("first")).repartition(min(tasks, 10_000), "path", "at")

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for source, length, at, start in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for part in range_samples(source, at, min(at + size, length), length):
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(part)), pa.array(range(start, start + len(part)), pa.int64()), pa.array(part, pa.int32())], ["source_id", "i", "sym"])
                    start += len(part)

    return placed.mapInArrow(unpack, "source_id string, i long, sym int")


def range_batch(rows: list[tuple]):
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "at", "n"])


def range_samples(source: str, begin: int, end: int, length: int):
    """Samples that begin in a range of a file, some at a time."""
    import numpy as np

    from riskframe.sources.reports import file_system

    fs, path = file_system(source)
    with fs.open_input_file(path) as file:
        file.seek(begin)
        if re.search(RAW_SAMPLES, source):
            while begin < end:
                data = file.read(min(SAMPLES, end - begin))
                begin += len(data)
                yield np.frombuffer(data, np.uint8).astype(np.int32)
            return
        held = b""
        if begin:
            # a number that began before the range is that range's
            file.seek(begin - 1)
            head = file.read(1)
            if not re.match(APART, head):
                while (byte := file.read(1)) and not re.match(APART, byte):
                    begin += 1
                begin += 1 if byte else 0
        while begin < end or held:
            data = file.read(min(SAMPLES, end - begin)) if begin < end else b""
            begin += len(data)
            held += data
            if begin >= end and held and not re.match(APART, held[-1:]):
                # the last number may reach beyond the range
                while (byte := file.read(1)) and not re.match(APART, byte):
                    held += byte
            words = re.split(APART, held)
            held = words.pop() if begin < end else b""
            found = [w for w in words if w]
            s = np.array([int(w, 0) if w[:2].lower() == b"0x" else int(w) for w in found], np.int64)
            if len(s) and (s.min() < 0 or s.max() > 255):
                raise ValueError(f"{source}: samples must be from 0 to 255")
            if len(s):
                yield s.astype(np.int32)
            if begin >= end and not held:
                return


def read_puf(spark: SparkSession, path: str) -> DataFrame:
    """(device, read, bits) of a CSV file with comments; a missing read is the row's place among its device's."""
    from riskframe.functions.text import bits_of

    rows = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).withColumn("__at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("device").orderBy("__at")) - 1
    read = F.col("read").cast("int") if "read" in rows.columns else place
    return rows.select("device", read.alias("read"), bits_of(F.col("response")).alias("bits"))


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """(name, median_ns, min_ns, mean_ns, memory, allocs, samples) of a version 1 run."""
    entry = "struct<version:int,benchmarks:array<struct<name:string,median_ns:double,min_ns:double,mean_ns:double,memory:long,allocs:long,samples:long>>>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", entry).alias("r")).where("r.version = 1").select(F.inline("r.benchmarks"))


def tree_rows(profile: str, text: str):
    """(profile_id, node_id, parent_id, depth, method, file, line, self) of nested {method, file, line, self, children}."""
    data = json.loads(text)
    if data.get("version") != 1:
        return
    stack = [(None, 0, n) for n in reversed(data.get("trees", []))]
    k = 0
    while stack:
        parent, depth, node = stack.pop()
        k += 1
        yield profile, k, parent, depth, node.get("method"), node.get("file"), node.get("line"), float(node.get("self", 0.0))
        stack += [(k, depth + 1, c) for c in reversed(node.get("children", []))]


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of the trees of version 1 profiles in JSON."""
    from riskframe.shipping import ship

    ship(spark)

    def walk(frames):
        import pandas as pd

        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["value"], strict=True) for r in tree_rows(p, t)]
            yield pd.DataFrame(rows, columns=["profile_id", "node_id", "parent_id", "depth", "method", "file", "line", "self"]).astype({"parent_id": "Int64", "line": "Int64"})

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(walk, "profile_id string, node_id long, parent_id long, depth int, method string, file string, line long, self double")


def npm_inventory(files: DataFrame) -> DataFrame:
    """(pkg_id, name, version, path, depth, scripts, deps, deprecated, resolved, from_lock) of files(pkg_id, rel, content).

    Installed dependencies are package.json files below node_modules; the depth is how often that is in the path. Entries of
    a lockfile that are not installed are added, but not those for development.
    """
    field = lambda k: F.get_json_object("content", f"$.{k}")
    as_map = lambda c: F.from_json(c, "map<string,string>")
    mine = files.where(F.col("rel").rlike(r"(?:^|/)node_modules/(?:@[^/]+/)?[^/]+/package\.json$"))
    depth = (F.length("rel") - F.length(F.replace("rel", F.lit("node_modules/"), F.lit("")))) / len("node_modules/")
    mine = mine.select("pkg_id", field("name").alias("name"), field("version").alias("version"), "rel", depth.cast("int").alias("depth"), as_map(field("scripts")).alias("scripts"), as_map(field("dependencies")).alias("deps"), field("deprecated").alias("deprecated"), field("_resolved").alias("resolved"), F.lit(False).alias("from_lock")).withColumnRenamed("rel", "path")
    lock = "map<string,struct<version:string,resolved:string,dev:boolean,deprecated:string,hasInstallScript:boolean,dependencies:map<string,string>>>"
    rows = files.where(F.col("rel") == "package-lock.json").select("pkg_id", F.explode(F.from_json(F.get_json_object("content", "$.packages"), lock)).alias("path", "e")).where("path <> '' and not coalesce(e.dev, false)")
    name = F.regexp_extract("path", r"node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    depth = (F.length("path") - F.length(F.replace("path", F.lit("node_modules/"), F.lit("")))) / len("node_modules/")
    scripts = F.when(F.col("e.hasInstallScript"), F.create_map(F.lit("install"), F.lit("")))
    rows = rows.select("pkg_id", name.alias("name"), F.col("e.version").alias("version"), "path", depth.cast("int").alias("depth"), scripts.alias("scripts"), F.col("e.dependencies").alias("deps"), F.col("e.deprecated").alias("deprecated"), F.col("e.resolved").alias("resolved"), F.lit(True).alias("from_lock"))
    return mine.unionByName(rows.join(mine, ["pkg_id", "name", "version"], "left_anti").select(*mine.columns))


#: White space outside strings, and what installers add. A string is taken whole, so that what it holds stays.
SPACE_OR_STRING = r'("(?:[^"\\]++|\\.)*+")|\s+'
INSIDE = r'[^{}"]++|"(?:[^"\\]++|\\.)*+"'
#: Objects in it may hold objects in turn, two levels deep.
METADATA = rf',?"__metadata":\{{(?:{INSIDE}|\{{(?:{INSIDE}|\{{(?:{INSIDE})*+\}})*+\}})*+\}}'


def file_hashes(files: DataFrame) -> DataFrame:
    """(pkg_id, rel, sha256) of files(pkg_id, rel, content); package.json without white space between its tokens and what installers add, .vsixmanifest left out."""
    plain = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), SPACE_OR_STRING, "$1"), METADATA, "")
    data = F.when(F.col("rel") == "package.json", F.encode(F.regexp_replace(plain, r"^\{,", "{"), "UTF-8")).otherwise(F.col("content"))
    return files.where(~F.col("rel").endswith(".vsixmanifest")).select("pkg_id", "rel", F.sha2(data, 256).alias("sha256"))
