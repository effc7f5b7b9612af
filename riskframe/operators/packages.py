"""Signals of package manifests and of galleries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.names import known_bad_signals, publisher_signals, typosquats

# What manifests may hold that is worth a look.
SENSITIVE_KEYS = r"^(ctrl|cmd)\+(c|v|x|s|a|z)$|^enter$|^(ctrl|cmd)\+shift\+(p|v)$"
SECURITY_SETTINGS = r"^(security\.|extensions\.(autoUpdate|autoCheckUpdates|verifySignature)|workbench\.trust|git\.(allowNoVerifyCommit|ignoreLegacyWarning)$|http\.systemCertificates)"
PROXY_SETTINGS = r"^http\.(proxy|proxyStrictSSL|proxyAuthorization|proxySupport|noProxy)$"
TERMINAL_ENV = r"^terminal\.integrated\.env\."
BROAD_FOLDER = r"^workspaceContains:(\*\*/\*|\*|\*\*|\*\*/\*\.\*)$"
BRANDS = r"(?i)(?<![A-Za-z0-9_])(microsoft|github|google|amazon|aws|azure|jetbrains|docker|redhat|red hat|openai|anthropic)(?![A-Za-z0-9_])"
BRAND_PUBLISHERS = r"(?i)^(microsoft|ms-[\w-]+|vscode|github|google|googlecloudtools|amazonwebservices|aws-\w+|jetbrains|docker|ms-azuretools|redhat|openai|anthropic)$"
KNOWN_SCHEMA_HOSTS = r"(?i)^https?://(?:[\w-]+\.){0,126}(schemastore\.org|json-schema\.org|raw\.githubusercontent\.com|microsoft\.com|azure\.com|vscode-cdn\.net)/"
USUAL_ENTRY = r"^(\./)?(out|dist|lib|build|bundle|src|client|extension|server|web|bin|packages?)/"
WEIGHTS = {
    "activates-on-startup": 2, "activates-after-startup": 1, "untrusted-workspace": 1, "many-dependencies": 1, "sideloaded": 1, "uri-handler": 1, "broad-workspace-contains": 1,
    "terminal-profile": 1, "task-provider": 0, "debug-adapter-executable": 1, "auth-provider": 2, "keybinding-override": 2, "security-setting-defaults": 4, "proxy-defaults": 3,
    "terminal-env-defaults": 3, "unknown-dependency": 1, "missing-repository": 0, "missing-license": 0, "brand-impersonation": 4, "manifest-install-scripts": 2, "remote-schema": 1,
    "remote-walkthrough-media": 0, "unusual-entry": 3, "remote-workspace-exec": 1, "typosquat": 4,
}
STALE_DAYS, FEW_INSTALLS = 730, 1000


def field(path: str) -> Column:
    return F.get_json_object("manifest", f"$.{path}")


def strings(path: str) -> Column:
    """A JSON array's elements as text; empty if there is none."""
    return F.coalesce(F.from_json(field(path), "array<string>"), F.array().cast("array<string>"))


def keys(path: str) -> Column:
    return F.coalesce(F.json_object_keys(field(path)), F.array().cast("array<string>"))


def any_like(array: Column, pattern: str) -> Column:
    return F.exists(array, lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))


def unusual(entry: Column) -> Column:
    """Why an entry file stands in an odd place; the first reason, or null."""
    parts = F.split(F.regexp_replace(entry, r"^\./", ""), r"[\\/]")
    base = F.regexp_replace(F.element_at(parts, -1), r"\.[cm]?js$", "")
    hexadecimal = base.rlike(r"(?i)^[a-f0-9]{16,}$")
    mixed = base.rlike(r"(?i)^[a-z0-9]{12,}$") & base.rlike("[0-9]") & base.rlike("(?i)[a-z]") & ~base.rlike("(?i)(extension|index|main|bundle|client|server)")
    usual = lambda folders: F.concat(F.array_join(folders, "/"), F.lit("/")).rlike(USUAL_ENTRY)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return (
        F.when(entry == "", None)
        .when(F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(".", "..")), "is inside a hidden folder")
        .when(F.array_contains(parts, "node_modules"), "points into node_modules")
        .when(F.size(parts) > 5, "is unusually deeply nested")
        .when(hexadecimal | mixed, "has a random-looking file name")
        .when((F.size(parts) > 1) & ~usual(parts) & ~usual(folders), "is outside the usual output folders")
    )


def manifest_signals(packages: DataFrame, *, trusted: list[str], popular: DataFrame, removed: DataFrame) -> DataFrame:
    """(pkg_id, signal_id, weight, force) of packages(pkg_id, source, builtin, has_license, manifest); manifest is JSON.

    trusted: publishers; popular(ord, id); removed(id, type). One projection gives all signals of the manifest
    alone; those of lists are joins. A manifest that is no JSON object gives what an empty one gives.
    """
    known = [t.lower() for t in trusted]
    publisher = F.substring_index(F.lower("pkg_id"), ".", 1)
    is_known = publisher.isin(known) if known else F.lit(False)
    events = strings("activationEvents")
    related = F.transform(F.concat(strings("extensionDependencies"), strings("extensionPack")), lambda x: F.lower(x))
    foreign = F.exists(related, lambda x: ~(F.substring_index(x, ".", 1).isin(known) if known else F.lit(False)) & (F.substring_index(x, ".", 1) != publisher))
    bound = F.coalesce(F.from_json(field("contributes.keybindings"), "array<struct<key:string,mac:string,win:string,linux:string,when:string>>"), F.array().cast("array<struct<key:string,mac:string,win:string,linux:string,when:string>>"))
    press = lambda k: F.coalesce(F.lower(F.regexp_replace(k, r"\s+", "")).rlike(SENSITIVE_KEYS), F.lit(False))
    grabs = F.exists(bound, lambda b: F.coalesce(b["when"] == "", F.lit(True)) & (press(b["key"]) | press(b["mac"]) | press(b["win"]) | press(b["linux"])))
    defaults = keys("contributes.configurationDefaults")
    program = "struct<program:string>"
    bugs = F.coalesce(F.from_json(field("contributes.debuggers"), f"array<struct<program:string,runtime:string,windows:{program},osx:{program},linux:{program}>>"), F.array().cast(f"array<struct<program:string,runtime:string,windows:{program},osx:{program},linux:{program}>>"))
    starts = F.exists(bugs, lambda b: F.coalesce(b["program"], b["runtime"], b["windows"]["program"], b["osx"]["program"], b["linux"]["program"]).isNotNull())
    schemas = F.coalesce(F.from_json(field("contributes.jsonValidation"), "array<struct<url:string>>"), F.array().cast("array<struct<url:string>>"))
    remote = F.exists(schemas, lambda j: F.coalesce(j["url"].rlike("^https?://") & ~j["url"].rlike(KNOWN_SCHEMA_HOSTS), F.lit(False)))
    media = F.coalesce(field("contributes.walkthroughs"), F.lit("")).rlike(r'"media"\s*:\s*(\{[^{}]*|)"https?://')
    branded = F.coalesce(field("displayName").rlike(BRANDS), F.lit(False)) & ~publisher.rlike(BRAND_PUBLISHERS)
    sideloaded = F.col("source").isin("vsix", "resource")
    tests = {
        "activates-on-startup": F.array_contains(events, "*"),
        "activates-after-startup": ~F.array_contains(events, "*") & F.array_contains(events, "onStartupFinished"),
        "untrusted-workspace": field("capabilities.untrustedWorkspaces.supported") == "true",
        "many-dependencies": F.size(strings("extensionDependencies")) > 3,
        "sideloaded": sideloaded,
        "uri-handler": F.array_contains(events, "onUri"),
        "broad-workspace-contains": any_like(events, BROAD_FOLDER),
        "terminal-profile": F.size(strings("contributes.terminal.profiles")) > 0,
        "task-provider": F.size(strings("contributes.taskDefinitions")) > 0,
        "debug-adapter-executable": starts,
        "auth-provider": F.size(strings("contributes.authentication")) > 0,
        "keybinding-override": grabs,
        "security-setting-defaults": any_like(defaults, SECURITY_SETTINGS),
        "proxy-defaults": any_like(defaults, PROXY_SETTINGS),
        "terminal-env-defaults": any_like(defaults, TERMINAL_ENV),
        "unknown-dependency": foreign,
        "missing-repository": F.coalesce(field("repository"), F.lit("")) == "",
        "missing-license": (F.coalesce(field("license"), F.lit("")) == "") & ~F.coalesce("has_license", F.lit(False)),
        "brand-impersonation": branded & ~is_known,
        "manifest-install-scripts": any_like(keys("scripts"), "^(pre|post)?install$") & ~is_known,
        "remote-schema": remote,
        "remote-walkthrough-media": media,
        "unusual-entry": unusual(F.coalesce(field("main"), F.lit(""))).isNotNull() | unusual(F.coalesce(field("browser"), F.lit(""))).isNotNull(),
    }
    rows = [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(n).alias("signal_id"), F.lit(float(WEIGHTS[n])).alias("weight"))) for n, t in tests.items()]
    no_force = F.lit(None).cast("string").alias("force")
    own = packages.select("pkg_id", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))).select("pkg_id", "signal_id", "weight", no_force)
    who = publisher_signals(packages.withColumn("publisher", publisher).withColumn("source", F.when(F.col("builtin"), "builtin").when(sideloaded, "vsix").otherwise(F.col("source"))), known)
    out = own.unionByName(who.select("pkg_id", "signal_id", F.col("weight").cast("double").alias("weight"), no_force))
    bad = known_bad_signals(packages, removed)
    out = out.unionByName(bad.select("pkg_id", "signal_id", F.col("weight").cast("double").alias("weight"), "force"))
    squats = typosquats(packages.select(F.col("pkg_id").alias("id")), popular).select(F.col("id").alias("__id"))
    out = out.unionByName(packages.join(squats, F.lower("pkg_id") == F.col("__id")).select("pkg_id", F.lit("typosquat").alias("signal_id"), F.lit(4.0).alias("weight"), no_force))
    # a popular name under another publisher, unless that is known or the brand has been noticed
    known_names = popular.select(F.lower(F.substring_index("id", ".", -1)).alias("__name"), F.lower(F.substring_index("id", ".", 1)).alias("__who")).distinct()
    names = packages.where(~is_known & ~branded).join(known_names, (F.lower(F.substring_index("pkg_id", ".", -1)) == F.col("__name")) & (publisher != F.col("__who")), "left_semi")
    return out.unionByName(names.select("pkg_id", F.lit("brand-impersonation").alias("signal_id"), F.lit(4.0).alias("weight"), no_force))


def workspace_exec(packages: DataFrame, signals: DataFrame) -> DataFrame:
    """(pkg_id, signal_id, weight) of packages that run in the workspace first and start processes."""
    runs = signals.where(F.col("signal_id").isin("process-exec", "shell-exec")).select("pkg_id").distinct()
    first = packages.where(field("extensionKind[0]") == "workspace")
    return first.join(runs, "pkg_id", "left_semi").select("pkg_id", F.lit("remote-workspace-exec").alias("signal_id"), F.lit(1.0).alias("weight"))


def declared_telemetry(packages: DataFrame) -> DataFrame:
    """(pkg_id) of packages that say that they send telemetry: a file, a dependency, or a tagged setting."""
    dependency = any_like(keys("dependencies"), r"(?i)telemetry|applicationinsights")
    tagged = F.coalesce(field("contributes.configuration"), F.lit("")).rlike(r'"tags"\s*:\s*\[[^\]]*"telemetry"')
    return packages.where(dependency | tagged | F.coalesce("has_telemetry_file", F.lit(False))).select("pkg_id")


def without_declared(signals: DataFrame, declared: DataFrame) -> DataFrame:
    """signals without unauthorised telemetry of packages that declare it."""
    marked = declared.select("pkg_id", F.lit("telemetry-unauthorized").alias("signal_id")).distinct()
    return signals.join(marked, ["pkg_id", "signal_id"], "left_anti")


def gallery_signals(gallery: DataFrame, now: str) -> DataFrame:
    """(pkg_id, signal_id, weight) of gallery(id, found, verified, installs, last_updated) as of a time."""
    row = lambda name, weight: F.struct(F.lit(name).alias("signal_id"), F.lit(weight).alias("weight"))
    old = F.datediff(F.to_date(F.lit(now)), F.to_date("last_updated")) > STALE_DAYS
    rows = [
        F.when(~F.col("found"), row("not-on-marketplace", 3.0)),
        F.when(F.col("found") & F.col("verified"), row("verified-publisher", -1.0)),
        F.when(F.col("found") & ~F.col("verified"), row("unverified-publisher", 1.0)),
        F.when(F.col("found") & (F.col("installs") < FEW_INSTALLS), row("low-installs", 1.0)),
        F.when(F.col("found") & old, row("stale", 0.0)),
    ]
    return gallery.select(F.col("id").alias("pkg_id"), F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
