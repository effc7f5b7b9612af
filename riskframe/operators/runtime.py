"""Runtime evidence: what a recorded run shows, and what of the static suspicions it confirms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.text import under

# How many MB or calls make a runtime signal heavier, and hosts of dynamic DNS services.
LARGE_UPLOAD = 65_536
DYNAMIC_DNS = ("duckdns.org", "no-ip.org", "no-ip.com", "dyndns.org", "ngrok.io", "hopto.org", "ddns.net")
SHELLS = r"(?:^|[/\\])(?:sh|bash|zsh|cmd(?:\.exe)?|powershell(?:\.exe)?|pwsh)$"


def runtime_signals(events: DataFrame, *, declared: tuple[str, ...] = (), sandbox: tuple[str, ...] = (), minutes: float = 1.0) -> DataFrame:
    """(run_id, signal_id, weight, n, force) of events(run_id, t, kind, path, op, host, bytes, text), one scan for all.

    Processes (a shell weighs more), writes outside the sandbox, evaluated code, hosts that are not declared (addresses,
    dynamic DNS and large uploads weigh more), clipboard reads above one a minute, and sockets.
    """
    inside = F.lit(False)
    for root in sandbox:
        inside = inside | F.startswith(F.col("path"), F.lit(root))
    foreign = F.col("host").isNotNull() & ~under(F.col("host"), list(declared))
    kind = F.col("kind")
    outside = (kind == "fs") & F.coalesce(~inside, F.lit(False))
    weigh: list[tuple[str, Column, Column]] = [
        ("child-process-spawned", kind.isin("spawn", "spawn-pid"), F.when(F.col("path").rlike(SHELLS), 7).otherwise(2)),
        ("fs-access-violation", outside, F.when(F.col("path").rlike(r"\.(?:ssh|aws|gnupg|npmrc|kube)"), 8).when(F.col("op") == "write", 6).otherwise(3)),
        ("dynamic-eval-execution", kind == "eval", F.when(F.length("text") > 2000, 6).otherwise(2)),
        ("dns-and-http-destinations", kind.isin("http", "connect", "dns") & foreign, F.when(F.col("bytes") >= LARGE_UPLOAD, 10).when(under(F.col("host"), list(DYNAMIC_DNS)), 6).when(F.col("host").rlike(r"^[0-9.]+$"), 5).otherwise(2)),
        ("clipboard-poll-frequency", kind == "clipboard", F.lit(3)),
        ("network-raw-socket", kind.isin("udp", "udp-send"), F.when(kind == "udp-send", 4).otherwise(3)),
    ]
    sums = []
    for name, hit, weight in weigh:
        hit = F.coalesce(hit, F.lit(False))
        sums += [F.count_if(hit).alias(f"n_{name}"), F.max(F.when(hit, weight)).alias(f"w_{name}")]
    one = events.groupBy("run_id").agg(*sums)

    def row(name: str) -> Column:
        n, w = F.col(f"`n_{name}`"), F.col(f"`w_{name}`").cast("double")
        if name == "clipboard-poll-frequency":
            w = F.when(n / minutes > 1, 6.0).otherwise(w)
        force = F.when(w >= 7, "high")
        return F.when(n > 0, F.struct(F.lit(name).alias("signal_id"), w.alias("weight"), n.alias("n"), force.alias("force")))

    return one.select("run_id", F.inline(F.filter(F.array(*(row(name) for name, _, _ in weigh)), lambda x: x.isNotNull())))


def orphans(spawned: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(run_id, pid): spawned processes that are still there after the run's end."""
    return spawned.select("run_id", "pid").distinct().join(snapshot.select("run_id", "pid"), ["run_id", "pid"], "left_semi")


def kernel_signals(kernel: DataFrame, baseline: int = 0) -> DataFrame:
    """(run_id, signal_id, n): raw sockets, and memory made writable and executable more often than the baseline."""
    n = kernel.groupBy("run_id").agg(F.count_if(F.col("kind") == "RAWSOCK").alias("raw"), F.count_if(F.col("kind") == "RWX").alias("rwx"))
    rows = F.array(
        F.when(F.col("raw") > 0, F.struct(F.lit("network-raw-socket").alias("signal_id"), F.col("raw").alias("n"))),
        F.when(F.col("rwx") > baseline, F.struct(F.lit("mprotect-rwx").alias("signal_id"), (F.col("rwx") - baseline).alias("n"))),
    )
    return n.select("run_id", F.inline(F.filter(rows, lambda x: x.isNotNull())))


# Commands and settings whose change is of note, and scripts from elsewhere in a page.
PROTECTED_COMMAND = r"^(type|default:type|paste|cut|copy|workbench\.action\.terminal\.|git\.(commit|push|pushTo|sync)|editor\.action\.clipboard|workbench\.action\.files\.save|workbench\.action\.quickOpen)"
SECURITY_SETTING = r"^(security\.|http\.proxy|terminal\.integrated\.env|extensions\.(autoUpdate|autoCheckUpdates))"
REMOTE_SCRIPT = r"(?i)<(script|iframe)[^>]+src\s*=\s*\\?[\"']https?:"


def api_confirms() -> list[tuple[str, Column]]:
    """What recorded editor calls(api, id, key, html, options, scripts, uris) confirm: (signal, condition)."""
    api, html = F.col("api"), F.coalesce("html", F.lit(""))
    command = api == "commands.executeCommand"
    tamper = (api == "configuration.update") & F.col("key").rlike(SECURITY_SETTING)
    page = api == "webview.html"
    external = api == "env.openExternal"
    return [
        ("terminal-injection", (api == "terminal.sendText") | (api == "window.createTerminal") & F.col("options").rlike(r'hideFromUser"?\s*:\s*true')),
        ("terminal-sequence", command & (F.col("id") == "workbench.action.terminal.sendSequence")),
        ("command-override", (api == "commands.registerCommand") & F.col("id").rlike(PROTECTED_COMMAND)),
        ("debug-session-hook", (api == "debug.registerDebugAdapterTrackerFactory") | F.startswith(api, F.lit("listen:debug."))),
        ("settings-tamper", tamper),
        ("security-setting-defaults", tamper),
        ("webview-remote-content", page & F.col("scripts") & html.rlike(REMOTE_SCRIPT)),
        ("webview-remote-script", page & html.rlike(REMOTE_SCRIPT)),
        ("webview-no-csp", page & F.col("scripts") & ~html.rlike("(?i)Content-Security-Policy")),
        ("command-uris", (api == "window.createWebviewPanel") & F.col("uris")),
        ("extension-install", command & F.contains("id", F.lit("installExtension"))),
        ("extension-uninstall", command & F.col("id").rlike("uninstallExtension|disable")),
        ("open-external-startup", external),
        ("uri-handler", external),
        ("broad-auth-session", api == "authentication.getSession"),
        ("secret-storage-abuse", api == "secrets.get"),
        ("clipboard-exfil", api == "env.clipboard.readText"),
        ("document-exfil", F.startswith(api, F.lit("listen:workspace.onDidChangeTextDocument"))),
    ]


API_SIGNALS = ("terminal-injection", "terminal-sequence", "command-override", "debug-session-hook", "settings-tamper", "security-setting-defaults", "webview-remote-content", "webview-remote-script", "webview-no-csp", "command-uris", "extension-install", "extension-uninstall", "open-external-startup", "uri-handler", "broad-auth-session", "secret-storage-abuse", "clipboard-exfil", "document-exfil")


def api_evidence(calls: DataFrame) -> DataFrame:
    """(pkg_id, signal_id, api) of recorded calls(pkg_id, api, id, key, html, options, scripts, uris): what confirms a signal, each call's name once."""
    hits = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in api_confirms())), lambda x: x.isNotNull())
    return calls.select("pkg_id", F.explode(hits).alias("signal_id"), "api").distinct()


def evidence_chain(static: DataFrame, runtime: DataFrame, mapping: DataFrame, api: DataFrame | None = None) -> DataFrame:
    """(pkg_id, signal_id, verdict, evidence) of static(pkg_id, signal_id, weight), and runtime signals that nothing static explains.

    mapping(signal_id, runtime_id): what would confirm a signal; api: ``api_evidence``, which confirms some by recorded calls, too.
    confirmed, not-observed, no-runtime-check, runtime-only. Evidence are runtime signals, then names of calls.
    """
    wanted = static.where("weight > 0").select("pkg_id", "signal_id").distinct().join(mapping, "signal_id", "left")
    seen = runtime.select("pkg_id", F.col("signal_id").alias("runtime_id"), F.lit(True).alias("seen")).distinct()
    rows = wanted.join(seen, ["pkg_id", "runtime_id"], "left").groupBy("pkg_id", "signal_id").agg(F.count("runtime_id").alias("checks"), F.sort_array(F.collect_set(F.when(F.col("seen"), F.col("runtime_id")))).alias("evidence"))
    if api is not None:
        called = api.groupBy("pkg_id", "signal_id").agg(F.sort_array(F.collect_set("api")).alias("calls"))
        checked = F.col("checks") + F.when(F.col("signal_id").isin(*API_SIGNALS), 1).otherwise(0)
        rows = rows.join(called, ["pkg_id", "signal_id"], "left").select("pkg_id", "signal_id", checked.alias("checks"), F.concat("evidence", F.coalesce("calls", F.array().cast("array<string>"))).alias("evidence"))
    verdict = F.when(F.size("evidence") > 0, "confirmed").when(F.col("checks") > 0, "not-observed").otherwise("no-runtime-check")
    explained = wanted.where("runtime_id is not null").select("pkg_id", "runtime_id").distinct()
    rest = seen.join(explained, ["pkg_id", "runtime_id"], "left_anti").select("pkg_id", F.col("runtime_id").alias("signal_id"), F.lit("runtime-only").alias("verdict"), F.array("runtime_id").alias("evidence"))
    return rows.select("pkg_id", "signal_id", verdict.alias("verdict"), "evidence").unionByName(rest)
