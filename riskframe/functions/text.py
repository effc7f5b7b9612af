"""Column builders for texts: match positions, checksums, addresses, names, entropies, markers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

#: An end and a start of an ASCII word; Java's \b also knows other letters.
WORD_START, WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


#: Matches that are gathered together: a list of n grows by BLOCK at a time, not by one, so that it is not copied n times.
BLOCK = 256
MATCH = "array<struct<start:int,line:int,col:int,matched:string,value:string>>"


def moved(s: Column, text: Column) -> tuple[Column, Column, Column]:
    """Place, line and column behind a text that begins at those of s."""
    size = F.length(text)
    lines = size - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    col = F.when(lines > 0, F.length(F.substring_index(text, "\n", -1))).otherwise(s["col"] + size)
    return s["at"] + size, s["line"] + lines, col


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern that never matches nothing: array<struct<start, line, col, matched, value>>.

    start is the 0-based code point of the match, line and col are its 0-based line and column; value is the given group. Nulls give null.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(parts, 1, F.size(whole)).alias("before"), whole.alias("matched"), value.alias("value"))
    none = F.array().cast(MATCH)
    state = lambda at, line, col, out: F.struct(at.alias("at"), line.alias("line"), col.alias("col"), out.alias("out"))
    zero = F.lit(0)

    def step(s: Column, x: Column) -> Column:
        at, line, col = moved(s, x["before"])
        row = F.struct(at.alias("start"), line.alias("line"), col.alias("col"), x["matched"].alias("matched"), x["value"].alias("value"))
        return state(*moved({"at": at, "line": line, "col": col}, x["matched"]), F.concat(s["out"], F.array(row)))

    def join(s: Column, b: Column) -> Column:
        """The matches of a block behind those of the blocks before it."""
        col = lambda x: x["col"] + F.when(x["line"] == 0, s["col"]).otherwise(0)
        out = F.transform(b["out"], lambda m: F.struct((m["start"] + s["at"]).alias("start"), (m["line"] + s["line"]).alias("line"), col(m).alias("col"), m["matched"].alias("matched"), m["value"].alias("value")))
        return state(s["at"] + b["at"], s["line"] + b["line"], col(b), F.concat(s["out"], out))

    def gathered(r: Column) -> Column:
        n = F.ceil(F.size(r) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(zero, n - 1), lambda k: F.aggregate(F.slice(r, k * BLOCK + 1, BLOCK), state(zero, zero, zero, none), step))
        return F.aggregate(blocks, state(zero, zero, zero, none), join, lambda s: s["out"])

    # a lambda's argument is computed once, however often the body names it
    found = F.get(F.transform(F.array(rows), gathered), zero)
    return F.when(text.rlike(pattern), found).when(text.isNotNull(), none)


def line_of(text: Column, start: Column) -> Column:
    """The 0-based line of a 0-based place."""
    before = text.substr(F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def column_of(text: Column, start: Column) -> Column:
    """The 0-based column, in code points."""
    return F.length(F.substring_index(text.substr(F.lit(1), start), "\n", -1))


def render(template: str, values: dict[str, Column]) -> Column:
    """{{name}} replaced by values; unknown names are left as they are."""
    parts = re.split(r"(\{\{\w+\}\})", template)
    columns = [values[p[2:-2]] if p[:2] == "{{" and p[2:-2] in values else F.lit(p) for p in parts if p]
    return F.concat(*columns) if columns else F.lit("")


def luhn(value: Column) -> Column:
    """A checksum-valid number of 13 to 19 digits, spaces and dashes apart."""
    bare = F.regexp_replace(value, "[ -]", "")
    return F.coalesce(bare.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", bare), F.lit(False))


# Addresses of well-known resolvers.
RESOLVERS = ["1.0.0.1", "1.1.1.1", "4.2.2.1", "4.2.2.2", "8.8.4.4", "8.8.8.8", "9.9.9.9", "208.67.220.220", "208.67.222.222", "149.112.112.112"]


def public_ipv4(value: Column) -> Column:
    """A routable IPv4 address that is no version number, documentation or well-known resolver address."""
    parts = F.split(value, r"\.")
    shaped = value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    n = [F.get(parts, i).try_cast("int") for i in range(4)]
    a, b, c, d = n
    private = (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    special = ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & ((b.isin(18, 19)) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    small = (a < 32) & (b < 32) & (c < 32) & (d < 32)
    whole = (b == 0) & (c == 0) & (d == 0)
    fits = (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    return F.coalesce(shaped & fits & ~value.isin(RESOLVERS) & (a > 2) & ~small & ~whole & ~private & ~special, F.lit(False))


def once(value: Column, body) -> Column:
    """body(value), where a lambda's argument holds the value, so that it is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy(distinct: Column, n: Column, count) -> Column:
    """Entropy in bits from different values, their number and how often each occurs."""
    total = F.aggregate(F.transform(distinct, lambda x: count(x).cast("double")), F.lit(0.0), lambda s, c: s + c * F.log2(c))
    return F.when(n == 0, 0.0).otherwise(F.log2(n.cast("double")) - total / n)


def shannon_of(values: Column) -> Column:
    """Entropy in bits of an array's elements; 0 for an empty one. A pass for each different value, which suits few of them."""
    return once(values, lambda v: entropy(F.array_distinct(v), F.size(v), lambda x: F.size(v) - F.size(F.array_remove(v, x))))


def shannon(text: Column) -> Column:
    """Entropy in bits of the characters of a text; 0 for an empty one. A pass over the text for each different character."""
    chars = lambda s: F.filter(F.array_distinct(F.split(s, "")), lambda x: x != "")
    return once(text, lambda s: entropy(chars(s), F.length(s), lambda x: F.length(s) - F.length(F.replace(s, x, F.lit("")))))


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits and transpositions of neighbours, none edited twice."""
    m = F.length(b)
    first = F.sequence(F.lit(0), m)
    start = F.struct(F.lit(0).alias("i"), first.alias("above"), first.alias("before"))

    def row(s: Column, x: Column) -> Column:
        i = s["i"] + 1
        ca, pa = x, a.substr(i - 1, F.lit(1))

        def cell(r: Column, j: Column) -> Column:
            cb = b.substr(j, F.lit(1))
            change = F.element_at(s["above"], j) + F.when(ca == cb, 0).otherwise(1)
            least = F.least(F.element_at(s["above"], j + 1) + 1, F.element_at(r, -1) + 1, change)
            swap = (i > 1) & (j > 1) & (ca == b.substr(j - 1, F.lit(1))) & (pa == cb)
            both = F.least(least, F.when(swap, F.get(s["before"], j - 2) + 1))
            return F.concat(r, F.array(both))

        cells = F.aggregate(F.filter(F.sequence(F.lit(0), m), lambda j: j > 0), F.array(i), cell)
        return F.struct(i.alias("i"), cells.alias("above"), s["above"].alias("before"))

    chars = F.filter(F.split(a, ""), lambda c: c != "")
    return F.aggregate(chars, start, row, lambda s: F.element_at(s["above"], -1))


# Full-width signs and letters, and accented letters, with what they stand for, from Unicode's decompositions.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
ACCENTED = "".join(chr(c) for c in range(0xE0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0] in "abcdefghijklmnopqrstuvwxyz" and unicodedata.combining(unicodedata.normalize("NFKD", chr(c))[1:2] or "a"))
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)


def fold_lookalikes(name: Column) -> Column:
    """Names that look alike get one form: rn and m, vv and w, 0 and o, 1, | and l, i and l, 5 and s; separators as single dashes.

    Letters with accents stand for those without, full-width ones for usual ones (the compatibility forms of Latin letters).
    """
    s = F.lower(F.translate(name, WIDE, NARROW))
    s = F.translate(s, ACCENTED, PLAIN)
    s = F.replace(F.replace(s, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    s = F.translate(s, "01i|5_ ", "olll" + "s--")
    return F.regexp_replace(s, "-+", "-")


def signal_id(rule_id: Column) -> Column:
    """The signal of a rule: its id up to the first dot after a slash."""
    return F.regexp_extract(rule_id, r"^(?:[^/]*/)?[^.]*", 0)


def registrable(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def under(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.coalesce(F.exists(F.array(*map(F.lit, domains)).cast("array<string>"), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def editor_of(path: Column) -> Column:
    """The editor of an install folder, by its dot folder."""
    return F.regexp_extract(path, r"[/\\]\.([A-Za-z-]+)[/\\]extensions(?:[/\\]|$)", 1)


def version_key(version: Column) -> Column:
    """An orderable version: three numbers; pre-releases before the release."""
    core = F.regexp_extract(version, r"^v?(\d+(?:\.\d+){0,2})", 1)
    part = lambda i: F.coalesce(F.get(F.split(core, r"\."), i).try_cast("int"), F.lit(0))
    pre = F.regexp_extract(version, r"^v?[0-9.]+-([^+]*)", 1)
    # identifiers of a pre-release: numbers by value and before words
    marks = F.transform(F.split(pre, r"\."), lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("word"), F.coalesce(F.when(x.rlike("^[0-9]+$"), x.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("number"), x.alias("text")))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"), (pre == "").alias("release"), marks.alias("pre"))


def round1(x: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def format_duration(ns: Column) -> Column:
    return (
        F.when(ns < 1e3, F.format_string("%.1f ns", ns))
        .when(ns < 1e6, F.format_string("%.2f us", ns / 1e3))
        .when(ns < 1e9, F.format_string("%.2f ms", ns / 1e6))
        .otherwise(F.format_string("%.2f s", ns / 1e9))
    )


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KiB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MiB", n / 1024**2))
        .otherwise(F.format_string("%.1f GiB", n / 1024**3))
    )


SEVERITIES = ("error", "warning", "info", "hint")
LEVELS = ("low", "medium", "high")


def severity_rank(c: Column) -> Column:
    """0 for the gravest."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c) - 1


def level_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), c) - 1


def removal_weight(kind: Column) -> Column:
    """How bad it is that a gallery removed a package for this reason."""
    k = F.lower(kind)
    return F.when(k.rlike("malware|malicious"), 10).when(k.rlike("impersonat|untrustworthy|expired domain|typo"), 6).otherwise(0)


def obfuscator_names(text: Column) -> Column:
    """At least 20 names like _0x1a2b, at least 5 of them different."""
    found = F.regexp_extract_all(text, F.lit(r"_0x[0-9a-f]{4,6}"), F.lit(0))
    return (F.size(found) >= 20) & (F.size(F.array_distinct(found)) >= 5)


#: Stands for an escape. The engine of patterns calls itself for each turn of a loop over a group, but not over a character.
ESCAPE = "\x01"


def escape_density(text: Column) -> Column:
    """The first reason why a text's escapes are suspicious, or null.

    A literal that opens with 40 escapes, 150 literals of nothing but (four or more) escapes, or 500 brackets and signs in a row.
    """
    plain = F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(" ")), r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}", ESCAPE)
    marked = F.when(text.contains("\\x") | text.contains("\\u"), plain)

    def reason(m: Column) -> Column:
        literals = F.regexp_count(m, F.lit(f"(['\"]){ESCAPE}{{4,}}\\1"))
        return F.when(m.rlike(f"['\"`]{ESCAPE}{{40,}}"), "run of escapes").when(literals >= 150, "literals of escapes")

    return F.coalesce(once(marked, reason), F.when(text.rlike(r"[\[\]()!+]{500,}"), "code of brackets"))


def bits_of(response: Column) -> Column:
    """A response of 0 and 1, or hexadecimal, as an array of bits."""
    nibble = lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")
    bare = F.regexp_replace(F.lower(response), "^0x", "")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    text = F.when(response.rlike("^[01]+$"), response).otherwise(F.array_join(F.transform(chars(bare), nibble), ""))
    return F.transform(chars(text), lambda x: x.cast("int"))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def sensitive(name: Column) -> Column:
    """Names of card and authentication data."""
    return snake(name).rlike(r"(^|_)(pan|card_?number|cvv2?|cvc2?|track_?data|pin_?block|cardholder(_name)?|account_?number)($|_)")


def lifetime_seconds(text: Column) -> Column:
    """Seconds of an expiry like expiresIn: 60 * 60 or 15 * time.Minute; null without one."""
    product = F.regexp_extract(text, r"expiresIn['\"]?\s*[:=]\s*([0-9]+(?:\s*\*\s*[0-9]+)*+)", 1)
    seconds = F.aggregate(F.split(product, r"\s*\*\s*"), F.lit(1).cast("long"), lambda s, x: s * x.try_cast("long"))
    amount = F.regexp_extract(text, r"([0-9]+)\s*\*\s*time\.(?:Second|Minute|Hour)", 1).try_cast("long")
    unit = F.regexp_extract(text, r"[0-9]+\s*\*\s*time\.(Second|Minute|Hour)", 1)
    scale = F.when(unit == "Hour", 3600).when(unit == "Minute", 60).when(unit == "Second", 1)
    return F.when(product != "", seconds).otherwise(amount * scale)


# Services that data is sent to or tunnelled through.
EXFIL_HOSTS = r"(?i)(discord(app)?\.com/api/webhooks|api\.telegram\.org/bot|pastebin\.com|transfer\.sh|webhook\.site|ngrok(-free)?\.(io|app|dev)|trycloudflare\.com|pipedream\.net|requestcatcher\.com|interact\.sh|oast\.(pro|live|fun|me|site|online)|\.onion(?![A-Za-z0-9_]))"


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?\[?([^/?#@:\]]+)", 1)), F.lit(""))


def literal_public_ip(host: Column) -> Column:
    """A public IPv4 address as a host: not private, local, reserved, multicast or unspecified."""
    n = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b, c = (F.get(n, F.lit(i)) for i in range(3))
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    whole = host.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$") & (F.array_max(n) <= 255)
    return F.coalesce(whole & ~private, F.lit(False))


def suspicious_target(value: Column) -> Column:
    """Why a URL or host in code is suspicious, or null."""
    host = F.when(value.contains("://"), url_host(value)).otherwise(F.substring_index(value, ":", 1))
    return F.when(value.rlike(EXFIL_HOSTS), "an exfiltration or tunnelling service").when(literal_public_ip(host), "a literal public IP address")


def declared_hosts(manifest: Column) -> Column:
    """Hosts that a manifest (JSON) names as its repository, home page and bug tracker, which may be text or have a url."""

    def raw(key: str) -> Column:
        value, url = F.get_json_object(manifest, f"$.{key}"), F.get_json_object(manifest, f"$.{key}.url")
        return F.coalesce(url, value)

    hosts = F.array(*(url_host(F.regexp_replace(raw(k), r"^git\+", "")) for k in ("repository", "homepage", "bugs")))
    return F.filter(hosts, lambda h: h.isNotNull())


def trace_location(at: Column) -> Column:
    """struct<file, line, col> of a place in a stack trace, ``fn (file:line:col)``, from 0; null if it is none."""
    place = r"\(?([^()]+?):(\d+):(\d+)\)?$"
    part = lambda g: F.regexp_extract(at, place, g)
    number = lambda g: F.greatest(F.lit(0), part(g).try_cast("int") - 1)
    return F.when(at.rlike(place), F.struct(part(1).alias("file"), number(2).alias("line"), number(3).alias("col")))
