"""Rule packs of any size over texts: one search for all rules' literals picks the rules that can match, and only those run.

Each pattern is read for literals of which every match must hold one; a text is searched for all of them at once
(Aho-Corasick), so its cost hardly depends on the number of rules. A rule that does not compile or takes too long is a finding of
severity ``hint`` and stops nothing. Line starts of a text are found once for all rules. Texts go to Python tasks by Arrow and only findings
come back. For few rules whose plan may stay in the JVM see ``rules.scan``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.text import RESOLVERS
from riskframe.operators.rules import IGNORE, Rule, parse_packs
from riskframe.shipping import ship

#: Literals shorter than this pick too many texts to be of use.
LEAST = 3
#: Seconds after which a pattern is given up on a text: a fault of the rule, not a limit of the text.
PATIENCE = 60.0
SCHEMA = pa.schema([("rule_id", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("start", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("matched", pa.string()), ("value", pa.string())])


def shipped_rules(spark: SparkSession) -> list[Rule]:
    """The pack that comes with the library, which only the driver has."""
    path = Path(__file__).resolve().parents[1] / "data" / "code_rules.json"
    return parse_packs(spark, [(path.name, path.read_text("utf-8"))])[0]


def as_python(pattern: str) -> str:
    return re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)


def best(sets: list[frozenset[str] | None]) -> frozenset[str] | None:
    """Of sets of which each is enough, that with the longest shortest literal."""
    found = [s for s in sets if s]
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def literals_of(tree) -> frozenset[str] | None:
    """Texts of which any match of a parsed pattern holds one, in lower case; null if there is no such set."""
    sets: list[frozenset[str] | None] = []
    run = ""
    for op, value in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if name == "AT":
            continue
        if run:
            sets.append(frozenset([run]))
            run = ""
        if name == "SUBPATTERN":
            sets.append(literals_of(value[3]))
        elif name == "ATOMIC_GROUP":
            sets.append(literals_of(value))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            sets.append(literals_of(value[2]))
        elif name == "BRANCH":
            parts = [literals_of(p) for p in value[1]]
            sets.append(None if None in parts else frozenset().union(*parts))
    return best(sets)


def required_literals(rule: Rule) -> frozenset[str] | None:
    """Literals of which a text must hold one, in any case, for the rule to match; null if the rule must always be tried."""
    try:
        from re import _parser

        found = literals_of(_parser.parse(as_python(rule.regex)))
    except (re.error, ImportError, OverflowError, RecursionError):
        return None
    return found if found and min(map(len, found)) >= LEAST else None


def luhn(value: str) -> bool:
    digits = re.sub("[ -]", "", value)
    if not re.fullmatch("[0-9]{13,19}", digits):
        return False
    doubled = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def public_ipv4(value: str) -> bool:
    """As ``functions.text.public_ipv4``."""
    if not re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value) or value in RESOLVERS:
        return False
    a, b, c, d = map(int, value.split("."))
    private = a in (10, 127) or a == 172 and 16 <= b <= 31 or a == 192 and b == 168
    special = a == 100 and 64 <= b <= 127 or a == 169 and b == 254 or a == 192 and b == 0 and c in (0, 2) or a == 198 and (b in (18, 19) or b == 51 and c == 100) or a == 203 and b == 0 and c == 113 or a >= 224
    return max(a, b, c, d) <= 255 and a > 2 and max(a, b, c, d) >= 32 and (b, c, d) != (0, 0, 0) and not private and not special


VALIDATORS = {"luhn": luhn, "publicIpv4": public_ipv4}


class Scanner:
    """A pack in a Python worker: compiled patterns and the automaton of their literals."""

    def __init__(self, rules: list[Rule], patience: float):
        import ahocorasick

        self.rules, self.patience = rules, patience
        self.compiled: dict[str, object] = {}
        self.always, owners = [], {}
        for k, rule in enumerate(rules):
            found = required_literals(rule)
            if rule.kind == "absent" or not found:
                self.always.append(k)
            for literal in found or ():
                owners.setdefault(literal, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, rule_ids in owners.items():
            self.automaton.add_word(literal, tuple(rule_ids))
        if owners:
            self.automaton.make_automaton()
        self.owners = owners

    def pattern(self, text: str):
        """A pattern, compiled once; letters, digits and cases are those of ASCII, as in the JVM."""
        import regex

        found = self.compiled.get(text)
        if found is None:
            try:
                found = regex.compile(text, regex.ASCII | regex.VERSION0)
            except (regex.error, RecursionError, OverflowError) as error:
                found = error
            self.compiled[text] = found
        if isinstance(found, Exception):
            raise found
        return found

    def has(self, pattern: str, text: str) -> bool:
        return self.pattern(pattern).search(text, timeout=self.patience) is not None

    def candidates(self, text: str) -> list[int]:
        if not self.owners:
            return self.always
        found = set(self.always)
        for _, rule_ids in self.automaton.iter(text.lower()):
            found.update(rule_ids)
        return sorted(found)

    def applies(self, rule: Rule, text: str, path: str | None, language: str | None) -> bool:
        if "*" not in rule.languages and language not in rule.languages:
            return False
        if rule.path_pattern and not (path is not None and self.has(rule.path_pattern, path)):
            return False
        if rule.exclude_path_pattern and (path is None or self.has(rule.exclude_path_pattern, path)):
            return False
        if rule.unless and self.has(f"(?m){rule.unless}", text):
            return False
        return not rule.when or self.has(f"(?m){rule.when}", text)

    def found(self, rule: Rule, text: str) -> Iterator[tuple[int, str, str]]:
        """(place, match, value) of a rule in a text that it looks at."""
        if rule.kind == "absent":
            regex_text = rule.regex if rule.flags else f"(?m){rule.pattern}"
            if not self.has(regex_text, text):
                at = self.pattern(rule.anchor_regex).search(text, timeout=self.patience) if rule.anchor else None
                yield (at.start() if at else 0), "", ""
            return
        for m in self.pattern(rule.regex).finditer(text, timeout=self.patience):
            value = m.group(rule.group) if rule.group else m.group()
            if m.group() and (not rule.validate or VALIDATORS[rule.validate](value or "")):
                yield m.start(), m.group(), value or ""

    def unsuppressed(self, text: str, starts: list[int], rows: list[tuple], mark: str) -> list[tuple]:
        """rows without those that a directive of their line, the line before or the whole text names, as ``rules.suppress`` does."""
        pattern = re.compile(re.escape(mark) + IGNORE)
        known: dict[int, tuple[str, set[str]] | None] = {}

        def directive(line: int) -> tuple[str, set[str]] | None:
            if line not in known:
                end = starts[line + 1] - 1 if line + 1 < len(starts) else len(text)
                found = pattern.search(text, starts[line], end) if line >= 0 else None
                known[line] = (found.group(1) or "", set(re.split("[ ,]+", found.group(2)))) if found else None
            return known[line]

        def named(line: int, kind: str, rule_id: str) -> bool:
            found = directive(line)
            return found is not None and found[0] == kind and not found[1].isdisjoint((rule_id, "*"))

        whole = {bisect_right(starts, m.start()) - 1 for m in re.finditer(re.escape(mark) + "ignore-file", text)}
        return [r for r in rows if not (named(r[4], "", r[0]) or r[4] and named(r[4] - 1, "-next-line", r[0]) or any(named(line, "-file", r[0]) for line in whole))]

    def scan(self, text: str, path: str | None, language: str | None, mark: str | None = None) -> list[tuple]:
        out, starts = [], None
        for k in self.candidates(text):
            rule = self.rules[k]
            try:
                if not self.applies(rule, text, path, language):
                    continue
                rows = list(self.found(rule, text))
            except Exception as error:  # a broken rule must not take the others down
                out.append((rule.rule_id, "hint", f"rule {rule.rule_id} failed: {error or type(error).__name__}", 0, 0, 0, "", ""))
                continue
            for at, matched, value in rows:
                if starts is None:
                    starts = [0, *(m.end() for m in re.finditer("\n", text))]
                line = bisect_right(starts, at) - 1
                message = re.sub(r"\{\{(match|value)\}\}", lambda m, x=matched, v=value: x if m.group(1) == "match" else v, rule.message or rule.rule_id)
                out.append((rule.rule_id, rule.severity, message, at, line, at - starts[line], matched, value))
        if out and mark and mark in text:
            out = self.unsuppressed(text, starts or [0, *(m.end() for m in re.finditer("\n", text))], out, mark)
        return out


def scan_pack(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, language_col: str | None = None, disabled: tuple[str, ...] = (), keep: tuple[str, ...] = (), mark: str | None = None, patience: float = PATIENCE) -> DataFrame:
    """Findings of a pack: (id_col, *keep, rule_id, severity, message, start, line, col, matched, value), the same as those of ``rules.scan``.

    With ``mark`` (``lint-``) comments in a text suppress findings as ``rules.directives`` and ``rules.suppress`` do. A null text has none. Without a path or language column, rules that ask for one don't apply, but for languages, which all fit then.
    A rule that fails on a text has one finding there, of severity ``hint`` and with the reason.
    """
    ship(docs.sparkSession)
    rules = [r for r in rules if r.rule_id not in disabled]
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    language = F.col(language_col) if language_col else F.lit("*")
    if not language_col:
        rules = [replace(r, languages=("*",)) for r in rules]
    own = [id_col, *keep]

    def run(batches):
        scanner = Scanner(rules, patience)
        for batch in batches:
            texts, paths, languages = batch.columns[-3:]
            places, out = [], []
            for k in range(batch.num_rows):
                if (text := texts[k].as_py()) is not None:
                    rows = scanner.scan(text, paths[k].as_py(), languages[k].as_py(), mark)
                    places += [k] * len(rows)
                    out += rows
            found = list(zip(*out, strict=True)) if out else [[]] * len(SCHEMA)
            kept = [batch.column(k).take(pa.array(places, pa.int64())) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, f.type) for x, f in zip(found, SCHEMA, strict=True))], [*own, *SCHEMA.names])

    source = docs.select(*own, F.col(text_col).alias("__text"), path.alias("__path"), language.alias("__language"))
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return source.mapInArrow(run, f"{types}, rule_id string, severity string, message string, start int, line int, col int, matched string, value string")
