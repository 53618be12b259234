"""Secret scans: fixed patterns, and assignment-aware lexing.

The base patterns find assignments, access keys and long hex runs. Lexing adds
literals: source and configuration text is read as assignments, blocks (braces, or
deeper lines of a nested configuration), and elements of markup, which give pairs
of a target name and a value; so do macros, flags, subscripts, and calls with a
name and a literal for arguments. A value is a quoted literal (with a prefix, in triple
quotes, over lines), a bare one, a name whose constant is known, or a sum of such;
constants are carried forward through the text. What a string holds is read again
for assignments of its own. A bare literal ends at a blank, a quote, a bracket, a
comma, a semicolon, or where the next field of a query begins; signs within it are
its own, also a plus, unless a known name or a quote stands beside it. A bare run
that reads as a name made of words (read_config, tokenSource, a.b) is a name, and
an unknown name is no literal, but in a shell's assignment; a single word is a
literal. Lines of a key in PEM form are one literal. A target that says
nothing itself (value, data) is called what its block is called. Values are kept as
counts of their characters and as references to their parts, so that no length is
bounded and sums of sums do not grow. A literal is scored by how sensitive its
target's name is and by its length, variety and mix of characters; one with blanks
counts where the target is a phrase. The span of the literal that a sensitive target
receives is reported wherever the literal stands.

Nulls count as empty texts: no spans, and the digest of the empty string.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, table

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run is matched whole, so that shorter runs need no look
#: How sensitive a part of a target's name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "pw": 0.9, "private": 0.7, "auth": 0.7, "bearer": 0.8, "key": 0.7, "salt": 0.7, "signature": 0.7, "dsn": 0.7,
}
#: Parts that make a name harmless: it names something about a secret, or a placeholder.
HARMLESS = {"public", "length", "len", "count", "size", "name", "path", "file", "url", "type", "id", "expiry", "ttl", "limit", "field", "label", "hint"}
PLACEHOLDERS = re.compile(r"(?i)^(x+|\*+|\.+|changeme|example|placeholder|none|null|true|false|undefined|your[_-].*|<.*>|\$\{.*\}|todo)$")
#: The placeholders of any length that are not one character repeated.
ENCLOSED = re.compile(r"(?i)^(your[_-].*|<.*>|\$\{.*\})$")
#: Names that say only that a value follows, and names of secrets that hold blanks.
GENERIC = {"value", "data", "default", "content", "text", "string", "literal", "val", "raw", "plain"}
PHRASES = {"passphrase", "mnemonic", "phrase"}
#: A brace, an element of markup, a macro, a name and a literal as arguments, or an assignment: a dotted, quoted or subscript name or a flag, perhaps with a type, then = or : or =>, at a place where a statement or an entry can begin.
LEX = re.compile(
    r"""(?P<open>\{)|(?P<close>\})|<(?P<tag>[A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>(?P<inner>[^<>]++)</|\#[^\S\n]*+define[^\S\n]++(?P<macro>[A-Za-z_]\w*+)[^\S\n]++"""
    r"""|(?<=[(,])\s*+["'](?P<arg>[A-Za-z_][\w.-]*+)["']\s*+,\s*+(?=["'`])"""
    r"""|(?P<target>(?:(?<![\w.$-])|(?<=[\s"'(,\[]--))["']?(?P<name>[A-Za-z_][\w.$-]*+)["']?\s*+(?:\]\s*+)?+"""
    r"""(?::=|=>|=(?!=)|:(?![:/])(?:[^\S\n]*+[A-Za-z_][\w.]*+(?:\[[^\n="':]*\])?+(?:[^\S\n]*+\|[^\S\n]*+[A-Za-z_][\w.]*+)*+[^\S\n]*+=(?!=))?+)[^\S\n]*+)"""
)
#: What makes a bare value a literal of its own, whatever it reads like: a shell's assignment.
SHELL = re.compile(r"(?:^|[\s;&])(?:export|declare|setenv|ENV)[^\S\n]+(?:-\w+[^\S\n]+)*$")
VALUE = re.compile(
    r"""(?:[rRbBuUfF]{1,2}(?=["']))?+(?P<quoted>\"""(?:[^"\\]|\\[\s\S]|"(?!""))*+\"""|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
    r"""|(?P<call>[A-Za-z_][\w.]*+\()|(?P<bare>(?:[^\s"',;(){}\[\]&`]|&(?![A-Za-z_][\w.$-]*+=))++)"""
)
#: A name made of words, by their signs or by their humps.
NAME = re.compile(r"_*(?:[A-Za-z]{2,}[0-9]{0,2}|[0-9]{1,2})(?:[_.]+(?:[A-Za-z]{2,}[0-9]{0,2}|[0-9]{1,2}))+_*|(?:[a-z]{3,}|[A-Z][a-z]{2,})[0-9]{0,2}(?:[A-Z][a-z]{2,}[0-9]{0,2})+")
#: Signs of sums, and of a value that stands in for another one.
JOIN = re.compile(r"[^\S\n]*+(?:[+.]|\|\||\?\?|or\b)[^\S\n]*+")
#: What a sum can go on with.
OPERAND = re.compile(r"""[^\S\n]*+["'A-Za-z_]""")
#: Strings in strings are read again so deep: deeper than there are kinds of quotes, which no string holds of its own kind.
DEPTH = 8
#: Of a longer value, this much of either end is looked at for placeholders.
END = 32


@lru_cache
def stems(names: tuple[str, ...]) -> re.Pattern:
    """Finds every text in which one of the names, also as two parts, can stand."""
    each = ["[^a-z0-9]*".join(map(re.escape, n)) for n in sorted(names, key=len, reverse=True)]
    return re.compile("(?i)" + "|".join(each)) if each else re.compile("(?!)")


def words_of(name: str) -> list[str]:
    """The words of a name, by signs and by humps, in lower case."""
    return [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if p]


class Value:
    """What is known of a value that may be a sum: counts of its characters, their number, its ends, and its parts (spans and other values' parts)."""

    def __init__(self):
        self.counts, self.n, self.head, self.tail = Counter(), 0, "", ""
        self.parts: list = [False]  # whether reported, then the parts

    def add(self, value: str, part: tuple[int, int]) -> None:
        self._join(Counter(value), len(value), value[: 2 * END], value[-END:])
        self.parts.append(part)

    def extend(self, other: Value) -> None:
        self._join(other.counts, other.n, other.head, other.tail)
        self.parts.append(other.parts)

    def _join(self, counts: Counter, n: int, head: str, tail: str) -> None:
        self.counts.update(counts)
        self.n, self.head, self.tail = self.n + n, (self.head + head)[: 2 * END], (self.tail + tail)[-END:]

    def placeholder(self) -> bool:
        if self.n <= 2 * END:
            return bool(PLACEHOLDERS.match(self.head))
        return len({c.lower() for c in self.counts}) == 1 and bool(PLACEHOLDERS.match(self.tail)) or bool(ENCLOSED.match(self.head + self.tail))

    def report(self, found: set) -> None:
        """Adds the spans; parts that were reported before are not walked again."""
        todo = [self.parts]
        while todo:
            parts = todo.pop()
            if not parts[0]:
                parts[0] = True
                found.update(x for x in parts[1:] if isinstance(x, tuple) and x[1] > x[0])
                todo += [x for x in parts[1:] if isinstance(x, list)]


@dataclass(frozen=True)
class SecretScan:
    #: A literal is reported from this score on.
    threshold: float = 0.55
    min_length: int = 8
    weights: dict = field(default_factory=lambda: SENSITIVE)

    def name_score(self, name: str) -> float:
        """How sensitive a target name is: its most sensitive part, nothing if a part makes it harmless."""
        parts = words_of(name)
        if not parts or HARMLESS & set(parts):
            return 0.0
        joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
        return max((self.weights.get(p, 0.0) for p in [*parts, *joined]), default=0.0)

    def literal_score(self, value: str) -> float:
        """How much a literal looks like a generated value: from 0 to 1."""
        whole = Value()
        whole.add(value, (0, len(value)))
        return self.value_score(whole)

    def value_score(self, value: Value, blanks: bool = False) -> float:
        lines, armoured = "\n" in value.counts, "-----BEGIN " in value.head  # lines of a key bear no blanks but in its first and last one
        if value.n < self.min_length or value.placeholder() or " " in value.counts and not armoured and (lines or not blanks):
            return 0.0
        shares = [x for c in value.counts.values() if (x := c / value.n)]
        entropy = -sum(x * math.log2(x) for x in shares)
        kinds = sum(any(f(c) for c in value.counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value.counts)
        return min(1.0, 0.35 * min(entropy / 3.5, 1) + 0.35 * min(kinds / 3, 1) + 0.3 * min(value.n, 20) / 20)

    def literals(self, text: str) -> list[tuple[int, int]]:
        """Spans of the literals that reach a sensitive target, constants carried forward."""
        if not stems(tuple(self.weights)).search(text):  # without a sensitive name there is nothing to report
            return []
        known: dict[str, Value] = {}
        found: set[tuple[int, int]] = set()
        blocks: list[tuple[int | None, str]] = []  # indent (none for braces) and name of the open blocks
        last, at = "", 0  # the name that an opening brace belongs to
        line, seen = 0, 0  # where the present line begins, and what was searched for its beginning
        inside: list[int] = []  # ends of the strings that are read again
        while token := LEX.search(text, at):
            at = token.end()
            fresh = not seen
            if (broken := text.rfind("\n", seen, token.start())) >= 0:
                line, fresh = broken + 1, True
            seen = token.start()
            while inside and seen >= inside[-1]:
                inside.pop()
            if token["open"]:
                blocks.append((None, last))
                last = ""
            elif token["close"]:
                while blocks and blocks.pop()[0] is not None:
                    pass
            elif token["tag"]:
                value, inner = Value(), token["inner"].strip()
                start = token.start("inner") + len(token["inner"]) - len(token["inner"].lstrip())
                value.add(inner, (start, start + len(inner)))
                self._weigh(token["tag"], value, found)
                at = token.end("inner")
            elif name := token["macro"] or token["arg"]:
                at = self._value(text, at, name, name, known, found, inside)
            else:
                name = last = token["name"]
                if fresh and not text[line:seen].strip(" \t-"):  # the first of its line: deeper lines before it are over
                    while blocks and blocks[-1][0] is not None and blocks[-1][0] >= seen - line:
                        blocks.pop()
                    if text[at : at + 1] in ("\n", "\r"):
                        blocks.append((seen - line, name))
                own = blocks[-1][1] if blocks and set(words_of(name)) <= GENERIC else name
                shell = text[at - 1] == "=" and SHELL.search(text[max(line, seen - 40) : seen]) is not None
                at = self._value(text, at, own, name, known, found, inside, shell)
        return sorted(found)

    def _value(self, text: str, at: int, own: str, name: str, known: dict[str, Value], found: set, inside: list[int], shell: bool = False) -> int:
        """Reads the value at a place, for the target name that counts as own, and returns where reading goes on."""
        value, again = Value(), None
        while part := VALUE.match(text, at, *inside[-1:]):
            at = part.end()
            if part["call"]:
                break
            if part["quoted"]:
                size = 3 if len(part["quoted"]) > 5 and part["quoted"][:3] in ('"""', "'''") else 1
                a, b = part.start("quoted") + size, part.end() - size
                value.add(text[a:b], (a, b))
                if again is None and len(inside) < DEPTH and ("=" in part["quoted"] or ":" in part["quoted"]):
                    again = a
            elif self._bare(text, part[0], part.start(), known, value, shell):  # a sign of a sum ends it
                at += len(OPERAND.match(text, at)[0]) - 1
                continue
            if not (plus := JOIN.match(text, at, *inside[-1:])):
                break
            at = plus.end()
        if len(value.parts) > 1:
            known[name] = value
            self._weigh(own, value, found)
        if again is not None:  # strings may hold assignments of their own
            inside.append(at)
            return again
        return at

    def _weigh(self, name: str, value: Value, found: set) -> None:
        score = self.name_score(name)
        if score >= self.threshold and score * self.value_score(value, bool(PHRASES & set(words_of(name)))) >= self.threshold:
            value.report(found)

    @staticmethod
    def _bare(text: str, run: str, at: int, known: dict[str, Value], value: Value, shell: bool = False) -> bool:
        """Adds a bare run to value: a known constant, a sum with one in it, or a literal; in a shell what reads as a name is one too. Returns whether a sign of a sum ends it."""
        more = run[-1] in "+." and OPERAND.match(text, at + len(run)) is not None
        if more and (run[-1] == "+" or run[:-1] in known):
            run = run[:-1]
        else:
            more = False
        parts = run.split("+")
        if not any(p in known for p in parts):
            parts = [run]
        for p in parts:
            if p in known:
                value.extend(known[p])
            elif p and (shell or not NAME.fullmatch(p)):
                value.add(p, (at, at + len(p)))
            at += len(p) + 1
        return more

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns."""
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)


def scan(docs: DataFrame, settings: SecretScan = SecretScan(), column: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts by kind, the base digest, and all spans in code points, by start and then kind as listed."""

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for text in batch.column(column).to_pylist():
                text = text or ""
                base = settings.base(text)
                every = sorted({*base, *((a, 3, b) for a, b in settings.literals(text))})
                counts = Counter(k for _, k, _ in base)
                rows.append((counts[0], counts[1], counts[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return docs.select(key, column).mapInArrow(run, f"{key} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def op4_secret_names(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
