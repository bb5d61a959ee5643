"""Secret scans: three base patterns, and assignment-aware lexing that adds what they miss.

The lexer reads source and configuration text as assignments: ``name = "a" + "b"``, ``"name": "x"``, ``name: x``,
``export NAME=x``, ``<name>x</name>``, YAML and triple-quoted blocks, values on the next line. It knows comments,
strings and brackets, and which literal a name stands for: a constant holds until it is assigned anew or its block
ends (a line less indented, a closing brace); in comments, strings and calls none is defined. A literal counts as a
secret if the name that it reaches is sensitive and the literal is neither short, a placeholder nor plain prose.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

#: Where the lexer stops: line ends, quotes, comments, brackets, separators.
STOP = re.compile(r"""\n|["'`]|\#|//|/\*|--|:=|=>|[=:]|[{}()]""")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")
STRING = re.compile(r"""(?s:\"""((?:[^"\\]++|\\.|"(?!""))*+)\"""|\'\'\'((?:[^'\\]++|\\.|'(?!''))*+)\'\'\'|`([^`]*+)`)|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'""")
PREFIX = re.compile(r"[rbfuRBFU]{1,2}(?=[\"'])")
BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>|&+]++""")
BLANK, BLANKS = re.compile(r"[ \t]*+"), re.compile(r"(?:\s|\\\r?\n)*+")
JOIN = re.compile(r"(?:\s|\\\r?\n)*+(?:\+|\.\.)(?![=+])")
NEXT = re.compile(r"[ \t]*+(?::=|=>|[:=](?![=:]))")
BLOCK = re.compile(r"[ \t]*+[|>][-+\d]{0,2}[ \t]*+\r?\n")  # of YAML
BLOCK_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</([A-Za-z_][\w.:-]*+)\s*>")
SETTING = re.compile(r"""\b(?:key|name)[ \t]*+=[ \t]*+["']([\w.:-]++)["']\s++value[ \t]*+=[ \t]*+(?:"([^"\n]*+)"|'([^'\n]*+)')""")  # <add key="x" value="y"/>
REFERENCE = re.compile(r"[A-Za-z_$][\w$.-]*+")
ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)+", re.ASCII)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive the words of a name are; two words that stand together count as one.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "authorization": 2, "auth": 2, "bearer": 2, "pin": 1, "pass": 2, "signature": 1}
SENSITIVE_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("session", "key"), ("auth", "key"), ("account", "key"), ("client", "secret"), ("connection", "string")}
#: Whole literals that stand for a secret, and words without anything else.
PLACEHOLDER = re.compile(r"(?i)\W*(?:change.?me|example|placeholder|dummy|sample|redacted|none|null|nil|true|false|undefined|todo|test|secret|password|your[_ -].*|x{3,}|\*{3,}|\.{3,}|\$\{.*\}|<[^<>]*>|%\(.*\)s|\{\{.*\}\})[\W\d]*", re.DOTALL)
PROSE = re.compile(r"[^\W\d_]+['’]?[^\W\d_]*[.,;:!?]?(?:\s+[^\W\d_]+['’]?[^\W\d_]*[.,;:!?]?){4,}\s*")
LEAST_CHARS, LEAST_SCORE = 8, 4.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]  # a maximal run, as [0-9a-f]+ with 24 or more
    return found


def sensitivity(name: str) -> int:
    """How much a name says that its value is secret."""
    parts = [x.lower() for x in PARTS.findall(name)]
    pairs = zip(parts, parts[1:])
    return max([0, *(SENSITIVE.get(x, 0) for x in parts), *(3 for x in pairs if x in SENSITIVE_PAIRS)])


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_score(value: str) -> float:
    """Up to 3 for a literal that looks random; below 0 for one that can't be a secret."""
    if len(value) < LEAST_CHARS or PLACEHOLDER.fullmatch(value) or PROSE.fullmatch(value):
        return -9.0
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() and c != " " for c in value)
    return min(2.0, entropy(value) / 2) + (classes - 1) / 3


def block_spans(text: str, at: int, place: int) -> list[tuple[int, int]]:
    """The lines of a YAML block that starts at ``place``, of a key whose colon is at ``at``: those indented more."""
    line = text.rfind("\n", 0, at) + 1
    indent = len(BLOCK_LINE.match(text, line)[1])
    found = []
    while place < len(text):
        row = BLOCK_LINE.match(text, place)
        inner = row[2].rstrip()
        if inner and len(row[1]) <= indent:
            break
        if inner:
            found.append((row.start(2), row.start(2) + len(inner)))
        place = row.end()
    return found


Span = tuple[int, int]


class Constants:
    """The literals that names stand for, in nested blocks. None: a name whose value isn't a literal."""

    def __init__(self):
        self.of: dict[str, list[tuple[int, int, list[Span] | None]]] = {}
        self.open: list[tuple[int, int, str]] = []  # indent, braces, name, innermost last

    def define(self, name: str, indent: int, braces: int, spans: list[Span] | None) -> None:
        held = self.of.setdefault(name, [])
        if held and held[-1][:2] == (indent, braces):
            held[-1] = (indent, braces, spans)
        else:
            held.append((indent, braces, spans))
            self.open.append((indent, braces, name))

    def leave(self, indent: int, braces: int) -> None:
        """Ends the blocks that lie deeper."""
        while self.open and (self.open[-1][0] > indent or self.open[-1][1] > braces):
            self.of[self.open.pop()[2]].pop()

    def known(self, name: str) -> bool:
        return bool(self.of.get(name))

    def get(self, name: str) -> list[Span] | None:
        held = self.of.get(name)
        return held[-1][2] if held else None


def _name_before(text: str, at: int) -> tuple[str, int]:
    """The name, quoted or not, that ends before a separator, and its start."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    quote = text[end - 1] if end and text[end - 1] in "\"'" else ""
    end -= len(quote)
    start = end
    while start and text[start - 1] in NAME_CHARS:
        start -= 1
    if quote and text[start - 1 : start] != quote:
        return "", at
    while start < end and text[start] in "0123456789.-":  # where a name can't start
        start += 1
    return text[start:end], start - len(quote)


def _value(text: str, place: int, constants: Constants, nested: bool, run: list[int]) -> tuple[list[Span], bool, bool, int]:
    """What stands behind a separator that ends at ``place``: the spans of its literals, whether it is made of
    literals only, whether one of them is quoted or a constant's, and where it ends. ``run`` is the last bare run."""
    found: list[Span] = []
    literal, sure = True, False
    joined = 0
    while True:
        if joined or nested:
            start = BLANKS.match(text, place).end()
        else:
            start = BLANK.match(text, place).end()
            line = BLANKS.match(text, start).end()
            if text[start : start + 1] in ("\n", "\\", "\r") and STRING.match(text, line):
                start = line  # a literal on the next line
        if text[start : start + 1] == "(" and not found:
            nested, place = True, start + 1
            continue
        if prefix := PREFIX.match(text, start):
            start = prefix.end()
        if string := STRING.match(text, start):
            group = string.lastindex
            found.append(string.span(group))
            place, sure = string.end(), True
            after = (BLANKS if nested else BLANK).match(text, place).end()
            if text[after : after + 1] in ('"', "'") and STRING.match(text, after) and not NEXT.match(text, STRING.match(text, after).end()):
                place, joined = after, joined or 1  # strings that stand side by side
                continue
        elif run[0] <= start < run[1] or (bare := BARE.match(text, start)):
            if not run[0] <= start < run[1]:
                run[:] = bare.span()
            end = run[1]
            if joined and NEXT.match(text, end) and "\n" in text[joined:start]:
                return found, literal, sure, joined  # the next line's own name, as in a patch
            place = end
            if text[place : place + 1] in ("(", "["):
                return found, False, sure, place  # a call or an item
            while end > start and text[end - 1] in ".:":
                end -= 1
            word = REFERENCE.match(text, start)
            word = word[0].rstrip(".") if word and word.end() >= end else ""
            if (spans := constants.get(word)) is not None:
                found += spans
                sure = True
            elif word and (constants.known(word) or ATTRIBUTE.fullmatch(word) or joined):
                literal = False
            elif end > start:
                found.append((start, end))
        else:
            return found, literal and bool(found), sure, place
        more = JOIN.match(text, place)
        if not more:
            return found, literal, sure, place
        joined, place = place, more.end()


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """The literals (start, end, "lexed") that reach sensitive names."""
    found = set()

    def judge(name: str, spans: list[Span]) -> None:
        weight = sensitivity(name)
        if weight and spans and weight + literal_score("".join(text[a:b] for a, b in spans)) >= LEAST_SCORE:
            found.update((a, b, "lexed") for a, b in spans if b > a)

    if "</" in text or "value" in text:
        for m in ELEMENT.finditer(text):
            inner = m[2].strip()
            if m[1] == m[3] and inner:
                start = m.start(2) + m[2].index(inner)
                judge(m[1], [(start, start + len(inner))])
        for m in SETTING.finditer(text):
            judge(m[1], [m.span(m.lastindex)])
    if "=" not in text and ":" not in text:
        return sorted(found)
    constants = Constants()
    place = quoted = remark = braces = brackets = 0  # where a string and a comment end; how deep it is
    indent, run = BLANK.match(text).end(), [-1, -1]
    while stop := STOP.search(text, place):
        sign, (at, place) = stop[0], stop.span()
        if sign == "\n":
            begin = BLANK.match(text, place).end()
            if text[begin : begin + 1] not in ("\n", "\r", "", "#") and at >= quoted:
                indent = begin - place
                brackets = brackets if indent else 0
                constants.leave(indent, braces)
        elif sign in "\"'`":
            if at < quoted or sign != '"' and at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                continue  # inside a string, or an apostrophe
            if string := STRING.match(text, at):
                quoted = string.end()
                place = string.start(string.lastindex)
                if NEXT.match(text, quoted):
                    place = quoted  # a quoted name
        elif sign in ("#", "//", "--", "/*"):
            if at < quoted or at < remark:
                continue
            before, after = text[at - 1 : at], text[place : place + 1]
            if sign == "/*":
                end = text.find("*/", place)
                remark = end if end >= 0 else len(text)
            elif sign == "//" and before != ":" or sign == "#" and (not before or before.isspace()) or sign == "--" and (not before or before.isspace()) and after.isspace():
                end = text.find("\n", place)
                remark = end if end >= 0 else len(text)
        elif sign in "{}()":
            if at >= quoted and at >= remark:
                braces = max(0, braces + (sign == "{") - (sign == "}"))
                brackets = max(0, brackets + (sign == "(") - (sign == ")"))
                constants.leave(indent if sign != "}" else 1 << 60, braces)
        elif at and text[at - 1] in "=!<>:" or text[place : place + 1] in ("=", ":"):
            place += text[place : place + 1] in ("=", ":")
        else:
            name, start = _name_before(text, at)
            if not name:
                continue
            spans, literal, sure, end = _value(text, place, constants, brackets > 0 and at >= quoted, run)
            if sign == ":" and not sure and (more := NEXT.match(text, end)) and "\n" not in text[at:end] and text[more.end() - 1] == "=":
                place = end  # a type stands between the name and its value
                spans, literal, sure, end = _value(text, more.end(), constants, False, run)
            if not spans and sign == ":" and (block := BLOCK.match(text, place)):
                end = block.end()
                spans = block_spans(text, at, end)
                literal = bool(spans)
            if at < quoted:  # inside a string: its own end ends the value
                spans = [x for x in spans if x[1] <= quoted and x[0] >= place]
                literal = False
            judge(name, spans)
            if at >= quoted and at >= remark and not brackets and sign != "=>":
                constants.define(name, indent, braces, list(dict.fromkeys(spans)) if literal and spans else None)
            if spans and sensitivity(name):
                place = max(place, end if at >= quoted else min(end, quoted))  # else the strings are looked into
    return sorted(found)


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans and all spans, each by start and then kind; a lexed one inside a base one adds nothing."""
    text = text or ""
    by_place = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=by_place)
    more = [x for x in lexed_spans(text) if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
    return base, sorted(base + more, key=by_place)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): counts of base spans, their digest and all spans.

    Null and empty texts have no spans, so their digest is that of the empty string. Whole texts are scanned, each by
    itself; rows with equal doc_id each come back; other columns are not used; an empty table gives no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans(text)
                said = lambda x: ",".join(f"{kind}:{a}:{b}" for a, b, kind in x)
                count = Counter(kind for _, _, kind in base)
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), find, SCHEMA)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.load(spark, sf_dir, "documents"))
