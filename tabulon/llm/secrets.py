"""Secret scans: base patterns, and assignment-aware lexing of source and configuration text.

The lexer reads a text once from left to right.  It passes over comments, keeps strings
whole (single, double, back-quoted and triple ones) and takes pairs of a name and a value from:
names, quoted keys and subscripts before an assignment sign (=, :, :=, =>), also with a type
in between; elements `<name>value</name>`; calls whose first two arguments are
strings, or a string and a named argument; `name: N` beside `value: V`; and YAML block scalars; names and
values of a tuple go by their places.  A value is a literal, several that are joined (+,
. or next to each other), or a bare run, which may be the name of a constant; of alternatives (or, ||, ??, a condition's
two values) each counts.  Calls, subscripts and paths of plain words are expressions and no literals; of
a formatted string what stands between its braces is none.  Constants
are resolved over all of a document's pairs, so that `password = a` leads to
the literal of a, wherever `a = "..."` stands.  A literal's score is the
sensitivity of the target's name times the quality of the literal (length, entropy, no
placeholder).  Literals scored 0.5 or more that no base span overlaps become spans of kind
assign; joined ones are one span from the first to the last.

Defined results: null and empty texts have no spans; positions are code points with
exclusive ends; equal rows each get their own spans.  A document is lexed on its own, so
no row depends on another.  A quote or comment that is never closed is passed over.  Work is in
proportion to a text's length.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 and more: shorter runs fail anyway, and a match of a longer one starts at its start.
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What the lexer stops at: comments, strings, elements, signs and marks.
_STOP = re.compile(
    r"""(?P<block>/\*|<!--)|(?P<line>(?:(?<!\S)\#|(?<![:/\w])//|(?<!\S)--(?=\s))[^\n]*)|(?P<string>\"\"\"|\'\'\'|["'`])"""
    r"""|(?P<element><([A-Za-z_][\w:.-]*)(?:\s[^<>]*)?>([^<>]*)</\5\s*>)|(?P<sign>:=|=>|(?<![=!<>~+*/%&|^])=(?![=>~])|:(?![:=]))[ \t]*|(?P<mark>[,;(){}\[\]\n])"""
)
_NAME = re.compile(r"(?<![A-Za-z0-9_.$-])[0-9.$-]*+([A-Za-z_][A-Za-z0-9_.-]*+)\??[ \t]*$")
#: A type between a name's colon and its equals sign, as in `name: Optional[str] = "..."`.
_TYPE = re.compile(r"(?:&[ \t]*+)?(?:'[a-z_]++[ \t]++)?(?:mut[ \t]++|const[ \t]++)?[A-Za-z_]\w*+(?:(?:\.|::)\w++)*+(?:[ \t]*+[\[<](?:[\w.,|&?'\[\]<> \t]|::)*[\]>])?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+\??[ \t]*+=(?![=>])[ \t]*+")
_STRINGS = {
    '"""': re.compile(r'"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}', re.S), "\'\'\'": re.compile(r"'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}", re.S),
    '"': re.compile(r'"((?:[^"\\\n]|\\.)*+)"'), "'": re.compile(r"'((?:[^'\\\n]|\\.)*+)'"), "`": re.compile(r"`([^`\n]*+)`"),
}
_PREFIX = re.compile(r"(?i)(?:[rbfu]{1,2})?(?=[\"'`])")
_BARE = re.compile(r"""(?:(?i:bearer|basic)[ \t]+)?([^\s,;"'`()\[\]{}<>=]+(?:={1,2}(?![^\s,;"'`()\[\]{}<>]))?)""")
_PLUS = re.compile(r"\s*\+\s*|[ \t]*\.\.?[ \t]*(?=[\"'])")
#: What parts alternatives: `a or "b"`, and a condition's two values.
_OR = re.compile(r"[ \t]*(?:\bor\b|\|\||\?\?)[ \t]*")
_ASK, _ELSE = re.compile(r"[ \t]*\?[ \t]*(?![.?:])"), re.compile(r"[ \t]*:[ \t]*")
_SUBSCRIPT = re.compile(r"(?:\[[^\[\]\n]*+\])+")
#: A path of plain words, as in settings.db.password, is no literal.
_PATH = re.compile(r"[A-Za-z_]+(?:(?:\.|->|::)[A-Za-z_]+)+$")
_FILLED = re.compile(r"\{[^{}\n]*+\}")
#: Names before a type without a colon, as in Go's `var name string =`.
_DECLARED = re.compile(r"(?:^|\s)(?:var|const|let|static|final)[ \t]+([A-Za-z_]\w*+)[ \t]+[\w.\[\]*]++[ \t]*$")
#: Names that are assigned together, but for the last one.
_TUPLE = re.compile(r"(?:^|[\n;])[ \t]*+((?:[A-Za-z_][\w.]*+[ \t]*+,[ \t]*+)++)[A-Za-z_][\w.]*+[ \t]*$")
#: So far back names of a tuple are looked for.
_BACK = 200
_COMMA = re.compile(r"[ \t]*,[ \t]*")
_BESIDE = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?=[\"'])")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\n")
_ARMOUR = re.compile(r"-----[^\n]*-----$")

#: Parts of names and how sensitive a target of that name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0,
    "encryptionkey": 1.0, "sessionkey": 0.9, "authkey": 1.0, "auth": 0.7, "authorization": 0.7, "bearer": 0.8, "pass": 1.0,
}
#: Pieces of which every sensitive name holds one.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|placeholder|none|null|true|false|undefined|todo|your[_-].*|\$\{.*|\{\{.*|<.*|%.*%)$")


def sensitivity(name: str) -> float:
    """The best weight of the name's parts, one or two joined (camelCase, _, - and . part them)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", name)]
    joined = [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def quality(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret."""
    n = len(literal)
    if n < 8 or " " in literal or _PLACEHOLDER.match(literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.0) * (1.0 if classes >= 2 else 0.4)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns' matches, kind: place in KINDS."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


Value = tuple[str, int, int, bool]


def _apart(at: int) -> Value:
    """Stands between pieces of a value that are not joined."""
    return "", at, at, True


class _Lexer:
    """The name-value pairs of one text."""

    def __init__(self, text: str):
        self.text, self.pairs, self.named = text, [], ""
        self.dead = {}  # quote -> up to where no string of it closes

    def string(self, at: int, quote: str) -> re.Match | None:
        """The string that a quote at `at` opens, if it is one and closes."""
        if at < self.dead.get(quote, 0):
            return None
        if quote == "'" and at and self.text[at - 1].isalnum():
            first = at - 1
            while first and at - first < 3 and self.text[first - 1].isalnum():
                first -= 1
            if at - first > 2 or self.text[first:at].strip("rbfuRBFU"):
                return None  # an apostrophe
        found = _STRINGS[quote].match(self.text, at)
        if not found:
            end = self.text.find("\n", at) if len(quote) == 1 else -1
            self.dead[quote] = end if end >= 0 else len(self.text)
        return found

    def literal(self, at: int) -> tuple[list[Value], int] | None:
        """The pieces of the string at `at`, past a prefix, and where it ends: one, or those between what a formatted string fills in."""
        prefix, at = (m[0], m.end()) if (m := _PREFIX.match(self.text, at)) else ("", at)
        if at >= len(self.text) or self.text[at] not in "\"'`":
            return None
        quote = self.text[at] * 3 if self.text.startswith(self.text[at] * 3, at) and self.text[at] != "`" else self.text[at]
        m = self.string(at, quote)
        if not m:
            return None
        pieces, first = [], m.start(1)
        for hole in _FILLED.finditer(self.text, m.start(1), m.end(1)) if "f" in prefix.lower() or quote == "`" else ():
            pieces += [(self.text[first : hole.start()], first, hole.start(), False), _apart(hole.start())]
            first = hole.end()
        return [*pieces, (self.text[first : m.end(1)], first, m.end(1), False)], m.end()

    def value(self, at: int) -> tuple[list[Value], int]:
        """The pieces of the value at `at`, and where it ends."""
        pieces = []
        while self.text.startswith("(", at):
            at += 1
            while at < len(self.text) and self.text[at].isspace():
                at += 1
        while True:
            if found := self.literal(at):
                pieces += found[0]
                at = found[1]
            elif m := _BARE.match(self.text, at):
                whole = m[1].rstrip(".:") or m[1]
                if pieces and not whole[0].isalpha() and whole[0] != "_":
                    return pieces, at
                at = m.start(1) + len(whole)
                if self.text.startswith("(", at):
                    # A call: its arguments are read on their own.
                    return pieces, at
                subscript = _SUBSCRIPT.match(self.text, at)
                # What is looked up is no literal, nor is a condition.
                if subscript or _PATH.match(whole):
                    pieces.append(_apart(at))
                    at = subscript.end() if subscript else at
                else:
                    pieces.append((whole, m.start(1), at, True))
                if ask := _ASK.match(self.text, at):
                    first, end = self.one(ask.end())
                    if first and (other := _ELSE.match(self.text, end)):
                        last, end = self.one(other.end())
                        return [*pieces[:-1], *first, _apart(end), *last], end
            else:
                return pieces, at
            if other := _OR.match(self.text, at):
                pieces.append(_apart(at))
                at = other.end()
                continue
            joiner = _PLUS.match(self.text, at) or (not pieces[-1][3] and _BESIDE.match(self.text, at)) or None
            if not joiner:
                return pieces, at
            at = joiner.end()

    def placed(self, start: int, name: str, at: int) -> tuple[list[tuple[str, list[Value]]], int] | None:
        """Names and values by their places, of `a, b = x, y` whose sign is at `start`; nothing if there are not as many."""
        m = _TUPLE.search(self.text[max(0, start - _BACK) : start])
        if not m:
            return None
        out = []
        for other in (*re.findall(r"[A-Za-z_][\w.]*", m[1]), name):
            pieces, at = self.value(at)
            out.append((other, pieces))
            if not (comma := _COMMA.match(self.text, at)):
                break
            at = comma.end()
        # The last value may be a call.
        whole = all(p for _, p in out[:-1]) and (out[-1][1] or self.text.startswith("(", at))
        return (out, at) if len(out) == m[1].count(",") + 1 and whole else None

    def one(self, at: int) -> tuple[list[Value], int]:
        """The literal or bare run at `at`, and where it ends."""
        if found := self.literal(at):
            return found
        m = _BARE.match(self.text, at)
        return ([(m[1], m.start(1), m.end(1), True)], m.end(1)) if m else ([], at)

    def scalar(self, name_at: int, at: int) -> tuple[list[Value], int]:
        """A YAML block scalar whose lines start at `at`: those indented deeper than the line of the name."""
        line = self.text.rfind("\n", 0, name_at) + 1
        indent = len(self.text[line:name_at]) - len(self.text[line:name_at].lstrip(" -"))
        lines, first, last = [], None, at
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            row = self.text[at:end]
            if row.strip():
                deep = len(row) - len(row.lstrip(" "))
                if deep <= indent:
                    break
                if not _ARMOUR.match(row.strip()):
                    lines.append(row.strip())
                    first, last = (at + deep if first is None else first), at + len(row.rstrip())
            at = end + 1
        return ([("".join(lines), first, last, False)] if lines else []), min(at, len(self.text))

    def add(self, name: str, pieces: list[Value]) -> None:
        if not pieces:
            return
        self.pairs.append((name, pieces))
        low = name.lower()
        if low in ("name", "key"):
            self.named = pieces[0][0]
        elif low == "value" and self.named:
            self.pairs.append((self.named, pieces))
            self.named = ""

    def run(self) -> list[tuple[str, list[Value]]]:
        text, at, before = self.text, 0, 0  # before: where the text since the last stop begins
        key = None  # (content, end) of a string that a sign may follow
        call, argument = 0, ""  # of a call: 1 after "(", 2 after a first string, 3 after its comma
        while m := _STOP.search(text, at):
            kind, start, at = m.lastgroup, m.start(), m.end()
            gap = text[before:start]
            if kind == "block":
                end = text.find("*/" if m[0] == "/*" else "-->", at) if at >= self.dead.get(m[0], 0) else -1
                if end < 0:
                    self.dead[m[0]] = len(text)
                else:
                    at = end + (2 if m[0] == "/*" else 3)
            elif kind == "string":
                found = self.string(start, m[0])
                if not found:
                    at = start + len(m[0])
                    key, call = None, 0
                else:
                    at, content = found.end(), found[1]
                    if call == 1 and not gap.strip():
                        call, argument = 2, content
                    elif call == 3 and not gap.strip():
                        pieces, at = self.value(start)
                        self.add(argument, pieces)
                        call = 0
                    else:
                        call = 0
                    key = (content, at)
            elif kind == "element":
                body = m[6]
                inner = body.strip()
                if inner:
                    first = m.start(6) + len(body) - len(body.lstrip())
                    self.add(m[5], [(inner, first, first + len(inner), False)])
                key, call = None, 0
            elif kind == "sign":
                # A named argument after a first string, as in getenv("NAME", default="...").
                asked, call = (argument if call == 3 else ""), 0
                quoted = key and not text[key[1] : start].strip(" \t]")
                name = key[0] if quoted else (n[1] if (n := _DECLARED.search(gap) or _NAME.search(gap)) else None)
                key = None
                if name and not quoted and "=" in m["sign"] and text.startswith(",", before - 1) and (several := self.placed(start, name, at)):
                    for other, pieces in several[0]:
                        self.add(other, pieces)
                    at = max(at, several[1])
                elif name:
                    if m["sign"] == ":" and (typed := _TYPE.match(text, at)):
                        at = typed.end()
                    if m["sign"] == ":" and (block := _BLOCK.match(text, at)):
                        pieces, at = self.scalar(start, block.end())
                    else:
                        pieces, end = self.value(at)
                        # The value of one sign is the name of the next in a = b = "...".
                        if len(pieces) == 1 and pieces[0][3]:
                            before = pieces[0][1]
                            self.add(name, pieces)
                            at = max(at, end)
                            continue
                        at = max(at, end)
                    self.add(name, pieces)
                    if asked:
                        self.add(asked, pieces)
            elif kind == "mark":
                if m[0] == "(":
                    call = 1
                elif m[0] == "," and call == 2 and not gap.strip():
                    call = 3
                elif m[0] != "\n":
                    call = 0
                key = key if m[0] in "]\n" and key and not gap.strip() else None
            before = at
        return self.pairs


def assignments(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, value, start, end, bare) of each pair; literals that are joined are one value, a bare value may be the name of a constant."""
    out = []
    for name, pieces in _Lexer(text).run():
        run = []
        for piece in [*pieces, None]:
            if piece is not None and not piece[3]:
                run.append(piece)
                continue
            if run:
                out.append((name, "".join(x[0] for x in run), run[0][1], run[-1][2], False))
                run = []
            if piece is not None:
                out.append((name, *piece))
    return out


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, 0) of the literals whose targets are sensitive, after constants are propagated.

    A bare value stands for all literals that any assignment of the document gives to that
    name, directly or over other names; one without a literal is judged itself.
    """
    low = text.lower()
    if not any(x in low for x in _HINTS):
        return []
    found = assignments(text)
    if not found:
        return []
    named = {name for name, *_ in found}
    users = {}  # name -> names that take their values from it
    for name, value, _, _, bare in found:
        if bare and value in named:
            users.setdefault(value, []).append(name)
    held = set()  # names that a literal reaches
    todo = [name for name, value, _, _, bare in found if not (bare and value in named)]
    while todo:
        n = todo.pop()
        if n not in held:
            held.add(n)
            todo += users.get(n, ())
    linked = {}  # name -> names it takes its values from
    literal = {}  # name -> (value, start, end) of its own literals
    for name, value, start, end, bare in found:
        if bare and value in held:
            linked.setdefault(name, set()).add(value)
        else:
            literal.setdefault(name, set()).add((value, start, end))
    # The best weight of a name reaches the names that it takes its values from, highest first.
    best = {}
    for weight, name in sorted(((sensitivity(n), n) for n in named), reverse=True):
        todo = [name] if weight > 0 else []
        while todo:
            n = todo.pop()
            if n not in best:
                best[n] = weight
                todo += linked.get(n, ())
    out = {(start, end, 0) for n, weight in best.items() for value, start, end in literal.get(n, ()) if weight * quality(value) >= 0.5}
    return sorted(out)


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that no base span (in order of start) overlaps."""
    starts, ends, most = [x[0] for x in base], [], 0
    for x in base:
        most = max(most, x[1])
        ends.append(most)
    # Of the base spans that start before a span's end, the one that reaches furthest tells.
    return [x for x in spans if not (i := bisect_left(starts, x[1])) or ends[i - 1] <= x[0]]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans as arrays of (start, end, kind), kind: place in KINDS, ordered by start, then kind."""
    from pyspark.sql import functions as F

    item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))

    def each(batches):
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                b = base_spans(text)
                more = apart(lexed_spans(text), b)
                base.append([dict(zip(("start", "end", "kind"), x, strict=True)) for x in b])
                spans.append([dict(zip(("start", "end", "kind"), x, strict=True)) for x in sorted(b + more, key=lambda x: (x[0], x[2]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, item), pa.array(spans, item)], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:int,end:int,kind:int>>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(each, f"doc_id {kind}, base {spans}, spans {spans}")
