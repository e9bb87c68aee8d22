"""Secret scan: fixed patterns, and assignments read as a lexer reads them.

The base patterns find what looks like a secret wherever it stands. The lexer reads
source and configuration syntax into (name, literal) pairs, follows names that were
given a literal or another name earlier in the text, joins literals added together,
and scores each literal by how sensitive the name it ends up in is. A literal that
passes is one more span, of kind ``literal``, where the literal itself stands.

What follows an assignment on its line without quotes, up to white space, a comma or
the line end, is a literal too unless it is a known name: .env, INI, properties and
YAML write values so. Calls, ``${...}`` and what opens with a bracket are expressions,
lexed as such; a run ends where a further sensitive name is assigned within it.

A comment is lexed like the rest, but its assignments do not change what code holds.
``//`` after a colon is part of a URL, a quote after a letter an apostrophe.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

#: Fixed values of the contract, in its order: kind, pattern, group that must be long enough, its length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a part of a name is; a name counts as its most sensitive part.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "bearer": 0.8,
    "auth": 0.7, "signature": 0.5,
}
#: Characters of a value put together from several parts, beyond which its quality hardly
#: changes; its spans are those of all parts.
JOINED = 1024
#: Least product of a name's weight and its literal's quality.
LEAST = 0.45
#: No lexer is run on texts without one of these, nor a pattern on texts without any hit of its own filter.
#: A name's parts count together whatever stands between them, so it may stand between all letters.
_NAMES = "(?i)" + "|".join("[^A-Za-z0-9]*".join(k) for k in SENSITIVE if not any(o != k and o in k for o in SENSITIVE))
_FILTER = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

#: Strings by their quote; a single quote before a letter closes none.
_STRINGS = {'"': r'''"(?:[^"\\\n]|\\.)*+"''', "'": r"""'(?:[^'\\\n]|\\.)*+'""", "`": r"`[^`\n]*+`"}
_STRING = {q: re.compile(x) for q, x in _STRINGS.items()}


def _lexer(quotes: str) -> re.Pattern:
    """The lexer for places from which strings in these quotes can close."""
    strings = "|".join(_STRINGS[q] + (r"(?!\w)" if q == "'" else "") for q in quotes)
    return re.compile(
        rf"""(?P<comment>(?<!:)//|\#(?=[\s#!]))
          |(?P<string>(?:(?<!\w)[rRbBuUfF]{{1,2}}|(?<!\w))(?:{strings}))
          |(?P<name>[A-Za-z_$](?:[\w$]|[.-](?=\w))*)
          |(?P<op>:=|=>|==|!=|<=|>=|[:=])
          |(?P<plus>\+)
          |(?P<bare>[0-9][\w+/=.-]*)
          |(?P<nl>\n)
          |(?P<other>[^\s])""",
        re.VERBOSE,
    )


#: By whether double and single quotes are known to stay open up to the end of the line.
_LEXERS = {(d, s): _lexer(("" if d else '"') + ("" if s else "'") + "`") for d in (False, True) for s in (False, True)}
_ASSIGNS = frozenset((":", "=", ":=", "=>"))
#: An unquoted value: to white space or a comma, or to a quote that opens a string.
_OPENS = re.compile(r"""[^\S\n]*(?!(?<!:)//|\#[\s#!]|[rRbBuUfF]{1,2}["'])(?=[^\s,"'`(\[{:=])""")
_RUN = re.compile(r"""(?:[^\s,"'`]|(?<![(\[{=+:<>|&;?])["'`])*+""")
_HEAD = re.compile(r"[A-Za-z_$][\w$.]*+")
#: A name assigned within a run.
_INNER = re.compile(r"(?<![\w$.-])[A-Za-z_$](?:[\w$]|[.-](?=\w))*+(?=[:=])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """Of a name's parts (snake, kebab, dotted or camel case), alone or two together."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *(a + b for a, b in zip(parts, parts[1:]))]), default=0.0)


def quality(literal: str) -> float:
    """0 to 1: short, spaced or monotonous literals are no secrets."""
    n = len(literal)
    if n < 6 or any(c.isspace() for c in literal):
        return 0.0
    counts = Counter(literal)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 3.0) * (0.6 + 0.2 * min(kinds - 1, 2))


class _Runs:
    """Unquoted values of a text. A run that is cut at a name within it is not read again to its end."""

    def __init__(self, text: str):
        self.text, self.end, self.inner = text, 0, -1

    def value(self, at: int, known: dict) -> tuple[int, int]:
        """Start and end of the unquoted value at ``at``; equal if there is none."""
        text, m = self.text, _OPENS.match(self.text, at)
        if not m:
            return at, at
        a = m.end()
        if a >= self.end:
            self.end, self.inner = _RUN.match(text, a).end(), -1
        b = self.end
        if self.inner < a:
            self.inner = next((n.start() for n in _INNER.finditer(text, a, b) if sensitivity(n.group())), len(text))
        if self.inner < b:
            b = self.inner
            while b > a and text[b - 1] in ";&?({[|/":
                b -= 1
            return a, b
        after = text[b : b + 1]
        head = _HEAD.match(text, a, b)
        sign = text[head.end()] if head and head.end() < b else ""
        last = b - 1
        while last > a and text[last] in ";]}":
            last -= 1
        call = sign == "(" and (text[last] == ")" or after not in ("", "\n", "\r"))
        if (after and after in "\"'`") or text.startswith("${", a) or call or (sign == "+" and head.group() in known):
            return at, at
        return a, b


def pairs(text: str, comments: bool = False) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(name, literal, spans of its parts), in the order of the text; those in comments if asked for.

    ``name = "a" + other`` joins what it can read; a name without a known literal
    makes the value unknown. A later assignment replaces an earlier one.
    """
    code: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    # What comments assign, on top of what code does.
    noted: ChainMap[str, tuple[str, list[tuple[int, int]]]] = ChainMap({}, code)
    known, tokens, held = code, [], []

    def end() -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
        i = 0
        while i + 2 < len(tokens):
            (kind, name, *_), (op, sign, *_) = tokens[i], tokens[i + 1]
            if op != "op" or sign not in _ASSIGNS or kind not in ("name", "string", "word"):
                i += 1
                continue
            if kind == "string":
                name = name[1:-1]
            value, spans, j, fine = "", [], i + 2, True
            while j < len(tokens):
                k, t, a, b = tokens[j]
                after = tokens[j + 1][0] if j + 1 < len(tokens) else ""
                if k == "string":
                    value, spans = value + t[1:-1], [*spans, (a + 1, b - 1)]
                elif k in ("name", "word") and (const := t if t in known else t.rstrip(";)]}")) in known:
                    value, spans = value + known[const][0], [*spans, *known[const][1]]
                    # A constant that holds itself several times has each part once.
                    value, spans = (value[:JOINED] if len(spans) > 1 else value), list(dict.fromkeys(spans))
                elif k == "bare" or k == "word" and after not in ("op", "plus"):
                    value, spans = value + t, [*spans, (a, b)]
                else:
                    fine = False
                    break
                j += 1
                if after == "plus":
                    j += 1
                else:
                    break
            if fine and spans:
                known[name] = (value, spans)
                yield name, value, spans
                i = j
            else:
                known.pop(name, None)
                i += 2

    at, runs = 0, _Runs(text)
    # Where the line ends in which a quote is known to close no more: one that is open at a
    # place has only escaped ones after it, which open strings that stay open too.
    open_to = {'"': 0, "'": 0, "`": 0}
    while True:
        if len(tokens) > 1 and tokens[-1][0] == "op" and tokens[-1][1] in _ASSIGNS and tokens[-2][0] in ("name", "string", "word") and tokens[-1][3] == at:
            a, b = runs.value(at, known)
            if a < b:
                tokens.append(("bare" if text[a].isdigit() else "word", text[a:b], a, b))
                at = b
        m = _LEXERS[at < open_to['"'], at < open_to["'"]].search(text, at)
        if not m:
            break
        kind, at = m.lastgroup, m.end()
        if kind == "nl":
            if known is noted:
                yield from end()
                known, tokens = code, held
            # A line that ends in an operator goes on in the next.
            if tokens and tokens[-1][0] not in ("op", "plus"):
                yield from end()
                tokens.clear()
        elif kind == "comment":
            if not comments:
                end_of_line = text.find("\n", at)
                at = end_of_line if end_of_line >= 0 else len(text)
            elif known is code:
                known, held, tokens = noted, tokens, []
            else:
                yield from end()
                tokens.clear()
        else:
            t, a = m.group(), m.start()
            if kind == "other" and t in _STRING and a >= open_to[t] and not _STRING[t].match(text, a):
                line = text.find("\n", a)
                open_to[t] = line if line >= 0 else len(text)
            if kind == "string":
                skip = min(i for i, c in enumerate(t) if c in "\"'`")
                t, a = t[skip:], a + skip
            tokens.append((kind, t, a, at))
            # A line of prose may be long; nothing before a plain word pair matters.
            if len(tokens) > 64 and kind == "other":
                yield from end()
                tokens.clear()
    yield from end()
    if known is noted:
        known, tokens = code, held
        yield from end()


def literals(text: str, comments: bool = False) -> list[tuple[int, int, str, float]]:
    """start, end, name, score of every literal that a sensitive name holds; in comments too if asked for."""
    found: dict[tuple[int, int], tuple[str, float]] = {}
    for name, value, spans in pairs(text, comments):
        weight = sensitivity(name)
        score = weight * quality(value) if weight else 0.0
        if score >= LEAST:
            for span in spans:
                if span[1] > span[0] and score > found.get(span, ("", 0.0))[1]:
                    found[span] = (name, score)
    return [(a, b, *v) for (a, b), v in sorted(found.items())]


def scan_text(text: str, kinds: frozenset[str], lex: bool) -> list[tuple[str, int, int, str | None, float]]:
    """kind, start, end, name, score; by start, then kind. Code points, end exclusive."""
    out = []
    for kind, pattern, group, least in BASE:
        if kind in kinds:
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    out.append((kind, m.start(), m.end(), m.group(1) if kind == "assign" else None, 1.0))
    if lex:
        out += [("literal", a, b, name, score) for a, b, name, score in literals(text, comments=True)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(texts: pa.Array) -> Iterator[list]:
    texts = pc.fill_null(texts, "")
    hits = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in {**_FILTER, "literal": _NAMES}.items()}
    any_hit = sum(hits.values())
    for i in range(len(texts)):
        if any_hit[i]:
            yield scan_text(texts[i].as_py(), frozenset(k for k in _FILTER if hits[k][i]), bool(hits["literal"][i]))
        else:
            yield []


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
_KEYS = ("kind", "start", "end", "name", "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, name, score).

    Every row gives one row, in no order; a null or empty text has no spans; rows
    that share an id, and null ids, stay as they are. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[dict(zip(_KEYS, s)) for s in row] for row in _scan(part["text"])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>", length_col: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans by one.

    Other columns and texts without a finding stay as they are, a null text null.
    ``length_col``, if given, gets a changed text's number of characters.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                texts, changed = part.column(at).to_pylist(), {}
                for i, spans in enumerate(_scan(part.column(at))):
                    if spans:
                        changed[i] = texts[i] = replaced(texts[i], spans, mark)
                columns = list(part.columns)
                if changed:
                    columns[at] = pa.array(texts, part.schema.field(at).type)
                    if length_col is not None:
                        k = part.schema.get_field_index(length_col)
                        lens = columns[k].to_pylist()
                        for i, t in changed.items():
                            lens[i] = len(t)
                        columns[k] = pa.array(lens, part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)


def replaced(text: str, spans: list, mark: str) -> str:
    out, done = [], 0
    for _, start, end, *_ in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op6(spark, sf_dir):
    from .common import table

    rows = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "literal")),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
