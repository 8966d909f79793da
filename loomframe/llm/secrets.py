"""Secret scans: fixed credential patterns plus an assignment-aware lexer with constant propagation."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, map_rows

#: Kinds in the order in which spans that start together are listed; the first three are the fixed patterns.
KINDS = ("assign", "access", "hex", "named")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as all runs of which the short ones are dropped

# The lexer. An operator is found first, since prose has few; the name is read backwards from it.
_OPERATOR = re.compile(r":=|=>|[:=]")
_NAME_END = re.compile(r"[A-Za-z0-9_.\-]*\Z")
_LITERAL = re.compile(r"""[\x20\t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([^\s,;#"'`(){}\[\]<>|=:]+))""")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")

#: Weights of words within a target's name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.6, "key": 0.5, "access": 0.4,
    "signature": 0.4, "salt": 0.4, "cookie": 0.4, "session": 0.4, "pin": 0.4,
}
#: Just under the score of a wholly random literal under the weakest name.
THRESHOLD = 0.62


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed kind; a match that fails its length is dropped."""
    out = []
    folded = text.lower()  # only tells whether any name occurs
    if any(w in folded for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def pairs_of(text: str) -> list[tuple[str, str, int, int]]:
    """(name, literal, start, end of the literal) of each assignment, by position: `name = "x"`, `name: x`,
    `"name": "x"`, `name := x`, `"name" => "x"`."""
    out = []
    for op in _OPERATOR.finditer(text):
        at = op.start()
        while at and text[at - 1] in " \t":
            at -= 1
        if at and text[at - 1] in "\"'":
            at -= 1
        begin = at
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.-"):
            begin -= 1
        name = text[begin:at]
        if not name or not (name[0].isalpha() or name[0] == "_"):
            continue
        m = _LITERAL.match(text, op.end())
        if m and m[m.lastindex]:
            out.append((name, m[m.lastindex], m.start(m.lastindex), m.end(m.lastindex)))
    return out


def name_score(name: str) -> float:
    """0 to 1: how sensitive a target's name is, from its words (camelCase, snake_case and dots part them)."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    hits = [SENSITIVE[w] for w in {*words, *joined} if w in SENSITIVE]
    return min(1.0, max(hits, default=0.0) + 0.2 * (len(hits) > 1))


def literal_score(value: str) -> float:
    """0 to 1: how far the value looks random: its information (length times entropy a character) against 64 bits, in
    full where letters and digits mix; words or figures alone count 0.7 from 20 characters on, 0.4 below."""
    n = len(value)
    if n < 8 or " " in value:
        return 0.0
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    mixed = any(map(str.isdigit, value)) and any(map(str.isalpha, value))
    return min(1.0, bits / 64) * (1.0 if mixed else 0.7 if n >= 20 else 0.4)


def named_spans(text: str, threshold: float) -> list[tuple[str, int, int, float]]:
    """Literals whose score, the geometric mean of their target's name and of their own look, reaches the threshold.

    A random literal reaches it under any listed name, a long passphrase of plain letters under a strong one.

    A name bound to a literal is a constant; where a sensitive target is bound to that name later, the sensitive
    name's score passes back to the constant's literal (through chains of names too).
    """
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, tuple[str, int, int]] = {}
    best: dict[tuple[int, int], float] = {}
    for name, value, start, end in pairs_of(text):
        source = constants.get(value) if _IDENTIFIER.match(value) else None
        literal, a, b = source or (value, start, end)
        constants[name] = (literal, a, b)
        score = math.sqrt(name_score(name) * literal_score(literal))
        if score >= threshold:
            best[a, b] = max(score, best.get((a, b), 0.0))
    return [("named", a, b, s) for (a, b), s in sorted(best.items())]


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind. Fixed patterns score 1 and always stay; a named
    literal that lies within or over a fixed span adds nothing and is left out."""
    text = text or ""
    base = [(k, a, b, 1.0) for k, a, b in base_spans(text)]
    return sorted(base + clear_of(named_spans(text, threshold), base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def redact(text: str | None, spans: list[tuple], mark: str = "[SECRET]") -> str | None:
    """The text with each secret value (of assign: what follows the operator) replaced by the mark."""
    if not spans:
        return text
    cuts = []
    for kind, a, b, _ in spans:
        m = _ASSIGN.match(text, a) if kind == "assign" else None
        cuts.append((m.start(2) if m else a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc, *keep, spans, redacted): spans is array<struct<kind, start, end, score>> in code points, end exclusive;
    redacted is the text without the secrets' values.

    Each row is lexed where it is read, without a shuffle. Nulls: a null text has no spans and stays null; empty
    texts have none. Texts are scanned whole whatever their length. Repeated rows give repeated results; an empty
    table gives no rows; extra columns are ignored unless named in `keep` (kept columns called spans or redacted
    give way to the results).
    """
    held = [c for c in dict.fromkeys([doc, *keep]) if c not in ("spans", "redacted")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def start():
        def kernel(cols):
            for *own, body in zip(*cols, strict=True):
                spans = scan(body, threshold)
                yield *own, [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans], redact(body, spans)

        return kernel

    ddl = ", ".join(f"`{c}` {types[c]}" for c in held)
    src = docs.select(*held, F.col(text).alias("_body"))
    return map_rows(
        src, [*held, "_body"], start, f"{ddl}, spans array<struct<kind: string, start: long, end: long, score: double>>, redacted string"
    )


def base_digest(spans: list[tuple]) -> str:
    return hashlib.sha256(listed([s for s in spans if s[0] in KINDS[:3]]).encode()).hexdigest()
