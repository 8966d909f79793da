"""Personal data: fixed patterns, plus a BiLSTM-CRF that finds written variants which the patterns miss."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bilstm_crf
from .common import clear_of, drawn, map_rows

#: Kinds in the order in which spans that start together are listed: the fixed patterns, then the model's.
BASE = ("email", "ip", "card", "phone")
MODEL = tuple(f"model_{k}" for k in BASE)
KINDS = BASE + MODEL

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match ends with a whole run of digits, so none begins within one
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EVIDENCE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _octet(part: str) -> bool:
    """At most 255, whatever its number of leading zeros."""
    own = part.lstrip("0")
    return len(own) < 4 and int(own or 0) <= 255


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str):
    """As [A-Za-z0-9._%+-]+@ and a domain, found from the @ outwards, so that long runs cost no more than their length."""
    at, free = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        begin = at
        while m and begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            free = m.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str, checksum: bool = True) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed kind; a match that fails its check is dropped.

    Without `checksum` a card need not pass Luhn: what a reader of characters can tell, so what the model learns.
    """
    if not _EVIDENCE.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and (luhn(d) or not checksum):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- symbols and tags

_PLAIN = "abcdefghijklmnopqrstuvwxyz \n\t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOL = {c: i + 4 for i, c in enumerate(_PLAIN)} | {chr(c): 1 for c in range(0x30, 0x3A)} | {chr(c): 2 for c in range(0x41, 0x5B)}
SYMBOLS = 4 + len(_PLAIN)  # 0 other, 1 digit, 2 capital, 3 letter beyond a-z
PAD = "\n"
#: Tag 0 is outside; 2 k + 1 begins kind k, 2 k + 2 goes on.
TAGS = 1 + 2 * len(BASE)
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])


def symbols(text: str) -> list[int]:
    return [_SYMBOL.get(c, 3 if c.isalpha() else 0) for c in text]


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 2 * BASE.index(kind)
        out[a:b] = k + 2
        out[a] = k + 1
    return out


# --- labelled spans to learn from


def _card_number(rng: np.random.Generator) -> str:
    head = "".join(str(d) for d in rng.integers(0, 10, 15))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _variant(kind: str, rng: np.random.Generator, held_out: int | None = None) -> str:
    """A written form that the fixed pattern of its kind does not take (or takes in part). held_out: the number of one of
    the two forms a kind that training never shows, to measure with."""
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == "email":
        user = pick(word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}.{num(2)}")
        host, end = word(), pick("com", "org", "net", "de", "fr")
        if held_out is not None:
            return (f"{user}@ {host}.{end}", f"{user} [@] {host}.{end}")[held_out]
        return pick(f"{user} @ {host}.{end}", f"{user}@{host} dot {end}", f"{user} @ {host} dot {end}", f"{user}@{host}[.]{end}", f"{user}[@]{host}.{end}")
    if kind == "ip":
        if held_out is not None:
            return ("{.}", " [.] ")[held_out].join(str(p) for p in rng.integers(0, 256, 4))
        return pick("[.]", "(.)", " . ", "[dot]").join(str(p) for p in rng.integers(0, 256, 4))
    if kind == "card":
        d = _card_number(rng)
        if held_out is not None:
            return (":", " / ")[held_out].join(d[i : i + 4] for i in range(0, 16, 4))
        return pick(".", "_", " - ", "/").join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = num(3), num(3), num(4)
    if held_out is not None:
        return (f"({a}).{b}.{c}", f"{a}/{b}-{c}")[held_out]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00 {num(2)} {a} {b} {c}", f"({a}) {b} {c}", f"{a} {b} {c}")


def _decoy(rng: np.random.Generator) -> str:
    """Figures that are no personal data."""
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    kinds = [
        lambda: num(int(rng.integers(1, 7))), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"{num(1)}.{num(1)}",
        lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: f"1{num(1)}:{num(2)}", lambda: f"${num(1)},{num(3)}.{num(2)}", lambda: f"{num(2)}%",
        lambda: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 32)), lambda: f"AKIA{num(2)}QXZ{num(3)}JK", lambda: "@" + "handle" + num(1),
        lambda: f"({num(2)})", lambda: f"{num(3)}-{num(2)}", lambda: f"{num(3)},{num(3)}", lambda: f"= {num(2)}", lambda: f"{num(4)}/{num(2)}",
    ]
    return kinds[rng.integers(len(kinds))]()


def training_windows(texts: list[str], width: int, windows: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (windows, width). Labelled spans are the fixed patterns' matches in the texts, and variants
    and decoys planted between words of the texts at known places."""
    rng = np.random.Generator(np.random.PCG64(seed))
    plain = [t for t in texts if len(t) > 20] or ["some words of plain text to stand between the figures, and a few more of them. "]
    marked = [(t, s) for t in texts for s in base_spans(t, False)]
    ids, tags = [], []
    for i in range(windows):
        if marked and i % 3 == 0:
            text, (_, a, b) = marked[rng.integers(len(marked))]
            spans = base_spans(text, False)
            begin = max(0, int(rng.integers(min(a, b - width), max(a, b - width) + 1)))
        else:
            text = plain[rng.integers(len(plain))]
            begin = int(rng.integers(max(1, len(text) - width)))
            text = text[begin : begin + width]
            spans = base_spans(text, False)
            gaps = [m.end() for m in re.finditer(r"\s+", text) if not any(x < m.end() < y for _, x, y in spans)]
            if gaps:
                at = gaps[rng.integers(len(gaps))]
                kind = BASE[rng.integers(4)] if rng.random() < 0.6 else None
                own = _variant(kind, rng) if kind else _decoy(rng)
                text = text[:at] + own + (" ", ". ", ", ")[rng.integers(3)] + text[at:]
                inside = [(kind, at, at + len(own))] if kind else []
                spans = inside + [s for s in base_spans(text, False) if not any(s[1] < y and x < s[2] for _, x, y in inside)]
            begin = 0
        part = text[begin : begin + width]
        own_tags = tags_of(len(text), sorted(spans, key=lambda s: s[1]))[begin : begin + width]
        short = width - len(part)
        ids.append(symbols(part + PAD * short))
        tags.append(np.concatenate([_opened(own_tags), np.zeros(short, np.int64)]))
    return np.array(ids), np.array(tags)


def _opened(tags: np.ndarray) -> np.ndarray:
    """A span that the window's edge cuts begins with its first tag here."""
    if len(tags) and tags[0] and tags[0] % 2 == 0:
        tags = tags.copy()
        tags[0] -= 1
    return tags


def learn(docs: DataFrame, doc: str = "doc_id", text: str = "text", sample_docs: int = 800, max_doc_bytes: int = 20_000, windows: int = 4000, epochs: int = 9) -> bilstm_crf.Tagger:
    """Train on a bounded sample: about sample_docs documents with a digit or @ (by a hash of the id, never more than
    twice as many), each of at most max_doc_bytes. Labels come from spans (matches, planted variants), never from
    other columns."""
    rows = docs.select(F.col(doc).alias("k"), F.col(text).alias("t")).where((F.octet_length("t") <= max_doc_bytes) & F.col("t").rlike("[0-9@]"))
    texts = sorted(r.t for r in drawn(rows, "k", sample_docs).select("t").collect())
    net = bilstm_crf.fresh(SYMBOLS, 16, ALLOWED)
    bilstm_crf.train(net, *training_windows(texts, 80, windows), epochs)
    return net


# --- decoding

#: Windows of the first pass; a window's neighbours share EDGE characters with it.
WIDTH, EDGE = 192, 64
STRIDE = WIDTH - EDGE


def _sound(kind: str, value: str) -> bool:
    """What every form of a kind must hold."""
    d = _digits(value)
    if kind == "email":
        return value.count("@") == 1 and len(value) >= 6 and value[0].isalnum() and value[-1].isalnum()
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and _octet(p) for p in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def decode(net: bilstm_crf.Tagger, texts: list[str], threshold: float, pruned: bool = True) -> list[list[tuple[str, int, int, float]]]:
    """Model spans (kind, start, end, score) of each text.

    Overlapping windows cover each text. A span's score is its mean margin over tag 0. A span that a window's edge cuts
    is left to the neighbour; where no window holds it whole, a wider window around it is decoded, and so on until one
    does, so spans of any length are found. All windows' spans of a text are then reconciled at once: of the sets
    without overlap the one with the largest total margin stays.

    Every form of every kind holds a digit or an @, so windows without either decode to nothing; with `pruned`
    they are not run at all, and the result is the same.
    """
    spots = []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - EDGE), STRIDE):
            if not pruned or _EVIDENCE.search(t, a, a + WIDTH):
                spots.append((i, a))
    found: list[dict[tuple[str, int, int], float]] = [{} for _ in texts]
    whole: list[list[tuple[int, int]]] = [[] for _ in texts]
    width = WIDTH
    while spots:
        parted: dict[int, list[tuple[int, int]]] = {}
        many = max(1, 1024 * WIDTH // width)
        for at in range(0, len(spots), many):
            _decode_windows(net, texts, spots[at : at + many], width, threshold, found, whole, parted)
        spots, width = [], 2 * width
        for i, pieces in parted.items():
            for a, b in _joined(_not_within(pieces, _joined(whole[i]))):
                begin = max(0, min(a - EDGE, len(texts[i]) - width))
                spots += [(i, x) for x in range(begin, max(begin + 1, b), width - EDGE)]
    return [_heaviest([(*k, s) for k, s in f.items()]) for f in found]


def _not_within(pieces: list[tuple[int, int]], ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pieces that lie in none of the sorted, disjoint ranges."""
    begins = [a for a, _ in ranges]
    place = lambda a: bisect_right(begins, a) - 1
    return [(a, b) for a, b in pieces if place(a) < 0 or ranges[place(a)][1] < b]


def _joined(pieces) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _decode_windows(net, texts, spots, width, threshold, found, whole, parted) -> None:
    """Decode the windows (text, begin): spans that fit into `found`, their ranges into `whole` whatever their score,
    ranges cut by an edge into `parted`."""
    own = [texts[i][a : a + width] for i, a in spots]
    em = bilstm_crf.emissions(net, np.array([symbols(t + PAD * (width - len(t))) for t in own]).T)
    paths = bilstm_crf.viterbi(net, em)
    for j in np.flatnonzero((paths > 0).any(0)):
        i, a = spots[j]
        path, size = paths[:, j], len(own[j])
        for b in np.flatnonzero(path % 2 == 1):
            e = b + 1
            while e < width and path[e] == path[b] + 1:
                e += 1
            kind = BASE[(path[b] - 1) // 2]
            if (b == 0 and a > 0) or (e >= size and a + size < len(texts[i])):
                parted.setdefault(i, []).append((a + int(b), a + int(min(e, size))))
                continue
            if e > size:
                continue
            whole[i].append((a + int(b), a + int(e)))
            if not _sound(kind, own[j][b:e]):
                continue
            score = float((em[np.arange(b, e), j, path[b:e]] - em[b:e, j, 0]).mean())
            if score >= threshold:
                key = (kind, a + int(b), a + int(e))
                found[i][key] = max(score, found[i].get(key, score))


def _heaviest(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The set of spans without overlap that has the largest total margin (score times length)."""
    spans = sorted(spans, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int | None]] = [(0.0, None)]
    for s in spans:
        before = int(np.searchsorted(ends, s[1], side="right"))
        take = best[min(before, len(best) - 1)][0] + s[3] * (s[2] - s[1])
        best.append((take, before) if take > best[-1][0] else (best[-1][0], None))
    out, k = [], len(spans)
    while k:
        before = best[k][1]
        if before is None:
            k -= 1
        else:
            out.append(spans[k - 1])
            k = min(before, k - 1)
    return out[::-1]


def find_pii(docs: DataFrame, net: bilstm_crf.Tagger, doc: str = "doc_id", text: str = "text", threshold: float = 0.0) -> DataFrame:
    """(doc, spans, redacted): spans is array<struct<kind, start, end, score>> in code points, end exclusive, by
    start, then kind; redacted is the text with each span replaced by its kind in brackets.

    All fixed matches stay (score 1). A model span needs a mean margin over plain text of the threshold at least; one that
    overlaps a fixed match adds nothing and is left out. Texts are read
    whole, where they are, without a shuffle; windows of many texts are run together.

    Nulls: a null text has no spans and stays null; empty texts have none. Repeated rows give repeated results; an
    empty table gives no rows; extra columns are ignored.
    """

    def start():
        def kernel(cols):
            ids, bodies = cols
            texts = [t or "" for t in bodies]
            for doc_id, body, t, extra in zip(ids, bodies, texts, decode(net, texts, threshold), strict=True):
                base = base_spans(t)
                spans = [(k, a, b, 1.0) for k, a, b in base]
                spans += [(f"model_{k}", a, b, s) for k, a, b, s in clear_of(extra, base)]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                yield doc_id, [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans], redact(body, spans)

        return kernel

    kind = docs.schema[doc].dataType.simpleString()
    return map_rows(
        docs, [doc, text], start, f"`{doc}` {kind}, spans array<struct<kind: string, start: long, end: long, score: double>>, redacted string"
    )


def redact(text: str | None, spans: list[tuple]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.removeprefix('model_').upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
