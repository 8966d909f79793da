import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import queries, secrets

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def plain(text):
    out = []
    for kind, (p, ok) in PATTERNS.items():
        flags = re.I | re.A if kind == "assign" else 0
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, text, flags) if ok(m)]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["Token", "api_key", "apikey", "ſecret", "toKen", "secret", '"', "'", " ", "=", ":", "AKIA", "A1B2", "deadbeef", "0" * 30, "x/y+z", "\n"]), max_size=12).map("".join))
def test_fixed_patterns(text):
    assert sorted(secrets.base_spans(text), key=lambda s: (s[1], secrets.KINDS.index(s[0]))) == plain(text)


def test_pairs_and_constants():
    code = 'K = "q9Zr-77xLmP2vTb"\nalias = K\nclient.password_hash = alias\ncolour = "light-blue-9"\n'
    found = secrets.scan(code)
    assert [(k, code[a:b]) for k, a, b, _ in found] == [("named", "q9Zr-77xLmP2vTb")]
    assert [p[:2] for p in secrets.pairs_of('{"authToken": "abc", x => 1, y := \'two\', z: three}')] == [("authToken", "abc"), ("x", "1"), ("y", "two"), ("z", "three")]
    assert secrets.redact(code, found) == code.replace("q9Zr-77xLmP2vTb", "[SECRET]")
    assert secrets.name_score("dbPassword") == 1 and secrets.name_score("colour") == 0 and secrets.name_score("PRIVATE_KEY") > 0.6
    assert secrets.scan("The meeting is at: 10:30, see notes. Ratio = 3.5 and note: nothing.") == []


def test_each_name_alone_and_passphrases():
    """A random literal fires under any listed name; a long one of plain letters under strong ones; prose does not."""
    random_one = "q9ZrT7xLmP2vTbW4kYc8HsD1fGjN6aQe3RuV5oXi"
    for name in secrets.SENSITIVE:
        for form in (f'{name} = "{random_one}"', f"my_{name}: {random_one}", f'"{name}": "{random_one}"'):
            got = secrets.scan(form)
            assert got and all(form[a:b].endswith(random_one) or form[a:b].strip("\"' ") for _, a, b, _ in got), form
            assert random_one not in secrets.redact(form, got)
    for name in ("passphrase", "password", "credentials"):
        assert secrets.named_spans(f'{name} = "correcthorsebatterystaple"', secrets.THRESHOLD)
    for prose in ('colour = "q9ZrT7xLmP2vTbW4kYc8HsD1fGjN6aQe3RuV5oXi"', "session: Wednesday-afternoon", "key: description", "pin: 4711", "auth: required by all", "cookie: chocolate-and-oats"):
        assert secrets.named_spans(prose, secrets.THRESHOLD) == [], prose


def plain_named(text):
    """Named literals of lines `name = "literal"` or `name = other`, read line by line with constants passed on."""
    bound, out = {}, {}
    at = 0
    for line in text.split("\n"):
        m = re.match(r"""\s*([\w.\-]+)\s*=\s*(?:"([^"]*)"|([\w.]+))\s*$""", line)
        if m:
            name = m[1]
            here = (m[2], at + m.start(2), at + m.end(2)) if m[2] else (m[3], at + m.start(3), at + m.end(3)) if m[3] else None
            if here and re.match(r"[A-Za-z_][\w.]*$", here[0]) and here[0] in bound:
                here = bound[here[0]]
            if here:
                bound[name] = here
                score = (secrets.name_score(name) * secrets.literal_score(here[0])) ** 0.5
                if score >= secrets.THRESHOLD:
                    out[here[1:]] = max(score, out.get(here[1:], 0))
        at += len(line) + 1
    return [("named", a, b, s) for (a, b), s in sorted(out.items())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["K", "alias", "client.password", "db_token", "colour", "api-key", "sessionCookie"]), st.sampled_from(["K", "alias", "db_token", '"q9Zr-77xLmP2vTbW4kYc"', '"light"', '"correcthorsebatterystaple"', "r4nd0mT0kenValue99", '"a b c d e f g h"'])), max_size=12))
def test_named_spans_against_a_line_reader(lines):
    text = "\n".join(f"{n} = {v}" for n, v in lines)
    assert secrets.named_spans(text, secrets.THRESHOLD) == plain_named(text)


def test_many_spans_in_linear_time():
    import time

    text = 'client_signature = "q9ZrT7xLmP2vTbW4kYc8HsD1fGjN6aQe3RuV5oXi"\ntoken=abcdefgh12\n' * 20_000
    t = time.time()
    assert len(secrets.scan(text)) == 40_000 and time.time() - t < 20


def test_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op7_secrets(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = plain(d.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert rows[d.doc_id].spans == listed  # these documents hold no other assignments
        assert (rows[d.doc_id].n_assign, rows[d.doc_id].n_access, rows[d.doc_id].n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.KINDS[:3])


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "token=abcdefgh", "y"), (4, "word " * 100_000 + "secret: 'abcd/efgh'", "z"), (4, "a=" * 50_000, "z")]
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"), keep=("spans",)).collect()
    assert len(out) == 5 and out[0].redacted is None and out[1].spans == [] and out[2].redacted == "token=[SECRET]"
    assert out[3].redacted.endswith("secret: '[SECRET]'")
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
