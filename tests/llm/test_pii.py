import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import bilstm_crf, pii, queries

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The fixed patterns as given, by re alone."""
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(d) <= 19 and total % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text("a1@.+- (2", max_size=40) | st.text("0123456789.- +", max_size=60))
def test_fixed_patterns(text):
    assert sorted(pii.base_spans(text), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == plain(text)


@pytest.fixture(scope="module")
def net(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_gradients():
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    own = bilstm_crf.fresh(6, 4, allowed, 1)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, 6, (7, 3)), np.zeros((7, 3), int)
    tags[2], tags[3] = 1, 2
    for p in own.names:
        setattr(own, p, getattr(own, p).astype(np.float64))
    _, grads = bilstm_crf.loss_and_gradients(own, ids, tags)
    for p in own.names:
        w = getattr(own, p)
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in w.shape)
            old, e = w[at], 1e-3
            w[at] = old + e
            up, _ = bilstm_crf.loss_and_gradients(own, ids, tags)
            w[at] = old - e
            down, _ = bilstm_crf.loss_and_gradients(own, ids, tags)
            w[at] = old
            assert abs((up - down) / (2 * e) - grads[p][at]) < 1e-3


def test_held_out_variants(spark, net):
    """Variants that were never trained on, in documents of another table."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids, tags = pii.training_windows(texts[-300:], 80, 600, seed=77)
    got = bilstm_crf.viterbi(net, bilstm_crf.emissions(net, ids.T)).T

    def spans(rows):
        out = set()
        for r, row in enumerate(rows):
            for i in np.flatnonzero(row % 2 == 1):
                e = i + 1
                while e < len(row) and row[e] == row[i] + 1:
                    e += 1
                out.add((r, i, e, row[i]))
        return out

    want, found = spans(tags), spans(got)
    assert len(want & found) / len(found) > 0.85 and len(want & found) / len(want) > 0.8


def test_written_forms_that_training_never_shows(net):
    """Recall of whole forms held out, by kind; the README has the figures."""
    rng = np.random.Generator(np.random.PCG64(11))
    caught = {}
    for kind in pii.BASE:
        for form in (0, 1):
            texts, want = [], []
            for _ in range(60):
                own = pii._variant(kind, rng, form)
                head = "we spoke at length about the plan and wrote to "[: int(rng.integers(10, 46))] + " "
                texts.append(head + own + " before the end of the week, as agreed.")
                want.append((kind, len(head), len(head) + len(own)))
            got = pii.decode(net, texts, 0.0)
            caught[kind, form] = sum(any(k == w[0] and a < w[2] and w[1] < b for k, a, b, _ in g) for g, w in zip(got, want, strict=True)) / 60
    print({f"{k} {f}": round(v, 2) for (k, f), v in caught.items()})
    assert sum(caught.values()) / len(caught) > 0.5


def test_long_spans_at_every_offset(net):
    """A span longer than the windows' overlap is found wherever it stands."""
    own = "maximiliane.konstantinopolis.featherstonehaugh.wolkenstein @ international-committee-of-letters.example.org"
    assert len(own) > 100
    alone = [s for s in pii.decode(net, [f"please write to {own} today"], 0.0) if s]
    assert alone and any(b - a > 64 for _, a, b, _ in alone[0])
    texts = [("of all the words " * 40)[:k] + " please write to " + own + " today and " + "of all the words " * 20 for k in range(0, 256, 7)]
    found = pii.decode(net, texts, 0.0)
    assert sum(any(k == "email" and b - a > 64 for k, a, b, _ in f) for f in found) >= 0.9 * len(texts)


def test_zeros_and_many_spans():
    """Addresses with thousands of leading zeros, and a long text with a span in every line, in linear time."""
    import time

    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] == [s for s in plain_ip("0" * 5000 + ".1.1.1")]
    extra = [("model_ip", 40 * i + 20, 40 * i + 30, 1.0) for i in range(100_000)]
    base = [("email", 40 * i, 40 * i + (25 if i % 2 else 15)) for i in range(100_000)]
    t = time.time()
    assert len(pii.clear_of(extra, base)) == 50_000 and time.time() - t < 5


def plain_ip(text):
    m = re.match(PATTERNS["ip"], text)
    return [("ip", m.start(), m.end())] if all(len(p.lstrip("0") or "0") <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")) else []


def test_skipped_windows_change_nothing(spark, net):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    texts += ["call (269) 555-3296 or 00 44 207 946 0958 " * 20, "x" * 191 + " 12[.]34[.]56[.]78 " + "y" * 300]
    some, every = (pii.decode(net, texts, 0.0, pruned) for pruned in (True, False))
    assert [[x[:3] for x in t] for t in some] == [[x[:3] for x in t] for t in every] and any(some)
    # Windows run in other batches here, so scores agree but for the order of float32 sums.
    assert all(abs(x[3] - y[3]) < 1e-4 for a, b in zip(some, every, strict=True) for x, y in zip(a, b, strict=True))


def test_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op2_pii(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    added = 0
    for d in docs:
        base = plain(d.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        own = r.spans.split(",") if r.spans else []
        assert set(listed.split(",") if listed else []) <= set(own)
        added += len(own) - len(base)
    assert added <= 3  # these documents hold no variants
    # Documents that do: every form of training, planted among them, is found by the query's own settings.
    rng = np.random.Generator(np.random.PCG64(21))
    planted = [(i, f"as we said before, {pii._variant(pii.BASE[i % 4], rng)} is what was written there.", pii.BASE[i % 4]) for i in range(200)]
    out = pii.find_pii(spark.createDataFrame([(i, t) for i, t, _ in planted], "doc_id long, text string"), pii.learn(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    kinds = {r.doc_id: {s.kind.removeprefix("model_") for s in r.spans} for r in out}
    assert sum(k in kinds[i] for i, _, k in planted) / len(planted) >= 0.85


def test_edges(spark, net):
    text = "Write to ann.lee @ example.org now. "
    rows = [(1, None, "x"), (2, "", "x"), (None, "mail a@b.co", "y"), (4, "a" * 300_000 + " a@b.co " + "9" * 5000, "z"), (5, text * 3, "s"), (5, text * 3, "s")]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string"), net).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[1].redacted is None and by[2].spans == [] and by[None].redacted == "mail [EMAIL]"
    assert [(s.kind, s.start) for s in by[4].spans if s.kind == "email"] == [("email", 300_001)]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0
    assert pii.learn(spark.createDataFrame([], "doc_id long, text string"), epochs=1, windows=96) is not None
