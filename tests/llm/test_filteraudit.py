import random
import re
from itertools import permutations

from loomframe.llm import filteraudit, queries
from tools.compare import views

DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, docs long, _key string, _fails_A boolean"
LABEL = "doc_id long, quality int, toxic int, part string"


def failing(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and least is not None and doc_id > least,
    }
    return {f for f, bad in tests.items() if bad}


def plain(docs, labels):
    """Every part, order and step by removing documents one filter after the other."""
    least, good, toxic = {}, set(), set()
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, q, t, *_ in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if t == 1 and d is not None else set()
    parts = {}
    for d, text, _, source, *_ in docs:
        parts.setdefault(source or "", []).append((failing(text or "", d, least.get(text or "")), d in good, d in toxic))
    out, share = {}, {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                fails = [r for r in rows if f in r[0]]
                share[part, f] = share.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(fails) - len(gone), sum(r[0] == {f} for r in fails), sum(r[1] for r in gone), sum(r[2] for r in gone)
                )
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_against_plain_removal(spark):
    """Copies within and across parts, rows without an id, repeated rows, labels given twice, clashing column names."""
    rng = random.Random(3)
    long = ["w%d" % i for i in range(400)]
    texts = [None, "", " \n", "Ab", "x # y", "é" * 300]
    texts += [" ".join(rng.sample(long, 250)), " ".join(long[:90] * 3), " ".join(w.upper() for w in long[:250]), " ".join(long[:220]) + " $", "a b " * 5000]
    docs = []
    for i in range(300):
        d = rng.choice([i, i, i, i - 1, None])
        docs.append((d, rng.choice(texts) if rng.random() < 0.6 else f"{rng.choice(texts) or ''} {i}", "en", rng.choice(["a", "b", None, ""]), 1, "q", 7, "q", True))
    docs += docs[:20]
    labels = [(rng.choice([i, i + 1, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "q") for i in range(250)]
    df = filteraudit.audit_filters(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL))
    got, want = found(df), plain(docs, labels)
    assert got == want and len(got) == 3 * 600
    assert any(v[3] for v in want.values()) and any(v[4] for v in want.values()) and any(v[5] for v in want.values())


def test_edges(spark):
    nothing = filteraudit.audit_filters(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL))
    assert nothing.count() == 0
    one = [(5, "a", "en", "s", 1, "q", 1, "q", True)]
    got = found(filteraudit.audit_filters(spark.createDataFrame(one, DOC), spark.createDataFrame([], LABEL)))
    assert len(got) == 600 and got["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["s", "BCDEA", 4] == (1, 0, 0, 0, 0, 0, 0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = queries.op13_filteraudit(spark, sf)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found(got) == plain(docs, labels)
    res = views(sf).execute(queries.ORACLES["op13_filteraudit"])
    names = [d[0] for d in res.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(res.fetchall())
