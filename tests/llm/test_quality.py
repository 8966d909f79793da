import zlib

from loomframe.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op1_quality(spark, sf).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    seen = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(p == q for p, q in seen) / len(seen) > 0.95
    kept = [p for p, q in seen if q == 1]
    assert sum(kept) / len(kept) > 0.98


def test_edges(spark):
    good, bad = "the quick brown fox jumps over it ", "$$$ ### %%% &&& "
    docs = [(i, (good if i % 2 else bad) * 30, "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (None, good, "x"), (62, good * 20_000, "x")]
    docs += [docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(60, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.learn(d, marks)
    out = quality.score_quality(d, model).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r.score for r in out}
    assert by[1] > 0.5 > by[0] and by[62] > 0.5 and by[60] == by[61]
    none = quality.learn(d, marks.limit(0))
    assert {r.score for r in quality.score_quality(d, none).collect()} == {0.5}
    assert quality.score_quality(d.limit(0), model).count() == 0


def test_whole_table_against_plain_compression(spark):
    """Every document compressed chunk by chunk by compressors of its own, and the logistic curve by hand."""
    import math

    import zstandard

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in queries.op1_quality(spark, sf).collect()}

    def size(text, raw):
        body = (text or "").encode()
        made = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(made.compress(body[i : i + 1024])) for i in range(0, len(body), 1024))

    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g, b = size(r.text, model.good), size(r.text, model.bad)
        x = (b - g) / (b + g) if b + g else 0.0
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-(model.slope * x + model.offset)))) < 1e-9


def test_calibration(spark):
    """Scores as probabilities of label 1 on the held-out third: Brier score, and the mean gap between score and share by
    tenths of the score."""
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(r.score, marks[r.doc_id]) for r in queries.op1_quality(spark, sf).collect() if r.held_out and r.doc_id in marks]
    brier = sum((s - q) ** 2 for s, q in seen) / len(seen)
    gap = 0.0
    for k in range(10):
        own = [(s, q) for s, q in seen if min(9, int(10 * s)) == k]
        if own:
            gap += abs(sum(s for s, _ in own) - sum(q for _, q in own)) / len(seen)
    print(f"held out {len(seen)}, Brier {brier:.4f}, calibration error {gap:.4f}")
    share = sum(q for _, q in seen) / len(seen)
    assert brier < 0.5 * share * (1 - share) and gap < 0.05
