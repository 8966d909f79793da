import random
import time

import numpy as np
import pyarrow as pa

from loomframe.llm import minhash, queries, spandedup

SCHEMA = "doc_id long, text string, removed string"


def brute(rows, width=4, most=12, least=10):
    """Cut by hand, compare runs as tuples of words."""
    cut = {}
    for d, t in rows:
        out = []
        for line in (t or "").split("\n"):
            own = []
            for w in line.split():
                own.append(w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w))
                end = w[-1] in ".!?" or (w[-1] in "\"')]" and w[-2:-1] in (".", "!", "?"))
                if end or len(own) == most:
                    out.append(tuple(own))
                    own = []
            if own:
                out.append(tuple(own))
        cut[d] = out
    seen, gone = set(), {d: set() for d in cut}
    for d in sorted(cut):
        for i in range(len(cut[d]) - width + 1):
            run = tuple(cut[d][i : i + width])
            if sum(map(len, run)) >= least:
                if run in seen:
                    gone[d].update(range(i, i + width))
                seen.add(run)
    return {d: (len(cut[d]), len(gone[d])) for d in cut}


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in queries.op6_spandedup(spark, sf).collect()}
    assert got == brute(rows)


def test_passages_and_edges(spark):
    rnd = random.Random(2)

    def prose(n, tag):
        return " ".join(f"{tag}{rnd.randrange(10**6)}" + ("." if i % 7 == 6 else "") for i in range(n))

    passage = prose(51, "p") + "."
    plain = prose(60, "z")
    rows = [(5, prose(40, "a") + ". " + passage + " " + prose(30, "b")), (2, prose(30, "c") + ".\n" + passage + "\n" + prose(50, "d"))]
    rows += [(9, plain), (1, None), (3, ""), (4, "Short. text."), (None, passage), (6, passage * 2000), (6, passage * 2000), (7, prose(20, "e") + ". " + passage)]
    out = spandedup.remove_repeated_spans(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[2].text == rows[1][1] and by[9].text == plain and by[None].text == passage
    for d, t in rows:
        if d in (5, 7):
            assert by[d].text == t.replace(passage, "").replace(".  ", ". ")
    assert by[1].text is None and by[3].text == "" and by[4].n_removed == 0
    assert len({r.text for r in out if r.doc_id == 6}) == 1 and by[6].n_sentences - by[6].n_removed < 10
    assert spandedup.remove_repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_that_start_mid_sentence(spark):
    """Copies at every offset to the 12-word cuts, without stops or with stops that are not . ! or ?"""
    rnd = random.Random(4)
    words = lambda n, end="": " ".join(f"w{rnd.randrange(10**9)}" + (end if i % 9 == 8 else "") for i in range(n))
    passages = [words(51), words(200), words(70, "\u0964")]
    parts = [[(words(5 + at), p, words(20)) for at in range(13)] for p in passages]
    rows = [(100 * k + i, " ".join(own)) for k, group in enumerate(parts) for i, own in enumerate(group)]
    rows += [(900, words(400)), (901, words(50))]
    out = {r.doc_id: r for r in spandedup.remove_repeated_spans(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)).collect()}
    for k, group in enumerate(parts):
        assert out[100 * k].text == rows[13 * k][1]
        for i, (before, passage, after) in enumerate(group[1:], 1):
            left = out[100 * k + i].text.split()
            own = passage.split()
            rest = [w for w in left if w in own]
            assert len(rest) <= 2 * 19 and len(own) - len(rest) >= 32
            assert [w for w in left if w not in own] == before.split() + after.split()
    assert out[900].n_run_words == 0 and out[101].n_run_words >= 32
    assert out[900].text == rows[-2][1] and out[901].text == rows[-1][1]


def all_of(texts):
    """Sentences, runs of sentences and runs of words of texts taken together."""
    s = spandedup.sentences(*spandedup._bytes_of(pa.array(texts, pa.string())), 12)
    return s, spandedup.runs(s, 4, 10), spandedup.word_runs(s)


def test_texts_together_as_each_alone():
    """A batch of texts, cut into slices at any row, has the words, sentences and runs of each of its texts."""
    rnd = random.Random(6)
    marks = ["", ".", "!", '."', "?)", ",", "\u0964", "\u00e9"]
    word = lambda: rnd.choice("aBzZ") * rnd.randrange(1, 9) + str(rnd.randrange(40)) + rnd.choice(marks)
    text = lambda n: rnd.choice(["", " ", "\n"]) + "".join(word() + rnd.choice([" ", "\t ", "\n"]) for _ in range(n)) + rnd.choice(["", "end"])
    texts = [None, "", *(text(rnd.choice([0, 1, 4, 30, 50, 51, 52, 400])) for _ in range(150)), "x" * 3000, " \n", None, ""]
    rnd.shuffle(texts)
    whole = pa.array(["not in the slice.", *texts], pa.string()).slice(1)
    raw, bounds = spandedup._bytes_of(whole)
    assert [raw[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t or "" for t in texts]
    h, starts, ends = minhash.words_of_texts(raw, bounds, segment=100)
    alone = [minhash.word_spans((t or "").encode()) for t in texts]
    assert h.tolist() == [x for w in alone for x in w[0].tolist()]
    assert starts.tolist() == [x + at for w, at in zip(alone, bounds, strict=False) for x in w[1].tolist()]
    assert ends.tolist() == [x + at for w, at in zip(alone, bounds, strict=False) for x in w[2].tolist()]
    s, *found = all_of(texts)
    assert s.each.tolist() == h.tolist() and s.first_word.tolist() == np.cumsum([0, *(len(w[0]) for w in alone)]).tolist()
    ones = [all_of([t]) for t in texts]
    assert s.words.tolist() == [x for one, *_ in ones for x in one.words.tolist()]
    for k, first in enumerate((s.first, s.first_word)):
        for own in range(3):
            by = [one[1 + k][own] + (first[i] if own == 0 else 0) for i, one in enumerate(ones)]
            assert found[k][own].tolist() == np.concatenate(by).tolist()
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), whole], ["d", "t"])
    parts = list(spandedup._chunks([rows], 1))
    assert sum(p.num_rows for p in parts) == len(texts) and [x for p in parts for x in p.column(1).to_pylist()] == texts


def test_short_texts_cost_what_their_bytes_cost():
    """Hashing takes about as long for 8000 texts of 30 words as for 8 texts of as many words together; text by text it took 26 times
    as long."""
    rnd = random.Random(8)
    short = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) + "." for _ in range(8000)]
    long = [" ".join(short[i::8]) for i in range(8)]

    def cost(texts):
        took = []
        for _ in range(3):
            begun = time.process_time()
            for part in spandedup._chunks([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])], 0):
                all_of(part.column(0))
            took.append(time.process_time() - begun)
        return min(took)

    assert cost(short) < 4 * cost(long)


def test_cuts_next_to_other_texts(spark):
    """Texts of one slice that lose their ends, beginnings or all words, with white space around, and one doc_id of two texts."""
    rnd = random.Random(9)
    words = lambda n: " ".join(f"v{rnd.randrange(10**9)}" for _ in range(n))
    a, b, c = ("".join(words(5) + ". " for _ in range(4)).strip() for _ in range(3))
    rows = [(1, a + "\n" + b), (2, "  " + a), (3, "\n " + b + " \n"), (4, words(3) + ". " + a), (5, a + "\n" + c + "\ntail"), (6, None), (6, b), (6, c), (7, ""), (8, c + " " + c)]
    rows = [(d, t, "x") for d, t in rows]
    out = spandedup.remove_repeated_spans(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    got = sorted((r.doc_id, r.text, r.n_sentences, r.n_removed, [list(x) for x in r.removed]) for r in out if r.doc_id != 6)
    first = rows[3][1].split(". ")[0] + ". "
    assert got == [
        (1, rows[0][1], 8, 0, []),
        (2, "  ", 4, 4, [[0, 4]]),
        (3, "\n ", 4, 4, [[0, 4]]),
        (4, first, 5, 4, [[1, 5]]),
        (5, c + "\ntail", 9, 4, [[0, 4]]),
        (7, "", 0, 0, []),
        (8, "", 8, 8, [[0, 8]]),
    ]
    six = sorted(((r.text, r.n_removed) for r in out if r.doc_id == 6), key=str)
    assert six == [("", 4), ("", 4), (None, 0)]
