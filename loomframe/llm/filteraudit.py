"""How five document filters interact: survivors of every subset of them from one CUBE, every order of them step by step."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The filters: four conditions of a text, and E, which holds for a text that a smaller doc_id has too.
FILTERS = ("A", "B", "C", "D", "E")
_FLAGS = [f"_fails_{f}" for f in FILTERS]
_COUNTS = ["docs", "good", "toxic"]


def conditions(text: Column) -> dict[str, Column]:
    """What makes a document fail filters A to D, by its text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, _fails_A .. _fails_E, docs, good, toxic): how many documents of a part fail just these filters.

    A text stays where it is read; its flags, its part and its SHA-256 travel on. Rows are summed before each exchange, so
    a text, part or id that a third of all rows hold is one row a task. Equal texts fail A to D alike, so E needs no row a
    document: of a text's documents all but those with its smallest doc_id fail it.
    """
    body = F.coalesce("text", F.lit(""))
    flags = [c.alias(f"_fails_{f}") for f, c in conditions(F.col("_text")).items()]
    read = docs.select(F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("part"), body.alias("_text"))
    keys = ["_key", "part", *_FLAGS[:4]]
    light = read.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_key"), *flags)
    rows = light.groupBy("_id", *keys).agg(F.count(F.lit(1)).alias("_n"))

    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in (("quality", "_good"), ("toxic", "_toxic"))])
    known = rows.where(F.col("_id").isNotNull()).join(marks, "_id", "left")
    # A null id has no label and is neither smaller nor larger than another: such rows stay out of the join.
    nameless = rows.where(F.col("_id").isNull()).select("*", F.lit(False).alias("_good"), F.lit(False).alias("_toxic"))
    marked = known.unionByName(nameless)

    def counted(mark: str) -> Column:
        return F.when(F.coalesce(F.col(mark), F.lit(False)), F.col("_n")).otherwise(F.lit(0))

    marked = marked.select("_id", *keys, F.col("_n").alias("docs"), counted("_good").alias("good"), counted("_toxic").alias("toxic"))
    named = F.col("_id").isNotNull()
    texts = stored(marked.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        *[F.coalesce(F.sum(F.when(~named, F.col(c))), F.lit(0)).alias(f"_free_{c}") for c in _COUNTS],
        F.min(F.when(named, F.struct("_id", *_COUNTS))).alias("_least"),
    ), "filter-texts")  # so documents are read once
    owners = texts.groupBy("_key").agg(F.min("_least._id").alias("_owner"), F.count(F.lit(1)).alias("_parts"))
    # Only a text that several parts hold has to ask which of them owns it.
    several = owners.where(F.col("_parts") > 1).select("_key", "_owner")
    owned = texts.join(several, "_key", "left").withColumn("_owns", F.coalesce(F.col("_owner") == F.col("_least._id"), F.lit(True)))

    def kept(c: str) -> Column:
        return F.col(f"_free_{c}") + F.when(F.col("_owns"), F.coalesce(F.col(f"_least.{c}"), F.lit(0))).otherwise(F.lit(0))

    halves = F.array(
        F.struct(F.lit(False).alias("_fails_E"), *[kept(c).alias(c) for c in _COUNTS]),
        F.struct(F.lit(True).alias("_fails_E"), *[(F.col(c) - kept(c)).alias(c) for c in _COUNTS]),
    )
    split = owned.select("part", *_FLAGS[:4], F.inline(halves))
    return split.groupBy("part", *_FLAGS).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def survivors(patterns: DataFrame) -> DataFrame:
    """(part, subset, docs, good, toxic): the documents that pass all filters of a subset, for each of the 32 subsets.

    A subset is a number whose bit i stands for filter i. In a grouping set of the cube the selected flags are those that
    it groups by; its row in which all of them are false counts the subset's survivors.
    """
    cube = patterns.cube(*_FLAGS, "part").agg(
        *[F.sum(c).alias(c) for c in _COUNTS], F.grouping("part").alias("_all_parts"), *[F.grouping(f).alias(f"_off{f}") for f in _FLAGS]
    )
    passing = cube.where((F.col("_all_parts") == 0) & ~F.coalesce(F.greatest(*_FLAGS), F.lit(False)))
    bits = sum(((1 - F.col(f"_off{f}").cast("int")) * (1 << i) for i, f in enumerate(_FLAGS)), F.lit(0))
    found = passing.select("part", bits.alias("subset"), *_COUNTS)
    # A subset that nothing passes has no such row; the empty one has a row for each part.
    every = found.where(F.col("subset") == 0).select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("subset"))
    whole = every.join(found, ["part", "subset"], "left")
    return whole.select("part", "subset", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS])


def _steps() -> list[tuple[str, int, str, int, int, int]]:
    """(filter_order, step, filter, its bit, subset before, subset after) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), k, f, bit, before, before | bit))
            before |= bit
    return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row, zeros included, per part (a value of `source`), order of the filters and step in it. A step's figures come from
    the pair of subsets before and after it; what only the filter itself decides (redundant, unique_fails) from the
    subsets of it alone, of all others and of all.

    Nulls: a null text is empty, a null source the part of the empty string. A row without a doc_id is no copy of another and
    has no label; a text's rows with the smallest doc_id all pass E, so repeated rows count each. A label that several rows
    give one doc_id holds if one of them says 1; null labels say nothing. Empty texts fail A only (no share of nothing is too
    small), and E as copies of each other. An empty table gives no rows; extra columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    patterns = stored(failure_patterns(docs, labels), "filter-patterns")  # 32 rows a part, as its survivors
    counts = stored(survivors(patterns), "filter-survivors")
    ddl = "filter_order string, step int, filter string, bit int, before int, after int"
    steps = F.broadcast(spark.createDataFrame(_steps(), ddl))  # 600 rows, whatever the input
    every = 2 ** len(FILTERS) - 1

    def side(name: str) -> DataFrame:
        return counts.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in _COUNTS])

    pairs = side("before").join(steps, "before").join(side("after"), ["part", "after"])
    docs_of = counts.groupBy("part").agg(
        *[F.sum(F.when(F.col("subset") == s, F.col("docs"))).alias(f"_docs_{s}") for s in sorted({0, every} | {1 << i for i in range(5)} | {every - (1 << i) for i in range(5)})]
    )
    out = pairs.join(docs_of, "part")
    lone = F.coalesce(*[F.when(F.col("bit") == 1 << i, F.col("_docs_0") - F.col(f"_docs_{1 << i}")) for i in range(5)])
    only = F.coalesce(*[F.when(F.col("bit") == 1 << i, F.col(f"_docs_{every - (1 << i)}") - F.col(f"_docs_{every}")) for i in range(5)])
    removed = F.col("before_docs") - F.col("after_docs")
    figures = out.select(
        "part", "filter_order", "step", "filter", F.col("after_docs").alias("kept"), removed.alias("removed"), (lone - removed).alias("redundant"),
        only.alias("unique_fails"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )
    shares = figures.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return figures.join(shares, ["part", "filter"]).select(*figures.columns, "shapley")
