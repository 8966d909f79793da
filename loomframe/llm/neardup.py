"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

The stages, and what travels in each:

1. Every text is hashed where it is read; a row of fixed size (set hash, band keys, a byte a minimum) is stored.
2. Texts with the same shingle set form a class; its smallest doc_id stands for it from here on.
3. Band buckets that hold the same documents count once. Each bucket's members are compared with its smallest
   by their signatures; members that this leaves open are compared with the rest of the bucket in blocks.
   What comes out is a spanning forest of likely links, of which large-star/small-star makes coarse groups.
   Two documents over the similarity that share a bucket always fall into one coarse group.
4. Only documents in coarse groups are read again. Within a group every pair not yet joined is compared on full
   shingle sets, in blocks that share pivot documents; documents left outside their group's main component are
   then compared with all blocks. Again only spanning links leave a task.
5. Large-star/small-star over the confirmed links gives the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, stored, tidy
from .components import connected_components
from .minhash import Signer, set_hash, shingles, spanning_links, word_hashes

BLOCK_ROWS = 1500
BLOCK_SHINGLES = 1_500_000
PIVOTS = 32


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) at which a pair right at the threshold is missed with a probability under 1e-6."""
    t = min(percent, 99) / 100
    rows = 7 if percent >= 85 else max(1, math.floor(math.log(0.25) / math.log(t)))
    return math.ceil(math.log(1e-6) / math.log(1 - t**rows)), rows


def limits(percent: int, minima: int) -> tuple[float, float]:
    """(likely, near), shares of equal minima. Likely links reach the first, six standard deviations below the
    threshold; a document below it with its bucket's centre can only link to one that is above if it reaches near."""
    t = percent / 100
    likely = math.floor(20 * (t - 6 * math.sqrt(t * (1 - t) / minima))) / 20
    return likely, round(t + likely - 1.05, 2)


def hashed(docs: DataFrame, doc: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, h1, h2, bands, sketch) for every row; n = 0 and null bands where a text has no words."""

    def start():
        sign = Signer(bands, rows)

        def kernel(cols):
            for doc_id, body in zip(*cols, strict=True):
                s = shingles(word_hashes((body or "").encode("utf-8", "surrogatepass")), width)
                if len(s):
                    keys, sketch = sign(s)
                    yield doc_id, len(s), *set_hash(s), keys, sketch
                else:
                    yield doc_id, 0, None, None, None, None

        return kernel

    return map_rows(docs, [doc, text], start, "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch binary")


def _agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return (x == y).mean(axis=1)


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(u, v, est) of distinct (u, v) rows: the share of equal minima."""
    both = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("_a")), "u").join(
        sketches.select(F.col("node").alias("v"), F.col("sketch").alias("_b")), "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                est = _agreement(b.column(2).to_pylist(), b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(est)], ["u", "v", "est"])
        tidy()

    return both.select("u", "v", "_a", "_b").mapInArrow(run, "u long, v long, est double")


def _likely_links(keys: DataFrame, sketches: DataFrame, likely: float, near_enough: float, held: list[DataFrame]) -> DataFrame:
    """Spanning forest (u, v) of the likely links; keys: (key, node), a row for each band of each class.

    Tables that the result reads are added to `held`."""
    x = F.xxhash64("node")
    buckets = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("centre"), F.max("node").alias("top"), F.bit_xor(x).alias("x")
    )
    # Buckets with the same members say the same: one of them stays.
    kept = buckets.where("c > 1").groupBy("c", "centre", "top", "x").agg(F.min("key").alias("key"))
    kept = stored(kept, "buckets")
    wide = kept.where("c > 2").select("key", "centre")
    members = stored(keys.join(wide, "key").where("node != centre"), "members")
    pairs = kept.where("c = 2").select(F.col("top").alias("u"), F.col("centre").alias("v"))
    pairs = pairs.unionByName(members.select(F.col("node").alias("u"), F.col("centre").alias("v"))).distinct()
    found = stored(_estimated(pairs, sketches), "likely")
    links = found.where(F.col("est") >= likely).select("u", "v")

    # What the centre leaves open: two or more members away from it, or one near enough to a member that is linked.
    placed = members.join(found.select(F.col("u").alias("node"), F.col("v").alias("centre"), "est"), ["node", "centre"])
    away, near = F.col("est") < likely, (F.col("est") < likely) & (F.col("est") >= near_enough)
    tally = placed.groupBy("key").agg(
        F.sum(away.cast("long")).alias("away"), F.sum(near.cast("long")).alias("near"), F.sum((~away).cast("long")).alias("linked")
    )
    blocks = lambda c: F.ceil(c / BLOCK_ROWS).cast("int")
    unsure = tally.where("away > 1 or (near > 0 and linked > 0)")
    unsure = unsure.select("key", blocks(F.col("away")).alias("ra"), blocks(F.col("away") + F.col("linked")).alias("rb"))
    unsure = stored(unsure, "unsure")
    rows = placed.join(unsure, "key").withColumns({"a": F.pmod(F.xxhash64("node"), "ra"), "b": F.pmod(F.xxhash64("node", F.lit(1)), "rb")})
    # Task (key, a, b) holds the away rows of block a, each to be compared with all rows of block b.
    asks = rows.where(away).select("key", "a", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("b"), "node", F.lit(True).alias("ask"))
    told = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("ra") - 1)).alias("a"), "b", "node", F.lit(False).alias("ask"))
    tasks = asks.unionByName(told.select(*asks.columns)).join(sketches, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        asking, told_ = pdf[pdf.ask], pdf[~pdf.ask]
        if len(asking) and len(told_):
            x = np.frombuffer(b"".join(asking.sketch), np.uint8).reshape(len(asking), -1)
            y = np.frombuffer(b"".join(told_.sketch), np.uint8).reshape(len(told_), -1)
            a_ids, b_ids = asking.node.to_numpy(), told_.node.to_numpy()
            every = np.unique(np.concatenate([a_ids, b_ids]))
            labels = np.arange(len(every))
            pos = np.searchsorted(every, b_ids)
            for k, row in zip(a_ids, x, strict=True):
                i = int(np.searchsorted(every, k))
                others = np.flatnonzero(labels[pos] != labels[i])
                for j in others[(y[others] == row).mean(axis=1) >= likely] if len(others) else []:
                    if labels[pos[j]] != labels[i]:
                        labels[labels == labels[pos[j]]] = labels[i]
                        out.append((int(k), int(b_ids[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    more = tasks.groupBy("key", "a", "b").applyInPandas(compare, "u long, v long")
    held += [kept, members, found, unsure]
    return links.unionByName(more)


def _confirmed_links(groups: DataFrame, docs: DataFrame, doc: str, text: str, width: int, percent: int, held: list[DataFrame]) -> DataFrame:
    """Spanning links (u, v) confirmed on full shingle sets; groups: (node, component, n).

    Tables that the result reads are added to `held`."""
    per = groups.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    per = per.withColumn("blocks", F.ceil(F.greatest(F.col("c") / BLOCK_ROWS, F.col("s") / BLOCK_SHINGLES)).cast("int"))
    one = F.col("blocks") == 1
    sized = stored(groups.join(per, "component"), "groups")
    small, most = sized.agg(F.sum(F.when(one, F.col("n"))), F.max("blocks")).first()
    bins = max(1, -(-int(small or 0) // BLOCK_SHINGLES))
    pivot = ~one & (F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.lit(1), F.floor(F.col("c") / PIVOTS))) == 0)
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    placed = sized.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    # Small groups share tasks, a few megabytes each; blocks of large groups stand alone.
    task = F.when(one, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "block"))
    placed = placed.select("node", "component", "block", one.alias("small"), task.alias("task"))
    body = docs.select(F.col(doc).alias("node"), F.col(text).alias("text"))

    def sets_of(texts) -> list[np.ndarray]:
        return [shingles(word_hashes((t or "").encode("utf-8", "surrogatepass")), width) for t in texts]

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["component", "block"]):
            nodes = g.node.to_numpy()
            labels = np.unique(nodes, return_inverse=True)[1]
            out += [(nodes[i], nodes[j]) for i, j in spanning_links(sets_of(g.text), labels, percent)]
        tidy()
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    first = placed.join(body, "node").groupBy("small", "task").applyInPandas(confirm, "u long, v long")
    links = stored(first, "links")
    held += [sized, links]
    if (most or 0) <= 1:
        return links

    # Documents outside their group's main component so far meet every block of the group.
    large = sized.where("blocks > 1").select("node", "component", "blocks")
    labelled = large.join(connected_components(links).withColumnRenamed("component", "label"), "node", "left")
    labelled = stored(labelled.withColumn("label", F.coalesce("label", "node")), "labelled")
    held.append(labelled)
    main = labelled.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    split = labelled.join(main, "component").withColumn("out", F.col("label") != F.col("main"))
    asks = split.where("out").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("rounds"))
    split = split.join(asks, "component").select(
        "component", "node", "label", "out", F.sequence(F.lit(0), F.col("blocks") - 1).alias("all"), own.alias("mine"),
        F.sequence(F.lit(0), F.col("rounds") - 1).alias("every"), F.pmod(F.xxhash64("node", F.lit(3)), "rounds").cast("int").alias("turn"),
    )
    told = split.select("component", "node", "label", F.col("mine").alias("block"), F.explode("every").alias("turn"), F.lit(False).alias("ask"))
    ask = split.where("out").select("component", "node", "label", F.explode("all").alias("block"), "turn", F.lit(True).alias("ask"))

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = np.unique(pdf.label.to_numpy(), return_inverse=True)[1]
        nodes = pdf.node.to_numpy()
        found = spanning_links(sets_of(pdf.text), labels, percent, pdf["ask"].to_numpy(bool))
        tidy()
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in found], columns=["u", "v"], dtype="int64")

    second = told.unionByName(ask).join(body, "node").groupBy("component", "block", "turn").applyInPandas(rest, "u long, v long")
    return links.unionByName(second)


def near_duplicates(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, bands: int | None = None, rows: int | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; a document's set is its distinct `width`-word shingles, the
    whole sequence where it has fewer words. Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable, kept says that it is the row's own. Bands and limits
    follow from percent (36 bands of 7 minima at 85, 46 of 6 at 80): a pair right at the threshold is missed with a
    probability under 1e-6; every link is confirmed on full sets. There is no
    cap on buckets, partners or candidates: large buckets and groups are compared in blocks.

    Nulls: null, empty and wordless texts have an empty set and link with nothing. A row with a null doc_id is
    not compared: its component is null and it is kept. Rows that share a doc_id count as linked, and each gets
    its own n_shingles; repeated rows repeat. An empty table gives no rows. Extra columns are ignored.
    """
    if bands is None or rows is None:
        bands, rows = banding(percent)
    prints = stored(hashed(docs, doc, text, width, bands, rows), "prints")
    usable = prints.where("doc_id is not null and n > 0")
    classes = stored(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    own = usable.join(classes.select("node", "h1", "h2"), (F.col("doc_id") == F.col("node")) & usable.h1.eqNullSafe(classes.h1) & usable.h2.eqNullSafe(classes.h2))
    own = own.select("node", usable.h1, usable.h2, "n", "bands", "sketch").dropDuplicates(["node", "h1", "h2"])
    reps = stored(own.select("node", "n", "bands", "sketch"), "reps")
    keys = reps.select("node", F.explode("bands").alias("key"))
    held: list[DataFrame] = []
    coarse = connected_components(_likely_links(keys, reps.select("node", "sketch"), *limits(percent, bands * rows), held))
    discard(*held)
    held = [classes, reps]
    sizes = reps.groupBy("node").agg(F.max("n").alias("n"))
    links = _confirmed_links(coarse.join(sizes, "node"), docs, doc, text, width, percent, held)
    # Rows that share a doc_id join their classes.
    shared = usable.join(classes, ["h1", "h2"]).where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    components = connected_components(links.unionByName(shared))
    discard(*held)
    out = prints.join(components, prints.doc_id == components.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
