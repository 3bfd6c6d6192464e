"""Near duplicates by the Jaccard similarity of word shingles: candidates by covering masks, links by the exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare, stored, utf8
from .components import connected_components
from .simhash import _runs, bucket_links

#: Words of a shingle, and the similarity from which texts are near duplicates.
WIDTH, SIMILAR = 5, 0.8
#: Minhashes of a sketch, of a byte each. Bits of the first 128 are two fingerprints: the radius within which covering masks miss no pair, and the bits
#: that two may differ in if they meet all the same. Fingerprints of texts that are 0.8 alike differ in 6.4 of 64 bits on average, give or take 2.4.
HASHES, RADIUS, REACH = 256, 6, 13
#: Standard deviations of a sketch's estimate around SIMILAR within which the exact similarity decides.
DOUBT = 2.6
#: A group with more nodes is searched in blocks, a pair of blocks in a task.
GROUP_NODES = 2_000


def _multipliers() -> np.ndarray:
    x = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) | np.uint64(1)


_MULTIPLIERS = _multipliers()


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of a text's different shingles, sorted. A-Z are lower-cased, words are runs without ASCII white space; a text with
    fewer words is one shingle, a text without words has none."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1) if words else 0
    out = h[:n].copy()
    for k in range(1, min(width, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(own: np.ndarray) -> np.ndarray:
    """A byte of each minhash of a set of shingles: two sets agree in about as large a share of them as they are alike. All zero for none."""
    if not len(own):
        return np.zeros(HASHES, np.uint8)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 512):
        np.minimum(least, (own[i : i + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
    return (least >> np.uint64(20)).astype(np.uint8)


def matches_for(similarity: float, doubt: float) -> int:
    """In how many bytes two sketches agree, on average and `doubt` standard deviations on, if their sets are so much alike."""
    share = similarity + (1 - similarity) / 256
    return round(HASHES * share + doubt * (HASHES * share * (1 - share)) ** 0.5)


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [sketch(shingles(x.as_py(), width)) for x in batch.column(2)]
        bits = [np.packbits(m[:128] & 1).tobytes() for m in marks]
        whole = [m.tobytes() for m in marks]
        cols = [pa.array([xxhash.xxh3_128_digest(m) for m in whole], pa.binary()), *[pa.array([int.from_bytes(b[i : i + 8], "big", signed=True) for b in bits], pa.int64()) for i in (0, 8)], pa.array(whole, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "h", "node", "fp1", "fp2", "sketch"])


def _closest(marks: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Edges (i, j, matches) of rows that agree in `least` bytes or more: for each component a tree, of its closest pairs."""
    n = len(marks)
    left, best, best_at = np.ones(n, bool), np.zeros(n, np.int64), np.full(n, -1)
    tree: list[tuple[int, int, int]] = []
    for root in range(n):
        front = [root] if left[root] else []
        left[root] = False
        while front:
            p = front.pop()
            same = np.count_nonzero(marks == marks[p], axis=1)
            same[p] = 0
            better = same > best
            best[better], best_at[better] = same[better], p
            found = np.flatnonzero(left & (same >= least))
            left[found] = False
            front += found.tolist()
            tree += [(p, x, int(same[x])) for x in found.tolist()]
    tree += [(int(best_at[i]), int(i), int(best[i])) for i in np.flatnonzero(best >= least)]
    up, out = list(range(n)), []
    for i, j, m in sorted(tree, key=lambda e: (-e[2], e[:2])):
        a, b = i, j
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[b] = a
            out.append((i, j, m))
    return out


def _pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From rows (t, root, x, y, node, sketch) in order: edges (a, b, matches) within each group of the first four."""
    for *key, node, marks in _runs(batches, 4):
        rows = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, HASHES)
        new = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)])
        found = [(node[i + a], node[i + b], m) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(node)]) if j - i > 1 for a, b, m in _closest(rows[i:j], least)]
        cols = list(zip(*((min(a, b), max(a, b), m) for a, b, m in found))) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32()))], names=["a", "b", "matches"])


def candidate_links(nodes: DataFrame, least: int, radius: int = RADIUS, reach: int = REACH) -> DataFrame:
    """Edges (a, b, matches) of nodes whose sketches agree in `least` bytes or more, from rows (node, fp1, fp2, sketch).

    Covering masks bring together all pairs that differ in at most `radius` bits of either fingerprint, and many up to `reach`. Groups that several
    tables have alike are searched once. In each group every node is compared with every other, by sketches, and the closest pairs that connect what
    is connected are sent: fewer edges than nodes. A group with over GROUP_NODES nodes is cut in blocks, and each pair of
    blocks searched by itself, so that no pair is missed and no task holds more.
    """
    out = None
    for column in ("fp1", "fp2"):
        groups = bucket_links(nodes, column, radius, reach)
        groups = groups.unionByName(groups.select("t", "root", F.col("root").alias("fp"))).distinct()
        alike = groups.groupBy("t", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("sig"))
        once = alike.groupBy("root", "n", "sig").agg(F.min("t").alias("t")).select("t", "root")
        # values of a fingerprint that several nodes share are a group of their own, of table -1
        own = nodes.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(-1).alias("t"), F.col(column).alias("root"), F.col(column).alias("fp"))
        members = groups.join(once, ["t", "root"]).unionByName(own, allowMissingColumns=True)
        rows = stored(members.join(nodes.select(F.col(column).alias("fp"), "node"), "fp").select("t", "root", "node"), "members")
        large = rows.groupBy("t", "root").agg(F.ceil(2 * F.count("*") / GROUP_NODES).cast("int").alias("blocks")).where("blocks > 2")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(block, i).alias("x"), F.greatest(block, i).alias("y")))
        rows = rows.join(large, ["t", "root"], "left").select("t", "root", "node", F.explode(F.when(F.col("blocks").isNotNull(), pairs).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))).alias("p"))
        rows = rows.join(nodes.select("node", "sketch"), "node").select("t", "root", "p.x", "p.y", "node", "sketch")
        key = ["t", "root", "x", "y"]
        edges = rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(lambda it: _pairs(it, least), "a binary, b binary, matches int")
        out = edges if out is None else out.unionByName(edges)
    return out.groupBy("a", "b").agg(F.max("matches").alias("matches"))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(x.as_py(), width).view(np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similar: float = SIMILAR, radius: int = RADIUS, reach: int = REACH) -> DataFrame:
    """One row per row of docs: doc_id, h (a hash of the text), first, a struct with the doc_id and h of its group's row that
    stays: the smallest doc_id (null ids last), then the smallest h.

    Two texts are linked if their sets of shingles of `width` words have a Jaccard similarity of `similar` or more; groups are what links connect.
    A text's sketch has a byte of each of 256 minhashes of its shingles, and bits of those are two fingerprints of 64 bits. A SimHash would differ in 10 bits at a similarity of 0.8, where these
    differ in 6.4, so that covering masks of a radius that can be paid for bring more of the pairs together, whatever was edited, cut, moved or added. Candidates (see candidate_links) whose
    sketches leave a doubt are decided by the whole sets of their shingles; those far above need none. So no pair far below `similar` is
    linked; of pairs that are 0.8 alike about 0.93 meet, and of closer ones more. Texts with equal sketches are one node.

    Null and empty texts are near duplicates of each other; a text with fewer than `width` words is one shingle. Very long texts are hashed whole.
    Repeated rows have one node. An empty table gives an empty result; extra columns are ignored.
    """
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("h"), utf8(f"`{text}`").alias("raw"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    prints = stored(ids.mapInArrow(lambda it: _prints(it, width), f"doc_id {kind}, h long, node binary, fp1 long, fp2 long, sketch binary"), "sketches")
    nodes = prints.groupBy("node").agg(F.min("fp1").alias("fp1"), F.min("fp2").alias("fp2"), F.min("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("own"))
    nodes = stored(nodes, "nodes")
    edges = stored(candidate_links(nodes, matches_for(similar, -DOUBT), radius, reach), "candidates")
    sure = F.col("matches") >= matches_for(similar, DOUBT)
    doubted = edges.where(~sure).select("a", "b")
    asked = doubted.select(F.col("a").alias("node")).unionByName(doubted.select(F.col("b").alias("node"))).distinct()
    asked = asked.join(nodes, "node").select("node", F.col("own.doc_id").alias("own_id"), F.col("own.h").alias("own_h"))
    texts = ids.join(asked, (F.col("h") == F.col("own_h")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("node", "raw").dropDuplicates(["node"])
    sets = stored(texts.mapInArrow(lambda it: _sets(it, width), "node binary, own array<long>"), "shingles")
    both = doubted.join(sets.select(F.col("node").alias("a"), F.col("own").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    linked = both.where(common >= similar * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")
    roots = connected_components(edges.where(sure).select("a", "b").unionByName(linked)).withColumnRenamed("root", "top")
    nodes = stored(nodes.select("node", "own").join(roots, "node", "left").withColumn("top", F.coalesce("top", "node")), "roots")
    least = nodes.groupBy("top").agg(F.min("own").alias("least"))
    named = nodes.join(least, "top").select("node", F.struct("least.doc_id", "least.h").alias("first"))
    return prints.select("doc_id", "h", "node").join(named, "node").select("doc_id", "h", "first")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row for each group of near_duplicates: the one with the smallest doc_id (null ids last), of repeated
    rows one. Extra columns stay as they are. An empty table gives an empty result. Texts are shuffled once."""
    names = spare(docs, "text_h", "id_text", "id_null")
    h, as_text, is_null = names
    first = near_duplicates(docs, doc_id, text, **options).select("first.*").distinct()
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(as_text), F.col("doc_id").isNull().alias(is_null), F.col("h").alias(h)]
    same = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    rows = docs.withColumns({h: F.xxhash64(f"`{text}`"), as_text: same, is_null: F.col(f"`{doc_id}`").isNull()})
    keys = [as_text, is_null, h]
    return rows.dropDuplicates(keys).join(first.select(*own), keys, "left_semi").select(*[f"`{c}`" for c in docs.columns])
