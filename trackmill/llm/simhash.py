"""SimHash near-duplicates; candidates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, spare, stored, utf8
from .components import connected_components

BITS = 64
#: A bucket with more values is not searched in one task but cut further.
BUCKET_VALUES = 50_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of a UTF-8 text as a signed integer.

    A-Z are lower-cased; words are runs without ASCII white space. Every shingle of `width` words counts, repeats
    included; a text with fewer words is one shingle, and a text without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42) - (1 << 64 if xxhash.xxh64_intdigest(joined, 42) >> 63 else 0)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[i:j], 42) for i, j in zip(starts, ends[width - 1 :].tolist())])
    values = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    counts = np.bincount((values + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(values)).tobytes(), "big", signed=True)


def with_prints(docs: DataFrame, prints: dict[str, tuple[Callable[[bytes], int | bytes], T.DataType]], text: str = "text") -> DataFrame:
    """docs without the text, and a column for each of `prints`, a function of the text. Null texts count as empty."""
    rest = [c for c in docs.columns if c != text]
    (raw,) = spare(docs, "raw")
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    given = docs.select(*[F.col(f"`{c}`") for c in rest], utf8(f"`{text}`").alias(raw))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, (_, t) in prints.items())])
    jobs = [(f, pa.binary() if isinstance(t, T.BinaryType) else pa.int64()) for f, t in prints.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[f(x) for f, _ in jobs] for x in batch.column(len(rest)).to_pylist()]
            values = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(jobs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *values], names=schema.names)

    return given.mapInArrow(run, schema)


def with_fingerprints(docs: DataFrame, name: str, text: str = "text", width: int = 4) -> DataFrame:
    """docs without the text, and a long column `name` with the fingerprint."""
    return with_prints(docs, {name: (lambda x: fingerprint(x, width), T.LongType())}, text)


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; any two values that differ in at most `radius` bits agree under one of them.

    Each bit position has a non-zero vector of radius + 1 bits; mask v keeps the positions whose vector has an odd
    product with v. The vectors of at most `radius` positions lie in a proper subspace, so that some v is orthogonal
    to them all, and its mask leaves all of them out (Pagh, "Locality-Sensitive Hashing without False Negatives",
    2016). Signed, as Spark's longs are.
    """
    n = (1 << (radius + 1)) - 1
    step = max(1, (n + 1) // BITS)  # no mask then keeps fewer than half of the bits
    masks = [sum(1 << i for i in range(BITS) if ((i * step % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cut_masks(mask: int, radius: int) -> list[int]:
    """radius + 1 masks that keep what `mask` keeps and a band of the other bits each. Values that agree under `mask` and
    differ in at most `radius` bits agree under one of them."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    out = [(mask % (1 << 64)) | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _forest(left: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(root, other) for each component of rows: its first row and its others. `near` tells which rows are linked to one.
    Searches from each row only what is not reached."""
    out = []
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            yes = near(left, front.pop())
            if yes.any():
                found, left = left[yes], left[~yes]
                out += [(root, x) for x in found]
                front += list(found)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs that are equal in the first `keys` columns; a run may go on in the next batches. With `most`,
    a run of more rows comes in pieces."""
    held: list[list[np.ndarray]] = []
    whole = lambda parts: [np.concatenate(c) for c in zip(*parts)]
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        other = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
        first = other[-1] + 1 if len(other) else 0
        if held and (first or any(c[-1] != h[-1] for c, h in zip(cols[:keys], held[-1]))):
            yield whole([*held, [c[:first] for c in cols]])
            held = []
        elif first:
            yield [c[:first] for c in cols]
        held.append([c[first:] for c in cols])
        if most and sum(len(h[0]) for h in held) > most:
            yield whole(held)
            held = []
    if held:
        yield whole(held)


def _link(batches: Iterator[pa.RecordBatch], masks: np.ndarray, reach: int, most: int) -> Iterator[pa.RecordBatch]:
    """From rows (t, fp), in order of t and of what mask t keeps of fp, the bucket: rows (t, root, fp) of each bucket's
    components of two and more. Of buckets with over `most` values, rows (t, null, fp)."""
    near = lambda left, x: np.bitwise_count(left ^ x) <= reach

    def keyed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, fp = batch.column(0), batch.column(1)
            k = pa.array(fp.to_numpy() & masks[t.to_numpy()], pa.int64())
            yield pa.RecordBatch.from_arrays([t, k, fp], names=["t", "k", "fp"])

    large = None
    for t, k, fp in _runs(keyed(), 2, most):
        fp = fp.view(np.uint64)  # bits of signed values would be counted without their sign
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        length = np.diff(np.r_[new, len(t)])
        over = length > most
        over[0] |= large == (t[0], k[0])  # a large bucket goes on
        two = new[(length == 2) & ~over]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= reach]
        at, root, value = [t[two]], [fp[two]], [fp[two + 1]]
        some = (length > 2) & ~over
        for i, n in zip(new[some].tolist(), length[some].tolist()):
            if found := _forest(fp[i : i + n], near):
                at.append(np.full(len(found), t[i], np.int32))
                root.append(np.array([a for a, _ in found], np.uint64))
                value.append(np.array([b for _, b in found], np.uint64))
        rest = [np.arange(i, i + n) for i, n in zip(new[over].tolist(), length[over].tolist())]
        large = (t[-1], k[-1]) if over[-1] else None
        t_, a, b = (np.concatenate(x) for x in (at, root, value))
        cols = [pa.array(t_, pa.int32()), pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["t", "root", "fp"])
        if rest:
            own = np.concatenate(rest)
            cols = [pa.array(t[own], pa.int32()), pa.nulls(len(own), pa.int64()), pa.array(fp[own].view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["t", "root", "fp"])


def bucket_links(fingerprints: DataFrame, column: str, radius: int = 4, reach: int | None = None) -> DataFrame:
    """Rows (t, root, fp): fp is reached from root within a bucket of table t over links of at most `reach` bits, by default
    `radius`. Pairs within the radius all meet in a bucket; beyond it some do.

    Equal fingerprints are one node, so copies cost nothing. Each distinct value goes to one bucket of each of the
    2^(radius+1) - 1 tables. Of a bucket only the components with their first value are sent out, never all pairs; its
    values are 8 bytes each and are searched only against those not yet reached. A bucket with over BUCKET_VALUES values
    is dealt anew over radius + 1 wider masks, which again no pair within the radius escapes, until every bucket fits a
    task.
    """
    nodes = fingerprints.select(F.col(column).alias("fp")).where("fp IS NOT NULL").distinct()
    masks, out, most = covering_masks(radius), None, BUCKET_VALUES
    rows = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"), "fp")
    while True:
        key = F.col("fp").bitwiseAND(F.get(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("t")))
        rows = rows.repartition(F.col("t"), key).sortWithinPartitions(F.col("t"), key, F.col("fp"))
        own = np.array(masks, np.int64)
        found = stored(rows.mapInArrow(lambda it, own=own: _link(it, own, reach or radius, most), "t int, root long, fp long"), "buckets")
        done = found.where("root IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        large = found.where("root IS NULL")
        tables = sorted(r.t for r in large.select("t").distinct().collect())  # at most a level's tables
        if not tables:
            return out
        masks = [m for t in tables for m in cut_masks(masks[t], radius)]
        wider = F.array_position(F.array(*map(F.lit, tables)), F.col("t")).cast("int") - 1
        each = F.explode(F.sequence(wider * (radius + 1), wider * (radius + 1) + radius))
        rows = large.select(each.alias("t"), "fp")


def fingerprint_links(fingerprints: DataFrame, column: str, radius: int = 4) -> DataFrame:
    """Edges (a, b) between fingerprints that span every component of "differ in at most radius bits"."""
    return bucket_links(fingerprints, column, radius).select(F.col("root").alias("a"), F.col("fp").alias("b"))


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id.

    component_id is the smallest doc_id that can be reached over links of at most `radius` bits, the document's own
    included. Null or empty texts have fingerprint zero and link like any other. Rows with a null doc_id keep their
    row; they never name a component unless it has no other id, when it is null. Repeated rows stay repeated. Extra
    columns are ignored; an empty table gives an empty result.
    """
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = stored(with_fingerprints(ids, "fp", "text", width), "fingerprints")
    roots = connected_components(fingerprint_links(prints, "fp", radius)).withColumnRenamed("node", "fp")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    nodes = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = nodes.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: whole texts, 4-word shingles, links at 4 bits or fewer."""
    out = near_duplicate_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
