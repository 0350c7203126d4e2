"""MinHash near-duplicates with a circulant signature.

A document's set holds its distinct 5-word shingles (64-bit hashes).  One
permutation scatters the set, a second one, shifted by 0, 1, 2, ..., gives all
signature coordinates; 32 bands of 4 coordinates propose candidates (a pair at
similarity 0.75 is missed with probability (1 - 0.75^4)^32, about 5e-6), and
every link is confirmed on the full sets.

1. Documents with equal sets form a class at once; one of them goes on.
2. Classes that share a band are compared with the least class of that bucket;
   confirmed links give first components.
3. In buckets that still hold several components, the pairs across components
   are compared by signature inside tasks of bounded size (a larger bucket is
   dealt out in blocks).  A row of the result lists the likely pairs of two
   blocks of documents; each pair is listed for its first common band only.
   The lists meet the sets of their documents by blocks, and a task confirms
   pairs until their components are one.  So no link between components is
   lost, and no bucket is expanded into rows of pairs.
4. Sets for confirmation are computed again from the texts, only for classes
   with a candidate (a fixed-size bitmap tells most others).

Null or empty text: no set, no link.  Rows with equal text and id fall into one
class.  A component takes the smallest non-null id of its documents.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import in_bitmap, in_slices, key_bitmap, partitions
from corpuskit.llm.components import components
from corpuskit.llm.textwords import WHITE, Words, grams, mix
from corpuskit.session import materialize

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
BLOCK = 1000         # rows that meet in one pairwise comparison
LIKELY = 0.57        # share of equal coordinates below which 0.75 is out of the question (4.7 deviations)
PAIRS_A_TASK = 1 << 22  # pairs that one task of the pairwise comparison should hold
MOST_TASKS = 100_000
BITMAP_BITS = 1 << 26

SIGNED = "row long, doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, short_bands binary, signature binary"


def _sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, offsets): sorted within each text; a text of
    fewer than k words has its whole sequence as its one shingle."""
    hashes = words.hashes()
    values = grams(hashes, k)
    parts = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= k:
            parts.append(np.unique(values[lo:hi - k + 1]))
        else:
            parts.append(grams(hashes[lo:hi], hi - lo) + np.uint64(hi - lo) if hi > lo else np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """texts x COORDINATES least images: coordinate c is the least of
    pi(sigma(x) + c) over the set, sigma and pi permutations of 32-bit words."""
    some = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, COORDINATES), np.uint32)
    if not len(some):
        return out
    scattered = (mix(values) >> np.uint64(32)).astype(np.uint32)  # sigma
    at = off[:-1][some]
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            x = scattered + np.uint32(c)
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            x ^= x >> np.uint32(16)
            out[some, c] = np.minimum.reduceat(x, at)
    return out


def _sign(batches, k: int):
    import xxhash

    row = TaskContext.get().partitionId() << 36
    salt = np.arange(1, BANDS + 1, dtype=np.uint64)
    for batch in in_slices(batches, "text", 2 << 20):
        values, off = _sets(Words(batch.column("text"), WHITE), k)
        size, signed = np.diff(off), signatures(values, off)
        with np.errstate(over="ignore"):
            wide = signed.reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(salt, wide.shape[:2]).copy()
            for r in range(ROWS):
                key = mix(key + wide[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
        digest = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(size) + 1) * BANDS, BANDS), pa.int32()), pa.array(key.view(np.int64).reshape(-1)))
        yield pa.record_batch([pa.array(np.arange(row, row + len(size))), batch.column("doc_id"), batch.column("text_key"), pa.array(size), pa.array(digest, pa.binary()), bands,
                               pa.array([x.tobytes() for x in key.astype(np.uint32)], pa.binary()), pa.array([x.tobytes() for x in signed.astype(np.uint8)], pa.binary())],
                              names=["row", "doc_id", "text_key", "n_shingles", "digest", "bands", "short_bands", "signature"])
        row += len(size)


def _full_sets(batches, k: int, bitmap):
    import xxhash

    seen = set()
    for batch in in_slices(batches, "text"):
        batch = batch.filter(pa.array(in_bitmap(bitmap.value, batch.column("need_key").to_numpy())))
        if not batch.num_rows:
            continue
        values, off = _sets(Words(batch.column("text"), WHITE), k)
        digest, sets = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            d = xxhash.xxh3_128_digest(values[a:b].tobytes())
            if b > a and d not in seen:
                seen.add(d)
                digest.append(d)
                sets.append(values[a:b].view(np.int64))
        yield pa.record_batch([pa.array(digest, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])


def _likely(members: pd.DataFrame) -> pd.DataFrame:
    """One group (a bucket, or two parts of it): the pairs across components
    that may reach the threshold, one row for each pair of blocks, and the
    nodes in them."""
    members = members.drop_duplicates("node").sort_values(["n", "node"])
    node, root, size, part, block = (members[c].to_numpy() for c in ("node", "root", "n", "part", "block"))
    band, two = members["band"].iloc[0], len(np.unique(part)) > 1
    sign = np.frombuffer(b"".join(members["signature"]), np.uint8).reshape(len(members), -1)
    keys = np.frombuffer(b"".join(members["short_bands"]), np.uint32).reshape(len(members), -1)
    us, vs = [], []
    upto = np.searchsorted(size * PERCENT, 100 * size, "right")  # larger sets than that are out of reach
    for i in range(len(node) - 1):
        after = slice(i + 1, max(upto[i], i + 1))
        asked = root[after] != root[i]
        if two:
            asked &= part[after] != part[i]
        if band:  # else an earlier bucket has the pair
            asked &= ~(keys[after, :band] == keys[i, :band]).any(axis=1)
        j = np.flatnonzero(asked) + i + 1
        if not len(j):
            continue
        j = j[(sign[j] == sign[i]).mean(axis=1) >= LIKELY]
        us.append(np.full(len(j), i))
        vs.append(j)
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    meet = pd.DataFrame({"lo": np.minimum(block[u], block[v]), "hi": np.maximum(block[u], block[v]), "us": node[u], "vs": node[v]})
    rows = [(lo, hi, p["us"].to_numpy(), p["vs"].to_numpy(), np.union1d(p["us"], p["vs"])) for (lo, hi), p in meet.groupby(["lo", "hi"])]
    return pd.DataFrame(rows, columns=["lo", "hi", "us", "vs", "nodes"])


def _confirm(lists: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Links of two blocks that join components not joined so far."""
    at = {n: k for k, n in enumerate(sets["node"])}
    values, up = sets["shingles"].tolist(), {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    root, links = sets["root"].to_numpy(), []
    for us, vs in zip(lists["us"], lists["vs"]):
        for u, v in zip(us, vs):
            x, y = find(root[at[u]]), find(root[at[v]])
            if x == y:
                continue
            a, b = values[at[u]], values[at[v]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= PERCENT * (len(a) + len(b) - both):
                up[max(x, y)] = min(x, y)
                links.append((min(u, v), max(u, v)))
    return pd.DataFrame(links, columns=["u", "v"]).astype("int64")


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, text_key (xxhash64 of the text), n_shingles,
    component_id, links (confirmed links of its class that were needed to find the
    component), kept (doc_id =
    component_id) and first (one row of each component)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    signed = materialize(texts.mapInArrow(functools.partial(_sign, k=k), SIGNED), "signatures")

    # the least document of each class stands for it; its row is the class's node
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    classes = materialize(signed.where("digest is not null").groupBy("digest").agg(least, F.count("*").alias("copies")).select("digest", F.col("least.row").alias("node"), F.col("least.doc_id").alias("least_id"), "copies"), "classes")
    nodes = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi")

    banded = nodes.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("held"), F.min("node").alias("centre")).where("held > 1")
    members = materialize(banded.join(buckets, "bucket"), "buckets")
    stars = members.where("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    sizes = nodes.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"))
    shared = materialize(members.select("node").distinct(), "shared-nodes")

    need = signed.join(shared, signed["row"] == shared["node"], "left_semi").select(F.xxhash64("doc_id", "text_key").alias("need_key"))
    bitmap = spark.sparkContext.broadcast(key_bitmap(need, "need_key", BITMAP_BITS))
    keyed = texts.select("text", F.xxhash64("doc_id", "text_key").alias("need_key"))
    sets = keyed.mapInArrow(functools.partial(_full_sets, k=k, bitmap=bitmap), "digest binary, shingles array<long>")
    sets = materialize(sets.join(classes.select("digest", "node"), "digest").join(shared, "node", "left_semi").select("node", "shingles"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sizes.select(F.col("node").alias("u"), F.col("n").alias("nu"))
        b = sizes.select(F.col("node").alias("v"), F.col("n").alias("nv"))
        near = pairs.join(a, "u").join(b, "v").where(100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv"))
        full = near.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
        both = F.size(F.array_intersect("su", "sv"))
        return full.where(100 * both >= PERCENT * (F.size("su") + F.size("sv") - both)).select("u", "v").distinct()

    first = materialize(confirmed(stars), "star-links")
    roots = components(first)
    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_buckets = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("left")).where("a != b")
    rest = labelled.select("bucket", "node", "n", "root").join(open_buckets.select("bucket", "left"), "bucket")
    # a bucket of several parts: each row meets its own part and every other part once
    parts = F.ceil(F.col("left") / BLOCK).cast("long")
    part = F.pmod(F.xxhash64("node"), parts)
    rest = rest.select("bucket", "node", "n", "root", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    rest = rest.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    # blocks of nodes that share a least centre, as likely partners do
    near = members.groupBy("node").agg(F.min("centre").alias("label"))
    wide = near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    blocks = near.join(wide, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "blocks")).alias("block"))
    held = materialize(nodes.select(F.col("row").alias("node"), "signature", "short_bands", "bands").join(blocks, "node"), "node-blocks")
    rest = rest.join(held, "node").withColumn("band", F.array_position("bands", F.col("bucket")) - 1).drop("bands", "other")
    # tasks by the pairs they compare, not by the bytes they read
    pairs = open_buckets.agg(F.coalesce(F.sum(F.col("left").cast("double") * F.col("left")), F.lit(0.0)).alias("pairs")).first()["pairs"]
    tasks = int(min(MOST_TASKS, max(partitions(spark), pairs // PAIRS_A_TASK)))
    lists = rest.repartition(tasks, "bucket", "lo", "hi").groupBy("bucket", "lo", "hi").applyInPandas(_likely, "lo long, hi long, us array<long>, vs array<long>, nodes array<long>")
    lists = materialize(lists, "likely")
    wanted = lists.select("lo", "hi", F.explode("nodes").alias("node")).distinct()
    labels = labelled.select("node", "root").distinct()
    met = materialize(wanted.join(labels, "node").join(sets, "node"), "met-sets")
    second = lists.drop("nodes").groupBy("lo", "hi").cogroup(met.groupBy("lo", "hi")).applyInPandas(_confirm, "u long, v long")
    second = materialize(second.distinct(), "more-links")
    links = first.union(second).distinct()
    roots = materialize(components(links), "roots")

    ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    grouped = classes.join(roots, "node", "left").join(ends, "node", "left").withColumn("root", F.coalesce("root", "node")).where("copies > 1 or links is not null")
    grouped = materialize(grouped, "grouped")
    heads = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "node")).alias("head"))
    told = grouped.join(heads, "root").select("digest", "component_id", F.coalesce("links", F.lit(0)).alias("links"), F.col("head.node").alias("head"))
    out = signed.select("row", "doc_id", "text_key", "n_shingles", "digest").join(told, "digest", "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce(F.col("head") == F.col("row"), F.lit(True)).alias("first"))
