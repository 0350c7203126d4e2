"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; its key is the exclusive or of
the 128-bit hashes of its (place, role, text), so a parent's key is the node's
key without its last turn.  Texts are hashed in the scan and never shuffled.

Totals of all subtrees come from join rounds over the node table:

* *rake*: every childless node is taken off; its totals are added to its
  parent's (a grouped sum, combined before the shuffle, so a parent with very
  many children is no hot key);
* *compress*: in chains of nodes with one child each, the nodes that are local
  minima of a hash are spliced out: the child takes the node's parent and adds
  the node's own amount (about a third of a chain goes in each round).

Every round takes all leaves and a share of every chain, so the number of
rounds grows with the logarithm of the nodes, not with the depth.  Afterwards
the spliced nodes come back in reverse order: the removed node's total is what
its child had, and the child's is that less the node's own amount.  Each round
is written to the shared folder; a lost executor costs one round at most.

Turns are numbered within (conversation, turn number / ``SPAN``) with offsets
per span, so a very long conversation is spread over tasks.  The ends of a node
are joined in blocks of conversation numbers and digested as a stream.

Turns are ordered by turn (null first); turns of equal number by the hash of
role and text.  A null role or text is empty, a very long text one hash.  Rows
without a conversation number belong to no conversation.  Repeated rows are
turns of their own.  An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import partitions
from corpuskit.session import materialize

SPAN = 256         # turns of a conversation that one window numbers
END_BLOCK = 4096   # conversation numbers that are joined in one piece
WORD = "[^\\x20\\x09-\\x0D]+"

_KEY, _PARENT, _SUMS = ["a", "b"], ["pa", "pb"], ["n_leaves", "saved_tokens"]


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, words): the text as two hashes and its word count."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit("second"), text, role).alias("k2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _carried(df: DataFrame, inside: list[Column], running: dict[str, Column], total: dict[str, Column], add) -> DataFrame:
    """Running values over each conversation, as running values over its spans
    and the total of the spans before (``add`` joins the two)."""
    span = Window.partitionBy("conv_id", "span").orderBy(*inside).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id", "span")
    held = materialize(df.withColumns({k: c.over(span) for k, c in running.items()} | {f"_{k}": c.over(whole) for k, c in total.items()} | {"_row": F.row_number().over(span)}), "spans")
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation within one span (nearly all) has no offset
    several = held.where("_row = 1").groupBy("conv_id").agg(F.count("*").alias("spans")).where("spans > 1").select("conv_id")
    heads = held.where("_row = 1").join(several, "conv_id", "left_semi")
    sums = heads.select("conv_id", "span", *[(F.sum if k == "nth" else F.bit_xor)(f"_{k}").over(earlier).alias(f"_off_{k}") for k in total])
    joined = held.drop("_row", *[f"_{k}" for k in total]).join(sums, ["conv_id", "span"], "left")
    return joined.withColumns({k: add(F.col(k), F.coalesce(F.col(f"_off_{k}"), F.lit(0).cast("long"))) for k in running}).drop("span", *[f"_off_{k}" for k in total])


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``nth``: the place in the conversation, from 1."""
    spanned = turns.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62)).cast("long")))
    order = [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]
    return _carried(spanned, order, {"nth": F.count(F.lit(1))}, {"nth": F.count(F.lit(1))}, lambda x, off: x + off)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, a, b, pa, pb): the node of every first ``depth``
    turns, and its parent, from turns (conv_id, depth, k1, k2, words)."""
    own = turns.select("conv_id", "depth", "words", F.xxhash64("depth", "k1", "k2").alias("t1"), F.xxhash64("k2", "k1", "depth").alias("t2"), F.floor(F.col("depth") / SPAN).alias("span"))
    run = _carried(own, [F.col("depth")], {"a": F.bit_xor("t1"), "b": F.bit_xor("t2")}, {"a": F.bit_xor("t1"), "b": F.bit_xor("t2")}, lambda x, off: x.bitwiseXOR(off))
    return run.select("conv_id", "depth", "words", "a", "b", F.col("a").bitwiseXOR(F.col("t1")).alias("pa"), F.col("b").bitwiseXOR(F.col("t2")).alias("pb"))


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(k).alias(v) for k, v in names.items()])


def contract(nodes: DataFrame) -> DataFrame:
    """(a, b, n_children, n_leaves, saved_tokens) of every node of a forest
    from (a, b, pa, pb, saved): the parent of a root is null."""
    none = F.lit(0).cast("long")
    # (the round is a column, so that all rounds run the same compiled code)
    active = nodes.select(*_KEY, *_PARENT, none.alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), none.alias("round"))
    raked, spliced, children = [], [], None
    while True:
        kids = active.where("pa is not null").groupBy(*_PARENT).agg(F.count("*").alias("kids"))
        marked = active.join(_renamed(kids, {"pa": "a", "pb": "b", "kids": "kids"}), _KEY, "left")
        # a node without a child in the first round is a leaf; later ones hold what was raked before
        marked = marked.withColumn("n_leaves", F.when(F.col("kids").isNull() & (F.col("round") == 0), F.lit(1).cast("long")).otherwise(F.col("n_leaves")))
        given = marked.where("kids is null and pa is not null").groupBy(*_PARENT).agg(*[F.sum(c).alias(f"_{c}") for c in _SUMS])
        given = marked.join(_renamed(given, {"pa": "a", "pb": "b"} | {f"_{c}": f"_{c}" for c in _SUMS}), _KEY, "left")
        after = materialize(given.select(*_KEY, *_PARENT, "kids", *[(F.col(c) + F.coalesce(f"_{c}", none)).alias(c) for c in _SUMS], (F.col("round") + 1).alias("round")), "raked")
        raked.append(after.where("kids is null").select(*_KEY, *_SUMS))
        if children is None:
            children = after.select(*_KEY, F.coalesce("kids", none).alias("n_children"))
        left = after.where("kids is not null").drop("kids")
        if left.isEmpty():
            break
        only = left.where("pa is not null").groupBy(*_PARENT).agg(F.count("*").alias("kids"), F.min(F.struct(*_KEY)).alias("kid")).where("kids = 1")
        only = only.select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("kid.a").alias("ka"), F.col("kid.b").alias("kb"))
        order = lambda x, y: F.xxhash64("round", x, y)
        least = (order("a", "b") < order("pa", "pb")) & (order("a", "b") < order("ka", "kb"))
        out = materialize(left.join(only, _KEY).where("pa is not null").where(least), "spliced")
        spliced.append(out)
        taken = out.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
        rest = left.join(out.select(*_KEY), _KEY, "left_anti").join(taken, _KEY, "left")
        got = F.col("_pa").isNotNull()
        active = rest.select(*_KEY, *[F.when(got, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _PARENT], *[(F.col(c) + F.coalesce(f"_{c}", none)).alias(c) for c in _SUMS], "round")
    totals = raked[0]
    for more in raked[1:]:
        totals = totals.union(more)
    # only nodes of chains change when those come back
    touched = None
    for out in spliced:
        ends = out.select(*_KEY).union(out.select("ka", "kb"))
        touched = ends if touched is None else touched.union(ends)
    if touched is not None:
        touched = materialize(touched.distinct(), "chains")
        still, totals = materialize(totals.join(touched, _KEY, "left_semi"), "chain-totals"), totals.join(touched, _KEY, "left_anti")
        for k, out in enumerate(reversed(spliced)):
            own = out.select("ka", "kb", F.col("a").alias("va"), F.col("b").alias("vb"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
            both = still.join(_renamed(own, {"ka": "a", "kb": "b", "va": "va", "vb": "vb"} | {f"_{c}": f"_{c}" for c in _SUMS}), _KEY, "left")
            below = F.struct(*_KEY, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0).cast("long"))).alias(c) for c in _SUMS])
            above = F.struct(F.col("va").alias("a"), F.col("vb").alias("b"), *_SUMS)
            still = both.select(F.explode(F.when(F.col("va").isNull(), F.array(below)).otherwise(F.array(below, above))).alias("t")).select("t.*")
            if k % 3 == 2:
                still = materialize(still, "expanded")
        totals = totals.union(still)
    return children.join(materialize(totals, "totals"), _KEY)


def _digests(batches):
    """SHA-256 of each node's joined conversation numbers, its pieces in order."""
    now, told = None, None
    for batch in batches:
        a, b, sha = [], [], []
        for x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (x, y) == now:
                told.update(b"," + ids.encode())
                continue
            if now is not None:
                a.append(now[0])
                b.append(now[1])
                sha.append(told.hexdigest())
            now, told = (x, y), hashlib.sha256(ids.encode())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], names=["a", "b", "ends_sha256"])
    if now is not None:
        yield pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([told.hexdigest()])], names=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) from one row (a, b, conv_id) per conversation."""
    block = F.floor(F.col("conv_id") / END_BLOCK).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*_KEY, block).agg(ids.alias("ids"))
    dealt = pieces.repartition(partitions(ends.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "block")
    return dealt.select(*_KEY, "ids").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: its key (a, b), depth, conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has one row (conv_id) per conversation, ``turns`` one row
    (conv_id, depth, k1, k2, words) per turn, depth from 1 without gaps.
    """
    zero = F.lit(0).cast("long")
    pre = materialize(prefixes(turns), "prefixes")
    grown = pre.groupBy(*_KEY).agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("words"), none.alias("pa"), none.alias("pb"))
    nodes = materialize(grown.withColumn("depth", F.col("depth").cast("long")).union(root), "nodes")
    totals = contract(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    last = pre.groupBy("conv_id").agg(F.max(F.struct("depth", *_KEY)).alias("l")).select("conv_id", F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(totals, _KEY).join(end_digests(ends), _KEY, "left").join(above, _PARENT, "left")
    return told.select(*_KEY, "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) in which every conversation c starts with the first h
    turns of conversation c - c % group, in place of its own first h (h is the
    CRC-32 of c's digits modulo ``most``)."""
    own = materialize(numbered(hashed_turns(conversations)), "numbered")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    first = own.where(F.col("nth") < most).select(F.col("conv_id").alias("base"), "nth", "k1", "k2", "words")
    held = first.groupBy("base").agg(F.count("*").alias("n_base"))
    convs = materialize(convs.join(held, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))).alias("given")), "conversations")
    taken = convs.join(first, "base").where("nth <= h").select("conv_id", F.col("nth").alias("depth"), "k1", "k2", "words")
    rest = own.join(convs, "conv_id").where("nth > h").select("conv_id", (F.col("nth") - F.col("h") + F.col("given")).alias("depth"), "k1", "k2", "words")
    return convs.select("conv_id"), taken.union(rest)
