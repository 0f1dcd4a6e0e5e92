"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document is the set of its distinct ``SHINGLE``-word shingles (fewer words: the whole sequence as one).  A class
is the set of documents with equal shingle sets; it is handled once, under its smallest id.

  shared shingles  A shingle that no other class holds is in no intersection.  One exchange over chunks of documents
                   (``exchange.round_trip``) marks the shingles that several classes hold; a document whose shared
                   shingles alone cannot reach the threshold has no partner and is finished.  This is exact, and
                   leaves the documents with a near copy and few others.
  sketches         the ``K`` smallest hashes of a document's shared shingles
  inverted lists   sketch value -> classes.  Two linked classes share at least ``required`` values, so they meet in a
                   list of each one's rarest ``size - required + 1`` values; only those are kept.
  candidates       all pairs of a short list.  In a long list all members are compared with its pivot, the member with
                   the fewest shingles of its own; then more members in rounds, each with the members of other
                   components, until no two components of a list are left uncompared.  Pairs whose counts rule a link
                   out are not formed: what two members have in common is bounded by what each shares with the pivot
                   and by the overlap of their differences from it, which two small bit maps bound from above.
  estimate         pairs whose K smallest values of the united sketches hold too few common ones are dropped
  verification     Jaccard similarity of the full shingle sets

For K = 48 a link of similarity 0.85 has fewer than 19 common values among the K smallest of the union with a
probability under 1e-12 (binomial tail); sets of up to K shingles are compared whole, without any chance.  Classes are
told apart by 32 bits of their hash when shared shingles are marked.

Defined results: NULL, empty or blank text -> no shingles, no link, own component; rows that share an id are one
document (their components join); a NULL id gives component NULL and is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import top_n_per_group
from ..session import cut_lineage, ensure_checkpoint_dir
from .blocks import U64, mix, shingle_hashes, span_hashes, text_bytes, text_column, whole_hash, word_spans
from .components import components
from .exchange import buckets_of, pack, round_trip, unpack

SHINGLE = 5
THRESHOLD = (85, 100)  # linked: 100 * intersection >= 85 * union
K = 48
COMMON = 19            # common values that a link has among the K smallest of the union
SHORT_LIST = 16        # lists up to this length give all their pairs at once
_SALT = U64(0x632BE59BD9B4E019)
_KEY_BITS = 48         # bits of a shingle that are compared when shared shingles are marked: more look shared at worst


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text."""
    st, en, doc = word_spans(buf, off)
    words = span_hashes(buf, st, en)
    ends = np.searchsorted(doc, np.arange(len(off)))
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        w = words[a:b]
        out.append(np.unique(shingle_hashes(w, size)) if b - a >= size else whole_hash(w) if b > a else w)
    return out


def _describe(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, n (set size), two 64-bit hashes of the set, and ``shared``: the ascending shingles that other classes
    hold too, NULL where they are too few for any link."""
    share, whole = threshold
    buckets = buckets_of(docs)
    bits = U64(64 - _KEY_BITS)

    def sets_of(blocks):
        """Per block: (block, sets, first hash of each set); then all shingle keys and the class of each."""
        parts = []
        for b in blocks:
            sets = shingle_sets(*text_bytes(text_column(b)), size)
            with np.errstate(over="ignore"):
                parts.append((b, sets, np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)))
        every = [s for _, sets, _ in parts for s in sets]
        lengths = [len(s) for s in every]
        keys = np.concatenate(every) >> bits if every else np.empty(0, np.uint64)
        owner = np.repeat(mix(np.concatenate([p[2] for p in parts])).astype(np.uint32), lengths)
        return parts, keys, owner

    def runs(key):
        b = (key * U64(buckets)) >> U64(_KEY_BITS)
        found, first = np.unique(b, return_index=True)
        return [(int(x), slice(i, j)) for x, i, j in zip(found, first, np.append(first[1:], len(key)))]

    def held(key, owner, many):
        """(distinct keys, smallest owner, several owners?, number of the key of each entry)."""
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return k, owner, many, order
        low, high = (f.reduceat(owner[order], first) for f in (np.minimum, np.maximum))
        where = np.empty(len(k), np.int64)
        where[order] = np.cumsum(new) - 1
        return k[first], low, (low != high) | np.logical_or.reduceat(many[order], first), where

    def send(blocks):
        _, keys, owner = sets_of(blocks)
        key, low, many, _ = held(keys, owner, np.zeros(len(keys), bool))
        for b, s in runs(key):
            yield b, pack(np.diff(key[s], prepend=U64(0)), low[s], np.packbits(many[s]))

    def answer(payloads):
        got = [unpack(p) for p in payloads]
        keys = [np.cumsum(g[0], dtype=np.uint64) for g in got]
        many = np.concatenate([np.unpackbits(g[2], count=len(g[0])).astype(bool) for g in got])
        _, _, many, where = held(np.concatenate(keys), np.concatenate([g[1] for g in got]), many)
        return [pack(np.packbits(x)) for x in np.split(many[where], np.cumsum([len(k) for k in keys])[:-1])]

    def finish(blocks, replies):
        parts, keys, _ = sets_of(blocks)
        key, where = np.unique(keys, return_inverse=True)
        shared = np.zeros(len(key), bool)
        for b, s in runs(key):
            shared[s] = np.unpackbits(unpack(replies[b])[0], count=s.stop - s.start)
        shared = shared[where]
        at = 0
        for b, sets, first in parts:
            kept = []
            for s in sets:
                own = s[shared[at:at + len(s)]]
                at += len(s)
                kept.append(np.sort(own.view(np.int64)) if len(s) and whole * len(own) >= share * len(s) else None)
            with np.errstate(over="ignore"):
                second = np.array([mix(s ^ _SALT).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first.view(np.int64)),
                 pa.array(second.view(np.int64)), pa.array(kept, pa.list_(pa.int64()))],
                names=["doc_id", "n", "set_a", "set_b", "shared"])

    return round_trip(docs, "text", send, answer, finish,
                      "doc_id bigint, n bigint, set_a bigint, set_b bigint, shared array<bigint>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, common: int = COMMON,
                    size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD,
                    short_list: int = SHORT_LIST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    share, whole = threshold
    spark = docs.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/neardup-{uuid.uuid4().hex}"

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = table(_describe(src, size, threshold), "rows")
    known = rows.filter(F.col("doc_id").isNotNull())
    classes = table(known.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    # one row per class that may have a partner; r: its shared shingles
    viable = table(known.filter(F.col("shared").isNotNull()).join(classes, ["set_a", "set_b"])
                   .filter(F.col("doc_id") == F.col("rep")).dropDuplicates(["set_a", "set_b"])
                   .select("rep", "n", F.size("shared").cast("bigint").alias("r"), "shared",
                           F.slice("shared", 1, k).alias("sketch")), "viable")

    # values a link of this class has in common with the other sketch, at least
    exact = F.ceil(F.col("n") * share / whole) - F.greatest(F.lit(0), F.floor(F.col("n") * whole / share) - k)
    required = F.when(F.col("r") <= k, F.greatest(F.lit(1), exact)).otherwise(F.lit(common)).cast("int")
    values = viable.select("rep", "n", "r", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # exploded sketches are larger than the planner thinks: no broadcast
    lists = (values.hint("merge").join(shared, "v").groupBy("rep", "n", "r")
             .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))  # at most k per class
             .withColumn("take", F.size("vs") - required + 1).filter("take > 0")
             .select("rep", "n", "r", F.explode(F.slice("vs", F.lit(1), F.col("take"))).alias("e"))
             .select("rep", "n", "r", F.col("e.v").alias("v")))
    lists = table(lists, "lists")
    # the smallest set of a list bounds what its members can reach; members that cannot reach it leave the list
    least = lists.groupBy("v").agg(F.min("n").alias("n_min"))
    partner = F.greatest(F.col("n_min"), F.ceil(F.col("n") * share / whole))
    lists = lists.hint("merge").join(least, "v").filter(F.col("r") * whole >= (F.col("n") + partner - F.col("r")) * share).drop("n_min")
    lengths = lists.groupBy("v").agg(F.count(F.lit(1)).alias("len")).filter("len > 1")
    lists = table(lists.hint("merge").join(lengths, "v").withColumn("own", F.col("n") - F.col("r")), "long_enough")

    # intersection <= shared shingles of either: pairs that this rules out are not formed
    most = F.least("x.r", "y.r")
    possible = most * whole >= (F.col("x.n") + F.col("y.n") - most) * share
    pair = (F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))

    def side(name: str, *cols: str) -> DataFrame:
        return viable.select(F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        """Estimate, then verify on the full sets."""
        pairs = (pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
                 .withColumn("low", F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, k))
                 .withColumn("c", F.size(F.array_intersect("low", F.array_intersect("sketch_a", "sketch_b"))))
                 .filter(F.when(F.size("low") < k, F.col("c") * whole >= F.size("low") * share)
                         .otherwise(F.col("c") >= common)).select("a", "b").distinct())
        both = F.size(F.array_intersect("shared_a", "shared_b"))
        return table(pairs.join(side("a", "n", "shared"), "a").join(side("b", "n", "shared"), "b")
                     .withColumn("both", both)
                     .filter(F.col("both") * whole >= (F.col("n_a") + F.col("n_b") - F.col("both")) * share)
                     .select("a", "b").distinct(), f"links_{name}")

    x, y = lists.alias("x"), lists.alias("y")
    short = (x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.rep") < F.col("y.rep")) & possible
                    & (F.col("x.len") <= short_list) & (F.col("y.len") <= short_list)).select(*pair))
    long = lists.filter(F.col("len") > short_list)
    links = links_of(short.distinct(), "0")

    # every member of a long list against the list's pivot p: a in common, d only in p, e only in the member, and the
    # differences as bit maps
    first = long.groupBy("v").agg(F.min(F.struct("own", "rep")).alias("p")).select("v", F.col("p.rep").alias("p"))
    member = long.join(first, "v")
    family = (member.select("p", "rep").distinct().join(side("p", "n", "r", "shared"), "p")
              .join(side("rep", "n", "shared"), "rep")
              .withColumn("a", F.size(F.array_intersect("shared_p", "shared_rep")).cast("bigint"))
              .withColumn("in_p", F.array_except("shared_p", "shared_rep"))
              .withColumn("in_x", F.array_except("shared_rep", "shared_p")))
    def bit_map(values, skip: int):
        """Six bits of every value, above the ``skip`` lowest, as a map of 64 bits."""
        one = F.lit(1).cast("bigint")
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.call_function(
            "shiftleft", one, F.shiftrightunsigned(x, skip).bitwiseAND(F.lit(63)).cast("int"))))

    maps = {f"{name}{i}": bit_map(col, 6 * i) for name, col in (("d", "in_p"), ("e", "in_x")) for i in (0, 1)}
    family = table(family.select("p", "rep", "n_p", "r_p", "n_rep", "a", F.size("in_p").cast("bigint").alias("d"),
                                 F.size("in_x").cast("bigint").alias("e"), *[c.alias(n) for n, c in maps.items()]),
                   "families")
    links = links.union(family.filter((F.col("p") != F.col("rep")) & (
        F.col("a") * whole >= (F.col("n_p") + F.col("n_rep") - F.col("a")) * share))
        .select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")).distinct())
    long = table(member.join(family.drop("n_p", "n_rep"), ["p", "rep"]), "members")

    def overlap(name: str):
        """Upper bound of the common elements of two members' differences."""
        bounds = [F.col(f"x.{name}"), F.col(f"y.{name}")]
        for i in (0, 1):
            one, two = F.col(f"x.{name}{i}"), F.col(f"y.{name}{i}")
            both = F.bit_count(one.bitwiseAND(two)).cast("bigint")
            bounds += [both + F.col(f"x.{name}") - F.bit_count(one), both + F.col(f"y.{name}") - F.bit_count(two)]
        return F.least(*bounds)

    common_most = F.col("x.a") + F.col("y.a") - F.col("x.r_p") + overlap("d") + overlap("e")
    possible = possible & (common_most * whole >= (F.col("x.n") + F.col("y.n") - common_most) * share)
    # rows that share an id are one document
    twins = (known.groupBy("doc_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).filter("lo <> hi")
             .select("doc_id"))
    twins = (known.join(twins, "doc_id").join(classes, ["set_a", "set_b"])
             .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct())
    links = links.union(twins)
    found = cut_lineage(components(links))

    # later rounds: lists that still hold several components
    done, more = 1, 63
    while True:
        labelled = (long.join(found.withColumnRenamed("node", "rep"), "rep", "left")
                    .withColumn("comp", F.coalesce("component", "rep")).drop("component"))
        mixed = (labelled.filter(F.col("len") > done).groupBy("v")
                 .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("v"))
        labelled = table(labelled.join(mixed, "v"), f"mixed_{done}")
        if labelled.isEmpty():
            break
        pivots = top_n_per_group(labelled, ["v"], ["own", "rep"], done + more, salt_on=["rep"]) \
            .filter(F.col("_rank") > done)
        pairs = (labelled.alias("x").join(pivots.alias("y"), (F.col("x.v") == F.col("y.v"))
                                          & (F.col("x.comp") != F.col("y.comp")) & possible).select(*pair).distinct())
        new = links_of(pairs, str(done))
        done, more = done + more, more * 16
        if not new.isEmpty():
            links = links.union(new)
            found = cut_lineage(components(links))

    by_class = (classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
                .select("set_a", "set_b", F.coalesce("component", "rep").alias("of_class")))
    out = (rows.drop("shared").join(by_class, ["set_a", "set_b"], "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(),
                                              F.when(F.col("n") > 0, F.col("of_class")).otherwise(F.col("doc_id")))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
