"""Exact deduplication against immutable snapshots (operator 10).

A *snapshot* is the immutable record of the texts taken in so far, written to a folder and read back: exact buckets
``(key, text_sha256, keep_id, size)``, one row a text, and for each shard of the key space a static binary-fuse filter
over its keys. A new batch is digested, and the filters screen its distinct keys. Positives join the exact buckets by
key; the texts of the keys that meet are compared byte by byte with the snapshot's own. Repeated keys of the batch that
meet no bucket are grouped by their bytes separately, and everything else is new and is never joined.

Bytes are compared by grouping whole normalised texts (copies collapse before the shuffle). Rows are told their group by
the SHA-256 of their text; each grouping checks that no two texts share one, and fails otherwise, so a group is a class
of equal bytes.

Defined cases: a null text counts as empty; all empty texts form one group; ids may repeat, every row is returned and
the rows with the group's smallest id are ``kept``; a null id is never the smallest unless the whole group has none;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import SPACE_CLASS, broadcast_if_small, materialize, scratch_path, table

#: Keys of a filter shard; bounds what one task holds.
SHARD_KEYS = 1 << 15

FILTER_SCHEMA = "shard int, seed long, segment int, segments int, n long, fingerprints binary"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE_CLASS}+", " ")


def digests(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and the bucket key of each row; ``key_bits`` under 64 forces collisions (for tests)."""
    hashed = docs.select("doc_id", F.sha2(normalised(), 256).alias("text_sha256"))
    return hashed.withColumn("key", _key(F.col("text_sha256"), key_bits))


def _key(sha, key_bits: int):
    key = F.xxhash64(sha)
    return key if key_bits >= 64 else key.bitwiseAND(F.lit((1 << key_bits) - 1))


# --- binary fuse filter: small numpy kernels, one shard at a time -------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * segment)) ^ (h & low)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(40))) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a filter without false negatives over distinct uint64 keys.

    All slots that hold a single key are peeled at once, round by round; the rounds are then filled in backwards.
    """
    n = max(len(keys), 2)
    segment = 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += max(1, segments // 8)
        length = (segments + 2) * segment
        h = _mix(keys, seed)
        at = _places(h, segment, segments)
        count = np.bincount(at.ravel(), minlength=length)
        which = np.zeros(length, np.int64)
        for j in range(3):
            np.bitwise_xor.at(which, at[:, j], np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            peeled, first = np.unique(which[single], return_index=True)
            rounds.append((peeled, single[first]))
            left -= len(peeled)
            for j in range(3):
                np.subtract.at(count, at[peeled, j], 1)
                np.bitwise_xor.at(which, at[peeled, j], peeled)
        if left:
            continue
        slots, prints = np.zeros(length, np.uint8), _prints(h)
        for peeled, slot in reversed(rounds):
            slots[slot] = prints[peeled] ^ slots[at[peeled, 0]] ^ slots[at[peeled, 1]] ^ slots[at[peeled, 2]]
        return seed, segment, segments, slots.tobytes()
    raise RuntimeError("no seed peels these keys; are they distinct?")


def probe_fuse(keys: np.ndarray, seed: int, segment: int, segments: int, fingerprints: bytes) -> np.ndarray:
    slots, h = np.frombuffer(fingerprints, np.uint8), _mix(keys, seed)
    at = _places(h, segment, segments)
    return _prints(h) == slots[at[:, 0]] ^ slots[at[:, 1]] ^ slots[at[:, 2]]


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(rows["key"].to_numpy(np.int64)).view(np.uint64)
    seed, segment, segments, slots = build_fuse(keys)
    return pd.DataFrame([(rows["shard"].iloc[0], seed, segment, segments, len(keys), slots)], columns=["shard", "seed", "segment", "segments", "n", "fingerprints"])


def _screen_shard(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Incoming keys that one of the shard's filters holds (or seems to hold)."""
    keys = incoming["key"].to_numpy(np.int64)
    maybe = np.zeros(len(keys), bool)
    for f in filters.itertuples():
        maybe |= probe_fuse(keys.view(np.uint64), f.seed, f.segment, f.segments, f.fingerprints)
    return pd.DataFrame({"key": keys[maybe]})


# --- snapshots ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """Exact buckets (key, text_sha256, keep_id, size) and the filters over their keys, as read from ``path``."""

    path: str
    buckets: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def load(spark: SparkSession, path: str) -> Snapshot:
        """A snapshot that :func:`build_snapshot` has written; a reader of any later session may do so."""
        filters = spark.read.parquet(f"{path}/filters")
        shards = spark.read.parquet(f"{path}/shards").first()["shards"]
        return Snapshot(path, spark.read.parquet(f"{path}/buckets"), filters, shards)


def _shard(shards: int):
    return F.pmod(F.xxhash64("key", F.lit(11)), F.lit(shards)).cast("int").alias("shard")


def same_bytes(texts: DataFrame, *sides) -> DataFrame:
    """text_sha256, keep_id, size (and an aggregate per side) of each text of ``texts`` (key, doc_id, normal), by bytes."""
    groups = texts.groupBy("key", "normal").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"), *sides)
    names = [c for c in groups.columns if c not in ("key", "normal", "keep_id", "size")]
    groups = groups.select(F.sha2("normal", 256).alias("text_sha256"), "key", "keep_id", "size", *names)
    one = groups.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts"), *(F.first(c).alias(c) for c in groups.columns if c != "text_sha256"))
    clash = F.raise_error(F.lit("two different texts have one SHA-256"))
    return one.withColumn("size", F.when(F.col("texts") > 1, clash.cast("long")).otherwise(F.col("size"))).drop("texts")


def _texts(docs: DataFrame, keys: DataFrame, key_bits: int) -> DataFrame:
    """key, doc_id and whole normalised text of the rows whose key is in ``keys`` (key and more, a written table)."""
    rows = docs.select("doc_id", normalised().alias("normal")).withColumn("key", _key(F.sha2("normal", 256), key_bits))
    return rows.join(broadcast_if_small(keys), "key")


def _repeated(base: DataFrame, name: str) -> DataFrame:
    return materialize(base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), name)


def build_snapshot(docs: DataFrame, base: DataFrame, expected_keys: int, path: str, key_bits: int = 64) -> Snapshot:
    """Write the snapshot of ``docs`` (doc_id, text), whose digests are ``base``, to ``path`` and load it.

    ``expected_keys``: the most keys it or a later batch holds; sets the shards, and so what one task holds.
    """
    spark = docs.sparkSession
    repeated = _repeated(base, "fuse-repeated")
    single = base.join(broadcast_if_small(repeated), "key", "left_anti").select("key", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    buckets = single.unionByName(same_bytes(_texts(docs, repeated, key_bits)).select("key", "text_sha256", "keep_id", "size"))
    buckets.write.option("compression", "zstd").parquet(f"{path}/buckets")
    shards = max(1, math.ceil(expected_keys / SHARD_KEYS))
    spark.range(1).select(F.lit(shards).alias("shards")).write.parquet(f"{path}/shards")
    keys = spark.read.parquet(f"{path}/buckets").select("key", _shard(shards))
    keys.groupBy("shard").applyInPandas(_build_shard, FILTER_SCHEMA).write.parquet(f"{path}/filters")
    return Snapshot.load(spark, path)


def screen(keys: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Distinct incoming keys (column ``key``) that a snapshot's filters let through; no key that it holds is lost."""
    incoming = keys.select("key", _shard(snapshot.shards)).groupBy("shard")
    return incoming.cogroup(snapshot.filters.groupBy("shard")).applyInPandas(_screen_shard, "key long")


def against_snapshot(old: DataFrame, new: DataFrame, base: DataFrame, snapshot: Snapshot, key_bits: int = 64) -> DataFrame:
    """text_sha256, keep_id and size of the texts of a batch that have a group: copies of the snapshot's or each other's.

    ``old`` are the snapshot's documents, ``new`` the batch, ``base`` the digests of the batch. Sizes count both sides;
    the smallest id of a group with a text of the snapshot is the bucket's.
    """
    batch = materialize(base.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "fuse-batch")
    positive = materialize(screen(batch, snapshot), "fuse-positive")
    met = materialize(snapshot.buckets.join(broadcast_if_small(positive), "key", "left_semi").select("key").distinct(), "fuse-met")
    # positives: their bytes against those of the buckets that they meet
    both = _texts(new, met, key_bits).withColumn("old", F.lit(False)).unionByName(_texts(old, met, key_bits).withColumn("old", F.lit(True)))
    first = F.min(F.when(F.col("old"), F.col("doc_id"))).alias("first_old")
    met_groups = same_bytes(both, first, F.bool_and("old").alias("only_old")).where("NOT only_old")
    met_groups = met_groups.select("text_sha256", F.coalesce("first_old", "keep_id").alias("keep_id"), "size")
    # the batch's own repeated texts, apart from those
    again = batch.where("n > 1").select("key").join(broadcast_if_small(met), "key", "left_anti")
    own = same_bytes(_texts(new, materialize(again, "fuse-again"), key_bits)).select("text_sha256", "keep_id", "size")
    return met_groups.unionByName(own)


def exact_dedup(docs: DataFrame, snapshot_share: float = 0.5, key_bits: int = 64, path: str | None = None) -> DataFrame:
    """Group all rows of ``docs`` (doc_id, text) by equal normalised text; see the module for the cases.

    The rows with smaller ids (``snapshot_share`` of them) are the snapshot, written to ``path``, the others the batch
    that comes in, so that a row of the snapshot always precedes one of the batch. Returns doc_id, keep_id, group_size,
    kept, text_sha256, one row per input row.
    """
    spark = docs.sparkSession
    base = materialize(digests(docs, key_bits), "digests")
    bound, rows = base.agg(F.percentile_approx("doc_id", snapshot_share), F.count(F.lit(1))).first()
    early = F.coalesce(F.col("doc_id") <= F.lit(bound), F.lit(False)) if bound is not None else F.lit(False)
    old, new = docs.where(early), docs.where(~early)
    snapshot = build_snapshot(old, base.where(early), rows, path or scratch_path(spark, "snapshot"), key_bits)
    late = materialize(against_snapshot(old, new, base.where(~early), snapshot, key_bits), "fuse-late")
    # a text of both sides has its final size in ``late``
    early_groups = snapshot.buckets.where("size > 1").join(broadcast_if_small(late), "text_sha256", "left_anti")
    groups = materialize(early_groups.select("text_sha256", "keep_id", "size").unionByName(late).where("size > 1"), "fuse-groups")
    out = base.join(broadcast_if_small(groups), "text_sha256", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)""",
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
