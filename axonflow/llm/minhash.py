"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find (operator 7).

1. Each text becomes its set of hashed word shingles; SuperMinHash gives the set a signature of ``SLOTS`` values. Its
   ranks within an element are a permutation, so slots are negatively correlated and the variance is lower than that
   of independent hashes; a document stops as soon as no later rank can lower any slot.
2. Documents with equal sets are one node (the smallest id), so copies never meet in a bucket.
3. ``BANDS`` bands of ``SLOTS / BANDS`` values are the bucket keys. A pair at the threshold 0.8 shares no band with
   probability (1 - 0.8**5)**40 = 1.2e-7.
4. Each node is first compared with one centre, the node with the most bucket mates of all that lead its buckets, and
   the verified links are closed to components. What is left are pairs in buckets with several components, in which one
   member, the stray, lies outside the component of the bucket's leader. These are found by the members' differences
   (shingles added or removed) from the centre of that component, its node with the most bucket mates: a stray x
   misses the threshold with the centre, so by inclusion and exclusion any y that x links with has to share
   more than ``t (n_y - n_b) + |removed_y|`` of its own differences with x, t = 0.8 / 1.8, about half of them. With
   that many shared, the rarest differences of x and of y (their prefixes in the order of frequency around the centre)
   must meet, which an equi-join on (centre, difference) finds. No link is lost, no bucket expanded into all its pairs.
5. Each candidate is confirmed by the intersection of the two full sets. A centre's members are dealt to shares, and
   each share holds one copy of the centre's text, ahead of its members'.

Defined cases: null, empty and blank texts have an empty set and link with nothing; fewer words than a shingle make
one shingle of the whole sequence; rows that share a doc_id are one document with several texts; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import broadcast_if_small, materialize, slices, table
from axonflow.llm.components import connected_components
from axonflow.llm.shingles import U, mix, shared, shingle_sets

SLOTS, BANDS = 200, 40
#: Elements whose permutations are held at a time (SLOTS bytes each).
ELEMENTS = 1 << 14
_GOLDEN, _SEED = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_hash binary, bands array<long>"


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (len(sets), slots) of non-empty sets of 64-bit hashes, at most 256 slots."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets)
    signature = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
    rows = np.arange(len(h))
    active = np.ones(len(sets), bool)
    for j in range(slots):
        x = mix(h + U((_SEED + (j + 1) * _GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x & U(0xFFFF)) * U(slots - j)) >> U(16)).astype(np.int64)
        slot = order[rows, k].astype(np.int64)
        order[rows, k] = order[rows, j]
        np.minimum.at(signature, owner * slots + slot, (U(j) << U(48)) | (x >> U(16)))
        going = np.flatnonzero(active)
        done = going[signature.reshape(-1, slots)[going].max(axis=1) < U(j + 1) << U(48)]
        if len(done):
            active[done] = False
            stay = active[owner]
            h, owner, rows = h[stay], owner[stay], rows[stay]
            if not len(h):
                break
    return signature.reshape(-1, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(_GOLDEN), parts.shape[:2])
    for r in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, r]) + U(_GOLDEN)
    return mix(key)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            sets = shingle_sets(texts, words)
            keys: list = [None] * len(sets)
            group: list[int] = []
            held = 0
            for i, s in enumerate([*sets, None]):
                if group and (s is None or held + len(s) > ELEMENTS):
                    for j, row in zip(group, band_keys(superminhash([sets[j] for j in group])).view(np.int64), strict=True):
                        keys[j] = row
                    group, held = [], 0
                if s is not None and len(s):
                    group.append(i)
                    held += len(s)
            hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_hash", "bands"]
            )

    return run


#: Members that are compared with one copy of their centre's text.
SHARE = 256


def _beside_centres(pairs: DataFrame, docs: DataFrame, *extra: str) -> DataFrame:
    """Texts of the pairs (u, v and more), a written table, each centre v's ahead of those of its members u.

    Columns: v, share, member (false for the centre's own rows), u, extra and text, dealt by (v, share) and sorted so.
    The members of a centre are dealt to shares of about ``SHARE``, each with one copy of the centre's text, so a centre
    of any size is many groups, and its text is moved once a share instead of once a pair.
    """
    counts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
    dealt = pairs.join(broadcast_if_small(materialize(counts, "minhash-shares")), "v")
    dealt = materialize(dealt.select("u", "v", *extra, F.pmod(F.xxhash64("u"), "shares").alias("share")), "minhash-pairs")
    ids = materialize(dealt.select(F.col("u").alias("doc_id")).union(dealt.select("v")).distinct(), "minhash-ids")
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    members = dealt.join(texts, F.col("u") == F.col("doc_id")).select("v", "share", F.lit(True).alias("member"), "u", *extra, "text")
    centres = dealt.select("v", "share").distinct().join(texts, F.col("v") == F.col("doc_id")).select("v", "share", F.lit(False).alias("member"), F.col("v").alias("u"), "text")
    both = members.unionByName(centres, allowMissingColumns=True)
    return both.repartition("v", "share").sortWithinPartitions("v", "share", "member", "u")


def _walk(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray], list[list[np.ndarray]]]]:
    """Batches with the rows of their members, the members' sets and their centres' sets (several if an id is repeated)."""
    at, held = None, []
    for batch in slices(batches):
        keys = list(zip(batch.column("v").to_pylist(), batch.column("share").to_pylist(), strict=True))
        rows, sets, centres = [], [], []
        for i, (key, member, own) in enumerate(zip(keys, batch.column("member").to_pylist(), shingle_sets(batch.column("text").to_pylist(), words), strict=True)):
            if member:
                rows.append(i)
                sets.append(own)
                centres.append(held if key == at else [])
            else:
                held = [*held, own] if key == at else [own]
                at = key
        yield batch, rows, sets, centres


def _confirm(words: int, percent: int):
    """Keeps the pairs whose full sets meet the threshold."""

    def meet(a: np.ndarray, b: np.ndarray) -> bool:
        both = shared(a, b)
        return len(a) > 0 and 100 * both >= percent * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, sets, centres in _walk(batches, words):
            keep = pa.array([i for i, a, held in zip(rows, sets, centres, strict=True) if any(meet(a, b) for b in held)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(keep), batch.column("v").take(keep)], names=["u", "v"])

    return run


def _frames(words: int):
    """How the set of ``u`` differs from the set of its centre ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, sets, centres in _walk(batches, words):
            place, n, n_v, removed, differences = [], [], [], [], []
            for i, a, held in zip(rows, sets, centres, strict=True):
                for b in held:
                    added, lost = np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)
                    place.append(i)
                    n.append(len(a))
                    n_v.append(len(b))
                    removed.append(len(lost))
                    differences.append(np.concatenate([added, lost]).view(np.int64))
            columns = [batch.column(c).take(pa.array(place, pa.int64())) for c in ("u", "v", "component", "stray")]
            columns += [pa.array(n, pa.int64()), pa.array(n_v, pa.int64()), pa.array(removed, pa.int64()), pa.array(differences, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "component", "stray", "n", "n_v", "removed", "differences"])

    return run


FRAME_SCHEMA = "u long, v long, component long, stray boolean, n long, n_v long, removed long, differences array<long>"


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v), a written table, whose texts' shingle sets have 100 * shared >= percent * union."""
    return materialize(_beside_centres(pairs, docs).mapInArrow(_confirm(words, percent), "u long, v long").distinct(), "minhash-edges")


#: Members with one difference from a centre that a task joins with the strays that have it.
HOT_ROWS = 4096


def stray_candidates(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (u, v) that may link a stray with a member of another component around the same centre, or with the centre.

    ``members``: u, its centre v, its component, and whether it is a stray (outside the centre's component).
    """
    frames = _beside_centres(materialize(members, "minhash-open"), docs, "component", "stray").mapInArrow(_frames(words), FRAME_SCHEMA)
    frames = materialize(frames, "minhash-frames")
    each = frames.select("u", "v", "component", "stray", F.explode("differences").alias("e"))
    # differences that no stray shares with another member cannot meet: in the order they come before all others
    live = each.groupBy("v", "e").agg(F.count(F.lit(1)).alias("c"), F.count_if("stray").alias("strays")).where("c > 1 AND strays > 0").select("v", "e", "c")
    rare = each.join(live, ["v", "e"]).groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("rare"))
    share = percent / (100 + percent)
    size = F.size("differences")
    least_member = F.floor(share * (F.col("n") - F.col("n_v")) + F.col("removed") - 1e-6) + 1
    least_stray = F.greatest(F.lit(1), F.ceil(share * (F.col("n") + F.col("n_v")) - (F.col("n_v") - F.col("removed")) - 1e-6))
    prefix = lambda least: F.greatest(F.lit(0), size - least + 1 - (size - F.size("rare"))).cast("int")
    found = frames.join(rare, ["u", "v"]).select("u", "v", "component", "stray", "n", "n_v", "removed", "rare", prefix(least_member).alias("as_member"), prefix(least_stray).alias("as_stray"))

    def cut(rows: DataFrame, length: str, name: str) -> DataFrame:
        """The rows' prefixes, one row a difference, with how many differences could still be shared after it."""
        rows = rows.select("u", "v", "component", "n", "n_v", "removed", F.size("rare").alias("size"), F.posexplode(F.slice("rare", F.lit(1), F.col(length))).alias("at", "r"))
        columns = {"u": F.col("u"), "component": F.col("component"), "left": F.col("size") - F.col("at"), "part": share * F.col("n") + F.col("removed")}
        shares = F.ceil(F.col("r.c") / HOT_ROWS).cast("int").alias("shares")
        return rows.select(F.col("v").alias("centre"), F.col("r.e").alias("e"), shares, "n_v", *(c.alias(f"{name}_{k}") for k, c in columns.items()))

    stray, other = cut(found.where("stray AND as_stray > 0"), "as_stray", "x"), cut(found.where("as_member > 0"), "as_member", "y").drop("n_v")
    # a difference that very many members of a centre have is dealt into shares of them, each of which meets all strays
    stray = stray.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    other = other.withColumn("share", F.pmod(F.xxhash64("y_u"), F.col("shares")).cast("int")).drop("shares")
    # the first difference that a linked pair shares leaves room for all others that it has to share
    room = F.least("x_left", "y_left") >= F.col("x_part") + F.col("y_part") - F.col("n_v") - 1e-6
    same = (stray["centre"] == other["centre"]) & (stray["e"] == other["e"]) & (stray["share"] == other["share"])
    met = stray.join(other, same & (F.col("x_component") != F.col("y_component")) & room).select(F.col("x_u").alias("u"), F.col("y_u").alias("w"))
    linked = frames.where(F.col("stray") & (100 * (F.col("n_v") - F.col("removed")) >= percent * (F.col("n") + F.col("removed"))))
    return met.select("u", F.col("w").alias("v")).union(linked.select("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _fits(a, b, percent: int):
    """Set sizes at which the threshold can be met at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id) and kept for every row of ``docs`` (doc_id, text)."""
    signed = materialize(docs.select("doc_id", "text").mapInArrow(_signatures(words), SIGNATURE_SCHEMA), "minhash-signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = filled.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.select("set_hash", "copies", F.col("m.doc_id").alias("node"), F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands")), "minhash-nodes")

    keys = nodes.select(F.explode("bands").alias("b"))
    busy = broadcast_if_small(materialize(keys.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "minhash-buckets"))
    met = nodes.select("node", "n", F.explode("bands").alias("b")).join(busy, "b")
    met = met.groupBy("node", "n").agg(F.sum("c").alias("score"), F.collect_list("b").alias("bands"))
    met = materialize(met, "minhash-members")
    members = met.select("node", "n", "score", F.explode("bands").alias("b"))

    lead = members.groupBy("b").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"), "n")).alias("lead"))
    star = members.join(lead, "b").where((F.col("node") != -F.col("lead.minus")) & _fits(F.col("n"), F.col("lead.n"), percent))
    star = star.groupBy("node").agg(F.max("lead").alias("lead")).select(F.col("node").alias("u"), (-F.col("lead.minus")).alias("v"))
    star = materialize(star, "minhash-star")
    edges = verified(star, docs, words, percent)
    parts = connected_components(edges)

    # Buckets that still hold several components: members outside the leader's component may link with others.
    labelled = met.join(parts.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "minhash-labelled")
    first = F.max(F.struct("score", (-F.col("node")).alias("minus"), "component")).alias("m")
    centres = labelled.groupBy("component").agg(first).select(F.col("component").alias("home"), (-F.col("m.minus")).alias("v"))
    labelled = labelled.select("node", "score", "component", F.explode("bands").alias("b"))
    open_ = labelled.groupBy("b").agg(F.min("component").alias("low"), F.max("component").alias("high"), first)
    open_ = open_.where("low != high").select("b", F.col("m.component").alias("home"))
    around = labelled.join(open_, "b").select(F.col("node").alias("u"), "component", "home").distinct()
    around = around.join(centres, "home").select("u", "v", "component", (F.col("component") != F.col("home")).alias("stray"))
    done = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = materialize(stray_candidates(around, docs, words, percent).join(done, ["u", "v"], "left_anti"), "minhash-rest")
    late = verified(pairs, docs, words, percent)
    if not late.isEmpty():
        parts = connected_components(edges.union(late))

    joined = nodes.select("set_hash", "node", "copies").join(parts, "node", "left").where("copies > 1 OR component IS NOT NULL")
    joined = broadcast_if_small(materialize(joined.select("set_hash", F.coalesce("component", "node").alias("component_id")), "minhash-classes"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(joined, "set_hash", "left")
    # an id that is repeated with other texts stays one document
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


SQL = {
    "op7_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS un, any_value(b.n) AS vn, count(*) AS cut FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * cut >= 80 * (un + vn - cut) UNION ALL SELECT v, u FROM p WHERE 100 * cut >= 80 * (un + vn - cut)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id WHERE r.c < l.v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.sh""",
}
QUERIES = {"op7_near_duplicates": op7_near_duplicates}
