"""Line deduplication by a segment-partition edit join (operator 3), DataFrame functions only.

Equal lines are grouped first; the rest works on distinct lines. Lines of ``MIN_CHARS`` or more within ``EDITS`` edits
of each other are linked. A line of length n is split into EDITS + 1 segments; at most EDITS of them are touched by the
edits, so a linked line of length n + 0 .. n + EDITS holds one of them untouched, near its own place. The longer line
probes, for each shorter length and segment, the few substrings at which that can happen (the positions allowed by the
edits left and right of it). Segment number, length and text hash to the join key.

A key that many lines share (the fixed part of numbered lines, say) is hot: its lines are not paired with each other.
Lines with hot keys are joined on pairs of their rarest substrings of ``GRAM`` characters instead. Linked lines share all
but ``GRAM * EDITS`` of these, so of the ``GRAM * EDITS + 2`` rarest ones of either line (in one common order) both have at
least two. A link whose keys are all hot is found there, any other one by its key.

Candidates are thinned by two conditions that every link meets: a parity signature (one bit for each letter, digit and
some marks: odd or even count; an edit changes two bits at most), and blocks of eight characters (an edit touches one at
most). They are verified by a bit-parallel edit distance: the 2 * EDITS + 1 cells around the diagonal are one word of
vertical differences, carried along the line by ``aggregate``.

Defined cases: a null text has no lines, an empty one has one empty line; shorter lines are only grouped with equal ones;
repeated rows count as copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import broadcast_if_small, materialize, table
from axonflow.llm.components import connected_components

EDITS, MIN_CHARS, BLOCK = 2, 20, 8
SIGNATURE_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789.-/:"
#: Pairs of lines that one key may make; a key with more is hot.
HOT_PAIRS = 4096
GRAM = 3
#: More lines than a text can have.
PLACES = 4_000_000_000


def distinct_lines(docs: DataFrame) -> DataFrame:
    """line, copies and the first place (doc_id, line_no) of each distinct line; a null doc_id comes last.

    Both numbers of a place are one decimal, so that the lines are grouped by hashing and not by sorting texts.
    """
    lines = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    place = F.col("doc_id").cast("decimal(28,0)") * F.lit(PLACES).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    groups = lines.groupBy("line").agg(F.min(place).alias("place"), F.min("line_no").alias("least"), F.count(F.lit(1)).alias("copies"))
    exact = F.expr(f"cast(floor(place / cast({PLACES} as decimal(10,0))) as bigint)")
    number = (F.col("place") - exact.cast("decimal(28,0)") * F.lit(PLACES).cast("decimal(10,0)")).cast("int")
    return groups.select("line", F.struct(exact.alias("doc_id"), F.coalesce(number, F.col("least")).alias("line_no")).alias("first"), "copies")


def _segment(n: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """First character (from 1) and length of segment i of a line of n characters; the last segments are longer."""
    base, longer = F.floor(n / (edits + 1)).cast("int"), n % (edits + 1)
    short = F.lit(edits + 1) - longer
    return base * i + F.greatest(i - short, F.lit(0)) + 1, base + (i >= short).cast("int")


def index_keys(rows: DataFrame, edits: int) -> DataFrame:
    """id and key of each segment of the lines (id, line, n)."""
    cut = rows.select("id", "line", "n", F.explode(F.lit(list(range(edits + 1)))).alias("i"))
    start, length = _segment(F.col("n"), F.col("i"), edits)
    return cut.select("id", F.xxhash64("i", "n", F.substr("line", start, length)).alias("key"))


def probe_keys(rows: DataFrame, edits: int) -> DataFrame:
    """id and key of the substrings at which a segment of another line, shorter by 0 .. edits, can stand.

    Of lines of equal length, one that is moved to the left in the first is moved to the right in the second, and one in
    its own place is found by the index alone.
    """
    moves = [
        (gap, i, shift)
        for gap in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1)
        if gap or shift > 0
    ]
    listed = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("gap", "i", "shift"), m, strict=True))) for m in moves))
    cut = rows.select("id", "line", "n", F.explode(listed).alias("m")).select("id", "line", "n", "m.*").withColumn("short", F.col("n") - F.col("gap"))
    start, length = _segment(F.col("short"), F.col("i"), edits)
    at = start + F.col("shift")
    inside = cut.where((at >= 1) & (at + length - 1 <= F.col("n")))
    return inside.select("id", F.xxhash64("i", "short", F.substr("line", at, length)).alias("key"))


def rare_pair_keys(rows: DataFrame, edits: int) -> DataFrame:
    """key of each pair of the ``GRAM * edits + 2`` rarest substrings of the lines (id, line, n), and all columns but the line.

    Equal substrings of a line are numbered; rarity is counted over ``rows``, ties fall by the text. The other columns go along, so
    that the pairs, dozens a line, need not be joined with the lines again.
    """
    own = [c for c in rows.columns if c != "line"]
    grams = rows.select(*own, F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - GRAM + 1), lambda i: F.substr("line", i, F.lit(GRAM)))).alias("gram"))
    times = grams.groupBy(*own, "gram").agg(F.count(F.lit(1)).cast("int").alias("k"))
    each = times.select(*own, "gram", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k"))
    counted = each.join(each.groupBy("gram", "k").agg(F.count(F.lit(1)).alias("c")), ["gram", "k"])
    most = GRAM * edits + 2
    rare = counted.groupBy(*own).agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "gram", "k"))), 1, most).alias("rare"))
    both = F.lit([i * most + j for i in range(most) for j in range(i + 1, most)])
    pairs = rare.select(*own, "rare", F.explode(both).alias("p"))
    first, second = F.get("rare", F.floor(F.col("p") / most).cast("int")), F.get("rare", F.col("p") % most)
    return pairs.where(second.isNotNull()).select(*own, F.xxhash64(first["gram"], first["k"], second["gram"], second["k"]).alias("key"))


def parity(line: Column) -> Column:
    """A bit for each signature letter: whether its count is odd."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(SIGNATURE_LETTERS):
        odd = (F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(1)
        out = out.bitwiseOR(F.shiftleft(odd.cast("long"), i))
    return out


def few_blocks_missing(a: Column, b: Column, edits: int) -> Column:
    """Whether all but ``edits`` blocks of ``BLOCK`` characters of a occur in b, each within ``edits`` places of its own.

    An edit touches one block of a at most and moves the others by one place at most, so this holds for every link.
    """
    block = lambda k: F.substr(a, k * BLOCK + 1, F.lit(BLOCK))
    around = lambda k: F.substr(b, F.greatest(k * BLOCK + 1 - edits, F.lit(1)), F.lit(BLOCK + 2 * edits))
    lost = F.filter(F.sequence(F.lit(0), F.floor(F.length(a) / BLOCK).cast("int") - 1), lambda k: ~F.contains(around(k), block(k)))
    return F.when(F.length(a) < BLOCK, F.lit(True)).otherwise(F.size(lost) <= edits)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _common_start(a: Column, b: Column) -> Column:
    """Characters at the start that a and b share, found by halving steps (up to 2**21 - 1)."""
    most = F.least(F.length(a), F.length(b))
    steps = F.lit([1 << k for k in range(20, -1, -1)])
    grown = lambda n, p: F.when((n + p <= most) & (F.substr(a, n + 1, p) == F.substr(b, n + 1, p)), n + p).otherwise(n)
    return F.aggregate(steps, F.lit(0), grown)


def unlike_parts(pairs: DataFrame, edits: int) -> DataFrame:
    """``pairs`` with a and b cut to where they differ and up to ``edits`` shared characters beside it, at least.

    Shared starts and ends do not change the edit distance; keeping that much of them leaves a at least ``edits`` long.
    """
    rows = pairs.withColumns({"head": F.greatest(_common_start(F.col("a"), F.col("b")) - edits, F.lit(0)), "ra": F.reverse("a"), "rb": F.reverse("b")})
    rows = rows.withColumn("tail", F.greatest(_common_start(F.col("ra"), F.col("rb")) - edits, F.lit(0)))
    rows = rows.withColumn("tail", F.least("tail", F.greatest(F.length("a") - F.col("head") - edits, F.lit(0))))
    part = lambda c: F.substr(F.col(c), F.col("head") + 1, F.length(c) - F.col("head") - F.col("tail"))
    return rows.select("u", "v", part("a").alias("a"), part("b").alias("b"))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of a and b is at most ``edits``; b's length is a's plus 0 .. edits.

    At column j the bits 0 .. 2 * edits are the cells of rows j - edits .. j + edits. The score follows the lowest row
    of the band down the diagonal until that row is the last one, and then runs along it.
    """
    width = 2 * edits + 1
    big = lambda n: F.lit(n).cast("long")
    mask = big((1 << width) - 1)
    m = F.length(a)
    zero = F.struct(big(((1 << (edits + 1)) - 1) << edits).alias("vp"), big(0).alias("vn"), big(edits).alias("score"), F.lit(0).alias("j"), F.split(a, "").alias("x"), m.alias("m"))

    def step(acc: Column, letter: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]
        equal = big(0)
        for bit in range(width):
            equal = equal + F.when(F.get(acc["x"], acc["j"] - edits + bit) == letter, big(1 << bit)).otherwise(big(0))

        def column(d0: Column) -> Column:
            hn = d0.bitwiseAND(vp)

            def across(hp: Column) -> Column:
                down, j = F.shiftright(d0, 1), acc["j"] + 1
                last = F.call_function("shiftleft", big(1), F.greatest(acc["m"] - j + edits, F.lit(0)))
                along = (hp.bitwiseAND(last) != 0).cast("long") - (hn.bitwiseAND(last) != 0).cast("long")
                diagonal = (d0.bitwiseAND(big(1 << (width - 1))) == 0).cast("long")
                score = acc["score"] + F.when(j + edits <= acc["m"], diagonal).otherwise(along)
                new = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask)
                return F.struct(new.alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"), j.alias("j"), acc["x"].alias("x"), acc["m"].alias("m"))

            return _let(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask), across)

        # the carry of the sum runs down a run of matches
        return _let(equal, lambda eq: _let((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(mask), column))

    return F.aggregate(F.split(b, ""), zero, step)["score"] <= edits


def candidates(rows: DataFrame, edits: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v), u < v, of lines (id, line, n) that may be linked, and the lines (id, line, n, parity) they are of.

    Most lines share no key with another; only those that do get a signature and take part in the join of pairs.
    """
    index = index_keys(rows, edits)
    own = index.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("c"))
    # keys of two lines at least: those with several index rows, and those with a probe of another line
    met = probe_keys(rows, edits).join(own.hint("shuffle_hash"), "key", "right")
    met = met.where((F.col("low") != F.col("high")) | (F.col("id").isNotNull() & (F.col("low") != F.col("id"))))
    met = materialize(met.select("key", "id", "c"), "line-probes")
    keys = met.groupBy("key").agg((F.first("c") * (F.first("c") + F.count("id"))).alias("pairs"))
    hot = F.col("pairs") > (HOT_PAIRS if min_chars >= GRAM * (edits + 1) + 1 else 2**62)
    keys = broadcast_if_small(materialize(keys.select("key", hot.alias("hot")), "line-keys"))
    members = index.join(keys, "key").select("key", "id", "hot", F.lit(False).alias("probe"))
    members = members.unionByName(met.where("id IS NOT NULL").join(keys, "key").select("key", "id", "hot", F.lit(True).alias("probe")))
    members = materialize(members, "line-members")
    ids = members.groupBy("id").agg(F.bool_or("hot").alias("hot"))
    texts = rows.join(broadcast_if_small(materialize(ids, "line-ids")), "id")
    texts = materialize(texts.select("id", "line", "n", "hot", parity(F.col("line")).alias("parity")), "line-texts")
    signed = broadcast_if_small(texts.select("id", "parity", "n"))
    busy = members.where("NOT hot").join(signed, "id")
    rare = rare_pair_keys(texts.where("hot").drop("hot"), edits)

    def paired(left: DataFrame, right: DataFrame, extra) -> DataFrame:
        left, right = (d.select("key", *(F.col(c).alias(f"{c}_{s}") for c in d.columns if c != "key")) for d, s in ((left, 1), (right, 2)))
        near = (F.bit_count(F.col("parity_1").bitwiseXOR(F.col("parity_2"))) <= 2 * edits) & (F.abs(F.col("n_1") - F.col("n_2")) <= edits)
        met = left.withColumnRenamed("key", "_key").join(right, (F.col("_key") == F.col("key")) & near & extra)
        return met.select(F.least("id_1", "id_2").alias("u"), F.greatest("id_1", "id_2").alias("v"))

    ordered = F.col("id_1") < F.col("id_2")
    pairs = paired(busy.where("NOT probe").drop("probe"), busy, ordered | (F.col("probe_2") & (F.col("id_1") != F.col("id_2"))))
    if not texts.where("hot").isEmpty():
        pairs = pairs.unionByName(paired(rare, rare, ordered))
    return materialize(pairs.distinct(), "line-candidates"), texts


def linked_lines(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs (u, v) of ids of distinct lines (id, line) within ``edits`` edits, as a written table."""
    rows = lines.select("id", "line", F.length("line").alias("n")).where(F.col("n") >= max(min_chars, edits + 1))
    pairs, texts = candidates(rows, edits, min_chars)
    of = lambda c, text: texts.select(F.col("id").alias(c), F.struct("n", "line").alias(text))
    both = pairs.join(of("u", "x"), "u").join(of("v", "y"), "v")
    both = both.select("u", "v", F.least("x", "y")["line"].alias("a"), F.greatest("x", "y")["line"].alias("b"))  # the shorter first
    both = both.where(few_blocks_missing(F.col("a"), F.col("b"), edits))
    # the parts are used many times in the distance: written, they are computed once
    cut = materialize(unlike_parts(both, edits), "line-parts")
    return materialize(cut.where(within_edits(F.col("a"), F.col("b"), edits)).select("u", "v"), "line-links")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per distinct line: its first place (doc_id, line_no), copies, n_links, the first place of its class
    (class_doc_id, class_line_no) and whether it stays (it is the first of its class)."""
    lines = materialize(distinct_lines(docs).select(F.monotonically_increasing_id().alias("id"), "line", "first", "copies"), "lines")
    links = linked_lines(lines, edits, min_chars)
    degree = links.select(F.col("u").alias("id")).unionAll(links.select("v")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    parts = connected_components(links).select(F.col("node").alias("id"), "component")
    linked = lines.select("id", "first").join(parts, "id")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    known = linked.join(heads, "component").join(degree, "id").select("id", "n_links", "head")
    known = broadcast_if_small(materialize(known, "line-classes"))
    out = lines.select("id", "first", "copies").join(known, "id", "left").withColumn("head", F.coalesce("head", "first"))
    return out.select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), F.col("head").eqNullSafe(F.col("first")).alias("kept"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


SQL = {
    "op3_line_dedup": """
WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS k, count(*) OVER (PARTITION BY line) AS copies FROM r),
l AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, line, length(line) AS n, doc_id, line_no, copies FROM o WHERE k = 1),
p AS (SELECT a.id AS u, b.id AS v FROM l a JOIN l b ON b.n BETWEEN a.n AND a.n + 2 AND a.n >= 20 AND (a.n < b.n OR a.id < b.id)
      WHERE (contains(b.line, substr(a.line, 1, a.n // 3)) OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n // 3)) OR contains(b.line, substr(a.line, 2 * (a.n // 3) + 1)))
        AND levenshtein(a.line, b.line) <= 2),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
c(id, root) AS (SELECT id, id FROM l UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id WHERE c.root < e.v),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id),
g AS (SELECT u AS id, count(*) AS n_links FROM e GROUP BY u)
SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no, l.copies, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links,
       h.doc_id AS class_doc_id, CAST(h.line_no AS INTEGER) AS class_line_no, h.id = l.id AS kept
FROM l JOIN m ON m.id = l.id JOIN l h ON h.id = m.root LEFT JOIN g ON g.id = l.id""",
}
QUERIES = {"op3_line_dedup": op3_line_dedup}
