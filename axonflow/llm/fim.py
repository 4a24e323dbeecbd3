"""Fill-in-middle transformation (operator 13): two cuts at token ends, found by select on a set of boundaries.

The boundaries of a text (offsets in code points at which a token ends) form a :class:`BoundarySet`, a set of integers in
the manner of Roaring: values with equal leading bits share a container, which is a sorted array, a bitmap or a list of
runs, whichever is smallest, and the containers' running cardinalities are kept. The k-th boundary is a binary search in
these and one local select. Numpy builds and asks the sets in Arrow batches inside tasks and hands back three integers a
text; hashes, cuts, marks, output and the text restored from it are Spark expressions. Nothing is shuffled.

Defined cases: null text is empty; an empty text has no token and is plain; texts that hold a mark are plain; a null
doc_id hashes as an empty number; repeated rows are transformed each; an empty table gives an empty result; texts of any
length are whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Trailing bits of a value that its container holds.
LOW_BITS = 16
_BITMAP_BYTES = (1 << LOW_BITS) // 8


@dataclass(frozen=True)
class ArrayContainer:
    values: np.ndarray  # uint16, sorted

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass(frozen=True)
class BitmapContainer:
    words: np.ndarray  # uint64
    upto: np.ndarray  # set bits up to and including each word

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[word - 1]) if word else 0
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - before])


@dataclass(frozen=True)
class RunContainer:
    starts: np.ndarray
    upto: np.ndarray  # values up to and including each run

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[run - 1]) if run else 0
        return int(self.starts[run]) + k - before


def container(low: np.ndarray):
    """The smallest container of sorted, distinct 16-bit values."""
    first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
    array_bytes, run_bytes = 2 * len(low), 8 * len(first)
    if run_bytes < min(array_bytes, _BITMAP_BYTES):
        return RunContainer(low[first].astype(np.int64), np.append(first[1:], len(low)))
    if array_bytes <= _BITMAP_BYTES:
        return ArrayContainer(low.astype(np.uint16))
    bits = np.zeros(1 << LOW_BITS, np.uint8)
    bits[low] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    return BitmapContainer(words, np.cumsum(np.bitwise_count(words), dtype=np.int64))


class BoundarySet:
    """Sorted, distinct, non-negative integers in containers by their leading bits."""

    def __init__(self, values: np.ndarray):
        high = values >> LOW_BITS
        first = np.flatnonzero(np.diff(high, prepend=-1))
        ends = np.append(first[1:], len(values)) if len(first) else first
        self.high = high[first]
        self.containers = [container(values[a:b] & ((1 << LOW_BITS) - 1)) for a, b in zip(first, ends, strict=True)]
        #: Values up to and including each container.
        self.upto = ends.astype(np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th value, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.high[at]) << LOW_BITS) + self.containers[at].select(k - before)


def word_ends(points: np.ndarray) -> np.ndarray:
    """Ends of the tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` in an array of code points."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    last = np.append(space[1:], True)
    ends = np.flatnonzero(~space & last) + 1
    return np.append(ends, len(points)) if len(points) and space[-1] else ends


def character_ends(points: np.ndarray) -> np.ndarray:
    return np.arange(1, len(points) + 1)


UNITS = {"words": word_ends, "characters": character_ends}


def _cuts(units: str):
    ends = UNITS[units]

    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        found = np.zeros((3, len(texts)), np.int64)
        for row, (text, h1, h2) in enumerate(zip(texts, first.to_numpy(), second.to_numpy(), strict=True)):
            boundaries = BoundarySet(ends(np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)))
            n = len(boundaries)
            units_before = sorted((h1 % (n + 1), h2 % (n + 1)))
            found[0, row] = n
            found[1:, row] = [boundaries.select(int(k) - 1) if k else 0 for k in units_before]
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["n", "prefix_end", "middle_end"])

    return F.arrow_udf(cuts, "n long, prefix_end long, middle_end long")


def _hash(seed: int, k: int) -> Column:
    """The k-th 32 bits of the SHA-256 of ``seed:doc_id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, units: str = "words") -> DataFrame:
    """doc_id, text, n, form, prefix_end, middle_end, output of each row of ``docs`` (doc_id, text).

    ``rate`` per cent of the texts are cut; of those ``spm`` per cent are put suffix first, the others prefix first.
    The cuts lie after two hashed numbers of ``units`` (words or characters) and are null where the text stays plain.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(_hash(seed, k).alias(f"_h{k}") for k in (1, 2, 3, 4)))
    rows = rows.withColumn("_cut", _cuts(units)("text", "_h1", "_h2"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("_h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")
    cut = lambda name: F.when(F.col("form") != "plain", F.col("_cut")[name]).cast("int")
    rows = rows.withColumn("form", form).withColumns({"prefix_end": cut("prefix_end"), "middle_end": cut("middle_end")})
    prefix = F.substr("text", F.lit(1), F.col("prefix_end"))
    middle = F.substr("text", F.col("prefix_end") + 1, F.col("middle_end") - F.col("prefix_end"))
    suffix = F.substr("text", F.col("middle_end") + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    reverse = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", reverse).otherwise(F.col("text"))
    return rows.select("doc_id", "text", F.col("_cut")["n"].alias("n"), "form", "prefix_end", "middle_end", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. No mark can begin in one part and end in the next, since a mark's first
    letter occurs in it once."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one_end = F.position(first, body)
    two_end = F.position(second, body)
    one = F.substr(body, F.lit(1), one_end - 1)
    two = F.substr(body, one_end + len(SUFFIX), two_end - one_end - len(SUFFIX))
    middle = F.substr(body, two_end + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_end").cast("long").alias("prefix_chars"), (F.col("middle_end") - F.col("prefix_end")).cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = {
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
k AS (SELECT *, CAST(len(units) AS BIGINT) AS n, h1 % (len(units) + 1) AS k1, h2 % (len(units) + 1) AS k2 FROM u),
c AS (SELECT doc_id, text, n, array_to_string(units[1:least(k1, k2)], '') AS p, array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
             array_to_string(units[greatest(k1, k2) + 1:n], '') AS s,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c""",
}
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
