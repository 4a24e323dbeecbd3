"""Conversation structure repair (operator 11): depth-first branch-and-bound over edits.

Rows of a conversation are kept, get another role, are deleted, or turns without text are inserted, so that the role
initials match ``(s?(ua)+)?``, at the least cost; of the cheapest edit strings (*audits*) the ASCII-least is taken.

:func:`plan_repairs` sorts a few columns of each row (no texts, a digest of them) by conversation and order in Spark, and
each task streams through its conversations. A conversation is searched with an explicit stack (:func:`search`). The lower
bound of a node, a row and a state of the grammar, is the least cost of what can follow it, from one pass backwards; the
bound is tight, so that the first dive ends in a cheapest audit and the rest of the stack is closed by the incumbent and by
each node's dominance table. Work and memory are linear in a conversation's turns, a few bytes a turn.
:func:`apply_repairs` sorts the rows again, behind their audits, and streams the repaired turns out; no conversation's texts
are held at once.

Defined cases: null role and null text are one space; rows with a null conv_id are one conversation; rows are ordered by
turn (nulls first), role and the SHA-256 of the text; an empty role has a blank initial; initials other than s, u and a are
never legal; wholly equal rows are duplicates of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import materialize, table

DELETE, INSERT, KEEP, REROLE = b"DIKR"
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3

#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of the one role, user or assistant, that may be put in each state.
PUT = (USER, USER, ASSISTANT, USER)
#: The state after keeping a turn, by its initial, where that is legal.
AFTER = {ord("s"): {START: SYSTEM}, ord("u"): {START: USER, SYSTEM: USER, ASSISTANT: USER}, ord("a"): {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}

SOUND, CUT_OFF, DOOMED = range(3)


def moves(initial: int, fault: int, state: int) -> Iterator[tuple[int, int, int]]:
    """Edits of a row in ``state``: letter, next state, cost; in the order of their letters, inserts left out."""
    yield DELETE, state, COST[DELETE]
    if fault != DOOMED:
        more = TRUNCATED if fault == CUT_OFF else 0
        if state in AFTER.get(initial, ()):
            yield KEEP, AFTER[initial][state], COST[KEEP] + more
        yield REROLE, PUT[state], COST[REROLE] + more


def suffix_bounds(initials: bytes, faults: bytes) -> array:
    """The least cost of repairing the rows from i on in state s, at place 4 * i + s."""
    n = len(initials)
    out = array("q", bytes(32 * (n + 1)))
    for i in range(n, -1, -1):
        if i == n:
            cost = [0, 2 * COST[INSERT], COST[INSERT], 0]
        else:
            cost = [min(c + out[4 * i + 4 + after] for _, after, c in moves(initials[i], faults[i], s)) for s in range(4)]
            # a user and an assistant turn inserted in a row lead back to the state, so two inserts are the most
            one = [min(cost[s], COST[INSERT] + cost[PUT[s]]) for s in range(4)]
            cost = [min(one[s], COST[INSERT] + one[PUT[s]]) for s in range(4)]
        out[4 * i : 4 * i + 4] = array("q", cost)
    return out


def search(initials: bytes, faults: bytes) -> tuple[int, bytes]:
    """Cost and audit of the cheapest repair, the ASCII-least audit of those."""
    n, bound = len(initials), suffix_bounds(initials, faults)
    incumbent: tuple[int, bytes] | None = None
    best_at = array("q", [-1]) * (4 * (n + 1))  # dominance: the least cost at which each node was entered
    path = bytearray()
    stack = [(0, 0, 0, START, 0)]  # letters before it, its letter, row, state, cost
    while stack:
        depth, letter, i, state, cost = stack.pop()
        node = 4 * i + state
        # children are taken up in the order of bound and letter: what comes later at no less cost has a greater audit
        if incumbent is not None and cost + bound[node] >= incumbent[0]:
            continue
        if 0 <= best_at[node] <= cost:
            continue
        best_at[node] = cost
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if i == n and state in (START, ASSISTANT):
            incumbent = (cost, bytes(path))
            continue
        children = [(INSERT, i, PUT[state], cost + COST[INSERT])]
        if i < n:
            children += [(edit, i + 1, after, cost + c) for edit, after, c in moves(initials[i], faults[i], state)]
        children.sort(key=lambda child: (child[3] + bound[4 * child[1] + child[2]], child[0]))
        stack += [(depth + 1, *child) for child in reversed(children)]
    return incumbent


_SPACES = " \t\n\x0b\f\r"


def _order(rows: DataFrame) -> DataFrame:
    """Rows with what orders them and what the search needs of them."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), *([c for c in ("gone",) if c in rows.columns]))
    rows = rows.withColumn("_sha", F.unhex(F.sha2("text", 256)))
    return rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))


def _code() -> Column:
    """Initial of the role, and whether the text is blank or cut off."""
    bare = F.rtrim("text", F.lit(_SPACES))
    last = F.substr(bare, F.lit(-1))
    fault = F.when(bare == "", DOOMED).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    initial = F.when(F.substr("role", F.lit(1), F.lit(1)).isin("s", "u", "a"), F.ascii("role")).otherwise(F.lit(ord(" ")))
    return F.struct(initial.cast("int").alias("initial"), fault.cast("int").alias("fault"))


class _Conversation:
    """What has to be known of the rows seen so far: two bytes, a turn and a short digest of each."""

    def __init__(self):
        self.initials, self.faults, self.seen = bytearray(), bytearray(), set()
        self.blank = self.duplicate = self.cut_off = self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turn, initial: int, fault: int, digest: bytes) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.initials:
            self.illegal += bytes((self.initials[-1], initial)) not in (b"su", b"ua", b"au")
        if fault == DOOMED:
            self.blank += 1
        elif digest in self.seen:
            self.duplicate += 1
            fault = DOOMED
        else:
            self.cut_off += fault == CUT_OFF
        self.seen.add(digest)
        self.initials.append(initial)
        self.faults.append(fault)

    def result(self) -> tuple:
        cost, audit = search(bytes(self.initials), bytes(self.faults))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.cut_off, self.illegal, cost, audit.decode()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _plans(schema: pa.Schema):
    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "initial", "fault", "digest")]
            for conv, turn, gone, initial, fault, digest in zip(*columns, strict=True):
                if current is None or conv != key:
                    if current is not None:
                        done.append((key, *current.result()))
                    key, current = conv, _Conversation()
                if not gone:
                    current.add(turn, initial, fault, digest)
            if done:
                yield _batch(done, schema)
        if current is not None:
            yield _batch([(key, *current.result())], schema)

    return plans


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(fields: dict[str, str], conv: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([pa.field("conv_id", conv), *(pa.field(n, kinds[t]) for n, t in fields.items())])


def _conv_type(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def plan_repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``rows``.

    ``rows``: conv_id, turn (a whole number), role, text and, if some are lost but their conversations are to be listed
    all the same, gone.
    """
    spark_type, conv = _conv_type(rows)
    fields = dict.fromkeys(_COUNTS, "bigint") | {"audit": "string"}
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), 1, 16)
    coded = _order(rows).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "_sha", "gone", _code().alias("c"), digest.alias("digest"))
    coded = coded.select("conv_id", "turn", "role", "_sha", "gone", "c.initial", "c.fault", "digest")
    coded = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "_sha").drop("role", "_sha")
    return coded.mapInArrow(_plans(_arrow(fields, conv)), f"conv_id {spark_type}, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def _applied(schema: pa.Schema):
    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, position = None, "", 0, START, 0
        for batch in batches:
            done = []

            def put(role, text, edit):
                nonlocal position
                done.append((key, position, role, text, edit))  # noqa: B023
                position += 1

            def inserts():
                nonlocal at, state
                while audit[at : at + 1] == "I":
                    state = PUT[state]
                    put(ROLE[state], "", "I")
                    at += 1

            columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]
            for conv, plan, role, text in zip(*columns, strict=True):
                if plan is not None:
                    key, audit, at, state, position = conv, plan, 0, START, 0
                    inserts()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = AFTER[ord(role[0])][state]
                    put(role, text, "K")
                elif edit == "R":
                    state = PUT[state]
                    put(ROLE[state], text, "R")
                inserts()
            if done:
                yield _batch(done, schema)

    return applied


def apply_repairs(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit (K, R or I) of the repaired turns, in order within a task."""
    spark_type, conv = _conv_type(rows)
    kept = _order(rows).where("NOT gone").drop("gone")
    heads = plans.select("conv_id", "audit", *(F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "_sha")))
    both = kept.withColumn("audit", F.lit(None).cast("string")).unionByName(heads).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "_sha").select("conv_id", "audit", "role", "text")
    fields = {"position": "bigint", "role": "string", "text": "string", "edit": "string"}
    return both.mapInArrow(_applied(_arrow(fields, conv)), f"conv_id {spark_type}, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def _digests(schema: pa.Schema):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for conv, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield _batch(done, schema)
        if digest is not None:
            yield _batch([(key, digest.hexdigest())], schema)

    return digests


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` of its turns, joined by line feeds, as :func:`apply_repairs` streams them."""
    spark_type, conv = _conv_type(turns)
    return turns.mapInArrow(_digests(_arrow({"repaired_sha256": "string"}, conv)), f"conv_id {spark_type}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by the CRC-32 of ``conv_id:turn``, modulo 20."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    plans = materialize(plan_repairs(rows), "repair-plans")
    hashes = conversation_digests(apply_repairs(rows, plans)).withColumnRenamed("conv_id", "_conv")
    out = plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select("conv_id", *_COUNTS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL = {
    "op11_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS UBIGINT)) AS bytes FROM conversations),
kinds AS (SELECT conv_id, turn, role, text,
  xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS UBIGINT[])),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS UBIGINT)) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (0), (1)) copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM ordered),
rows AS (SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE ' ' END AS initial,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM rows),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pairs GROUP BY conv_id),
steps(before, letter, initial, after, cost) AS (VALUES
  ('0', 'D', '', '0', 4), ('S', 'D', '', 'S', 4), ('U', 'D', '', 'U', 4), ('A', 'D', '', 'A', 4),
  ('0', 'K', 's', 'S', 0), ('0', 'K', 'u', 'U', 0), ('S', 'K', 'u', 'U', 0), ('A', 'K', 'u', 'U', 0), ('U', 'K', 'a', 'A', 0),
  ('0', 'R', '', 'U', 3), ('S', 'R', '', 'U', 3), ('A', 'R', '', 'U', 3), ('U', 'R', '', 'A', 3)),
inserted(before, letter, after, cost) AS (VALUES ('0', '', '0', 0), ('S', '', 'S', 0), ('U', '', 'U', 0), ('A', '', 'A', 0),
  ('0', 'I', 'U', 3), ('S', 'I', 'U', 3), ('A', 'I', 'U', 3), ('U', 'I', 'A', 3), ('0', 'II', 'A', 6), ('S', 'II', 'A', 6)),
best(conv_id, i, state, edits) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '0', {'cost': 0, 'audit': ''} FROM counts
  UNION ALL
  SELECT b.conv_id, b.i + 1, s.after, min({'cost': b.edits.cost + x.cost + s.cost + CASE WHEN s.letter <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': b.edits.audit || x.letter || s.letter})
  FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
  JOIN inserted x ON x.before = b.state JOIN steps s ON s.before = x.after AND (s.initial = '' OR s.initial = r.initial) AND (s.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.conv_id, b.i + 1, s.after),
ends AS (SELECT c.conv_id, min({'cost': b.edits.cost + x.cost, 'audit': b.edits.audit || x.letter}) AS edits
  FROM counts c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n JOIN inserted x ON x.before = b.state AND x.after IN ('0', 'A') GROUP BY c.conv_id),
letters AS (SELECT conv_id, j, substr(audit, CAST(j AS INTEGER), 1) AS letter, audit FROM (SELECT conv_id, edits.audit AS audit, unnest(range(1, length(edits.audit) + 1)) AS j FROM ends)),
placed AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
turned AS (SELECT p.conv_id, p.j, p.letter, p.place, r.role, r.text, r.initial FROM placed p LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.letter <> 'D'),
system AS (SELECT conv_id, bool_or(letter = 'K' AND place = 1 AND initial = 's') AS has FROM turned GROUP BY conv_id),
repaired AS (SELECT t.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CASE WHEN has THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS digest FROM turned t JOIN system s ON s.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(e.edits.cost, 0) AS BIGINT) AS cost, coalesce(e.edits.audit, '') AS audit, coalesce(d.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired d ON d.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
QUERIES = {"op11_conversation_repair": op11_conversation_repair}
