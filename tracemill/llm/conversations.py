"""Repair of the turn structure of conversations, with one suffix-shared automaton for all of them.

A row is blank (no character but white space), a duplicate (role and text stand in an earlier row of its conversation), truncated (its last other character is none of
``. ! ?``) or sound; the first that holds counts.  Edits turn the rows of a conversation, in order of turn, into one whose role initials form
``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert of an empty-text user or assistant anywhere 3; a
truncated row that is not deleted adds 3.  The audit is the string of initials of the cheapest edits, of equal ones the least in ASCII.

1. *Signatures.*  Role initial and fault of each row are one of nine symbols; a conversation is the string of its symbols.  Equal signatures of all
   conversations are worked out once.
2. *Automaton.*  Signatures that end alike share nodes: a node is a suffix.  Spark sorts the reversed signatures by range; a task walks its range as one path that
   grows and shrinks, so every suffix is a node once (those on a border between ranges once per range).
3. *Cost-to-go.*  A node holds, per state of the grammar, the least cost of the rest, the first edit of the least audit and the state that follows it, and
   the rank of that audit among those of the other states.  Two audits that begin with the same edit go on from one node, so ranks decide all ties, and no node
   holds a string.  Nodes that differ by a constant cost only are one entry of a table.  The audit of a signature is read off its path.
4. *Repair.*  Signature and audit come back to the conversations; their rows follow, in order, and are repaired and hashed as they pass.

The grammar leaves one role for each Rerole and Insert.  A kept row may have any role of the right initial.

Duplicates are found by (conversation, role, text), gaps and signatures from slim rows without text.  A conversation is one signature and one SHA-256, which takes its rows one after the
other: its rows pass through one task in sorted batches, which holds the current batch and one byte a row.

Defined cases: null conv_id, turn, role and text are one space where text is needed, also in the key of the damage; a null conv_id is a conversation of its own, a
null turn comes before all others.  Rows of one turn follow in order of role and of a digest of the text.  A role without a first character fits no place.  A conversation
without rows after the damage has zeros, an empty audit and the hash of nothing.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Run

# Costs, white space, symbols of (fault, role) and the grammar.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
GONE, SOUND, CUT = b"x", b"suao", b"SUAO"
ROLES = {"u": "user", "a": "assistant"}
#: What a state takes and where that leads: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = "uuau"  # the role that Rerole and Insert give
ENDS = (0, 3)


#: What a node holds, state by state: cost above the least one of the node, first edit, the state behind it, rank of the audit.
Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...], tuple[int, ...]]


def _settled(options: list[list[tuple[int, str, int, int]]]) -> tuple[Node, int]:
    """The node and its least cost from, per state, (cost, edit, rank of the rest, state of the rest); Inserts, which stay at the node, are added here."""
    best = [min(choices, default=(1 << 60, "", 0, 0)) for choices in options]
    cost, to = [b[0] for b in best], [STEPS[s][WANTED[s]] for s in range(4)]
    while better := [s for s in range(4) if cost[to[s]] + INSERT < cost[s]]:
        for s in better:
            cost[s] = cost[to[s]] + INSERT
    # An audit of this node is its Inserts, the next edit and the rank of the rest.  An Insert costs, so states by rising cost find what they lead to.
    keys: list[tuple] = [()] * 4
    edit, then = [""] * 4, [0] * 4
    for s in sorted(range(4), key=cost.__getitem__):
        found = [(best[s][1:3], best[s][1], best[s][3])] if best[s][0] == cost[s] else []
        if cost[to[s]] + INSERT == cost[s]:
            found.append((("I", *keys[to[s]]), "I", to[s]))
        keys[s], edit[s], then[s] = min(found)
    order, least = sorted(set(keys)), min(cost)
    return (tuple(c - least for c in cost), tuple(edit), tuple(then), tuple(order.index(k) for k in keys)), least


END = _settled([[(0, "", 0, 0)] if s in ENDS else [] for s in range(4)])


@lru_cache(maxsize=None)  # few nodes differ once their least cost is taken off
def before(symbol: int, below: Node) -> tuple[Node, int]:
    """The node of a row in front of a suffix, and how much more it costs at least."""
    role, extra = chr(symbol).lower(), 0 if symbol in SOUND else TRUNCATED
    options = []
    for state, steps in enumerate(STEPS):
        found = [(DELETE, "D", state)]
        if symbol not in GONE:
            found += [(extra, "K", steps[role])] if role in steps else []
            found.append((REROLE + extra, "R", steps[WANTED[state]]))
        options.append([(cost + below[0][then], edit, below[3][then], then) for cost, edit, then in found])
    return _settled(options)


class Path:
    """The nodes of one reversed signature; the next one keeps those of the suffix that both share."""

    def __init__(self) -> None:
        self.text, self.nodes, self.costs = b"", [END[0]], array("q", [END[1]])

    def audit(self, text: bytes) -> tuple[int, str]:
        """Cost and audit of a reversed signature."""
        common = next((i for i, (x, y) in enumerate(zip(text, self.text, strict=False)) if x != y), min(len(text), len(self.text)))
        del self.nodes[common + 1 :], self.costs[common + 1 :]
        for symbol in text[common:]:
            node, more = before(symbol, self.nodes[-1])
            self.nodes.append(node)
            self.costs.append(self.costs[-1] + more)
        self.text = text
        state, at, out = 0, len(text), []
        while edit := self.nodes[at][1][state]:
            out.append(edit)
            state, at = self.nodes[at][2][state], at - (edit != "I")
        return self.costs[-1] + self.nodes[-1][0][0], "".join(out)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cost and audit of every signature; rows come in order of the reversed signatures."""
    path = Path()
    for batch in batches:
        found = [path.audit(text) for text in batch.column("reversed").to_pylist()]
        columns = [batch.column("reversed"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["reversed", "cost", "audit"])


def text_of(column: Column | str) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of ``conv_id:turn`` chooses."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.withColumn("fate", fate).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


ORDER = ("conv_hash", "no_conv", "conv_id", "has_turn", "turn", "role", "digest", "row")
SIGNED = "conv_id long, signature binary, gaps long, blank long, duplicate long, truncated long, illegal long"


def faulty(rows: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """The rows with what orders them, and without text but with their fault."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = run.land(
        rows.withColumns(
            {
                "conv_hash": F.xxhash64("conv_id"),
                "no_conv": F.col("conv_id").isNull(),
                "has_turn": F.col("turn").isNotNull(),
                "digest": F.unhex(F.md5(F.col("text").cast("binary"))),
                "blank": trimmed == "",
                "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"),
                "row": F.monotonically_increasing_id(),
            }
        ),
        "rows",
    )
    same = F.md5(F.concat_ws("\n", text_of("conv_id"), F.col("no_conv").cast("string"), F.hex("digest"), F.col("role")).cast("binary"))
    slim = rows.drop("text").withColumn("same", same)
    # Rows of a conversation with one role and text meet as their first place only, summed up before they are shuffled.
    place = F.struct("has_turn", "turn", "row")
    first = run.land(slim.groupBy("same").agg(F.min(place)["row"].alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("same", "first"), "first")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNotNull() & (F.col("first") != F.col("row")), "duplicate").when(F.col("cut"), "truncated")
    return rows, slim.join(first, "same", "left").withColumn("fault", fault).select(*ORDER, "fault")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its sorted rows."""
    place = {"s": 0, "u": 1, "a": 2}
    own: object = None
    state: dict | None = None

    def closed() -> dict:
        turns = state.pop("turns")
        state.pop("last")
        out = state | {"signature": bytes(state["signature"]), "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0}
        return {n: out[n] for n in names}

    schema = [c.split() for c in SIGNED.split(", ")]
    names, kinds = [c[0] for c in schema], {"long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in schema])
    for batch in batches:
        out = []
        for conv, turn, role, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "fault")), strict=True):
            if state is None or conv != own:
                if state is not None:
                    out.append(closed())
                own, state = conv, {"conv_id": conv, "signature": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": None, "last": None}
            if fault:
                state[fault] += 1
            if state["last"] is not None and state["last"] + role not in ("su", "ua", "au"):
                state["illegal"] += 1
            state["last"] = role
            state["signature"] += GONE if fault in ("blank", "duplicate") else (CUT if fault else SOUND)[(at := place.get(role, 3)) : at + 1]
            if turn is not None:
                least, most, different = state["turns"] or (turn, turn - 1, 0)
                state["turns"] = (least, turn, different + (turn != most))
        yield pa.RecordBatch.from_pylist(out, schema=arrow)
    yield pa.RecordBatch.from_pylist([closed()] if state is not None else [], schema=arrow)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the hash of the repaired rows: each conversation's audit comes first, then its rows in order."""
    own: object = None
    digest, audit, at, state, some, begun = hashlib.sha256(), "", 0, 0, False, False

    def put(role: str, text: str) -> None:
        nonlocal some
        digest.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        some = True

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = WANTED[state]
            put(ROLES[role], "")
            state, at = STEPS[state][role], at + 1

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        out = []
        columns = [batch.column(n) for n in ("conv_id", "role", "text", "audit")]
        for row in range(batch.num_rows):
            conv, role, text, header = (c[row].as_py() for c in columns)
            if header is not None:
                if begun:
                    inserts()
                    out.append((own, digest.hexdigest()))
                own, digest, audit, at, state, some, begun = conv, hashlib.sha256(), header, 0, 0, False, True
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            role = ROLES[WANTED[state]] if edit == "R" else role
            put(role, text)
            state = STEPS[state][role[0]]
        yield made(out)
    if begun:
        inserts()
    yield made([(own, digest.hexdigest())] if begun else [])


def repair(rows: DataFrame, run: Run) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text without nulls in the last two)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, faults = faulty(rows, run)
    slim = faults.withColumn("initial", F.substring("role", 1, 1)).repartition(parts, "conv_hash").sortWithinPartitions(*ORDER)
    signed = run.land(slim.select("conv_id", "turn", "initial", "fault").mapInArrow(_sign, SIGNED).withColumn("reversed", F.reverse(F.col("signature").cast("string")).cast("binary")), "signed")
    signatures = signed.select("reversed").distinct().repartitionByRange(parts, "reversed").sortWithinPartitions("reversed")
    solved = run.land(signatures.mapInArrow(_solve, "reversed binary, cost long, audit string"), "solved")
    known = run.land(signed.join(solved, "reversed").drop("reversed", "signature"), "known")
    texts = rows.select(*ORDER, "text", F.lit(None).cast("string").alias("audit"))
    heads = known.select(F.xxhash64("conv_id").alias("conv_hash"), F.col("conv_id").isNull().alias("no_conv"), "conv_id", "audit")
    merged = texts.unionByName(heads, allowMissingColumns=True).repartition(parts, "conv_hash")
    # Nulls come first, so the row with the audit precedes those of its conversation.
    merged = merged.sortWithinPartitions("conv_hash", "no_conv", "conv_id", F.asc_nulls_first("has_turn"), *ORDER[4:])
    hashes = merged.select("conv_id", "role", "text", "audit").mapInArrow(_hash, "conv_id long, repaired_sha256 string")
    same = known["conv_id"].eqNullSafe(hashes["conv_id"])
    return known.join(hashes, same).select(known["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """A row per original conv_id: its faults after the damage, the cheapest repair and the hash of the repaired rows."""
    run = Run(conversations.sparkSession, "conversations")
    found = run.land(repair(damaged(conversations), run), "repaired")
    every = conversations.select(F.col("conv_id").cast("long").alias("own")).distinct()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rows = every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return rows.select(
        F.col("own").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
