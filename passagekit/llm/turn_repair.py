"""Structure repair of conversations: generalised LR parsing over the role grammar, with edits.

The grammar is ``chat: empty | body``, ``body: head pair | body pair``, ``head: empty | system``,
``pair: user assistant``. A parser reads the turns of a conversation and may also delete or
rerole a turn or insert an empty one, each at a cost. All ways to read so far share one
graph-structured stack: its tops are parser states, and where two ways arrive at the
same top, only the cheaper stays, of equal costs the one whose edits spell the smaller text. What lies
below a top does not matter for the turns to come, since both ways to begin a body reduce to the same
stack, so merging loses nothing.

Conversations are read in stretches of bounded length. Sorted turns are dealt by ranges, so that
a long conversation lies in several tasks; a stretch that may have a beginning elsewhere is
parsed from every top, and its table of the best edits from top to top is joined with
those of the other stretches of its conversation. The edits found then go back to the
stretches, which are repaired on their own.

Of a turn, only its role, its faults and the digest of its text are moved until it is
repaired. What must fit a row is the text of a conversation's edits, one letter a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, saved, table

#: Turns of a conversation that are parsed as one stretch.
STRETCH = 2048
#: What the edits cost, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Neighbouring roles that are in order, by their initials.
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

#: Parser states: before the first turn, after the head, after a user, after whole pairs.
START, HEAD, USER, BODY = range(4)
TOPS = (START, HEAD, USER, BODY)
ACCEPTING = (START, BODY)
#: By state and role: the roles shifted as they are, and the nonterminals then reduced.
SHIFTS = {(START, "s"): HEAD, (START, "u"): USER, (HEAD, "u"): USER, (BODY, "u"): USER, (USER, "a"): BODY}


@dataclass(frozen=True)
class Node:
    """A top of the stack: its state, the node below, and the best way to it."""

    state: int
    below: Node | None
    cost: int
    edits: str

    def rank(self) -> tuple[int, str]:
        return self.cost, self.edits


def _shifted(node: Node, token: str, cost: int, edit: str) -> Node | None:
    """The top after a token, all reductions done; None if the grammar has no such token here."""
    to = SHIFTS.get((node.state, token))
    if to is None:
        return None
    cost, edits = node.cost + cost, node.edits + edit
    if to == BODY:
        # pair: user assistant; body: head pair | body pair. The user's node and what
        # it lies on are popped, whether that is a head or a body.
        return Node(BODY, None, cost, edits)
    return Node(to, node, cost, edits)


def _merge(tops: dict[int, Node], node: Node | None) -> bool:
    """Put a node among the tops if it is the best of its state."""
    if node is None:
        return False
    old = tops.get(node.state)
    if old is not None and old.rank() <= node.rank():
        return False
    tops[node.state] = node
    return True


def with_inserts(tops: dict[int, Node]) -> dict[int, Node]:
    """The tops that are reached by inserting turns, too."""
    tops = dict(tops)
    changed = True
    while changed:
        changed = False
        for node in list(tops.values()):
            for token in ROLES:
                changed |= _merge(tops, _shifted(node, token, INSERT, "I"))
    return tops


def read(tops: dict[int, Node], initial: str, fault: str, copies: int) -> dict[int, Node]:
    """The tops after a turn and ``copies - 1`` repetitions of it.

    A blank turn or a duplicate can only go, and so can repetitions. Turns are
    inserted before a turn that may stay; before others it would spell a greater text at the same cost.
    """
    after: dict[int, Node] = {}
    gone = copies if fault in ("blank", "duplicate") else copies - 1
    if gone < copies:
        stays = TRUNCATED if fault == "truncated" else 0
        for node in with_inserts(tops).values():
            _merge(after, _shifted(node, initial, stays, "K"))
            for token in ROLES:
                _merge(after, _shifted(node, token, REROLE + stays, "R"))
            _merge(after, Node(node.state, node.below, node.cost + DELETE, node.edits + "D"))
    else:
        after = tops
    if gone:
        end = "D" * gone
        after = {s: Node(s, n.below, n.cost + DELETE * gone, n.edits + end) for s, n in after.items()}
    return after


def entry(state: int, cost: int = 0, edits: str = "") -> Node:
    """A top to go on from. What lies below a user is reduced in the same way, whatever it is."""
    below = Node(BODY, None, 0, "") if state == USER else None
    return Node(state, below, cost, edits)


# ------------------------------------------------------------------ faults


def _visible(text: Column) -> Column:
    """The text without the characters that count as blank."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def faults(turns: DataFrame) -> DataFrame:
    """Distinct turns of a conversation, with ``copies``, ``fault`` and ``digest`` in place of the text.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``, the last two not null. Turns equal in all four are one row with their number as
    ``copies``. ``fault`` is ``blank``, ``duplicate`` if role and text stood in an earlier turn, ``truncated`` or
    empty, the first that holds; the repetitions of a row's first copy are duplicates anyway.
    """
    seen = _visible(F.col("text"))
    narrow = turns.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (seen == "").alias("blank"),
        (~F.endswith(seen, F.lit(".")) & ~F.endswith(seen, F.lit("!")) & ~F.endswith(seen, F.lit("?"))).alias("cut"),
    )
    # Partial sums fold what repeats before anything is moved.
    folded = narrow.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(
        F.count(F.lit(1)).alias("copies")
    )
    # A null turn comes first.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"))
    firsts = firsts.toDF("_conv", "_role", "_digest", "_first")
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest"))
    )
    fault = (
        F.when(F.col("blank"), "blank")
        .when(~F.col("turn").eqNullSafe(F.col("_first.turn")), "duplicate")
        .when(F.col("cut"), "truncated")
        .otherwise("")
    )
    return folded.join(firsts, same).select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault"))


# ------------------------------------------------------- parsing in stretches

_TABLE = (
    "conv_id long, stretch long, source int, target int, cost long, edits string, blank long, duplicate long,"
    " truncated long, illegal long, first string, last string"
)
_ROW = "conv_id long, turn long, role string, digest binary, copies long, fault string, stretch long, number int"


def in_stretches(rows: DataFrame, size: int = STRETCH) -> DataFrame:
    """The rows sorted and dealt by ranges, with their ``stretch`` and ``number`` in it.

    A conversation goes by turn, nulls first, then role and digest. A stretch ends after
    ``size`` rows and with the conversation or the task.
    """
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        now, stretch, count, begun = None, base - 1, 0, False
        for batch in batches:
            stretches, numbers = [], []
            for conv in batch["conv_id"].to_pylist():
                if not begun or conv != now or count == size:
                    now, stretch, count, begun = conv, stretch + 1, 0, True
                stretches.append(stretch)
                numbers.append(count)
                count += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(stretches, pa.int64()), pa.array(numbers, pa.int32())],
                names=[*batch.schema.names, "stretch", "number"],
            )

    # Written once, since a task that is run again must number the same rows.
    return saved(placed.mapInArrow(number, _ROW))


def tables(rows: DataFrame) -> DataFrame:
    """For each stretch and pair of tops, the best edits from the one to the other, and its counts.

    Only the first stretch of a task can begin in the middle of a conversation unseen; other
    stretches that open a conversation are parsed from the start alone.
    """
    columns = ["conv_id", "stretch", "role", "fault", "copies"]
    kinds = ("blank", "duplicate", "truncated")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"stretch": None}

        def found() -> list[tuple]:
            counts = [state[k] for k in (*kinds, "illegal", "first", "last")]
            head = state["conv"], state["stretch"]
            return [
                (*head, source, node.state, node.cost, node.edits, *counts)
                for source, tops in state["tops"].items()
                for node in tops.values()
            ]

        for batch in batches:
            out = []
            for conv, stretch, role, fault, copies in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                initial = role[:1]
                if stretch != state["stretch"]:
                    opens = state["stretch"] is not None and conv != state["conv"]
                    if state["stretch"] is not None:
                        out += found()
                    sources = (START,) if opens else TOPS
                    state = {"stretch": stretch, "conv": conv, "illegal": 0, "first": initial, "last": None}
                    state |= dict.fromkeys(kinds, 0) | {"tops": {s: {s: entry(s)} for s in sources}}
                state["tops"] = {s: read(tops, initial, fault, copies) for s, tops in state["tops"].items()}
                pairs = [] if state["last"] is None else [state["last"] + initial]
                state["illegal"] += sum(p not in LEGAL for p in pairs) + (copies - 1) * (initial * 2 not in LEGAL)
                state["last"] = initial
                if fault == "blank":
                    state["blank"] += copies
                else:
                    state["duplicate"] += copies - (fault != "duplicate")
                    state["truncated"] += fault == "truncated"
            yield _batch(out, _TABLE)
        if state["stretch"] is not None:
            yield _batch(found(), _TABLE)

    return rows.sortWithinPartitions("stretch", "number").select(*columns).mapInArrow(parse, _TABLE)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


_EDITS = (
    "conv_id long, stretch long, source int, piece string, cost long, blank long, duplicate long,"
    " truncated long, illegal long"
)


def edits(tables_: DataFrame) -> DataFrame:
    """For each stretch, the top it begins with and its piece of the conversation's cheapest edits.

    Each row also has the cost and the counts of its whole conversation.
    """

    def join(found: pa.Table) -> pa.Table:
        rows = sorted(found.select([f.split()[0] for f in _TABLE.split(", ")]).to_pylist(), key=lambda r: r["stretch"])
        stretches: dict[int, list[dict]] = {}
        for row in rows:
            stretches.setdefault(row["stretch"], []).append(row)
        tops, ways = {START: entry(START)}, []
        counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        before = None
        for parts in stretches.values():
            after, came = {}, {}
            for part in parts:
                if node := tops.get(part["source"]):
                    way = Node(part["target"], None, node.cost + part["cost"], node.edits + part["edits"])
                    if _merge(after, way):
                        came[part["target"]] = part["source"]
            ways.append((tops, came))
            tops = after
            for name in counts:
                counts[name] += parts[0][name]
            if before is not None:
                counts["illegal"] += before + parts[0]["first"] not in LEGAL
            before = parts[0]["last"]
        ends = [(_ended(node), state) for state, node in tops.items()]
        end, state = min(((end, state) for end, state in ends if end), key=lambda x: x[0].rank())
        text, out = end.edits, []
        for stretch, (entered, came) in reversed(list(zip(stretches, ways, strict=True))):
            source = came[state]
            start = len(entered[source].edits)
            out.append((rows[0]["conv_id"], stretch, source, text[start:], end.cost, *counts.values()))
            text, state = text[:start], source
        return pa.Table.from_batches([_batch(out, _EDITS)])

    return tables_.groupBy("conv_id").applyInArrow(join, _EDITS)


def _ended(node: Node) -> Node | None:
    """The best accepted way from one top, turns inserted at the end included."""
    tops = with_inserts({node.state: entry(node.state, node.cost, node.edits)})
    return min((tops[state] for state in ACCEPTING if state in tops), key=Node.rank, default=None)


_REPAIRED = "conv_id long, stretch long, place int, edit string, role string, turn long, old_role string, digest binary"


def _applied(rows: pa.Table, pieces: pa.Table) -> pa.Table:
    """The turns of one stretch after its edits; deleted ones have no role."""
    way = pieces.to_pylist()[0]
    state, out = way["source"], []
    left = iter(way["piece"])

    def put(edit: str, role: str | None, row: dict | None) -> None:
        kept = (row["turn"], row["role"], row["digest"]) if row else (None, None, None)
        out.append((way["conv_id"], way["stretch"], len(out), edit, role, *kept))

    def step(edit: str, row: dict | None) -> None:
        nonlocal state
        token = ("a" if state == USER else "u") if edit in "IR" else row["role"][:1] if edit == "K" else None
        role = ROLES[token] if edit in "IR" else row["role"] if edit == "K" else None
        put(edit, role, row)
        if token is not None:
            state = SHIFTS[state, token]

    for row in sorted(rows.to_pylist(), key=lambda r: r["number"]):
        for _ in range(row["copies"]):
            while (edit := next(left)) == "I":
                step(edit, None)
            step(edit, row)
    for edit in left:
        step(edit, None)
    return pa.Table.from_batches([_batch(out, _REPAIRED)])


# ---------------------------------------------------------------- the operator


def reports_and_repairs(turns: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """Reports of the conversations that have turns, and their repaired turns.

    ``turns`` has ``conv_id``, ``turn`` (long), ``role`` and ``text``; other columns are left out. Roles and texts that are
    null count as one space, a null ``conv_id`` is a conversation of its own, and null turns come first. Turns of one
    number go by role and then by the digest of their text, equal ones side by side.

    A report has ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``. Repaired turns have
    ``conv_id``, ``stretch`` and ``place``, which order them, ``edit`` (``K``, ``R``, ``D``, ``I``), ``role`` (null if deleted), and ``turn``,
    ``old_role`` and ``text`` of the turn they come from; an inserted turn has the empty text. An
    empty table gives empty ones.
    """
    import_on_workers(turns.sparkSession)
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"))
    rows = in_stretches(faults(turns), stretch)
    pieces = saved(edits(tables(rows)))
    turn = F.col("turn")
    gaps = turns.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps")
    )
    audits = (
        pieces.groupBy("conv_id")
        .agg(
            *[F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("stretch", "piece"))), lambda p: p["piece"]), ""
            ).alias("audit"),
        )
        .withColumnRenamed("conv_id", "_conv")
    )
    reports = gaps.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    applied = (
        rows.groupBy("conv_id", "stretch")
        .cogroup(pieces.groupBy("conv_id", "stretch"))
        .applyInArrow(_applied, _REPAIRED)
    )
    texts = turns.select(
        F.col("conv_id").alias("_conv"),
        F.col("turn").alias("_turn"),
        F.col("role").alias("_role"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_digest"),
        "text",
    ).dropDuplicates(["_conv", "_turn", "_role", "_digest"])
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & F.col("turn").eqNullSafe(F.col("_turn"))
        & (F.col("old_role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest"))
    )
    repaired = applied.join(texts, same, "left").select(
        "conv_id",
        "stretch",
        "place",
        "edit",
        "role",
        "turn",
        "old_role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return reports, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256`` of ``role:text`` lines, read in order by a task a conversation.

    A digest goes through a conversation's text from end to end, so this is the one step that does not split a
    long one; it holds a turn at a time.
    """
    lines = repaired.where(F.col("role").isNotNull()).select(
        "conv_id", "stretch", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "stretch", "place")]
    schema = "conv_id long, repaired_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, begun = None, None, False
        for batch in batches:
            out = []
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"], strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append((now, sums.hexdigest()))
                    now, sums, begun = conv, hashlib.sha256(), True
                else:
                    sums.update(b"\n")
                sums.update(line.as_py())
            yield _batch(out, schema)
        if begun:
            yield _batch([(now, sums.hexdigest())], schema)

    dealt = lines.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "line")
    return dealt.mapInArrow(digest, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage that the contract names, by ``crc32`` of ``conv_id:turn`` modulo 20."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    twice = F.when(kind == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    left = conversations.where(kind != 0)
    return left.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(twice).alias("_copy")
    ).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation, damaged and repaired."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    reports, repaired = reports_and_repairs(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_every")).distinct()
    hashed = digests(repaired).withColumnRenamed("conv_id", "_hashed")
    found = every.join(reports, F.col("_every").eqNullSafe(F.col("conv_id")), "left").join(
        hashed, F.col("_every").eqNullSafe(F.col("_hashed")), "left"
    )
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("_every").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
