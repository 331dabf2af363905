"""Cheapest repair of conversations by depth-first branch and bound.

A conversation is to read: an optional system turn, then pairs of a user and an
assistant turn, or nothing at all. Rows may be kept, given another role or deleted,
and empty turns may be inserted. Faults are found by window functions; the search
sees one byte for each row, texts never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Initials of the edits. In ASCII order, which decides between repairs of equal cost.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
#: Added for a truncated row that is not deleted.
TRUNCATED_COST = 5

#: What has been written so far: nothing, the system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: A repair may end in these.
ENDS = (NOTHING, ASSISTANT)
#: The turn that may come next besides a system turn at the start, and the state after it.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

#: Codes of a row: its role's initial s, u or a, ``x`` for any other role, ``d`` where it
#: has to be deleted; upper case where it is truncated.
MUST_GO = "d"
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Rows of a conversation that are searched at once.
SEGMENT_ROWS = 2000
#: No repair costs as much.
NO_WAY = 1 << 60

Label = tuple[int, str]


def _moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, state after, cost) of the edits that use up a row, in ASCII order of initials."""
    moves = [(DELETE, state, COST[DELETE])]
    kind = code.lower()
    if kind == MUST_GO:
        return moves
    more = TRUNCATED_COST if code != kind else 0
    own = OF_INITIAL.get(kind)
    if own == NEXT[state] or own == SYSTEM and state == NOTHING:
        moves.append((KEEP, own, more))
    if own != NEXT[state]:
        moves.append((REROLE, NEXT[state], COST[REROLE] + more))
    return moves


MOVES = {(code, state): _moves(code, state) for kind in "suaxd" for code in (kind, kind.upper()) for state in STATES}


def suffix_bounds(codes: str, ends: tuple[int, ...]) -> list[list[int]]:
    """``bounds[i][state]``: no way from before row ``i`` to one of ``ends`` costs less.

    Exact once something is written. Before that, rows that need not go count
    nothing and only the cheapest way of the rest counts, so the search has to prove
    how a conversation begins.
    """
    n = len(codes)
    bounds = [[NO_WAY] * 4 for _ in range(n + 1)]
    for s in ends:
        bounds[n][s] = 0
    for i in range(n, -1, -1):
        here = bounds[i]
        if i < n:
            after = bounds[i + 1]
            for s in (SYSTEM, USER, ASSISTANT):
                here[s] = min(cost + after[t] for _, t, cost in MOVES[codes[i], s])
        for _ in range(2):  # at most two insertions in a row help
            for s in (SYSTEM, USER, ASSISTANT):
                here[s] = min(here[s], COST[INSERT] + here[NEXT[s]])
        free = 0 if i == n or codes[i].lower() != MUST_GO else COST[DELETE]
        here[NOTHING] = min(min(here), free + (min(bounds[i + 1]) if i < n else NO_WAY))
    return bounds


def _children(codes: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, row after, state after, cost) of the edits at a node."""
    found = [(INSERT, i, NEXT[state], COST[INSERT])]
    if i < len(codes):
        found += [(e, i + 1, t, cost) for e, t, cost in MOVES[codes[i], state]]
    return found


def _first_incumbent(codes: str, start: int, ends: tuple[int, ...], bounds: list[list[int]]) -> int:
    """What the repair costs that begins at once and then takes the edit of least cost and bound.

    Beginning later or not at all could save a few edits only, so the search, which
    looks for that, has little left to try.
    """
    i, state, total = 0, start, 0
    while i < len(codes) or state not in ends:
        children = [m for m in _children(codes, i, state) if state != NOTHING or m[0] != DELETE]
        _, i, state, cost = min(children, key=lambda m: m[3] + bounds[m[1]][m[2]])
        total += cost
        if total >= NO_WAY or bounds[i][state] >= NO_WAY:
            return NO_WAY
    return total


def search(codes: str, start: int = NOTHING, ends: tuple[int, ...] = ENDS) -> Label | None:
    """The least (cost, audit) that leads from ``start`` to one of ``ends``; None if there is none.

    Depth first with an explicit stack, edits in ASCII order, so of several audits of
    equal cost the least is met first. A prefix is given up when its cost and the
    bound of the rest exceed the incumbent, or when its node (row, state) has been
    reached at no greater cost before.
    """
    n = len(codes)
    bounds = suffix_bounds(codes, ends)
    best_cost, best_audit = _first_incumbent(codes, start, ends, bounds), None
    reached: dict[tuple[int, int], int] = {}
    audit: list[str] = []
    stack: list[tuple[int, int, int, str, int]] = [(0, start, 0, "", 0)]
    while stack:
        i, state, cost, step, depth = stack.pop()
        if cost + bounds[i][state] > best_cost or reached.get((i, state), NO_WAY) <= cost:
            continue
        reached[i, state] = cost
        del audit[max(0, depth - 1) :]
        if step:
            audit.append(step)
        if i == n and state in ends:
            found = "".join(audit)
            if best_audit is None or (cost, found) < (best_cost, best_audit):
                best_cost, best_audit = cost, found
        for edit, row, after, price in sorted(_children(codes, i, state), reverse=True):
            stack.append((row, after, cost + price, edit, depth + 1))
    return None if best_audit is None else (best_cost, best_audit)


def segment_table(codes: str, first: bool) -> list[Label | None]:
    """The best way through a segment from each state to each state, state by state."""
    return [search(codes, s, (t,)) if s == NOTHING or not first else None for s in STATES for t in STATES]


def joined(tables: Iterable[list[Label | None]]) -> Label:
    """The best repair over all segments, in order.

    Two different ways through the same rows that end in the same state and cost the
    same cannot be one the start of the other, so the lesser one stays the lesser.
    """
    best: dict[int, Label] = {NOTHING: (0, "")}
    for table in tables:
        after: dict[int, Label] = {}
        for s, (cost, audit) in best.items():
            for t in STATES:
                way = table[4 * s + t]
                if way is not None:
                    label = (cost + way[0], audit + way[1])
                    if t not in after or label < after[t]:
                        after[t] = label
        best = after
    return min(best[s] for s in ENDS if s in best)


def steps(audit: str) -> tuple[list[int | None], list[str | None]]:
    """For each turn of the repair its row, None if inserted, and its new role, None if kept."""
    size = sum(e != DELETE for e in audit)
    rows, roles, row = [], [], 0
    for edit in audit:
        if edit != DELETE:
            at = len(rows) - size % 2
            rows.append(None if edit == INSERT else row)
            roles.append(None if edit == KEEP else ("user", "assistant")[at % 2])
        row += edit != INSERT
    return rows, roles


#: Characters that do not count as text, and those that end a sentence.
BLANK, SENTENCE_END = r"\x20\x09-\x0D", ".!?"


def faults(df: DataFrame, key: str, turn: str, role: str, text: str, alive: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, alive, row, initial, fault, before) of every row.

    Rows of a conversation are ordered by turn, nulls first, then role and text;
    ``row`` counts from 0. ``fault`` is the first that holds of ``blank`` (no
    character but ASCII blanks), ``duplicate`` (role and text of an earlier row) and
    ``truncated`` (the last other character does not end a sentence), else null.
    ``before`` is the initial of the row before. Null role and text count as one
    space. Rows that are not ``alive`` only tell that their conversation occurs.
    """
    rows = df.select(
        F.col(key).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(True) if alive is None else alive).alias("alive"),
    )
    of_conv = Window.partitionBy("conv", "alive").orderBy(F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv", "alive", "role", "text").orderBy("row")
    tail = F.regexp_extract("text", f"([^{BLANK}])[{BLANK}]*\\z", 1)
    fault = F.when(tail == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
    return (
        rows.withColumn("row", F.row_number().over(of_conv) - 1)
        .withColumn("initial", F.substring("role", 1, 1))
        .withColumn("before", F.lag("initial").over(of_conv))
        .withColumn("fault", fault.when(~tail.isin(*SENTENCE_END), "truncated"))
    )


def _code() -> Column:
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)


VERDICT = "turns array<struct<row: int, role: string>>"


def _searched(batches):
    for batch in batches:
        tables = [segment_table(c, s == 0) for s, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        ways = [[None if x is None else {"cost": x[0], "audit": x[1]} for x in t] for t in tables]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ways, WAYS)], ["conv", "segment", "ways"])


def _joined(batches):
    for batch in batches:
        costs, audits, turns = [], [], []
        for segments in batch.column(1).to_pylist():
            tables = [[w and (w["cost"], w["audit"]) for w in s["ways"]] for s in segments]
            cost, audit = joined(tables)
            costs.append(cost)
            audits.append(audit)
            turns.append([{"row": r, "role": x} for r, x in zip(*steps(audit))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(turns, TURNS)],
            ["conv", "cost", "audit", "turns"],
        )


WAYS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
TURNS = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns that ``right`` has of the same conversation, null ones included."""
    renamed = right.withColumnRenamed("conv", "same_conv")
    return left.join(renamed, F.col("conv").eqNullSafe(F.col("same_conv")), "left").drop("same_conv")


def verdicts(found: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of each conversation.

    ``found`` is what :func:`faults` gives. Counts are of the rows alive; ``illegal``
    are neighbours whose initials are not su, ua or au. ``turns`` lists the row of
    each repaired turn (null: inserted) and its new role (null: kept). Conversations
    are searched in segments of ``segment_rows`` rows, from each state to each, so a
    very long one is shared out; one byte a row and way is joined at the end.
    """
    alive = found.where("alive")
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    pair = F.concat("before", "initial")
    stats = alive.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"),
        F.count(F.when(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au"), 1)).alias("illegal"),
    )
    segments = alive.groupBy("conv", F.floor(F.col("row") / segment_rows).cast("int").alias("segment")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", _code().alias("code")))), lambda x: x["code"]), "").alias("codes")
    )
    kind = dict(found.dtypes)["conv"]
    ways = segments.mapInArrow(_searched, f"conv {kind}, segment int, ways array<struct<cost: bigint, audit: string>>")
    in_order = ways.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "ways"))).alias("segments"))
    repairs = in_order.mapInArrow(_joined, f"conv {kind}, cost bigint, audit string, {VERDICT}")
    full = _with(_with(found.select("conv").distinct(), stats), repairs)
    return full.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"])


def repaired_turns(found: DataFrame, verdict: DataFrame) -> DataFrame:
    """(conv, at, role, text, row) of the repaired conversations; inserted turns have no text and no row."""
    wanted = verdict.select("conv", F.posexplode("turns").alias("at", "t")).select("conv", "at", F.col("t.row").alias("row"), F.col("t.role").alias("new_role"))
    rows = found.where("alive").select(F.col("conv").alias("of"), F.col("row").alias("own"), "role", "text")
    joined_rows = wanted.join(rows, F.col("conv").eqNullSafe(F.col("of")) & (F.col("row") == F.col("own")), "left")
    return joined_rows.select("conv", "at", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "row")


def with_digest(found: DataFrame, verdict: DataFrame) -> DataFrame:
    """The verdicts with ``repaired_sha256`` of the lines ``role:text`` in place of ``turns``.

    A digest is of one text, so the turns of a conversation meet in one task here.
    """
    line = F.concat("role", F.lit(":"), "text")
    texts = repaired_turns(found, verdict).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    texts = texts.select("conv", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("told"))
    return _with(verdict.drop("turns"), texts).withColumn("repaired_sha256", F.sha2(F.coalesce("told", F.lit("")), 256)).drop("told")
