"""Cheapest repair of a conversation's turns by iterative-deepening A*.

A well-formed conversation is empty, or an optional system turn followed by user and assistant
turns in turn, the assistant last. Edits stand in ASCII order of their initials: **D**\\ elete a row
(2), **I**\\ nsert an empty user or assistant row (5), **K**\\ eep a row (0) and **R**\\ erole it to
user or assistant (1). Blank and repeated rows must go; a truncated row that stays costs 5 more.
The role an edit gives follows from the rows before it, so the initials say all.

The search goes depth first through the edits in that order, under a cost bound that rises to the
least total it had to refuse. States are (rows used, what came last); a table keeps for every state
the least cost it is known to need to the end. It starts from the need of a simpler problem
(:func:`needs`) and learns from every failed state, so that no state is searched twice with the same
means. The first path accepted is the cheapest and, among the cheapest, least in ASCII order.

Spark brings the rows of a conversation together once as one code byte a row, and once with
their texts, both as a sorted stream: a task holds codes and edits of one conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wartalens.llm.common import prepare_python, quoted
from wartalens.session import stage

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
ROLES = "uasx"                        # user, assistant, system, anything else
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
REMEMBERED = 100_000                  # short conversations whose repair a task remembers
SHORT = 64


def code(role: str, fault: int) -> str:
    """One letter for a row's role and fault."""
    return chr(65 + 4 * fault + ROLES.index(role))


def needs(codes: str) -> list[array]:
    """Cost that is surely needed from each (state, row) to the end, by a simpler grammar.

    That one takes a system turn alone as well-formed, too, so its states after a system and after an
    assistant turn are one, and its costs are never too high. They are close, so a
    search needs few bounds however long the conversation is.
    """
    n = len(codes)
    user_next, assistant_next, start = (array("q", bytes(8 * (n + 1))) for _ in range(3))
    assistant_next[n] = INSERT
    for i in range(n - 1, -1, -1):
        fault, role = divmod(ord(codes[i]) - 65, 4)
        u, a, first = (DELETE + later[i + 1] for later in (user_next, assistant_next, start))
        if fault < BLANK:
            extra = CUT if fault == TRUNCATED else 0
            u = min(u, extra + (0 if role == 0 else REROLE) + assistant_next[i + 1])
            a = min(a, extra + (0 if role == 1 else REROLE) + user_next[i + 1])
            first = min(first, extra + user_next[i + 1]) if role == 2 else first
        user_next[i], assistant_next[i] = min(u, INSERT + a), min(a, INSERT + u)
        start[i] = min(first, user_next[i])
    return [start, array("q", user_next), assistant_next, user_next]


def _moves(i: int, last: int, codes: str) -> list[tuple[str, int, int, int]]:
    """``(initial, cost, next row, what came last)`` in ASCII order."""
    given = AFTER_A if last == AFTER_U else AFTER_U
    moves = []
    fault = role = None
    if i < len(codes):
        fault, role = divmod(ord(codes[i]) - 65, 4)
        moves.append(("D", DELETE, i + 1, last))
    moves.append(("I", INSERT, i, given))
    if fault is not None and fault < BLANK:
        extra = CUT if fault == TRUNCATED else 0
        if (role, given) in ((0, AFTER_U), (1, AFTER_A)):
            moves.append(("K", extra, i + 1, given))
        else:
            if role == 2 and last == START:
                moves.append(("K", extra, i + 1, AFTER_S))
            moves.append(("R", REROLE + extra, i + 1, given))
    return moves


def cheapest_edits(codes: str) -> tuple[int, str]:
    """Least cost and the ASCII-least initials of that cost."""
    n, need = len(codes), needs(codes)
    while True:
        bound = need[START][0]
        path: list[str] = []
        stack = [(0, START, bound, iter(_moves(0, START, codes)))]
        if n == 0:
            return 0, ""
        while stack:
            i, last, left, moves = stack[-1]
            for initial, cost, j, came in moves:
                if cost + need[came][j] > left:
                    continue
                path.append(initial)
                if j == n and came in (START, AFTER_A):
                    return bound - left + cost, "".join(path)
                stack.append((j, came, left - cost, iter(_moves(j, came, codes))))
                break
            else:                                       # failed: it needs more than was left
                least = min(cost + need[came][j] for _, cost, j, came in _moves(i, last, codes))
                need[last][i] = max(need[last][i], least)
                stack.pop()
                if path:
                    path.pop()


def illegal_pairs(codes: str) -> int:
    """Neighbouring rows whose roles are not system-user, user-assistant or assistant-user."""
    roles = [ROLES[(ord(c) - 65) % 4] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def visible(text: Column) -> Column:
    """The text without white space at its end."""
    return F.rtrim(text, F.lit(SPACE))


def turn_rows(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, digest, copy, gone)``; null roles and texts are one space."""
    said = F.coalesce(quoted(text).cast("string"), F.lit(" "))
    return turns.select(
        quoted(key).alias("conv"), quoted(turn).cast("bigint").alias("turn"),
        F.coalesce(quoted(role).cast("string"), F.lit(" ")).alias("role"), said.alias("text"),
        F.sha2(said, 256).alias("digest"), F.lit(0).alias("copy"), F.lit(False).alias("gone"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Turns damaged by a hash of conversation and turn; rows of :func:`turn_rows`, dropped ones marked ``gone``.

    Of 20 classes 0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it,
    4 makes it the user's; the others stay.
    """
    spelled = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    kind = F.crc32(spelled) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.sha2(text, 256).alias("digest"), copies.alias("copy"), (F.col("gone") | (kind == 0)).alias("gone"),
    )


def _in_order(first: str | None = None) -> list[Column]:
    return [*([F.col(first)] if first else []), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def _coded(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation with one code letter each (empty for a dropped row)."""
    narrow = rows.select("conv", "turn", "role", "digest", "copy", "gone", F.right(visible(F.col("text")), F.lit(1)).alias("end"))
    placed = narrow.repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "role", "digest", "gone").orderBy(*_in_order())) > 1
    fault = (F.when(F.col("end") == "", BLANK).when(again, DUPLICATE)
             .when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    letter = F.when(F.col("gone"), "").otherwise(F.chr(F.lit(65) + 4 * fault + role))
    coded = placed.withColumn("code", letter).sortWithinPartitions(F.col("conv"), *_in_order())
    return coded.select("conv", F.when(~F.col("gone"), F.col("turn")).alias("turn"), "code")


AUDITS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, codes string"


def _search(batches: Iterator[pa.RecordBatch], known: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv, begun = None, False
    codes: list[str] = []
    low = high = previous = None
    n_turns = 0

    def close() -> None:
        spelled = "".join(codes)
        found = known.get(spelled)
        if found is None:
            found = (*[sum(spelled.count(code(r, fault)) for r in ROLES) for fault in (BLANK, DUPLICATE, TRUNCATED)],
                     illegal_pairs(spelled), *cheapest_edits(spelled))
            if len(spelled) <= SHORT and len(known) < REMEMBERED:
                known[spelled] = found
        out.append((conv, 0 if low is None else high - low + 1 - n_turns, *found, spelled))

    def flush() -> pa.RecordBatch:
        names = ["conv", *[part.split(" ")[0] for part in AUDITS.split(", ")]]
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for own, turn, letter in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not begun or own != conv:
                if begun:
                    close()
                conv, begun, low, high, previous, n_turns = own, True, None, None, None, 0
                codes.clear()
            if letter:
                codes.append(letter)
            if turn is not None:
                low = turn if low is None else low
                high = turn
                n_turns += turn != previous
                previous = turn
        if len(out) >= 1000:
            yield flush()
    if begun:
        close()
    if out:
        yield flush()


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of :func:`turn_rows`: faults, cost and edits.

    ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, codes``. A row's first fault counts:
    blank (nothing visible), duplicate (role and text seen earlier), truncated (last visible character
    is no sentence end). Rows follow their turn, nulls first, then role and text hash. Conversations
    whose rows are all gone have zeros and no edits; rows with a null key are one conversation. An
    empty table gives none.
    """
    prepare_python(rows.sparkSession)
    coded = _coded(rows)
    kind = coded.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _search(batches, {}, to_arrow_type(kind))

    return coded.mapInArrow(run, f"conv {kind.simpleString()}, {AUDITS}")


def _edited(audit: str, codes: str) -> Iterator[tuple[str, str | None]]:
    """``(edit, role given)`` one by one; a kept row has its own role."""
    last, i = START, 0
    for initial in audit:
        given = AFTER_A if last == AFTER_U else AFTER_U
        name = "assistant" if given == AFTER_A else "user"
        if initial == "K" and (ord(codes[i]) - 65) % 4 == 2:
            given = AFTER_S
        yield initial, name if initial in "IR" else None
        last = last if initial == "D" else given
        i += initial != "I"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv, role, text)`` of the repaired rows in order; ``(conv, None, None)`` first for each conversation.

    Batches hold, sorted by conversation, its edits (``tag`` 0) and then its rows.
    """
    conv, edits, waiting = None, iter(()), None

    def inserted(until_row: bool):
        nonlocal waiting
        for waiting in edits:
            if waiting[0] != "I":
                return
            yield conv, waiting[1], ""
        waiting = None

    for batch in batches:
        for own, tag, role, text, audit, codes in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if tag == 0:
                if waiting is None:
                    yield from inserted(False)
                conv, edits, waiting = own, _edited(audit, codes), None
                yield conv, None, None
                yield from inserted(True)
                continue
            edit, waiting_role = waiting
            if edit != "D":
                yield conv, waiting_role or role, text
            yield from inserted(True)


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Edits and rows of each conversation together, edits first."""
    texts = rows.filter(~F.col("gone")).select(
        "conv", F.lit(1).alias("tag"), "turn", "role", "digest", "copy", "text", F.lit("").alias("audit"), F.lit("").alias("codes"))
    heads = found.select(
        "conv", F.lit(0).alias("tag"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
        F.lit(0).alias("copy"), F.lit("").alias("text"), "audit", "codes")
    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", *_in_order("tag"))
    return both.select("conv", "tag", "role", "text", "audit", "codes")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, position, role, text)`` after the edits ``found`` by :func:`audits` on the same ``rows``."""
    together = _stream(rows, found)
    kind = together.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        position, out = 0, []
        kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string()]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv", "position", "role", "text"])

        for conv, role, text in _repaired(batches):
            if role is None:
                position = 0
                continue
            out.append((conv, position, role, text))
            position += 1
            if len(out) >= 1000:
                yield flush()
        if out:
            yield flush()

    return together.mapInArrow(run, f"conv {kind.simpleString()}, position bigint, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)``: SHA-256 of the repaired ``role:text`` lines, joined by newlines, read as a stream."""
    together = _stream(rows, found)
    kind = together.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        done, conv, digest, first = [], None, None, True
        kinds = [to_arrow_type(kind), pa.string()]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv", "repaired_sha256"])

        for own, role, text in _repaired(batches):
            if role is None:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                    if len(done) >= 1000:
                        yield flush()
                conv, digest, first = own, hashlib.sha256(), True
                continue
            digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
            first = False
        if digest is not None:
            done.append((conv, digest.hexdigest()))
        if done:
            yield flush()

    return together.mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, edits and the digest of the repaired text, one row per conversation."""
    found = stage(audits(rows), "audits")
    digests = repaired_digests(rows, found)
    return found.drop("codes").join(digests.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
