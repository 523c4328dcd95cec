"""Conversation structure repair: the cheapest edits that make turns alternate, found in one sorted stream.

Rows are dealt out by conversation and sorted by turn; one pass over Arrow batches carries, for each of the four states
of the turn automaton, the least cost, the order of the edit texts and a running hash of the repaired rows. Only four
bytes a row are kept to trace the edits back, in a file of the task once a conversation is long, so memory doesn't grow
with a conversation. Copies of earlier rows are marked before, by a sort on their content inside the same partition.

Edits: keep (K) costs 0, rerole to user or assistant (R) 2, delete (D) 3, insert an empty user or assistant row (I) 2; a
blank row or one whose role and text were seen earlier must be deleted; a row that stays and doesn't end a sentence
adds 1. The repaired roles' initials are ``(s?(ua)+)?``. Among equal costs the least text of initials wins.

Defined cases: null role or text counts as one space; null turns come first, equal turns go by role and text in
code-point order; repeated rows are copies; rows without a conversation id form one conversation; an empty table gives
an empty result; other columns are ignored. Texts and conversations may have any length.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import col

#: Bytes of back pointers (four a row) that a conversation holds in memory before they go to a file.
HELD = 4 << 20
#: Back pointers read at a time when edits are traced.
READ = 1 << 20

# White space and the ends of sentences.
WHITE, ENDS = r"[\x20\x09-\x0D]", ".!?"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CUT_SHORT = 1
#: States: nothing yet, after the system row, after a user row, after an assistant row (the first and last are complete).
STATES = 4
FOLLOW = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}
FAR = 1 << 60


def _inserted(state: int) -> str:
    """The role that can be inserted in a state."""
    return "a" if state == 2 else "u"


@lru_cache(maxsize=None)
def _steps(initial: str, must_go: bool, cut_short: bool) -> list[list[tuple]]:
    """For each state after a row: (state before, cost, edits, inserted roles, new role or None, row stays).

    The edits are any inserted rows and then what happens to the row. More than two inserted rows lead where fewer do.
    """
    into: list[list[tuple]] = [[] for _ in range(STATES)]
    for before in range(STATES):
        state, added = before, ""
        for n in range(3):
            paid, edits = n * INSERT, "I" * n
            into[state].append((before, paid + DELETE, edits + "D", added, None, False))
            if not must_go:
                kept = FOLLOW.get((state, initial))
                if kept is not None:
                    into[kept].append((before, paid + KEEP + CUT_SHORT * cut_short, edits + "K", added, None, True))
                role = _inserted(state)
                into[FOLLOW[state, role]].append((before, paid + REROLE + CUT_SHORT * cut_short, edits + "R", added, FULL[role], True))
            role = _inserted(state)
            state, added = FOLLOW[state, role], added + role
    return into


#: Edits of one step, in code-point order; a back pointer is 16 times the state before plus the place here, in a byte.
EDITS = sorted("I" * n + e for n in range(3) for e in "DKR")
CODE = {e: k for k, e in enumerate(EDITS)}


class _Repair:
    """The state of one conversation."""

    def __init__(self) -> None:
        self.cost = [0] + [FAR] * (STATES - 1)
        self.rank = list(range(STATES))  # the order of the edit texts so far; none begins another
        self.hash = [hashlib.sha256() for _ in range(STATES)]
        self.empty = [True] * STATES
        self.trail = bytearray()
        self.file = None
        self.rows = 0

    def _write(self, state_hash, empty: bool, line: bytes):
        if not empty:
            state_hash.update(b"\n")
        state_hash.update(line)

    def add(self, role: str, text: str, must_go: bool, cut_short: bool) -> None:
        best: list[tuple | None] = []
        for choices in _steps(role[:1], must_go, cut_short):
            least = None
            for before, cost, edits, added, new_role, stays in choices:
                if self.cost[before] < FAR:
                    found = (self.cost[before] + cost, self.rank[before], edits, before, added, new_role, stays)
                    if least is None or found[:3] < least[:3]:
                        least = found
            best.append(least)
        order = sorted((b[1:3], s) for s, b in enumerate(best) if b)
        rank = [0] * STATES
        for k, (_, s) in enumerate(order):
            rank[s] = k
        hashes, empty = [], []
        for b in best:
            if b is None:
                hashes.append(hashlib.sha256())
                empty.append(True)
                continue
            one, blank = self.hash[b[3]].copy(), self.empty[b[3]]
            for r in b[4]:
                self._write(one, blank, f"{FULL[r]}:".encode())
                blank = False
            if b[6]:
                self._write(one, blank, f"{b[5] or role}:{text}".encode("utf-8", "surrogatepass"))
                blank = False
            hashes.append(one)
            empty.append(blank)
        self.trail += bytes(b[3] << 4 | CODE[b[2]] if b else 0 for b in best)
        self.cost, self.rank, self.hash, self.empty = [b[0] if b else FAR for b in best], rank, hashes, empty
        self.rows += 1
        if len(self.trail) >= HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.trail)
            self.trail.clear()

    def _pointers(self, start: int, end: int) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(bytes(self.trail), np.uint8).reshape(-1, STATES)[start:end]
        self.file.seek(start * STATES)
        return np.frombuffer(self.file.read((end - start) * STATES), np.uint8).reshape(-1, STATES)

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and hash of the repaired rows."""
        if self.file is not None:
            self.file.write(self.trail)
        ways = []
        for state in range(STATES):
            if self.cost[state] < FAR:
                rest, at = "", state
                while at in (1, 2):
                    rest, at = rest + _inserted(at), FOLLOW[at, _inserted(at)]
                ways.append((self.cost[state] + INSERT * len(rest), self.rank[state], state, rest))
        cost, _, state, rest = min(ways)
        digest = self.hash[state]
        for k, r in enumerate(rest):
            self._write(digest, self.empty[state] and k == 0, f"{FULL[r]}:".encode())
        parts, end = ["I" * len(rest)], self.rows
        while end > 0:
            start = max(0, end - READ)
            block = []
            for row in self._pointers(start, end)[::-1]:
                pointer = int(row[state])
                block.append(EDITS[pointer & 15])
                state = pointer >> 4
            parts.append("".join(reversed(block)))
            end = start
        if self.file is not None:
            self.file.close()
        return cost, "".join(reversed(parts)), digest.hexdigest()


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text with faults that follow from crc32("<conversation>:<turn>") modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 gives it to the user. Nulls
    count as one space.
    """
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = conversations.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"), text_of(col(role_col)).alias("role"),
                                text_of(col(text_col)).alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat(text_of(F.col("conv")), F.lit(":"), text_of(F.col("turn"))).cast("binary")) % 20)
    rows = rows.filter("kind <> 0").withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("_", "kind")


def _ends_well(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(*ENDS)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps`` are turn numbers missing between the least and the greatest; ``blank``, ``duplicate`` and ``truncated`` count
    rows by their first fault; ``illegal`` counts neighbours whose initials are none of su, ua, au.
    """
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    source = rows.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"), text_of(col(role_col)).alias("role"),
                         text_of(col(text_col)).alias("text"))
    key = Window.partitionBy("conv", "role", "seal").orderBy("turn")
    sealed = source.withColumn("seal", F.sha2("text", 256)).repartition("conv").withColumn("copy", F.row_number().over(key) > 1)
    blank = ~F.col("text").rlike(f"[^{WHITE[1:-1]}]")
    faults = sealed.withColumn("fault", F.when(blank, 1).when(F.col("copy"), 2)
                               .when(~_ends_well(F.col("text")), 3).otherwise(0))
    ordered = faults.sortWithinPartitions("conv", "turn", "role", "text", "copy")
    # pandas would make floats of integers with gaps
    plain = ordered.select(F.col("conv").cast("string").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                           F.col("turn").isNotNull().alias("numbered"), "role", "text", "fault")
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        conv, one = None, None

        def close() -> None:
            low, high, distinct = turns
            gaps = high - low + 1 - distinct if distinct else 0
            out.append((conv, gaps, *counts[1:], illegal, *one.end()))

        for batch in batches:
            for c, turn, numbered, role, text, fault in zip(*(batch[k].tolist() for k in batch.columns)):
                if one is None or c != conv:
                    if one is not None:
                        close()
                    conv, one, counts, illegal, last, turns = c, _Repair(), [0] * 4, 0, None, (0, 0, 0)
                counts[fault] += 1
                illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
                last = role[:1]
                if numbered and (not turns[2] or turn != turns[1]):
                    turns = (turns[0] if turns[2] else turn, turn, turns[2] + 1)
                one.add(role, text, fault in (1, 2), fault == 3)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if one is not None:
            close()
            yield pd.DataFrame(out, columns=names)

    schema = "conv string, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string"
    return plain.mapInPandas(run, schema).withColumn("conv", F.col("conv").cast(source.schema["conv"].dataType))
