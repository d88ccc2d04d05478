"""Conversation structure repair: the cheapest edits that make the turns read system?, then user and assistant in turn.

A conversation is a walk through a graph without cycles: rows in order, times the state of the role pattern.  Every walk has one
whole number as its weight.  The high digits are its cost.  The low digits are its audit: each row has three digits of its own
(at most two insertions and the row's edit), each letter a digit in ASCII order, zeros at the end.  The letters before a row's
own edit are insertions only, so no row's letters begin another choice of its letters, and comparing weights compares audits as
strings.  Edges add to the weight, the least weight wins: nothing but additions and minima of whole numbers decides.

Long conversations are cut into segments.  At a cut the audits so far are replaced by their rank among the live states (one
digit), so weights stay short; what is held of the earlier rows is one letter per edit and one running digest a state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.setup import ready

#: Cost of each edit, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Digits of the letters; a digit has three bits.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {n: c for c, n in DIGIT.items()}
BITS, GROUP = 3, 9
#: Rows of a conversation whose letters one weight holds.
SEGMENT = 256

#: The pattern (s?(ua)+)? as states: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLE = {"u": "user", "a": "assistant"}
END = (EMPTY, ASSISTANT)
LEGAL = {"su", "ua", "au"}

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string, repaired array<struct<role: string, text: string>>")
KIND = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                  ("audit", pa.string()), ("repaired_sha256", pa.string()),
                  ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def _code(letters: str) -> int:
    """The three digits of a row's letters."""
    return sum(DIGIT[c] << (GROUP - BITS * (i + 1)) for i, c in enumerate(letters))


def _letters(code: int) -> str:
    return "".join(LETTER[d] for i in (2, 1, 0) if (d := code >> (BITS * i) & 7))


def _inserted(state: int) -> Iterator[tuple[int, str]]:
    """(state, letters) after no, one or two insertions; a third one would only repeat the pattern at more cost."""
    for n in range(3):
        yield state, "I" * n
        state = MOVES[state, WANTED[state]]


def _edges(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(state, next state, cost, digits) of a row by its role's initial and its fault: the best for each pair of states."""
    best = {}
    for state in range(4):
        for at, letters in _inserted(state):
            fee, stays = INSERT * len(letters), TRUNCATED * (fault == "truncated")
            options = [(at, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                options.append((MOVES[at, WANTED[at]], REROLE + stays, "R"))
                if (at, initial) in MOVES:
                    options.append((MOVES[at, initial], stays, "K"))
            for to, cost, letter in options:
                choice = (fee + cost, _code(letters + letter))
                best[state, to] = min(best.get((state, to), choice), choice)
    return [(a, b, *choice) for (a, b), choice in best.items()]


EDGES = {(c, fault): _edges(c, fault) for c in "sua-" for fault in ("", "blank", "duplicate", "truncated")}
CLOSING = {state: next((INSERT * len(x), _code(x)) for at, x in _inserted(state) if at in END) for state in range(4)}


class Repair:
    """One conversation: rows go in in order, `finish` gives the outcome."""

    def __init__(self, texts: bool):
        self.texts = texts
        self.rows: list[tuple[str, str, str]] = []
        #: state -> (cost, rank, letters so far as (earlier, part), digest, number of turns, turns)
        self.live = {EMPTY: (0, 0, None, hashlib.sha256(), 0, [])}

    def add(self, role: str, text: str, fault: str) -> None:
        if len(self.rows) == SEGMENT:
            self._cut()
        self.rows.append((role, text, fault))

    def _weights(self) -> tuple[dict[int, int], int]:
        """Least weight of every state after the rows held, and the bits below the cost."""
        low = GROUP * len(self.rows)
        bits = low + BITS
        weight = {state: cost << bits | rank << low for state, (cost, rank, *_) in self.live.items()}
        at = low
        for role, _, fault in self.rows:
            at -= GROUP
            after: dict[int, int] = {}
            for state, to, cost, code in EDGES[role[:1] if role[:1] in tuple("sua") else "-", fault]:
                if state in weight:
                    total = weight[state] + (cost << bits) + (code << at)
                    if to not in after or total < after[to]:
                        after[to] = total
            weight = after
        return weight, bits

    def _follow(self, weight: int, bits: int, closing: int = 0) -> tuple:
        """(cost, rank, letters, digest, turns, texts) of the walk that a weight stands for."""
        low = bits - BITS
        origin = next(s for s, kept in self.live.items() if kept[1] == weight >> low & 7)
        _, _, earlier, digest, count, turns = self.live[origin]
        digest, turns, state, part = digest.copy(), list(turns), origin, []

        def say(role: str, text: str) -> None:
            nonlocal count
            digest.update(("\n" if count else "").encode() + f"{role}:{text}".encode())
            count += 1
            if self.texts:
                turns.append({"role": role, "text": text})

        for i, (role, text, _) in enumerate([*self.rows, ("", "", "")]):
            letters = _letters(weight >> (low - GROUP * (i + 1)) & 511) if i < len(self.rows) else _letters(closing)
            part.append(letters)
            for letter in letters:
                if letter == "D":
                    continue
                initial = role[:1] if letter == "K" else WANTED[state]
                say(role if letter == "K" else ROLE[initial], "" if letter == "I" else text)
                state = MOVES[state, initial]
        return weight >> bits, 0, (earlier, "".join(part)), digest, count, turns

    def _cut(self) -> None:
        weights, bits = self._weights()
        low = (1 << bits) - 1
        order = sorted(weights, key=lambda s: weights[s] & low)
        self.live = {s: (kept[0], order.index(s), *kept[2:]) for s in order for kept in [self._follow(weights[s], bits)]}
        self.rows = []

    def finish(self) -> tuple[int, str, str, list[dict]]:
        """(cost, audit, digest, turns)."""
        weights, bits = self._weights()
        last = {s: (w << GROUP) + (CLOSING[s][0] << (bits + GROUP)) + CLOSING[s][1] for s, w in weights.items()}
        state = min(last, key=last.__getitem__)
        _, _, letters, digest, _, turns = self._follow(weights[state], bits, CLOSING[state][1])
        parts = []
        while letters is not None:
            letters, part = letters
            parts.append(part)
        return last[state] >> (bits + GROUP), "".join(reversed(parts)), digest.hexdigest(), turns


def fault(text: str, again: bool) -> str:
    """A row's first fault, or ''."""
    said = text.rstrip(BLANKS)
    return "blank" if not said else "duplicate" if again else "" if said[-1] in ".!?" else "truncated"


class Conversation:
    """Counts and repair of one conversation, fed row by row."""

    def __init__(self, conv: int | None, texts: bool):
        self.conv, self.texts = conv, texts
        self.repair, self.counts = Repair(texts), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.turn = self.initial = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and (self.turn is None or turn != self.turn):
            self.first, self.turn, self.distinct = (turn if self.first is None else self.first), turn, self.distinct + 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        found = fault(text, again)
        if found:
            self.counts[found] += 1
        self.repair.add(role, text, found)

    def row(self) -> dict:
        cost, audit, digest, turns = self.repair.finish()
        gaps = self.turn - self.first + 1 - self.distinct if self.distinct else 0
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost, "audit": audit,
                "repaired_sha256": digest, "repaired": turns if self.texts else None}


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           gone: str | None = None, texts: bool = True) -> DataFrame:
    """One row a conversation: faults, and the cheapest edits (see the module); `repaired` are its turns after them.

    Rows go by turn, nulls first, then by role and text.  A row's first fault counts: blank, duplicate (role and text of an
    earlier row), truncated (the last character that is no blank is not one of .!?).  Edits: Keep (0), Rerole to user or assistant
    (3), Delete (4; the only edit of blank and duplicate rows), Insert an empty user or assistant turn anywhere (3); truncated
    rows that stay add 3.  Among the cheapest audits the ASCII-least one is taken.  A null role or text is one space; a null
    conversation is one of its own; repeated rows are duplicates.  Rows with a true `gone` only name their conversation: one
    without other rows has zeros, an empty audit and no turns.  Other columns are ignored; no rows give no rows.

    One shuffle, by conversation: a conversation is one audit and one digest of its text, so its rows pass one task, in order, row
    by row (Spark sorts them and spills).  With `texts` False the turns are not held, only the audit.
    """
    ready(rows.sparkSession)
    used = rows.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), (F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")) > 1
    ordered = used.repartition("conv_id").withColumn("again", again).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            for conv, at, who, said, absent, seen in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if current is None or conv != current.conv:
                    if current is not None:
                        done.append(current.row())
                    current = Conversation(conv, texts)
                if not absent:
                    current.add(at, who, said, seen)
            if len(done) >= 1000 or texts and done:
                yield pa.RecordBatch.from_pylist(done, KIND)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([*done, current.row()], KIND)

    return ordered.select("conv_id", "turn", "role", "text", "gone", "again").mapInArrow(run, SCHEMA)


def turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations as rows, turns from 0."""
    return repaired.select("conv_id", F.posexplode("repaired").alias("turn", "row")).select("conv_id", F.col("turn").cast("long"), "row.role", "row.text")


def draw(conv: Column, turn: Column) -> Column:
    """0 to 19, by the CRC-32 of `conv:turn`."""
    named = F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.pmod(F.crc32(named.cast("binary")), F.lit(20))


def damage(rows: DataFrame) -> DataFrame:
    """`conversations` with made faults: (conv_id, turn, role, text, gone); dropped rows stay as `gone`."""
    hit, text = draw(F.col("conv_id"), F.col("turn")), F.coalesce("text", F.lit(" "))
    hurt = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), hit.alias("hit"))
    made = made.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("hit") == 0).alias("gone"),
                       F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return made.drop("copy")
