"""Conversation repair by cheapest edits, with costs shared between all conversations over their common endings.

Rows. ``damaged`` spoils rows by a checksum of their place. Every row has a signature: the initial of its role (s, u, a, or
another) and its fault (none, to be deleted, truncated). Edits make the roles spell ``(s?(ua)+)?``: keep 0, rerole to user or
assistant 2, delete 3 (blank and duplicate rows must go), insert an empty user or assistant 2, and 1 for each truncated row
that stays. Of the cheapest the one whose initials (D, I, K, R) come first in ASCII is taken.

Method. The signatures of a conversation are a word, and what a repair costs from a row on depends on the word's ending only.
All distinct words, sorted from their ends, are walked as a trie of endings: each node (a distinct ending: the state of
the minimised automaton that has just these rows left) is computed once per grammar state, from the node of the ending one
row shorter, and holds the cost and the first edit of the best audit for each way out. Range partitions split the trie, so
only the nodes on the path to a partition's first word are computed twice.

Long conversations. Rows are range-partitioned by conversation, turn and the rest of the sort key and cut into pieces of
``PIECE`` rows or ``BYTES`` bytes, so no conversation is gathered. A word covers one piece; its nodes hold costs from each
grammar state to each one. Pieces are joined from the last to the first by the cost of each state (four numbers are carried), then
read from the first on. Only the digest of a whole conversation passes through one task, as a stream of pieces.

Defined results: null role and text are one space; a null turn counts as one space in the checksum, sorts first and has no
part in gaps; rows of the same turn are sorted by role, the text's first 64 characters and its digest; a null conv_id is a conversation. Empty texts are blank. Texts of
any length are one row. Repeated rows of a conversation are duplicates. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

PIECE = 512
BYTES = 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after the one role that rerole and insert can give
ROLE = ("user", "user", "assistant", "user")
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
NEVER = 1 << 40
CODES = "suao"  # signature: initial x fault, as letters from "A" on
NONE, GONE, CUT = range(3)


# --- rows -------------------------------------------------------------------------------
def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped) after damage; a dropped row stays as a mark without role and text."""
    space = F.lit(" ")
    said = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"))
    name = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    said = said.withColumn("fate", F.pmod(F.crc32(F.encode(name, "utf-8")), F.lit(20)))
    spoilt = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    said = said.select("conv", "turn", F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("fate") == 0, "").otherwise(spoilt).alias("text"), (F.col("fate") == 0).alias("dropped"), "fate")
    return said.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows in order of their conversations over range partitions; before a row that is no longer the first of its kind stands a mark."""
    keyed = rows.withColumns({"kind": F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")), "lead": F.substring("text", 1, 64), "row": F.monotonically_increasing_id()})
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "row")
    first = keyed.where("not dropped").groupBy("conv", "kind").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    narrow = keyed.where("not dropped").select("conv", "turn", "role", "lead", "kind", "row")
    late = narrow.alias("x").join(first.alias("f"), F.expr("x.conv <=> f.conv and x.kind = f.kind and x.row != f.first.row"))
    marks = late.select("x.*", F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark"), F.lit(False).alias("dropped"))
    key = ["conv", "turn", "role", "lead", "kind", "row"]
    both = keyed.withColumn("mark", F.lit(False)).unionByName(marks)
    return both.repartitionByRange(*key).sortWithinPartitions(*[F.col(k) for k in key], F.col("mark").desc())


PIECES = ("conv string, piece long, word string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, "
          "low long, high long, turns long, first string, last string")


def _initial(role: str) -> str:
    return role[:1]


def _blank(text: str) -> bool:
    return not text.strip(" \t\n\v\f\r")


def _truncated(text: str) -> bool:
    return text.rstrip(" \t\n\v\f\r")[-1:] not in (".", "!", "?")


class _Piece:
    def __init__(self, conv):
        self.conv, self.rows, self.size = conv, [], 0

    def row(self, number: int) -> dict:
        word, kinds, previous, illegal = [], [0, 0, 0], None, 0
        for role, text, turn, again in self.rows:
            blank, cut = _blank(text), _truncated(text)
            if blank or again:
                kinds[0 if blank else 1] += 1
            elif cut:
                kinds[2] += 1
            fault = GONE if blank or again else CUT if cut else NONE
            letter = _initial(role) if _initial(role) in ("s", "u", "a") else "o"
            word.append(chr(65 + 3 * CODES.index(letter) + fault))
            illegal += previous is not None and previous + _initial(role) not in ("su", "ua", "au")
            previous = _initial(role)
        turns = [int(t) for _, _, t, _ in self.rows if t is not None]
        return {"conv": self.conv, "piece": number, "word": "".join(word), "roles": [r[0] for r in self.rows], "texts": [r[1] for r in self.rows],
                "blank": kinds[0], "duplicate": kinds[1], "truncated": kinds[2], "illegal": illegal,
                "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
                "first": _initial(self.rows[0][0]) if self.rows else None, "last": previous}


def _cut(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    number, piece, again, out, held = TaskContext.get().partitionId() << 33, None, False, [], 0

    def done():
        nonlocal number, held
        out.append(piece.row(number))
        number, held = number + 1, held + piece.size

    for batch in batches:
        convs, turns = batch["conv"].tolist(), batch["turn"].tolist()
        for conv, turn, role, text, mark, dropped in zip(convs, turns, batch["role"], batch["text"], batch["mark"], batch["dropped"]):
            if piece is None or piece.conv != conv or len(piece.rows) >= size or piece.size > BYTES:
                if piece is not None:
                    done()
                piece = _Piece(conv)
            if mark:
                again = True
            elif not dropped:
                piece.rows.append((role, text, turn, again))
                piece.size += len(text)
                again = False
            if held > BYTES:
                yield _frame(out)
                out, held = [], 0
    if piece is not None:
        done()
    if out:
        yield _frame(out)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    for name in ("low", "high"):
        frame[name] = frame[name].astype("Int64")
    return frame


def pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """One row per piece of a conversation, in order of ``piece``."""
    ordered = _sorted_rows(rows).select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("long").cast("string").alias("turn"), "role", "text", "mark", "dropped")
    return ordered.mapInPandas(lambda batches: _cut(batches, size), PIECES)


# --- the automaton ----------------------------------------------------------------------
class Node:
    """One ending. For each grammar state and each way out: the cheapest cost and the first edit of the best audit."""

    __slots__ = ("cost", "edit")

    def __init__(self, cost: list[list[int]], edit: list[list[str]]):
        self.cost, self.edit = cost, edit


@functools.lru_cache(maxsize=2)
def end_node(last: bool) -> Node:
    """No rows left. At the end of a conversation rows may be inserted; pieces before leave that to the piece behind."""
    cost = [[0 if s == t else NEVER for t in range(4)] for s in range(4)]
    edit = [["" for _ in range(4)] for _ in range(4)]
    if last:
        _insert(cost, edit)
    return Node(cost, edit)


def _insert(cost: list[list[int]], edit: list[list[str]]) -> None:
    plain = [c[:] for c in cost], [e[:] for e in edit]
    for s in (USER, ASSISTANT):  # from where one insert leads to the other: never both
        for t in range(4):
            _offer(cost, edit, s, t, "I", 2 + plain[0][NEXT[s]][t])
    for s in (START, SYSTEM):
        for t in range(4):
            _offer(cost, edit, s, t, "I", 2 + cost[NEXT[s]][t])


def _offer(cost, edit, s, t, letter, price):
    if price < NEVER and (price < cost[s][t] or (price == cost[s][t] and letter < edit[s][t])):
        cost[s][t], edit[s][t] = price, letter


def node_before(code: str, after: Node) -> Node:
    """The node of the ending that has one more row, of signature ``code``, in front."""
    initial, fault = CODES[(ord(code) - 65) // 3], (ord(code) - 65) % 3
    stays = fault == CUT
    cost, edit = [[NEVER] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for s in range(4):
        for t in range(4):
            _offer(cost, edit, s, t, "D", 3 + after.cost[s][t])
            if fault != GONE:
                if (s, initial) in KEEP:
                    _offer(cost, edit, s, t, "K", stays + after.cost[KEEP[s, initial]][t])
                _offer(cost, edit, s, t, "R", 2 + stays + after.cost[NEXT[s]][t])
    _insert(cost, edit)
    return Node(cost, edit)


def audit_of(word: str, nodes: list[Node], s: int, t: int) -> str:
    """The best audit from state s to t; ``nodes[i]`` is the node of the ending of i rows."""
    out, left = [], len(word)
    while True:
        letter = nodes[left].edit[s][t]
        if not letter:
            return "".join(out)
        out.append(letter)
        if letter == "I":
            s = NEXT[s]
            continue
        if letter == "K":
            s = KEEP[s, CODES[(ord(word[len(word) - left]) - 65) // 3]]
        elif letter == "R":
            s = NEXT[s]
        left -= 1


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words sorted from their ends: the nodes of the path are kept, and only what the next word does not share is computed."""
    paths = {last: ([end_node(last)], "") for last in (False, True)}
    for batch in batches:
        out = []
        for ending, last in zip(batch["ending"], batch["last"]):
            nodes, before = paths[last]
            shared = 0
            for x, y in zip(before, ending):
                if x != y:
                    break
                shared += 1
            del nodes[shared + 1 :]
            for code in ending[shared:]:
                nodes.append(node_before(code, nodes[-1]))
            paths[last] = nodes, ending
            word, top = ending[::-1], nodes[-1]
            costs = [c for row in top.cost for c in row]
            audits = [audit_of(word, nodes, s, t) if top.cost[s][t] < NEVER else None for s in range(4) for t in range(4)]
            out.append({"word": word, "last": last, "costs": costs, "audits": audits})
            if len(out) >= 256:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)


def automaton(words: DataFrame) -> DataFrame:
    """(word, last, costs, audits) of distinct (word, last): costs and audits from state s to t at 4 s + t."""
    endings = words.distinct().select(F.reverse("word").alias("ending"), "last")
    return endings.repartitionByRange("last", "ending").sortWithinPartitions("last", "ending").mapInPandas(
        _walk, "word string, last boolean, costs array<long>, audits array<string>")


# --- conversations ----------------------------------------------------------------------
def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of each conversation from the last on: for each state the best way out and the cost from there to the end."""
    ahead = [NEVER] * 4
    for batch in batches:
        out = []
        for piece, last, costs, audits in zip(batch["piece"], batch["last"], batch["costs"], batch["audits"]):
            if last:
                ahead = [0 if t in FINAL else NEVER for t in range(4)]
            ways = [min(((int(costs[4 * s + t]) + ahead[t], audits[4 * s + t], t) for t in range(4) if costs[4 * s + t] + ahead[t] < NEVER), default=None) for s in range(4)]
            ahead = [w[0] if w else NEVER for w in ways]
            out.append({"piece": piece, "costs": ahead, "audits": [w[1] if w else None for w in ways], "outs": [w[2] if w else -1 for w in ways]})
        if out:
            yield pd.DataFrame(out)


REPAIRED = ("conv string, piece long, cost long, audit string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, "
            "illegal long, low long, high long, turns long, first string, last string")


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order: the audit from the state that the piece before has left, and the repaired rows."""
    conv, state = object(), START
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if conv != r.conv:
                conv, state = r.conv, START
            audit, roles, texts, at, now = r.audits[state], [], [], 0, state
            for letter in audit:
                if letter == "I" or letter == "R":
                    roles.append(ROLE[now])
                    texts.append(r.texts[at] if letter == "R" else "")
                    now = NEXT[now]
                elif letter == "K":
                    roles.append(r.roles[at])
                    texts.append(r.texts[at])
                    now = KEEP[now, _initial(r.roles[at])]
                at += letter != "I"
            row = {n: getattr(r, n) for n in ("conv", "piece", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "first", "last")}
            out.append(row | {"cost": r.costs[state], "audit": audit, "roles": roles, "texts": texts})
            state = r.outs[state]
        if out:
            yield _frame(out)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation from its pieces in order."""
    now, out = None, []

    def done() -> dict:
        known = now["low"] is not None
        return {"conv": now["conv"], "gaps": now["high"] - now["low"] + 1 - now["turns"] if known else 0, **{k: now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")},
                "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

    for batch in batches:
        for r in batch.itertuples(index=False):
            if now is None or now["conv"] != r.conv:
                if now is not None:
                    out.append(done())
                now = {"conv": r.conv, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": int(r.cost),
                       "audit": [], "sha": hashlib.sha256(), "any": False, "role": None}
            for k in ("blank", "duplicate", "truncated", "illegal"):
                now[k] += int(getattr(r, k))
            if r.first is not None:
                now["illegal"] += now["role"] is not None and now["role"] + r.first not in ("su", "ua", "au")
                now["role"] = r.last
            if not pd.isna(r.low):
                now["turns"] += int(r.turns) - (now["high"] == int(r.low))
                now["low"] = int(r.low) if now["low"] is None else now["low"]
                now["high"] = int(r.high)
            now["audit"].append(r.audit)
            for role, text in zip(r.roles, r.texts):
                now["sha"].update((("\n" if now["any"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                now["any"] = True
        if len(out) >= 1024:
            yield pd.DataFrame(out)
            out = []
    if now is not None:
        out.append(done())
    if out:
        yield pd.DataFrame(out)


def _solved(conversations: DataFrame, conv: str, turn: str, role: str, text: str, size: int) -> DataFrame:
    """Pieces with their ways for each state at their beginning, each conversation in one task in order of its pieces."""
    cut = cut_lineage(pieces(damaged(conversations, conv, turn, role, text), size))
    ends = cut.groupBy("conv").agg(F.max("piece").alias("piece")).select("piece", F.lit(True).alias("end"))
    narrow = cut.select("conv", "piece", "word").join(ends, "piece", "left")
    narrow = cut_lineage(narrow.select("conv", "piece", "word", F.coalesce("end", F.lit(False)).alias("last")))
    solved = narrow.join(automaton(narrow.select("word", "last")), ["word", "last"])
    solved = solved.repartition("conv").sortWithinPartitions("conv", F.col("piece").desc()).select("piece", "last", "costs", "audits")
    ways = solved.mapInPandas(_carry, "piece long, costs array<long>, audits array<string>, outs array<int>")
    return cut.drop("word").join(ways, "piece").repartition("conv").sortWithinPartitions("conv", "piece")


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PIECE) -> DataFrame:
    """Repaired conversations in pieces (conv as string): cost from here to the end, audit, roles and texts, counts of faults."""
    return _solved(conversations, conv, turn, role, text, size).mapInPandas(_resolve, REPAIRED)


def report(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PIECE) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and the digest of the repaired rows."""
    rows = _solved(conversations, conv, turn, role, text, size).mapInPandas(
        lambda batches: _digests(_resolve(batches)),
        "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return rows.select(F.col("conv").cast(conversations.schema[conv].dataType).alias(conv), *rows.columns[1:])
