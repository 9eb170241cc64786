"""Operator 13: conversations repaired by the cheapest edits.

A conversation is legal when the first letters of its roles read
``(s?(ua)+)?``. Rows are followed in order of turn; each is kept (0), given
the role user or assistant (3) or deleted (4), and a turn without text may be
inserted anywhere (3). Blank and repeated rows must be deleted; a truncated row
that stays adds 3. The edits of least total cost are taken, and of several such
edit strings (initials D, I, K, R) the one that is least in ASCII.

The search is iterative-deepening A*: depth first in ASCII order under a cost
bound that grows to the least cost seen beyond it, so the first string that ends
in an accepting state is the answer. States are (row, what the roles so far end
in); the transposition table keeps for every failed state the least budget that
may still succeed, which starts as the cost no path from there can avoid.

Scale: rows are dealt by range over (conversation, turn, role, text), written
once with their position, and cut into blocks of at most ``BLOCK_ROWS`` rows; a
conversation of any length is spread over many tasks. Only one code per row
(first letter, fault) takes part in the search. A block of a longer conversation
is searched for every pair of states before and after it; a path consumes
exactly its rows, so no string is a prefix of another, and the best strings of
the blocks, chosen from the last to the first, make the best string of the
whole. ``digests`` follows a conversation in order with a running hash, for
SHA-256 has no parallel form; its audit is one string by contract.

Defined cases: null role or text counts as one space; an empty role has no first
letter, so such a row cannot be kept; rows are ordered by (turn, role, text),
nulls first, which settles ties; repeated rows are repeated turns; rows without
conversation id are one conversation with a null id; a conversation without rows
is legal; very long texts are read in the JVM for their faults and travel only
to be returned; an empty table gives an empty table; other columns are ignored,
whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, shuffle_partitions

BLOCK_ROWS = 512
# Fixed values of the task: costs, blanks, ends of sentences.
DELETE, INSERT, REROLE, TRUNCATED_STAYS = 4, 3, 3, 3
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")

# What the roles so far end in.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
SUCCESSOR = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)        # state after the next role that may be inserted
ROLE_OF = {AFTER_U: "user", AFTER_A: "assistant"}
# Closing a conversation that ends in a state: cost and inserted turns.
CLOSING = (0, 2 * INSERT, INSERT, 0)
CLOSING_EDITS = ("", "II", "I", "")
NEVER = 1 << 60

# A row's code is LETTERS.index(first letter) + 4 * fault.
LETTERS = "suax"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = (None, "blank", "duplicate", "truncated")


def search(codes: Sequence[int], entry: int, closing: Sequence[int]) -> tuple[int, str, int]:
    """(cost, edits, exit state) of the best way through the rows from the state
    ``entry``, when leaving in state t costs ``closing[t]`` more (``NEVER``: not
    allowed). Some way must exist."""
    n = len(codes)
    least = [0] * (n + 1)
    least[n] = min(closing)
    for i in range(n - 1, -1, -1):
        fault = codes[i] >> 2
        least[i] = least[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else TRUNCATED_STAYS if fault == TRUNCATED else 0)
    need = [x for x in least for _ in range(4)]
    need[4 * n:] = closing

    def edits(node: int) -> list[tuple[str, int, int]]:
        i, state = node >> 2, node & 3
        if i == n:
            return []
        letter, fault = LETTERS[codes[i] & 3], codes[i] >> 2
        turned = SUCCESSOR[state]
        out = [("D", DELETE, node + 4), ("I", INSERT, 4 * i + turned)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED_STAYS if fault == TRUNCATED else 0
            if letter == ROLE_OF[turned][0]:
                out.append(("K", more, 4 * (i + 1) + turned))
            elif letter == "s" and state == START:
                out.append(("K", more, 4 * (i + 1) + AFTER_S))
            out.append(("R", REROLE + more, 4 * (i + 1) + turned))
        return out

    while True:
        bound = need[entry]
        path: list[list] = [[entry, bound, edits(entry), 0, NEVER, ""]]      # node, budget, edits, next one, least need, edit taken
        while path:
            top = path[-1]
            node, budget, ways, k, low, _ = top
            if node >> 2 == n:
                return bound, "".join(p[5] for p in path[:-1]), node & 3
            if k == len(ways):
                need[node] = max(need[node], low)
                path.pop()
                if path:
                    up = path[-1]
                    cost = up[2][up[3] - 1][1]
                    up[4] = min(up[4], cost + need[node])
                continue
            edit, cost, child = ways[k]
            top[3] = k + 1
            if need[child] > budget - cost:
                top[4] = min(low, cost + need[child])
                continue
            top[5] = edit
            path.append([child, budget - cost, edits(child), 0, NEVER, ""])


def crossings(codes: Sequence[int], first: bool = False, last: bool = False) -> Iterator[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of every pair of states that some
    way through the rows joins. The first block of a conversation begins in the
    start state; the last one needs only the way that is best with its close."""
    system = any(LETTERS[c & 3] == "s" and c >> 2 in (SOUND, TRUNCATED) for c in codes)
    for before in (START,) if first else range(4):
        if last:
            cost, path, after = search(codes, before, CLOSING)
            yield before, after, cost - CLOSING[after], path
            continue
        for after in range(4):
            if after in (AFTER_U, AFTER_A) or before == after or (before == START and after == AFTER_S and system):
                cost, path, _ = search(codes, before, [0 if t == after else NEVER for t in range(4)])
                yield before, after, cost, path


def best_edits(blocks: Sequence[Sequence[tuple[int, int, int, str]]]) -> list[str]:
    """Edits of every block of a conversation, given the crossings of its blocks in order."""
    closing: Sequence[int] = CLOSING
    chosen = []
    for ways in reversed(blocks):
        best = [(NEVER, "", START)] * 4
        for before, after, cost, path in ways:
            best[before] = min(best[before], (cost + closing[after], path, after))
        chosen.append(best)
        closing = [b[0] for b in best]
    out, state = [], START
    for best in reversed(chosen):
        out.append(best[state][1])
        state = best[state][2]
    if out:
        out[-1] += CLOSING_EDITS[state]
    return out


def _placed(df: DataFrame, conv: str, turn: str, role: str, text: str, st: Stages) -> DataFrame:
    """Rows in order with their position ``pos`` (rising along a conversation), code of letter and own fault, written once."""
    space = F.lit(" ")
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role).cast("string"), space).alias("role"),
                     F.coalesce(F.col(text).cast("string"), space).alias("text"),
                     F.monotonically_increasing_id().alias("tie"))          # equal rows may lie in several ranges
    order = ["conv_id", "turn", "role", "text", "tie"]
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    told = F.rtrim(F.col("text"), F.lit(BLANKS))
    letter = F.substring("role", 1, 1)
    number = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    fault = (F.when(told == "", BLANK).when(~F.right(told, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(SOUND))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return st.write(dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"),
                                 number.alias("letter"), fault.alias("fault"), same.alias("same")), "turns")


def _block() -> Column:
    return F.expr(f"pos div {BLOCK_ROWS}")


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, codes): the codes of every block in order, repeated rows marked."""
    firsts = rows.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    known = rows.select("conv_id", "pos", "letter", "fault").join(firsts, "pos", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    code = (F.col("letter") + 4 * fault).cast("int")
    gathered = known.groupBy("conv_id", _block().alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", code.alias("code")))).alias("c"))
    return gathered.select("conv_id", "block", F.col("c.code").alias("codes"))


def _searched(blocks: DataFrame) -> DataFrame:
    """Blocks with their crossings."""
    ends = blocks.groupBy(F.col("conv_id").alias("of")).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    # the work of a block is not in proportion to its bytes, so the number of tasks is given
    dealt = (blocks.join(ends, blocks["conv_id"].eqNullSafe(ends["of"]))
             .select("conv_id", "block", "codes", (F.col("block") == F.col("lo")).alias("first"), (F.col("block") == F.col("hi")).alias("last"))
             .repartition(shuffle_partitions(blocks.sparkSession), "conv_id", "block"))
    way = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("codes", pa.list_(pa.int32())), ("ways", pa.list_(way))])

    def run(batches):
        for b in batches:
            found = [[dict(zip(("before", "after", "cost", "edits"), x)) for x in crossings(*c)] for c in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(way))], schema=schema)

    return dealt.mapInArrow(run, "conv_id long, block long, codes array<int>, ways array<struct<before:int,after:int,cost:bigint,edits:string>>")


def _chosen(searched: DataFrame) -> DataFrame:
    """(conv_id, block, codes, edits): the edits of the best way through every conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("codes", pa.list_(pa.int32())), ("edits", pa.string())])

    def run(batches):
        key, held = None, []

        def result():
            paths = best_edits([[(w["before"], w["after"], w["cost"], w["edits"]) for w in ways] for _, _, ways in held])
            return pa.RecordBatch.from_arrays([pa.array([key] * len(held), pa.int64()), pa.array([x[0] for x in held], pa.int64()),
                                               pa.array([x[1] for x in held], pa.list_(pa.int32())), pa.array(paths, pa.string())], schema=schema)
        for b in batches:
            for conv, block, codes, ways in zip(*(c.to_pylist() for c in b.columns)):
                if held and conv != key:
                    yield result()
                    held = []
                key = conv
                held.append((block, codes, ways))
        if held:
            yield result()

    return (searched.repartition("conv_id").sortWithinPartitions("conv_id", "block")
            .mapInArrow(run, "conv_id long, block long, codes array<int>, edits string"))


EDITS = "conv_id long, edit string, fault string, old_role string, role string, text string"


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of every conversation, one row each, a conversation's rows
    adjacent and in order: edit (D, I, K or R), fault of the row (null, blank,
    duplicate, truncated), its role before (null for inserted turns) and the role
    and text it has now. The repaired conversation is its rows but those of D."""
    st = Stages(df.sparkSession)
    rows = _placed(df, conv, turn, role, text, st)
    blocks = st.write(_blocks(rows), "turn_codes")
    chosen = st.write(_chosen(_searched(blocks)), "edits")
    st.drop(blocks)
    none = F.lit(None)
    both = (rows.select("conv_id", _block().alias("block"), "pos", "role", "text", none.cast("array<int>").alias("codes"), none.cast("string").alias("edits"))
            .unionByName(chosen.select("conv_id", "block", F.lit(-1).cast("long").alias("pos"), none.cast("string").alias("role"),
                                       none.cast("string").alias("text"), "codes", "edits")))
    names = [c.split()[0] for c in EDITS.split(", ")]

    def run(batches):
        begun, key, codes, edits, i, k, state = False, None, [], "", 0, 0, START
        for b in batches:
            out: list[tuple] = []
            for conv_id, pos, role_, text_, new_codes, new_edits in zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 4, 5, 6))):
                if pos < 0:                         # a block begins
                    if not begun or conv_id != key:
                        begun, key, state = True, conv_id, START
                    codes, edits, i, k = new_codes, new_edits, 0, 0
                    continue
                while edits[k] == "I":
                    state = SUCCESSOR[state]
                    out.append((conv_id, "I", None, None, ROLE_OF[state], ""))
                    k += 1
                edit, fault = edits[k], FAULTS[codes[i] >> 2]
                k, i = k + 1, i + 1
                now = role_
                if edit == "R":
                    state = SUCCESSOR[state]
                    now = ROLE_OF[state]
                elif edit == "K":
                    state = AFTER_S if role_[0] == "s" else SUCCESSOR[state]
                out.append((conv_id, edit, fault, role_, now, text_))
                if i == len(codes):                 # turns inserted at the end
                    for _ in edits[k:]:
                        state = SUCCESSOR[state]
                        out.append((conv_id, "I", None, None, ROLE_OF[state], ""))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64())] + [pa.array([r[j] for r in out], pa.string()) for j in range(1, 6)], names=names)

    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos").select("conv_id", "block", "pos", "role", "text", "codes", "edits")
            .mapInArrow(run, EDITS))


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation, from the rows of ``repair`` as they come: conv_id, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    price = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}

    def run(batches):
        key, state = None, None

        def result():
            counts, illegal, cost, audit, sha = state[0], state[1], state[2], "".join(state[3]), state[4].hexdigest()
            return (key, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)

        def table(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [pa.int64()] * 6 + [pa.string()] * 2)], names=names)
        for b in batches:
            done = []
            for conv, edit, fault, old, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != key:
                    if state is not None:
                        done.append(result())
                    key, state = conv, [dict.fromkeys(FAULTS, 0), 0, 0, [], hashlib.sha256(), None, True]
                state[3].append(edit)
                state[2] += price[edit] + (TRUNCATED_STAYS if fault == "truncated" and edit != "D" else 0)
                if edit != "I":
                    state[0][fault] += 1
                    if state[5] is not None and (state[5][:1] + old[:1]) not in ("su", "ua", "au"):
                        state[1] += 1
                    state[5] = old
                if edit != "D":
                    state[4].update(f"{'' if state[6] else chr(10)}{role}:{text}".encode())
                    state[6] = False
            if done:
                yield table(done)
        if state is not None:
            yield table([result()])

    return edits.mapInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def gaps(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, gaps): turns missing between the first and the last of a conversation; 0 without any turn."""
    kinds = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn")).distinct()
    return kinds.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by crc32(conv_id:turn) mod
    20: 0 drops the row, 1 empties its text, 2 takes its ends of sentences away, 3
    repeats it, 4 makes its role user. Null is one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def damaged_and_repaired(df: DataFrame) -> DataFrame:
    """The damaged conversations' faults, their repair and its digests; one row for every conversation of ``df``."""
    rows = damage(df)
    told, missing = digests(repair(rows)), gaps(rows).withColumnRenamed("conv_id", "g")
    every = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = (every.join(told.withColumnRenamed("conv_id", "t"), F.col("conv_id").eqNullSafe(F.col("t")), "left")
           .join(missing, F.col("conv_id").eqNullSafe(F.col("g")), "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
