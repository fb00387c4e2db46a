"""Conversation repair: the cheapest edits after which a conversation's roles follow the grammar ``(s?(ua)+)?``.

Edits per row: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, and Insert (an empty user or assistant row,
anywhere) 5; a row that is blank or a repeat must be deleted, one that ends without ``.``, ``!`` or ``?`` costs 5 more if it
stays. For each cost c in turn a layer holds per row a bitset of the grammar's states from which the rest can be repaired
for at most c; a layer follows from cheaper ones by table look-ups on whole bitsets. The first layer that has the start state
at the first row gives the cost, and a walk through the layers' bits, trying edits in ASCII order, the least audit. After a
prefix of an audit the state is known, so the walk never turns back.

Long conversations. Layers are built for ``BLOCK`` rows at a time, from the end: all that a block needs from those after it
is what the rest costs from each state, four numbers. A conversation of more than ``long_rows`` rows is cut into pieces of
``PIECE`` rows, each of which tells what it costs from state to state (min-plus matrices); these are chained per
conversation, one small row per piece; then the pieces find their audits from each state, the states are chained, and each
piece keeps one. So no task holds a long conversation. Only the sha256 of the repaired text has to read it in order: its
rows are streamed, and held by no one.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are ordered by role, then by
sha256 of the text, and equal rows lie side by side; a null conv_id is a conversation of its own; a role's initial is its
first character, and roles that begin otherwise than with s, u or a cannot be kept; a conversation without rows has zeros
and the sha256 of nothing; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ensure_importable, frugal, maybe_broadcast, stored
from .ordered import consecutive, first_nulls, numbered

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
BLOCK, PIECE, LONG_ROWS = 64, 4096, 20_000
SPACES = " \t\n\x0b\x0c\r"
#: The states: nothing yet, after a system, a user, an assistant row; nothing and assistant may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after the only user or assistant row that may stand here, and its role.
_NEXT = [USER, USER, ASSISTANT, USER]
_ROLE = ["user", "user", "assistant", "user"]
#: What the end costs from each state: inserted rows.
_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
_NEVER = 1 << 40
#: A row as one byte: 0 must be deleted, else 2 * kind + truncated, where the kind is the place of the initial here.
KINDS = ("", "s", "u", "a", None)


def _into(steps: dict[int, int]) -> list[int]:
    """By set of states: the states from which ``steps`` lead into it."""
    return [sum(1 << a for a, b in steps.items() if states >> b & 1) for states in range(16)]


_KEPT = [_into(_AFTER.get(k, {})) for k in KINDS]
_FORCED = _into(dict(enumerate(_NEXT)))
BOUNDARIES = ("su", "ua", "au")
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def layers(codes: Sequence[int], end: Sequence[int], wanted: int) -> list[list[int]]:
    """By cost, by row: the states from which the rest costs no more, where after the last row it costs ``end``. The last
    layer is the first that has all ``wanted`` states at the first row, or the first that could have any."""
    out: list[list[int]] = []
    most = max((e for e in end if e < _NEVER), default=0) + DELETE_COST * len(codes) + 2 * INSERT_COST
    n = len(codes)
    for c in range(most + 1):
        here = [0] * (n + 1)
        here[n] = now = sum(1 << q for q in range(4) if end[q] <= c)
        deleted = out[c - DELETE_COST] if c >= DELETE_COST else None
        inserted = out[c - INSERT_COST] if c >= INSERT_COST else None
        rerole = out[c - REROLE_COST] if c >= REROLE_COST else None
        late = out[c - TRUNCATED_COST] if c >= TRUNCATED_COST else None
        late_rerole = out[c - TRUNCATED_COST - REROLE_COST] if c >= TRUNCATED_COST + REROLE_COST else None
        for i in range(n - 1, -1, -1):
            code, states = codes[i], deleted[i + 1] if deleted else 0
            if code:
                if code & 1:
                    if late:
                        states |= _KEPT[code >> 1][late[i + 1]]
                    if late_rerole:
                        states |= _FORCED[late_rerole[i + 1]]
                else:
                    states |= _KEPT[code >> 1][now]
                    if rerole:
                        states |= _FORCED[rerole[i + 1]]
            if inserted:
                states |= _FORCED[inserted[i]]
            here[i] = now = states
        out.append(here)
        if now & wanted == wanted:
            break
    return out


def first_layers(found: list[list[int]]) -> list[int]:
    """What the rest costs at the first row, from each state."""
    return [next((c for c, layer in enumerate(found) if layer[0] >> q & 1), _NEVER) for q in range(4)]


def walk(codes: Sequence[int], found: list[list[int]], state: int) -> tuple[str, int]:
    """The least audit of the rows from ``state`` on, and the state after it."""
    cost, audit = next(c for c, layer in enumerate(found) if layer[0] >> state & 1), []
    for i, code in enumerate(codes):
        while True:
            if cost >= DELETE_COST and found[cost - DELETE_COST][i + 1] >> state & 1:
                audit.append("D")
                cost -= DELETE_COST
                break
            if cost >= INSERT_COST and found[cost - INSERT_COST][i] >> _NEXT[state] & 1:
                audit.append("I")
                cost, state = cost - INSERT_COST, _NEXT[state]
                continue
            left = cost - TRUNCATED_COST * (code & 1)
            kept = _AFTER.get(KINDS[code >> 1] or "", {}).get(state)
            if kept is not None and left >= 0 and found[left][i + 1] >> kept & 1:
                audit.append("K")
                cost, state = left, kept
            else:
                audit.append("R")
                cost, state = left - REROLE_COST, _NEXT[state]
            break
    return "".join(audit), state


def _scaled(costs: Sequence[int]) -> tuple[int, list[int]]:
    least = min(costs)
    return least, [c - least if c < _NEVER else _NEVER for c in costs]


def through(codes: Sequence[int], end: Sequence[int], wanted: int = 15) -> tuple[list[int], list[list[list[int]]]]:
    """What the rest costs at the first row from each state, and the layers of each block."""
    blocks: list[list[list[int]]] = []
    costs = list(end)
    for at in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        least, rest = _scaled(costs)
        blocks.append(layers(codes[at : at + BLOCK], rest, wanted if at == 0 else 15))
        costs = [least + c if c < _NEVER else _NEVER for c in first_layers(blocks[-1])]
    return costs, blocks[::-1]


def walk_through(codes: Sequence[int], blocks: list[list[list[int]]], state: int) -> tuple[str, int]:
    audits = []
    for k, found in enumerate(blocks):
        audit, state = walk(codes[k * BLOCK : (k + 1) * BLOCK], found, state)
        audits.append(audit)
    return "".join(audits), state


def closing(state: int) -> str:
    """The inserts after the last row."""
    return "I" * (_END[state] // INSERT_COST)


@lru_cache(1 << 16)
def repair_codes(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's rows."""
    costs, blocks = through(codes, _END, 1 << START)
    audit, state = walk_through(codes, blocks, START)
    return costs[START], audit + closing(state)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults that the crc32 of conversation and turn decides on: one row in 20 each is
    dropped, emptied, robbed of its full stops, repeated, or given to the user. Nulls of role and text become one space."""

    def told(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    chosen = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), chosen.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _ordered_by() -> list[str]:
    return ["turn", "role", "digest"]


def _with_digest(rows: DataFrame) -> DataFrame:
    filled = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return filled.withColumn("digest", F.sha2("text", 256))


def _lean(rows: DataFrame) -> DataFrame:
    """Rows without their texts: what their faults follow from."""
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    cut = ~F.right(core, F.lit(1)).isin(".", "!", "?")
    return _with_digest(rows).select("conv_id", "turn", "role", "digest", (core == "").alias("is_blank"), cut.alias("is_cut"))


def _code(initial: str, gone: bool, cut: bool) -> int:
    return 0 if gone else 2 * (KINDS.index(initial) if initial in ("s", "u", "a") else len(KINDS) - 1) + cut


def _audited(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, conversation by conversation, each led by a row without ``kind``: the finished audits."""
    ids, stats, audits = [], [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(x, pa.int64()) for x in zip(*stats)), pa.array(audits, pa.string())], names)

    for run in consecutive(batches, ["conv_id"]):
        known, codes, seen = dict.fromkeys(STATS, 0), bytearray(), set()
        turns = {t for t in run.column("turn").to_pylist() if t is not None}
        known["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        before = None
        for kind, role, digest, blank, cut in zip(*(run.column(c).to_pylist() for c in ("kind", "role", "digest", "is_blank", "is_cut"))):
            if not kind:
                continue
            initial, again = role[:1], (role, digest) in seen
            seen.add((role, digest))
            known["illegal"] += before is not None and before + initial not in BOUNDARIES
            before = initial
            fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
            if fault:
                known[fault] += 1
            codes.append(_code(initial, blank or again, cut))
        known["cost"], audit = repair_codes(bytes(codes)) if codes else (0, "")
        ids.append(run.column("conv_id").chunk(0).slice(0, 1))
        stats.append([int(known[s]) for s in STATS])
        audits.append(audit)
        if len(ids) >= 1000:
            yield batch()
            ids, stats, audits = [], [], []
    if ids:
        yield batch()


def _long_audits(lean: DataFrame, part_rows: int) -> DataFrame:
    """As _audited, for conversations of any length."""
    kind = dict(lean.dtypes)["conv_id"]
    placed, _ = numbered(stored(lean, "long"), "conv_id", _ordered_by(), part_rows)
    placed = stored(placed.drop("part"), "placed")
    # The first of equal rows is known by its place, so the join below has keys that do not repeat.
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("index").alias("index")).select(F.col("conv_id").alias("of"), F.col("index").alias("at"), F.lit(True).alias("is_first"))
    initial = F.substring("role", 1, 1)
    marked = placed.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("index") == F.col("at")), "left").select(
        "conv_id", "index", F.floor(F.col("index") / PIECE).cast("long").alias("piece"), initial.alias("initial"), "is_blank", F.col("is_first").isNull().alias("again"), "is_cut"
    )

    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("index", "initial", "is_blank", "again", "is_cut"))))
        initials = [r[1] for r in rows]
        codes = bytes(_code(i, blank or again, cut) for _, i, blank, again, cut in rows)
        ends = [[0 if q == p else _NEVER for p in range(4)] for q in range(4)]
        from_to = [c for end in ends for c in through(codes, end)[0]]
        return pa.table({
            "conv_id": table.column("conv_id").slice(0, 1), "piece": table.column("piece").slice(0, 1), "codes": pa.array([codes], pa.binary()), "costs": pa.array([from_to], pa.list_(pa.int64())),
            "blank": [sum(r[2] for r in rows)], "duplicate": [sum(r[3] and not r[2] for r in rows)], "truncated": [sum(r[4] and not r[2] and not r[3] for r in rows)],
            "illegal": [sum(a + b not in BOUNDARIES for a, b in zip(initials, initials[1:]))], "first": [initials[0]], "final": [initials[-1]],
        })

    pieces = stored(marked.groupBy("conv_id", "piece").applyInArrow(solve, f"conv_id {kind}, piece long, codes binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, final string"), "pieces")

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        costs, end, ends = table.column("costs").to_pylist(), list(_END), []
        for own in reversed(costs):
            ends.append(end)
            end = [min(own[4 * q + p] + end[q] for q in range(4)) for p in range(4)]
        return pa.table({"conv_id": table.column("conv_id"), "piece": table.column("piece"), "end": pa.array(ends[::-1], pa.list_(pa.int64())), "cost": pa.array([end[START]] * len(ends), pa.int64())})

    chained = stored(pieces.select("conv_id", "piece", "costs").groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, piece long, end array<long>, cost long"), "chained")
    ends = chained.select(F.col("conv_id").alias("of"), F.col("piece").alias("at"), "end", "cost")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at"))

    def trace(batches):
        for batch in batches:
            rows = []
            for codes, end in zip(batch.column("codes").to_pylist(), batch.column("end").to_pylist()):
                blocks = through(codes, end)[1]
                found = [walk_through(codes, blocks, q) for q in range(4)]
                rows.append(([a for a, _ in found], [q for _, q in found]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["conv_id", "piece", "audits", "exits"])

    traced = stored(pieces.join(ends, same).select("conv_id", "piece", "codes", "end").mapInArrow(trace, f"conv_id {kind}, piece long, audits array<string>, exits array<long>"), "traced")

    def enter(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        state, entries = START, []
        for exits in table.column("exits").to_pylist():
            entries.append(state)
            state = exits[state]
        final = ["" for _ in entries[1:]] + [closing(state)]
        return pa.table({"of": table.column("conv_id"), "at": table.column("piece"), "state": pa.array(entries, pa.int64()), "closing": pa.array(final, pa.string())})

    entered = stored(traced.select("conv_id", "piece", "exits").groupBy("conv_id").applyInArrow(enter, f"of {kind}, at long, state long, closing string"), "entered")
    chosen = traced.join(entered, same).select("conv_id", F.struct("piece", F.concat(F.col("audits")[F.col("state").cast("int")], "closing").alias("audit")).alias("own"))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("own")), lambda x: x["audit"]), "").alias("audit"))
    between = Window.partitionBy("conv_id").orderBy("piece")
    border = F.concat(F.lag("final").over(between), F.col("first"))
    counted = pieces.withColumn("illegal", F.col("illegal") + F.when(border.isNull() | border.isin(*BOUNDARIES), 0).otherwise(1))
    sums = counted.groupBy(F.col("conv_id").alias("of")).agg(*(F.sum(c).alias(c) for c in STATS[1:5]))
    costs = chained.where("piece = 0").select(F.col("conv_id").alias("of_cost"), "cost")
    turns = lean.groupBy(F.col("conv_id").alias("of_turns")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    on = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    return audits.join(sums, on("of")).join(costs, on("of_cost")).join(turns, on("of_turns")).select("conv_id", *STATS, "audit")


def audits(rows: DataFrame, conversations: DataFrame | None = None, long_rows: int = LONG_ROWS, part_rows: int = 100_000) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``rows``, and of those of
    ``conversations`` (conv_id) that have no rows."""
    ensure_importable(rows.sparkSession)
    lean = stored(_lean(rows), "turns")
    kind = dict(lean.dtypes)["conv_id"]
    marks = (conversations if conversations is not None else lean).select("conv_id").distinct()
    counted = stored(lean.groupBy(F.col("conv_id").alias("of")).count().where(F.col("count") > long_rows).select("of"), "counted")
    short, long = lean, None
    if not counted.isEmpty():
        those, same = maybe_broadcast(counted, 100_000), F.col("conv_id").eqNullSafe(F.col("of"))
        short, marks, long = lean.join(those, same, "left_anti"), marks.join(those, same, "left_anti"), lean.join(those, same, "left_semi")
    led = marks.select("conv_id", *(F.lit(None).cast(k).alias(c) for c, k in lean.dtypes[1:]), F.lit(0).alias("kind")).unionByName(short.withColumn("kind", F.lit(1)))
    names = ["conv_id", *STATS, "audit"]
    dealt = led.repartition("conv_id").sortWithinPartitions(*first_nulls("conv_id"), "kind", *first_nulls(*_ordered_by()))
    found = dealt.mapInArrow(lambda batches: _audited(batches, names), f"conv_id {kind}, {', '.join(f'{s} long' for s in STATS)}, audit string")
    return found if long is None else found.unionByName(_long_audits(long, part_rows))


def _applied(rows: DataFrame, found: DataFrame, schema: str, conversation) -> DataFrame:
    """Streams each conversation's rows, led by its audit, through ``conversation``: called with the leading row, it gives
    what takes (edit, role, text) and says at the end which rows to give out."""
    turns = _with_digest(rows).withColumn("kind", F.lit(1))
    both = found.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    order = [*first_nulls("conv_id"), "kind", *first_nulls(*_ordered_by())]
    both = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", *found.columns[1:], "role", "text")
    names = [c.split()[0] for c in schema.split(", ")]

    def stream(batches):
        own, audit, at, state, out = None, "", 0, START, []

        def take(last: bool, role: str = "", text: str = "") -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                out.extend(own("I", _ROLE[state], "") or ())
                at, state = at + 1, _NEXT[state]
            if last:
                out.extend(own(None, "", "") or ())
                return
            edit = audit[at]
            at += 1
            if edit == "R":
                role = _ROLE[state]
            if edit != "D":
                state = _NEXT[state] if edit == "R" else _AFTER[role[:1]][state]
            out.extend(own(edit, role, text) or ())

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        types = None
        for given in batches:
            types = types or [given.schema.field("conv_id").type, *(pa.int64() if c.split()[1] == "long" else pa.string() for c in schema.split(", ")[1:])]
            for row in given.to_pylist():
                if not row["kind"]:
                    if own:
                        take(True)
                    own, audit, at, state = conversation(row), row["audit"], 0, START
                else:
                    take(False, row["role"], row["text"])
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
        if own:
            take(True)
        if out:
            yield batch(out)

    return both.mapInArrow(frugal(stream), schema)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the conversations as their audits repair them; deleted rows are not among them."""

    def conversation(row: dict):
        conv_id, place = row["conv_id"], 0

        def take(edit: str | None, role: str, text: str):
            nonlocal place
            if edit not in (None, "D"):
                place += 1
                return [(conv_id, place - 1, role, text, edit)]

        return take

    return _applied(rows, found, f"conv_id {dict(found.dtypes)['conv_id']}, place long, role string, text string, edit string", conversation)


def repair_digests(rows: DataFrame, conversations: DataFrame | None = None, long_rows: int = LONG_ROWS, part_rows: int = 100_000) -> DataFrame:
    """What audits() tells of each conversation, and the sha256 of its repaired rows, ``role:text``, joined by line breaks."""
    found = stored(audits(rows, conversations, long_rows, part_rows), "audits")

    def conversation(row: dict):
        hashed, first = sha256(), True

        def take(edit: str | None, role: str, text: str):
            nonlocal first
            if edit is None:
                return [(row["conv_id"], *(row[s] for s in STATS), row["audit"], hashed.hexdigest())]
            if edit != "D":
                hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        return take

    return _applied(rows, found, f"conv_id {dict(found.dtypes)['conv_id']}, {', '.join(f'{s} long' for s in STATS)}, audit string, repaired_sha256 string", conversation)
