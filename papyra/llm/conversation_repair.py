"""Conversation structure repair: the cheapest edits that make a conversation alternate, the ASCII-least where costs tie.

A conversation is read by turn. A row is blank (no character but white space), a duplicate (role and
text seen earlier) or truncated (its last such character ends no sentence); its first fault counts. The
edits are Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate rows) and
Insert an empty user or assistant row (5); a truncated row that stays adds 5. What is left must read
``(s?(ua)+)?`` in initials of the roles.

The nodes of a graph are (rows read, what was said last); its arcs are edits. Costs from the start and
costs to the end tell which arcs are tight, that is lie on a cheapest path. The least of the cheapest edit strings
is read off by a set of nodes: from all nodes that the letters so far lead to, take the least letter of
any tight arc. All of them have read the same rows, as equal letters read equally many.

Rows are sorted over all partitions by (conversation, turn, role, text), so a conversation may span any
number of tasks. A stretch of one conversation in a task is cut into segments of at most ``ROWS`` rows and ``BYTES`` bytes. A
conversation inside one task and one segment is repaired on the spot. For the others segments pass on what they need:
a table of costs between the states at their ends, then the costs from both sides, then the set
of nodes; each is a stream in order of segments that holds one row at a time. Only the digest of
the repaired text must read a conversation's segments one after the other, as SHA-256 does.

Odd input. A null turn sorts first; in gaps it does not count. Rows of equal turn are taken by role, first
characters of the text and its digest, so copies stand together. A null role or text is one space; a null
conv_id is a conversation of its own. Roles other than by the initials s, u and a can only be reroled or deleted.
A conversation without rows has zeros, no edits and the digest of nothing. An empty table gives an
empty table; other columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra.llm import common

ROWS = 50_000
BYTES = 8 << 20
#: Rows of a conversation whose repair a worker remembers by its codes.
SHORT = 24
NEVER = 1 << 60
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: What was said last: nothing, the system's row, a user's, an assistant's. Initials have the same numbers; 0 is any other.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A row's code is its initial and four times its fault.
FINE, MUST_GO, CUT_SHORT = range(3)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FOLLOWS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
INSERTS = [(p, q) for q in (USER, ASSISTANT) for p in FOLLOWS[q]]

Vector = tuple[int, int, int, int]


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, from, to) of the edits that read a row, by letter."""
    fault, initial = divmod(code, 4)
    out = [("D", DELETE, q, q) for q in range(4)]
    if fault != MUST_GO:
        extra = TRUNCATED if fault == CUT_SHORT else 0
        out += [("K", extra, p, initial) for p in FOLLOWS.get(initial, ())]
        out += [("R", REROLE + extra, p, q) for q in (USER, ASSISTANT) for p in FOLLOWS[q]]
    return out


ARCS = [_arcs(code) for code in range(12)]


def inserted(cost: list[int]) -> Vector:
    """Costs from the start, with rows inserted here."""
    cost[USER] = min(cost[USER], min(cost[p] for p in FOLLOWS[USER]) + INSERT)
    cost[ASSISTANT] = min(cost[ASSISTANT], cost[USER] + INSERT)
    return tuple(cost)


def inserted_back(cost: list[int]) -> Vector:
    """Costs to the end, with rows inserted here."""
    cost[USER] = min(cost[USER], cost[ASSISTANT] + INSERT)
    for p in FOLLOWS[USER]:
        cost[p] = min(cost[p], cost[USER] + INSERT)
    return tuple(cost)


BEGIN = inserted([0, NEVER, NEVER, NEVER])
END = inserted_back([0, NEVER, NEVER, 0])


def forward(codes: bytes, cost: Vector) -> list[Vector]:
    """Costs from the start before each row and after the last."""
    out = [cost]
    for code in codes:
        new = [NEVER] * 4
        for _, price, p, q in ARCS[code]:
            new[q] = min(new[q], cost[p] + price)
        cost = inserted(new)
        out.append(cost)
    return out


def backward(codes: bytes, cost: Vector) -> list[Vector]:
    """Costs to the end before each row and after the last."""
    out = [cost]
    for code in reversed(codes):
        new = [NEVER] * 4
        for _, price, p, q in ARCS[code]:
            new[p] = min(new[p], cost[q] + price)
        cost = inserted_back(new)
        out.append(cost)
    return out[::-1]


class Tight:
    """The tight arcs of a segment, given the costs up to it and from its end on."""

    def __init__(self, codes: bytes, before: Vector, after: Vector) -> None:
        self.codes, self.f, self.b = codes, forward(codes, before), backward(codes, after)
        self.cost = min(f + b for f, b in zip(self.f[0], self.b[0], strict=True))

    def starts(self) -> int:
        """Nodes that lie on a cheapest path, as bits."""
        return sum(1 << q for q in range(4) if self.f[0][q] + self.b[0][q] == self.cost)

    def _step(self, i: int, nodes: int) -> tuple[str, int]:
        """The least letter and where it leads."""
        f, b, best, to = self.f[i], self.b[i], "Z", 0
        for p, q in INSERTS:
            if nodes >> p & 1 and f[p] + INSERT + b[q] == self.cost:
                best, to = "I", to | 1 << q
        if i < len(self.codes):
            after = self.b[i + 1]
            for letter, price, p, q in ARCS[self.codes[i]]:
                if letter <= best and nodes >> p & 1 and f[p] + price + after[q] == self.cost:
                    best, to = letter, (to if letter == best else 0) | 1 << q
        return best, to

    def walk(self, nodes: int, last: bool) -> tuple[str, int]:
        """The least letters of cheapest paths from the nodes to the segment's end, or to the end of all; the nodes that they lead to."""
        letters, i = [], 0
        while i < len(self.codes) or (last and not any(nodes >> q & 1 and self.b[i][q] == 0 for q in range(4))):
            letter, nodes = self._step(i, nodes)
            letters.append(letter)
            i += letter != "I"
        return "".join(letters), nodes


def _whole(codes: bytes) -> tuple[int, str]:
    tight = Tight(codes, BEGIN, END)
    return tight.cost, tight.walk(1 << START, True)[0]


_remembered = lru_cache(maxsize=1 << 16)(_whole)


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    return (_remembered if len(codes) <= SHORT else _whole)(codes)


def table_of(codes: bytes) -> list[int]:
    """Costs from each state before a segment to each after it."""
    return [c for q in range(4) for c in forward(codes, inserted([0 if p == q else NEVER for p in range(4)]))[-1]]


def repaired(edits: str, rows: Iterable[tuple[bytes, bytes]], at: int = 0, system: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """(role:text, rows so far, whether the system speaks first) of each row that is left; rows: (role, text)."""
    own = iter(rows)
    for letter in edits:
        role, text = (b"", b"") if letter == "I" else next(own)
        if letter == "D":
            continue
        if letter == "K":
            system = system or int(at == 0 and role[:1] == b"s")
        else:
            role = b"assistant" if (at - system) % 2 else b"user"
        at += 1
        yield role + b":" + text, at, system


class Facts:
    """What is counted in a stretch of rows, mergeable with the next stretch."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")

    def __init__(self, values: list | None = None) -> None:
        for name, value in zip(self.FIELDS, values or (0, 0, 0, 0, None, None, None, None, 0), strict=True):
            setattr(self, name, value)

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]

    def turn(self, turn: int | None) -> None:
        """The next turn in ascending order, nulls first."""
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, turn: int | None, code: int, blank: bool) -> None:
        fault, initial = divmod(code, 4)
        self.blank += blank
        self.duplicate += fault == MUST_GO and not blank
        self.truncated += fault == CUT_SHORT
        self.illegal += self.last is not None and (self.last, initial) not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        self.turn(turn)

    def add(self, other: Facts) -> None:
        if other.first is not None:
            self.illegal += self.last is not None and (self.last, other.first) not in LEGAL
            self.first, self.last = other.first if self.first is None else self.first, other.last
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.low is not None:
            self.turns += other.turns - (other.low == self.high)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def result(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, live) with each row's code, duplicates apart, whether it is blank, and its place in the order."""
    initial = F.substring("role", 1, 1)
    seen = F.rtrim(F.col("text"), F.lit(common.SPACES))
    blank = seen == ""
    number = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    fault = F.when(blank, MUST_GO).when(F.substring(seen, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_SHORT)
    return rows.withColumns({"code": (number + fault * 4).cast("int"), "blank": blank, "head": F.substring("text", 1, 40), "digest": F.sha2("text", 256), "n": F.monotonically_increasing_id()})


def arrow(schema: str) -> pa.Schema:
    """Plain Arrow types of a schema string, read on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def in_order(df: DataFrame, fold: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, descending: bool = False) -> DataFrame:
    """fold on the stream of each conversation's rows in order of segments; nothing but a batch is held."""
    out = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for part in common.slices(batch, 1 << 20) for r in part.to_pylist())
        held: list[tuple] = []
        for _, own in groupby(rows, key=lambda r: r["conv_id"]):
            for row in fold(own):
                held.append(row)
                if len(held) == 1000:
                    yield batch_of(held, out)
                    held = []
        if held:
            yield batch_of(held, out)

    moved = df.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc() if descending else F.col("seg"))
    return common.map_stream(moved, run, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def segments(rows: DataFrame, kind: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The repair of each conversation that lies inside a task and a segment; of the others, segments with their rows."""
    schema = f"conv_id {kind}, {RESULT}, seg long, turns array<long>, roles array<binary>, texts array<binary>, codes binary, blanks binary"
    out = arrow(schema)

    def solved(conv, rows: list[tuple]) -> tuple:
        facts, codes, seen = Facts(), bytearray(), set()
        for turn, role, text, code, blank in rows:
            if not blank:
                if (role, text) in seen:
                    code = code % 4 + 4 * MUST_GO
                seen.add((role, text))
            codes.append(code)
            facts.row(turn, code, blank)
        cost, edits = cheapest(bytes(codes))
        text = b"\n".join(r[0] for r in repaired(edits, ((r[1], r[2]) for r in rows)))
        return conv, *facts.result(), cost, edits, hashlib.sha256(text).hexdigest(), None, None, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        whole = (r for batch in batches for part in common.slices(batch, 1 << 20) for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
        held: list[tuple] = []

        def segment(conv, rows: list[tuple]) -> tuple:
            nonlocal k
            k += 1
            return conv, *[None] * 8, base + k, *([r[c] for r in rows] for c in range(3)), bytes(r[3] for r in rows), bytes(r[4] for r in rows)

        before, first = None, True
        for conv, own in groupby(whole, key=lambda r: r[0]):
            if before is not None:  # it has begun and ended in this task
                held.append(segment(*before) if first else solved(*before))
                first = False
            before, rows, size = None, [], 0
            cut = False
            for _, turn, role, text, live, code, blank in own:
                if live:
                    rows.append((turn, role, text, code, blank))
                    size += len(role) + len(text)
                    if len(rows) >= most_rows or size >= most_bytes:
                        held.append(segment(conv, rows))
                        yield batch_of(held, out)
                        rows, size, cut, held = [], 0, True, []
            if cut:
                held.append(segment(conv, rows))
                first = False
            else:
                before = (conv, rows)
            if len(held) >= 1000:
                yield batch_of(held, out)
                held = []
        if before is not None:
            held.append(segment(*before))
        if held:
            yield batch_of(held, out)

    order = ["conv_id", "turn", "role", "head", "digest", "n"]
    moved = marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    binary = moved.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "live", "code", "blank")
    return common.map_stream(binary, run, schema)


def _times(vector: list[int], table: list[int]) -> list[int]:
    return [min(NEVER, *(vector[p] + table[4 * p + q] for p in range(4))) for q in range(4)]


def _times_back(table: list[int], vector: list[int]) -> list[int]:
    return [min(NEVER, *(table[4 * p + q] + vector[q] for q in range(4))) for p in range(4)]


def spanning(held: DataFrame, kind: str, scratch: common.Scratch) -> DataFrame:
    """The repair of conversations of several segments."""
    rows = held.select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts"))).select("conv_id", "seg", "pos", "col.*")
    said = rows.filter(F.length(F.rtrim(F.col("texts").cast("string"), F.lit(common.SPACES))) > 0)
    said = said.select("conv_id", "seg", "pos", F.sha2(F.concat(F.octet_length("roles").cast("string").cast("binary"), F.lit(":").cast("binary"), "roles", "texts"), 256).alias("said"))
    first = said.groupBy("conv_id", "said").agg(F.min(F.struct("seg", "pos")).alias("f")).select("f.*")
    again = said.join(first, ["seg", "pos"], "left_anti").groupBy("seg").agg(F.collect_list("pos").alias("again"))

    coded = f"conv_id {kind}, seg long, codes binary, facts array<long>, costs array<long>"
    out = arrow(coded)

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for conv, seg, turns, codes, blanks, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes, facts = bytearray(codes), Facts()
            for i in copies or ():
                codes[i] = codes[i] % 4 + 4 * MUST_GO
            for turn, c, blank in zip(turns, codes, blanks, strict=True):
                facts.row(turn, c, bool(blank))
            rows.append((conv, seg, bytes(codes), facts.values(), table_of(bytes(codes))))
        return batch_of(rows, out)

    own = held.join(again, "seg", "left").select("conv_id", "seg", "turns", "codes", "blanks", "again")
    own = scratch.write(common.map_batches(own, code, coded), "coded")

    def ahead(rows: Iterator[dict]) -> Iterator[tuple]:
        cost = list(BEGIN)
        for r in rows:
            yield r["conv_id"], r["seg"], r["codes"], r["costs"], cost
            cost = _times(cost, r["costs"])

    def back(rows: Iterator[dict]) -> Iterator[tuple]:
        cost, last = list(END), True
        for r in rows:
            yield r["conv_id"], r["seg"], r["codes"], r["before"], cost, last
            cost, last = _times_back(r["costs"], cost), False

    way = in_order(own, ahead, f"conv_id {kind}, seg long, codes binary, costs array<long>, before array<long>")
    way = in_order(way, back, f"conv_id {kind}, seg long, codes binary, before array<long>, after array<long>, last boolean", descending=True)
    way = scratch.write(way, "way")

    moved = f"conv_id {kind}, seg long, moves array<long>"
    moved_out = arrow(moved)

    def moves(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in batch.to_pylist():
            tight = Tight(r["codes"], tuple(r["before"]), tuple(r["after"]))
            some = tight.starts()
            rows.append((r["conv_id"], r["seg"], [tight.walk(n, False)[1] if n and n & some == n else 0 for n in range(16)]))
        return batch_of(rows, moved_out)

    def frontier(rows: Iterator[dict]) -> Iterator[tuple]:
        nodes = 1 << START
        for r in rows:
            yield r["seg"], nodes
            nodes = r["moves"][nodes]

    nodes = in_order(common.map_batches(way, moves, moved), frontier, "seg long, nodes long")

    edited_out = arrow("seg long, edits string, cost long")

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in batch.to_pylist():
            tight = Tight(r["codes"], tuple(r["before"]), tuple(r["after"]))
            rows.append((r["seg"], tight.walk(r["nodes"], r["last"])[0], tight.cost))
        return batch_of(rows, edited_out)

    edits = common.map_batches(way.join(nodes, "seg"), edit, "seg long, edits string, cost long")

    def whole(rows: Iterator[dict]) -> Iterator[tuple]:
        facts, letters, digest, at, system = Facts(), [], hashlib.sha256(), 0, 0
        for r in rows:
            facts.add(Facts(r["facts"]))
            letters.append(r["edits"])
            for text, at, system in repaired(r["edits"], zip(r["roles"], r["texts"], strict=True), at, system):
                digest.update(text if at == 1 else b"\n" + text)
        yield r["conv_id"], *facts.result(), r["cost"], "".join(letters), digest.hexdigest()

    parts = held.select("conv_id", "seg", "roles", "texts").join(edits, "seg").join(own.select("seg", "facts"), "seg")
    return in_order(parts, whole, f"conv_id {kind}, {RESULT}")


def repair(rows: DataFrame, live: Column | None = None, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text): counts of faults, the cost, the edits and the digest of what they leave. Rows that are not live only name their conversation."""
    scratch = common.Scratch(rows.sparkSession, "conversations")
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(True) if live is None else live).alias("live"))
    kind = dict(own.dtypes)["conv_id"]
    held = scratch.write(segments(own, kind, most_rows, most_bytes), "held")
    names = [f.split()[0] for f in RESULT.split(", ")]
    across = spanning(held.filter("seg is not null"), kind, scratch)
    return held.filter("seg is null").select("conv_id", *names).unionByName(across)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): rows harmed by a checksum of (conv_id, turn); a dropped one is not live."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    h = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = conversations.select(
        "conv_id", "turn",
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h <= 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (h != 0).alias("live"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation, after the stated damage."""
    rows = damaged(common.table(spark, sf_dir, "conversations"))
    return repair(rows, F.col("live"))


#: The same by a recursion from the last row to the first that carries the least (cost, edits) of each state.
ORACLE_SQL = """
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), summed AS (
    SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) % 20 AS h
    FROM keyed
), harmed AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM summed WHERE h <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen, substr(role, 1, 1) AS initial
    FROM harmed
), faults AS (
    SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two
    FROM placed
), facts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
), costs AS (
    -- from the last row to the first: the least (cost, edits) to the end after nothing (a), a system row (b), a user row (c), an assistant row (d)
    SELECT conv_id, n + 1 AS i, {'c': 0, 's': ''} AS a, {'c': 10, 's': 'II'} AS b, {'c': 5, 's': 'I'} AS c, {'c': 0, 's': ''} AS d
    FROM facts
    UNION ALL
    SELECT conv_id, i, least(a1, {'c': 5 + c2.c, 's': 'I' || c2.s}), least(b1, {'c': 5 + c2.c, 's': 'I' || c2.s}), c2, least(d1, {'c': 5 + c2.c, 's': 'I' || c2.s})
    FROM (SELECT *, least(c1, {'c': 5 + d1.c, 's': 'I' || d1.s}) AS c2 FROM (
        SELECT f.conv_id, f.i,
            list_min([{'c': 2 + p.a.c, 's': 'D' || p.a.s}, {'c': ks + p.b.c, 's': 'K' || p.b.s}, {'c': ku + p.c.c, 's': 'K' || p.c.s}, {'c': r + p.c.c, 's': 'R' || p.c.s}]) AS a1,
            list_min([{'c': 2 + p.b.c, 's': 'D' || p.b.s}, {'c': ku + p.c.c, 's': 'K' || p.c.s}, {'c': r + p.c.c, 's': 'R' || p.c.s}]) AS b1,
            list_min([{'c': 2 + p.c.c, 's': 'D' || p.c.s}, {'c': ka + p.d.c, 's': 'K' || p.d.s}, {'c': r + p.d.c, 's': 'R' || p.d.s}]) AS c1,
            list_min([{'c': 2 + p.d.c, 's': 'D' || p.d.s}, {'c': ku + p.c.c, 's': 'K' || p.c.s}, {'c': r + p.c.c, 's': 'R' || p.c.s}]) AS d1
        FROM costs p JOIN (
            SELECT conv_id, i, CASE WHEN initial = 's' THEN stay ELSE 1000000 END AS ks, CASE WHEN initial = 'u' THEN stay ELSE 1000000 END AS ku,
                CASE WHEN initial = 'a' THEN stay ELSE 1000000 END AS ka, stay + 1 AS r
            FROM (SELECT conv_id, i, initial, CASE fault WHEN 'fine' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000 END AS stay FROM faults)
        ) f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i - 1
    ))
), edits AS (
    SELECT conv_id, a.c AS cost, a.s AS audit FROM costs WHERE i = 1
), steps AS (
    SELECT conv_id, j, substr(audit, j, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM edits)
), read_ AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS o FROM steps
), left_ AS (
    SELECT s.conv_id, s.o, s.letter, f.role, f.text, bool_or(s.o = 1 AND s.letter = 'K' AND f.initial = 's') OVER (PARTITION BY s.conv_id) AS system
    FROM read_ s LEFT JOIN faults f ON s.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i
    WHERE s.letter <> 'D'
), texts AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS repaired
    FROM left_ GROUP BY conv_id
)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
    coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN edits e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
