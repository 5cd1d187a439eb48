"""Conversation structure repair: the cheapest edits that make a conversation's roles follow (s?(ua)+)?.

A row is kept (0), given role user or assistant (3) or deleted (4), a turn without
text is put in (3); a row whose text breaks off costs 3 more unless it goes; blank
rows and repeated ones must go. Edits follow from the least costs of what is left
after each row, one number for each of four states: nothing yet, after the system
turn, after a user's, after an assistant's. Of the cheapest edits the ASCII-least
string of their initials is taken.

A conversation's rows are cut into chunks, wherever its rows lie, so that it needs no
task of its own. Rank-convergence parallel Viterbi: each chunk runs backward from a
speculative cost vector. Vectors are held less their least number, so two that differ
only by a constant are one. A scan over chunks says what vector each chunk's successor
really hands on; chunks that have not run from it run again, and stop at the first
row where they meet the vector of an earlier run. When no chunk asks for a
vector, each is traced forward from each state, and a scan stitches the pieces. Only
few vectors exist, all chunks run from all that were asked for, and so the number of
passes is bounded by theirs, whatever the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import few, ship, table, written

CHUNK = 1024  # rows of a chunk, at most
SPACES = " \t\n\x0b\f\r"

Vector = tuple[int, int, int, int]
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a put-in or renamed turn leads to
TAKE = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
END: Vector = (0, 6, 3, 0)  # costs after the last row
NAMES = {USER: "user", ASSISTANT: "assistant"}


def ways(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row: initial, cost, next state. Codes are the initial of the role, upper case if the text breaks off, x for other roles and d for rows that must go."""
    yield "D", DELETE, state
    if code != "d":
        more = BROKEN if code.isupper() else 0
        if (code.lower(), state) in TAKE:
            yield "K", KEEP + more, TAKE[code.lower(), state]
        yield "R", REROLE + more, TURN[state]


def closed(costs: list[int]) -> list[int]:
    """With turns put in first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[TURN[q]]) for q, c in enumerate(costs)]
    return costs


@cache
def before(code: str, after: Vector) -> Vector:
    """The vector before a row, less its least number."""
    costs = closed([min(cost + after[to] for _, cost, to in ways(code, q)) for q in range(4)])
    return tuple(c - min(costs) for c in costs)


@cache
def choice(code: str, after: Vector, state: int) -> tuple[str, int, int]:
    """Initials of the least edits up to and with a row, their cost, the next state."""
    costs = closed([min(cost + after[to] for _, cost, to in ways(code, q)) for q in range(4)])
    best = [(letter, cost, to, "") for letter, cost, to in ways(code, state) if cost + after[to] == costs[state]]
    if INSERT + costs[TURN[state]] == costs[state]:
        letters, cost, to = choice(code, after, TURN[state])
        best.append(("I" + letters, INSERT + cost, to, ""))
    return min(best)[:3]


def swept(codes: str, end: Vector, held: list[Vector] | None = None) -> list[Vector]:
    """The vectors before each row and after the last one. held: those of an earlier run, whose rest is taken where the two meet."""
    out = [end] * (len(codes) + 1)
    for k in range(len(codes) - 1, -1, -1):
        if held and out[k + 1] == held[k + 1]:
            return held[: k + 1] + out[k + 1 :]
        out[k] = out[k + 1] if codes[k] == "d" else before(codes[k], out[k + 1])
    return out


def traced(codes: str, runs: list[int], vectors: list[Vector], state: int) -> tuple[int, str, int]:
    """The state after the chunk's rows, the initials of the edits, their cost."""
    letters, total = [], 0
    for k, code in enumerate(codes):
        if code == "d":
            letters.append("D" * runs[k])
            total += DELETE * runs[k]
        else:
            own, cost, state = choice(code, vectors[k + 1], state)
            letters.append(own)
            total += cost
    return state, "".join(letters), total


def packed(v: Vector) -> str:
    return ",".join(map(str, v))


def unpacked(v: str) -> Vector:
    return tuple(map(int, v.split(",")))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches; a long one is sent on at once."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or n > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, b.num_rows, 200):
            yield from zip(*(c.to_pylist() for c in b.slice(k, 200).columns))


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """`fn` on the rows of each partition, in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(lambda batches: _batches(fn(_rows(batches)), out), schema)


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of the last two as one space, and digest, the first 128 bits of the SHA-256 of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    return own.withColumn("digest", digest)


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    return F.expr(" and ".join(f"{a}.{n} <=> {b}.{n}" for n in names))


def faults(own: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n (equal rows), blank, broken, first (no such role and text at an earlier turn)."""
    last = F.rtrim("text", F.lit(SPACES))
    own = own.select("conv_id", "turn", "role", "digest", (last == "").alias("blank"), (~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("broken"))
    own = own.groupBy("conv_id", "turn", "role", "digest", "blank", "broken").agg(F.count("*").alias("n"))
    key = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls come first
    seen = own.filter("not blank").groupBy("conv_id", "digest").agg(F.min(key).alias("least"), F.count("*").alias("turns")).filter("turns > 1")
    seen = few(written(seen.select("conv_id", "digest", "least.turn", F.lit(True).alias("again"))))
    joined = own.alias("a").join(seen.alias("b"), same("a", "b", "conv_id", "digest"), "left")
    return joined.select("a.*", (F.col("again").isNull() | F.col("a.turn").eqNullSafe(F.col("b.turn"))).alias("first"))


CHUNKS = "conv_id long, part int, k int, codes string, runs array<long>, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, turns long, low long, high long"
LEGAL = {"su", "ua", "au"}


def chunks(marked: DataFrame, size: int) -> DataFrame:
    """Rows in order, up to `size` to a chunk; part and k order a conversation's chunks.

    codes: a letter a row, rows that must go as one d for a run of them, whose length
    is in runs.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        part, k = TaskContext.get().partitionId(), 0
        for conv, own in groupby(rows, lambda r: r[0]):
            while held := [r for _, r in zip(range(size), own)]:
                codes, runs, count = [], [], {"blank": 0, "duplicate": 0, "truncated": 0}
                illegal, roles = 0, [r[2][:1] for r in held]
                for (_, _, role, n, blank, broken, first), initial in zip(held, roles):
                    fault = "blank" if blank else "duplicate" if not first else "truncated" if broken else None
                    gone = n if blank or not first else n - 1
                    if gone < n:
                        code = initial if initial and initial in "sua" else "x"
                        codes.append(code.upper() if broken else code)
                        runs.append(1)
                    if fault in ("blank", "duplicate"):
                        count[fault] += n
                    else:
                        count["truncated"] += fault == "truncated"
                        count["duplicate"] += n - 1
                    if gone:
                        if codes and codes[-1] == "d":
                            runs[-1] += gone
                        else:
                            codes.append("d")
                            runs.append(gone)
                    illegal += n - 1
                illegal += sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
                turns = [r[1] for r in held if r[1] is not None]
                yield (conv, part, k, "".join(codes), runs, count["blank"], count["duplicate"], count["truncated"], illegal, roles[0], roles[-1], len(set(turns)), min(turns, default=None), max(turns, default=None))
                k += 1

    order = ["conv_id", "turn", "role", "digest"]
    own = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "n", "blank", "broken", "first")
    return _mapped(own, run, CHUNKS)


def ran(of: DataFrame, known: list[Vector]) -> DataFrame:
    """conv_id, part, k, starts: the vectors before each chunk for each vector of `known` after it."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, k, codes in rows:
            held, starts = None, []
            for end in known:
                own = swept(codes, end, held)
                held = held or own
                starts.append(packed(own[0]))
            yield conv, part, k, starts

    return _mapped(of.select("conv_id", "part", "k", "codes"), run, "conv_id long, part int, k int, starts array<string>")


def ends(starts: DataFrame, known: list[Vector]) -> DataFrame:
    """conv_id, part, k, end (the vector after each chunk), asked: no run from it is known, so what comes before is speculative."""
    at = {packed(v): n for n, v in enumerate(known)}

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(rows, lambda r: r[0]):
            end = packed(END)
            for _, part, k, before_it in own:
                yield conv, part, k, end, end not in at
                end = before_it[at.get(end, 0)]

    back = starts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("k"))
    return _mapped(back, run, "conv_id long, part int, k int, end string, asked boolean")


def settled(of: DataFrame) -> DataFrame:
    """conv_id, part, k, end: the true vector after each chunk. Passes until no chunk asks for a vector."""
    known = [END]
    while True:
        found = written(ends(written(ran(of, known)), known))
        asked = [r.end for r in found.filter("asked").select("end").distinct().collect()]  # vectors, of which few exist
        if not asked:
            return found.drop("asked")
        known += sorted(map(unpacked, asked))


PIECES = "conv_id long, part int, k int, to array<int>, letters array<string>, costs array<long>"
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def pieces(of: DataFrame, found: DataFrame) -> DataFrame:
    """Each chunk's edits from each state."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, k, codes, runs, end in rows:
            vectors = swept(codes, unpacked(end))
            to, letters, costs = zip(*(traced(codes, runs, vectors, q) for q in range(4)))
            yield conv, part, k, to, letters, costs

    own = of.alias("a").join(found.alias("b"), same("a", "b", "conv_id", "part", "k")).select("a.conv_id", "a.part", "a.k", "codes", "runs", "end")
    return _mapped(own, run, PIECES)


def stitched(of: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each conversation."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(rows, lambda r: r[0]):
            state, letters, cost, counts, role = START, [], 0, [0, 0, 0, 0], None
            turns, low, high = 0, None, None
            for _, _, _, to, pieces_of, costs, *counted, first_role, last_role, n, least, most in own:
                letters.append(pieces_of[state])
                cost, state = cost + costs[state], to[state]
                counts = [a + b for a, b in zip(counts, counted)]
                counts[3] += role is not None and role + first_role not in LEGAL
                role = last_role
                turns += n - (n > 0 and high is not None and high == least)
                if n:
                    low, high = least if low is None else low, most
            while state in (SYSTEM, USER):
                letters.append("I")
                cost, state = cost + INSERT, TURN[state]
            yield conv, 0 if low is None else high - low + 1 - turns, *counts, cost, "".join(letters)

    own = of.alias("a").join(parts.alias("b"), same("a", "b", "conv_id", "part", "k"))
    own = own.select("a.conv_id", "a.part", "a.k", "to", "letters", "costs", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "turns", "low", "high")
    return _mapped(own.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k"), run, OUT)


def audits(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation of `rows` (conv_id, turn, role, text).

    Rows go by turn, nulls first, then by role, then by digest of role and text. A
    null conv_id is a conversation; null roles and texts are one space; an empty
    table has no conversations. Other columns are not read.
    """
    ship(rows.sparkSession)
    of = written(chunks(faults(keyed(rows)), size))
    return stitched(of, written(pieces(of, settled(of))))


def followed(rows: DataFrame, found: DataFrame, fn, schema: str) -> DataFrame:
    """`fn` on (conversation's row of `found`, its repaired turns as (role, text) in order) for each conversation, as a stream: texts are not held.

    A conversation's texts pass through one task in order, a row at a time.
    """
    names = found.columns

    def turns(own: Iterator[tuple], audit: str) -> Iterator[tuple[str, str]]:
        state, at = START, 0
        for *_, role, text in own:
            while audit[at] == "I":
                state, at = TURN[state], at + 1
                yield NAMES[state], ""
            if audit[at] == "K":
                state = TAKE[role[0], state]
                yield role, text
            elif audit[at] == "R":
                state = TURN[state]
                yield NAMES[state], text
            at += 1
        while at < len(audit):
            state, at = TURN[state], at + 1
            yield NAMES[state], ""

    def run(rows_of: Iterator[tuple]) -> Iterator[tuple]:
        for _, own in groupby(rows_of, lambda r: r[0]):
            head = next(own)[4]
            yield from fn(head, turns(own, head["audit"]))

    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.struct(*names).alias("head"), F.lit("").alias("role"), F.lit("").alias("text"))
    own = keyed(rows).select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "digest", F.lit(None).cast(head.schema["head"].dataType).alias("head"), "role", "text")
    both = head.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return _mapped(both.select("conv_id", "kind", "turn", "digest", "head", "role", "text"), run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text of the repaired conversations; `found` as of `audits`."""

    def run(head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        for k, (role, text) in enumerate(turns):
            yield head["conv_id"], k, role, text

    return followed(rows, found, run, "conv_id long, turn long, role string, text string")


def with_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`found` with repaired_sha256, of the repaired turns as role:text, joined by newlines."""
    names = found.columns

    def run(head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        state = hashlib.sha256()
        for k, (role, text) in enumerate(turns):
            state.update(("\n" * (k > 0) + role + ":" + text).encode())
        yield *(head[n] for n in names), state.hexdigest()

    return followed(rows, found, run, OUT + ", repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the query's damage, drawn by the CRC-32 of conv_id:turn."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("__draw")).filter("__draw <> 0")
    text = F.when(F.col("__draw") == 1, "").when(F.col("__draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    own = own.select("conv_id", "turn", F.when(F.col("__draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "__draw")
    return own.withColumn("__copy", F.explode(F.when(F.col("__draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__draw", "__copy")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    bad = damaged(rows)
    found = with_digests(bad, written(audits(bad)))
    ids = rows.select("conv_id").distinct()
    joined = ids.alias("a").join(found.alias("b"), same("a", "b", "conv_id"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("a.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
