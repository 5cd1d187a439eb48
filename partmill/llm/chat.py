"""Chat formatting: records of different layouts become canonical turns, turns become one text with a loss mask.

A record's schema fingerprint is the SHA-256 of its nested field paths, sorted;
`[]` stands for the elements of an array. Only paths that some layout knows are
hashed, so further fields change nothing. The fingerprint selects a declarative
mapping: for a table with columns once, from its schema; for JSON records row by
row, from the parsed value. Both use the same paths and hashes. All of it is DataFrame
functions.

The template names a speaker between [INST] and [/INST]:
    <s>[INST]role[/INST]text</s>
A control string inside a role or a text gets a backslash after its first character,
also where it has some already, so taking one away restores the text.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from partmill.llm.common import table

DEPTH = 3  # levels of objects and arrays that a layout's paths go down

# The template's control strings and their spelling as patterns.
OPEN, CLOSE, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array of objects."""

    array: str
    role: str
    text: str


@dataclass(frozen=True)
class One:
    """One turn of a given role from fields, joined by a blank line; without any of them, none if it may lack."""

    role: str
    fields: tuple[str, ...]
    may_lack: bool = False


@dataclass(frozen=True)
class Row:
    """The record is a turn."""

    role: str
    text: str
    order: str | None = None


@dataclass(frozen=True)
class Layout:
    name: str
    turns: tuple[Each | One | Row, ...]
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        """Of the paths with any of the optional ones."""
        some = itertools.chain.from_iterable(itertools.combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [fingerprint([*self.paths, *x]) for x in some]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


_SYSTEM = One("system", ("system",), may_lack=True)
LAYOUTS = (
    Layout("turn rows", (Row("role", "text", "turn"),), ("role", "text"), ("turn",)),
    Layout("turn rows, content", (Row("role", "content", "turn"),), ("role", "content"), ("turn",)),
    Layout("messages", (_SYSTEM, Each("messages", "role", "content")), ("messages[].role", "messages[].content"), ("system",)),
    Layout("from and value", (_SYSTEM, Each("conversations", "from", "value")), ("conversations[].from", "conversations[].value"), ("system",)),
    Layout("prompt and completion", (_SYSTEM, One("user", ("prompt",)), One("assistant", ("completion",))), ("prompt", "completion"), ("system",)),
    Layout("prompt and response", (_SYSTEM, One("user", ("prompt",)), One("assistant", ("response",))), ("prompt", "response"), ("system",)),
    Layout("question and answer", (_SYSTEM, One("user", ("question",)), One("assistant", ("answer",))), ("question", "answer"), ("system",)),
    Layout("prompt and completion messages", (Each("prompt", "role", "content"), Each("completion", "role", "content")), ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content")),
    Layout("instruction", (_SYSTEM, One("user", ("instruction", "input")), One("assistant", ("output",))), ("instruction", "output"), ("input", "system")),
)
SPEAKERS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}  # of arrays; other names stay
TURNS = "array<struct<role:string,text:string>>"


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({p for x in layouts for p in (*x.paths, *x.optional)})


def schema_paths(kind: DataType, prefix: str = "", depth: int = DEPTH) -> list[str]:
    """Paths of a schema's fields."""
    if depth and isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name, depth - 1)]
    if depth and isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]", depth - 1)
    return [prefix]


def record_paths(value: Column, prefix: Column | None = None, depth: int = DEPTH) -> Column:
    """Paths of a variant's fields; an empty array or object is a field without any below."""
    own = F.lit("") if prefix is None else prefix
    if not depth:
        return F.array(own)
    fields, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    name = (lambda e: e["key"]) if prefix is None else (lambda e: F.concat(own, F.lit("."), e["key"]))
    below = F.flatten(F.transform(F.map_entries(fields), lambda e: record_paths(e["value"], name(e), depth - 1)))
    each = F.flatten(F.transform(items, lambda x: record_paths(x, F.concat(own, F.lit("[]")), depth - 1)))
    return F.when(F.size(fields) > 0, below).when(F.size(items) > 0, F.array_distinct(each)).otherwise(F.array(own))


def record_fingerprint(value: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    known = F.array(*[F.lit(p) for p in known_paths(layouts)])
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(record_paths(value), known)), "\n"), 256)


def _speaker(role: Column) -> Column:
    names = F.create_map([F.lit(x) for kv in SPEAKERS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, role), role)


def _element(rule: Each, inner):
    return lambda x: F.struct(_speaker(F.coalesce(inner(x, rule.role), F.lit(""))).alias("role"), F.coalesce(inner(x, rule.text), F.lit("")).alias("text"))


def _turns(layout: Layout, field, items, inner) -> Column:
    """The mapping as an array of turns; how fields, arrays and their elements' fields are read is given."""
    parts = []
    for rule in layout.turns:
        if isinstance(rule, Each):
            parts.append(F.coalesce(F.transform(items(rule.array), _element(rule, inner)), F.array().cast(TURNS)))
        elif isinstance(rule, One):
            texts = [x for x in map(field, rule.fields) if x is not None]
            whole = F.array_join(F.filter(F.array(*texts), lambda x: x != ""), "\n\n") if texts else F.lit("")
            own = F.array(F.struct(F.lit(rule.role).alias("role"), whole.alias("text")))
            parts.append(F.when(whole != "", own).otherwise(F.array().cast(TURNS)) if rule.may_lack else own)
        else:
            parts.append(F.array(F.struct(F.coalesce(field(rule.role), F.lit("")).alias("role"), F.coalesce(field(rule.text), F.lit("")).alias("text"))))
    return F.concat(*parts)


def table_turns(rows: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, at, role, text from a table whose columns follow a layout.

    `turn` is the layout's order column, or null; `at` counts the turns of a row.
    Null roles and texts are ''. An unknown layout is an error, at plan time.
    Columns that no layout knows are not read.
    """
    known = set(known_paths(layouts))
    own = fingerprint([p for p in schema_paths(rows.schema) if p in known])
    layout = next((x for x in layouts if own in x.fingerprints()), None)
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(known & set(schema_paths(rows.schema)))}")
    have = set(rows.columns)
    field = lambda name: F.col(name).cast("string") if name in have else None
    turns = _turns(layout, field, F.col, lambda x, name: x[name].cast("string"))
    order = next((r.order for r in layout.turns if isinstance(r, Row) and r.order in have), None)
    if all(isinstance(r, Row) for r in layout.turns):  # no array around a single turn
        (rule,) = layout.turns
        return rows.select(F.col(key).alias("conv_id"), (F.col(order) if order else F.lit(None)).cast("long").alias("turn"), F.lit(0).alias("at"), *[F.coalesce(field(c), F.lit("")).alias(n) for c, n in ((rule.role, "role"), (rule.text, "text"))])
    return rows.select(F.col(key).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.posexplode(turns).alias("at", "__turn")).select("conv_id", "turn", "at", "__turn.role", "__turn.text")


def record_turns(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Turns as of `table_turns`, from JSON records of any of the layouts, and the records of none: conv_id, record, fingerprint, paths.

    Records that are null or no JSON are among the latter, with null paths. A
    value that is no string comes as its JSON text. A record is one variant, which
    Spark limits to 128 MB; longer ones are among the latter, too.
    """
    parsed = records.select(F.col(key).alias("conv_id"), F.col(record).alias("record"), F.try_parse_json(F.col(record)).alias("__value"))
    parsed = parsed.withColumn("fingerprint", F.when(F.col("__value").isNotNull(), record_fingerprint(F.col("__value"), layouts)))
    read = lambda v, name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    value = F.col("__value")
    mapped = F.coalesce(*[
        F.when(F.col("fingerprint").isin(x.fingerprints()), _turns(x, lambda name: read(value, name), lambda name: F.try_variant_get(value, f"$.{name}", "array<variant>"), read))
        for x in layouts
    ])
    order = F.coalesce(*[F.when(F.col("fingerprint").isin(x.fingerprints()), F.try_variant_get(value, f"$.{r.order}", "long")) for x in layouts for r in x.turns if isinstance(r, Row) and r.order])
    known = F.col("fingerprint").isin([f for x in layouts for f in x.fingerprints()])
    turns = parsed.filter(known).select("conv_id", order.alias("turn"), F.posexplode(mapped).alias("at", "__turn")).select("conv_id", "turn", "at", "__turn.role", "__turn.text")
    rest = parsed.filter(~F.coalesce(known, F.lit(False))).select("conv_id", "record", "fingerprint", F.when(value.isNotNull(), record_paths(value)).alias("paths"))
    return turns, rest


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: a text for each conversation and the byte spans of the texts of role `learn` in it.

    Turns go by turn, nulls first, then by their place in the record, then as
    formatted; repeated rows stay. A null conv_id is a conversation of its own. A
    conversation is one value and must fit one: under 2 GB.
    """
    lead = F.concat(F.lit(OPEN + ROLE), escaped(F.col("role")), F.lit(TEXT))
    own = turns.select("conv_id", "turn", "at", (F.col("role") == learn).alias("learn"), lead.alias("lead"), escaped(F.col("text")).alias("text"))
    own = own.select("conv_id", "turn", "at", "learn", F.octet_length("lead").alias("lead"), F.concat("lead", "text", F.lit(CLOSE)).alias("piece"))
    before = Window.partitionBy("conv_id").orderBy("turn", "at", "piece")
    end = F.sum(F.octet_length("piece").cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("end", end).withColumn("start", F.col("end") - F.octet_length("piece"))
    parts = F.sort_array(F.collect_list(F.struct("start", "piece")))
    spans = F.sort_array(F.collect_list(F.when(F.col("learn"), F.struct((F.col("start") + F.col("lead")).alias("start"), (F.col("end") - len(CLOSE)).alias("end")))))
    whole = own.groupBy("conv_id").agg(parts.alias("parts"), spans.alias("loss"))
    return whole.select("conv_id", F.array_join(F.col("parts.piece"), "").alias("formatted"), "loss")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, unescaped."""

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, TEXT, 1)
        rest = F.substr(piece, F.char_length(head) + len(TEXT) + 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(ROLE) + 1))).alias("role"),
            unescaped(F.left(rest, F.char_length(rest) - len(CLOSE))).alias("text"),
        )

    pieces = F.split(text, F.lit(OPEN))
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the mask, unescaped, in order."""
    held = F.array(F.struct(text.cast("binary").alias("bytes"), loss.alias("spans")))  # the bytes are taken once
    cut = lambda x: F.transform(x["spans"], lambda s: unescaped(F.substr(x["bytes"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")))
    return F.transform(held, cut)[0]


def read_back(texts: DataFrame) -> DataFrame:
    """Per formatted conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    own = texts.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return own.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


# The conversation of control strings that the query adds.
_PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op12_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, by the layout of their table, and conversation -1, a JSON record of messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe, _ = record_turns(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(_PROBE).alias("record")), "id", "record")
    return read_back(formatted(table_turns(rows, "conv_id").unionByName(probe)))


OP12_SQL = r"""
WITH said AS (SELECT conv_id, turn, 0 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, k, who, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(k, who)),
pieces AS (SELECT *, '<s>[INST]' || regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') || '[/INST]' || regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') || '</s>' AS piece FROM said),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, place, piece) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, place, piece) FILTER (role = 'assistant'), '') AS loss, sum(length(piece))::BIGINT AS formatted_chars FROM pieces GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""
