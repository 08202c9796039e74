"""Chat formatting by schema fingerprints.

Records arrive as JSON in several layouts (message lists, prompt and response, instruction with input
and output). The set of a record's nested field paths, hashed, selects a declarative mapping
which names the path and role of every turn; no code looks at a record's content to guess its layout.
Turns are written to a template that marks them with control strings. Inside texts and roles these
are escaped by a backslash before every ``<|`` (and before every backslash), which reading back undoes.

A formatted conversation is a series of segments, one per turn, in order; its text is their
concatenation. Segments are sorted and read as a stream, so a conversation of any number of turns
is never held whole.

Defined results: a null text or role is empty; turns are ordered by turn number (null first), then by
role and text, so ties and repeated rows have one order; a record whose fingerprint has no mapping
goes to :func:`unmapped` (also one with a JSON string over the reader's 20 million characters); an empty table gives an empty result; columns beside those named are not
carried.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

START, END, MASKED = "<|im_start|>", "<|im_end|>", "assistant"

#: Characters of one JSON string at most; longer texts come in parts (JSON readers limit a string's length).
PART = 1_000_000
#: Declarative mappings. ``turns`` lists (role, path) in order; ``each`` names a list path with its role and
#: text fields, and the text field of its parts where texts come in parts (``mixed``: in some items only); ``roles``
#: gives roles their usual names.
LAYOUTS = [
    {"fields": ["messages[].content", "messages[].role"], "each": ("$.messages", "role", "content")},
    {"fields": ["messages[].content[].text", "messages[].role"], "each": ("$.messages", "role", "content", "text")},
    {"fields": ["messages[].content", "messages[].content[].text", "messages[].role"], "each": ("$.messages", "role", "content", "text"), "mixed": True},
    {"fields": ["conversations[].from", "conversations[].value"], "each": ("$.conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    {"fields": ["prompt", "response"], "turns": [("user", "$.prompt"), ("assistant", "$.response")]},
    {"fields": ["prompt", "response", "system"], "turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")]},
    {"fields": ["instruction", "output"], "turns": [("user", "$.instruction"), ("assistant", "$.output")]},
    {"fields": ["input", "instruction", "output"], "turns": [("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")]},
]


def schema_hash(fields: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


def _field(record: Column, name: Column) -> Column:
    return F.call_function("get_json_object", record, F.concat(F.lit("$['"), name, F.lit("']")))


def _paths(value: Column, path: Column, depth: int) -> Column:
    """Paths of all fields under a JSON value, which a lambda must have bound; lists as ``path[]``, over all their elements."""
    if not depth:
        return F.array(path)

    def fields(item: Column, at: Column) -> Column:
        inner = lambda k: F.flatten(F.transform(F.array(_field(item, k)), lambda v: _paths(v, F.concat(at, F.lit("."), k), depth - 1)))
        return F.coalesce(F.flatten(F.transform(F.json_object_keys(item), inner)), F.array(at))

    items = F.from_json(F.when(F.json_array_length(value).isNotNull(), value), "array<string>")
    listed = F.array_distinct(F.flatten(F.transform(items, lambda x: fields(x, F.concat(path, F.lit("[]"))))))
    return F.coalesce(listed, fields(value, path))  # an empty list has no paths


#: A string that is a value: after a colon, or in a list (where no colon follows it).
_STRING = r'(?s)([:\[,]\s*)"(?:[^"\\]++|\\.)*+"(?!\s*:)'


def fingerprint(record: Column) -> Column:
    """Hash of the sorted nested field paths of a JSON record, lists as ``name[]`` with the fields of all their elements.

    String values are taken out first, so no text can look like a list or an object."""

    def paths(bare: Column) -> Column:
        top = F.coalesce(F.json_object_keys(bare), F.array().cast("array<string>"))
        each = F.transform(top, lambda k: F.flatten(F.transform(F.array(_field(bare, k)), lambda v: _paths(v, k, 2))))
        return F.array_sort(F.array_distinct(F.flatten(each)))

    bare = F.regexp_replace(record, _STRING, "$1 0")
    found = F.get(F.transform(F.array(bare), paths), F.lit(0))
    return F.substring(F.sha2(F.array_join(found, "\n").cast("binary"), 256), 1, 16)


def _listed(record: Column, path: str, role: str, text: str, *part: str, mixed: bool = False, roles: dict | None = None) -> Column:
    own = lambda kind: F.from_json(F.get_json_object(record, path), f"array<struct<`{role}`:string,`{text}`:{kind}>>")
    joined = lambda m: F.array_join(F.transform(m[text], lambda p: F.coalesce(p[part[0]], F.lit(""))), "")

    def named(r: Column) -> Column:
        for other, usual in (roles or {}).items():
            r = F.when(r == other, usual).otherwise(r)
        return r

    if not part:
        return F.transform(own("string"), lambda m: F.struct(named(m[role]).alias("role"), m[text].alias("text")))
    parts = F.transform(own(f"array<struct<`{part[0]}`:string>>"), lambda m: F.struct(named(m[role]).alias("role"), joined(m).alias("text")))
    if not mixed:  # a text that is not in parts reads as null there
        return parts
    return F.zip_with(parts, own("string"), lambda p, m: F.struct(p["role"].alias("role"), F.coalesce(p["text"], m[text]).alias("text")))


def canonical(records: DataFrame, record_id: str = "record_id", record: str = "record") -> DataFrame:
    """Columns record_id, pos, role, text, chosen by each record's fingerprint; records without a mapping give no rows."""
    rows = records.select(F.col(record_id).alias("record_id"), F.col(record).alias("record_"))
    rows = rows.withColumn("schema_", fingerprint(F.col("record_")))
    turns = F.array().cast("array<struct<role:string,text:string>>")
    for layout in LAYOUTS:
        if "each" in layout:
            made = _listed(F.col("record_"), *layout["each"], mixed=layout.get("mixed", False), roles=layout.get("roles"))
        else:
            made = F.array(*[F.struct(F.lit(r).alias("role"), F.get_json_object("record_", p).alias("text")) for r, p in layout["turns"]])
        turns = F.when(F.col("schema_") == schema_hash(layout["fields"]), made).otherwise(turns)
    out = rows.select("record_id", F.posexplode(turns).alias("pos", "t"))
    return out.select("record_id", "pos", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def unmapped(records: DataFrame, record_id: str = "record_id", record: str = "record") -> DataFrame:
    """Columns record_id, schema: the records whose fingerprint no mapping knows."""
    rows = records.select(F.col(record_id).alias("record_id"), F.col(record).alias("record_"))
    rows = rows.select("record_id", fingerprint(F.col("record_")).alias("schema"))
    return rows.filter(~F.col("schema").isin([schema_hash(x["fields"]) for x in LAYOUTS]))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def format_turns(turns: DataFrame, order: list[str], conv: str = "conv_id") -> DataFrame:
    """A column segment with each turn in the template, and where its masked text begins and ends in it.

    ``order`` names the columns that order a conversation's turns. Mask positions count code points
    and are null for turns outside the loss.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    role = F.replace(role, F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    out = turns.select(F.col(conv).alias("conv_id"), *[F.col(c).alias(f"order_{k}") for k, c in enumerate(order)],
                       F.concat(head, text, F.lit(END + "\n")).alias("segment"), F.length(head).alias("begin"),
                       (F.length(head) + F.length(text)).alias("end"), F.coalesce(F.col("role") == MASKED, F.lit(False)).alias("masked"))
    return out.withColumns({c: F.when(F.col("masked"), F.col(c)) for c in ("begin", "end")}).drop("masked")


_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment, unescaped."""
    m = _SEGMENT.fullmatch(segment)
    role = _ESCAPED.sub(lambda x: "\n" if x[1] == "n" else x[1], m[1])
    return role, _ESCAPED.sub(r"\1", m[2])


def _digest(batches):
    """Segments sorted by conversation to one row each: what is read back from the template and the mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row(now, n, turns, chars, loss, formatted):
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    now, begun = None, False
    for batch in batches:
        done = []
        ids = batch.column(0).to_pylist()
        for conv, segment, begin, end in zip(ids, *(batch.column(k).to_pylist() for k in (1, 2, 3))):
            if not begun or conv != now:
                if begun:
                    done.append(row(now, n, turns, chars, loss, formatted))
                now, begun, n, chars, formatted = conv, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            role, text = read_segment(segment)
            turns.update(f"{role}\n{text}\n".encode())
            n, formatted = n + 1, formatted + len(segment)
            if begin is not None:
                masked = _ESCAPED.sub(r"\1", segment[begin:end])
                loss.update(masked.encode())
                chars += len(masked)
        yield _batch(done, names, batch.schema.field(0).type)
    if begun:
        yield _batch([row(now, n, turns, chars, loss, formatted)], names, batch.schema.field(0).type)


def _batch(rows, names, kind):
    cols = list(zip(*rows)) or [()] * len(names)
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def digest(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments in order.

    Rows are dealt by conversation because a digest needs its turns in sequence; the task streams
    them from a sort that can spill, holding one segment at a time.
    """
    C.ship(segments.sparkSession)
    order = [c for c in segments.columns if c.startswith("order_")]
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    kind = segments.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "segment", "begin", "end").mapInArrow(
        _digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def to_records(turns: DataFrame) -> DataFrame:
    """One record for each row of ``conversations`` (conv_id, turn, role, text), as JSON, in one of the layouts that hold one turn.

    A record holds one turn, so a conversation of any length stays spread; its order travels as columns. The layout goes by
    a hash of the row's place; the one that renames roles is for roles which it leaves alone."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))
    other = F.struct(F.array(F.struct(role.alias("from"), text.alias("value"))).alias("conversations"))
    count = F.greatest(F.ceil(F.length(text) / PART), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(F.substring(text, k * PART + 1, F.lit(PART)).alias("text")))
    cut = F.struct(F.array(F.struct(role.alias("role"), parts.alias("content"))).alias("messages"))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    renamed = role.isin([r for x in LAYOUTS for r in x.get("roles", ())])
    return turns.withColumn("record", F.when((F.length(text) > PART) | (kind == 1), F.to_json(cut)).when((kind == 2) & ~renamed, F.to_json(other)).otherwise(F.to_json(whole)))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    given = C.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    records = to_records(given.unionByName(more)).withColumn("record_id", F.struct("conv_id", "turn"))
    turns = canonical(records).select("record_id.conv_id", "record_id.turn", "pos", "role", "text")
    return digest(format_turns(turns, ["turn", "pos", "role", "text"]))
