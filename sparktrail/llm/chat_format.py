"""Chat formatting: fingerprints of field paths choose the mapping to canonical turns.

Any layout of prompts, instructions and messages is described by its nested
field paths, such as ``messages[].role``. The SHA-256 of the sorted paths is
its fingerprint; a table of declarative mappings, keyed by fingerprint, says how
such rows become turns of (role, text). A typed table has one fingerprint, taken
from its schema; a column of JSON has one for each row, computed by Spark.
Everything here is built of Spark's own functions.

Defined cases: a null text or role is empty; a null or unreadable JSON, or one
of no known layout, gives no turns and the mapping ``none``; columns and fields
that no mapping names are ignored, whatever their names; a text given as a list of
parts is the texts of these, put together; fields of one role in a row are one turn, joined by
a line end, without the empty ones; a system text beside a layout that has no place for
one is the first turn, if it is not empty; repeated rows are
repeated turns; turns that tie in number stand by role, then text; a
conversation without turns is formatted as the empty string; an empty table
gives an empty table. The turns of one conversation become one text, so they
meet in one task after partial lists; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """shape: rows (one row a turn), array (a column of messages) or fields (one column a turn)."""

    name: str
    shape: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()  # fields: role and path, in order
    array: str = ""  # array: column, with the fields below
    role: str = ""
    text: str = ""

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _array(name: str, array: str, role: str, text: str) -> Mapping:
    return Mapping(name, "array", (array, f"{array}[].{role}", f"{array}[].{text}"), array=array, role=role, text=text)


def _fields(name: str, *turns: tuple[str, str]) -> Mapping:
    return Mapping(name, "fields", tuple(p for _, p in turns), turns=turns)


#: In order of preference where the paths of several are there.
MAPPINGS = (
    Mapping("turn_rows", "rows", ("conv_id", "turn", "role", "text"), role="role", text="text"),
    _array("messages", "messages", "role", "content"),
    _array("shared_turns", "conversations", "from", "value"),
    _array("dialogue", "dialogue", "speaker", "text"),
    _fields("system_prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _fields("instruction_input", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    _fields("instruction", ("user", "instruction"), ("assistant", "output")),
    _fields("prompt_response", ("user", "prompt"), ("assistant", "response")),
    _fields("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    _fields("question_answer", ("user", "question"), ("assistant", "answer")),
)
#: Names that message layouts give to the canonical roles; rows by turn keep the roles that they have.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"
#: Where a system text may stand beside any layout.
SYSTEM = ("system", "system_prompt")


def field_paths(schema: T.StructType, before: str = "") -> list[str]:
    found = []
    for f in schema.fields:
        path, kind = f"{before}{f.name}", f.dataType
        found.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        if isinstance(kind, T.StructType):
            found += field_paths(kind, f"{path}.")
    return found


def choose(paths, mappings=MAPPINGS) -> Mapping | None:
    """By the fingerprint of those paths that any mapping names, else the first mapping whose paths are all there."""
    known = set(paths) & {p for m in mappings for p in m.paths}
    by_print = {m.fingerprint: m for m in mappings}
    return by_print.get(fingerprint(known)) or next((m for m in mappings if set(m.paths) <= known), None)


def _turn(role: Column, text: Column, rename: bool = True) -> Column:
    named = F.coalesce(role.cast("string"), F.lit(""))
    canonical = F.coalesce(*[F.when(named == k, F.lit(v)) for k, v in ROLES.items()], named) if rename else named
    return F.struct(canonical.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _said(value: Column, kind: T.DataType) -> Column:
    """The text of a field: itself, or the texts of its parts put together."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda p: F.coalesce(_said(p, kind.elementType), F.lit(""))), "")
    return value["text"].cast("string") if isinstance(kind, T.StructType) and "text" in kind.names else value.cast("string")


def _variant_said(value: Column) -> Column:
    """The same of a VARIANT."""
    one = lambda p: F.coalesce(F.when(F.schema_of_variant(p).startswith("OBJECT"), F.try_variant_get(p, "$.text", "string")).otherwise(F.try_variant_get(p, "$", "string")), F.lit(""))
    parts = value.try_cast("array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, one), "")).otherwise(one(value))


def _laid_out(m: Mapping, field) -> Column:
    """The turns of a layout of fields; field(path) is the text there. Fields of one role in a row are one turn."""
    turns: list[tuple[str, list[str]]] = []
    for role, path in m.turns:
        if turns and turns[-1][0] == role:
            turns[-1][1].append(path)
        else:
            turns.append((role, [path]))
    texts = lambda paths: field(paths[0]) if len(paths) == 1 else F.array_join(F.filter(F.array(*map(field, paths)), lambda t: t != ""), "\n")
    return F.array(*[_turn(F.lit(role), texts(paths)) for role, paths in turns])


def _after_system(turns: Column, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.array(_turn(F.lit("system"), text)).cast(TURNS), turns)).otherwise(turns)


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """(conv_id, fingerprint, mapping, turns) of a typed table, by the mapping that its schema's fingerprint selects."""
    m = choose(field_paths(df.schema), mappings)
    if m is None:
        raise ValueError(f"no mapping has the paths of {field_paths(df.schema)}")
    said = F.lit(m.fingerprint).alias("fingerprint"), F.lit(m.name).alias("mapping")
    if m.shape == "rows":
        # Partial lists are made before the shuffle: a row for each task and conversation.
        one = F.struct(F.col("turn"), F.coalesce(m.role, F.lit("")).alias("role"), F.coalesce(m.text, F.lit("")).alias("text"))
        rows = df.groupBy(conv_id).agg(F.array_sort(F.collect_list(one)).alias("rows"))
        return rows.select(F.col(conv_id).alias("conv_id"), *said, F.transform("rows", lambda t: _turn(t["role"], t["text"], rename=False)).alias("turns"))
    if m.shape == "array":
        kind = df.schema[m.array].dataType
        turns = F.transform(F.coalesce(F.col(m.array), F.array().cast(kind)), lambda t: _turn(t[m.role], _said(t[m.text], kind.elementType[m.text].dataType)))
    else:
        turns = _laid_out(m, lambda path: _said(F.col(path), df.schema[path].dataType))
    turns = turns.cast(TURNS)
    for path in SYSTEM:
        if path in df.columns and path not in m.paths:
            turns = _after_system(turns, _said(F.col(path), df.schema[path].dataType))
    return df.select(F.col(conv_id).alias("conv_id"), *said, turns.alias("turns"))


def canonical_turns_json(df: DataFrame, conv_id: str = "conv_id", payload: str = "payload", mappings=MAPPINGS) -> DataFrame:
    """(conv_id, fingerprint, mapping, turns) of a column of JSON objects whose layout may differ from row to row."""
    mappings = [m for m in mappings if m.shape != "rows"]
    tops = sorted({p.split("[]")[0] for m in mappings for p in m.paths})
    parsed = df.select(F.col(conv_id).alias("conv_id"), F.try_parse_json(payload).alias("v"))
    at = lambda path: F.try_variant_get("v", f"$.{path}", "variant")
    messages = lambda top: F.filter(F.coalesce(at(top).try_cast("array<variant>"), F.array().cast("array<variant>")), lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    none, paths = F.array().cast("array<string>"), []
    for top in tops:
        paths.append(F.when(at(top).isNotNull(), F.array(F.lit(top))).otherwise(none))
        # a field counts if a message has it, not something inside of a message
        for inner in sorted({p.split("[].")[1] for m in mappings for p in m.paths if p.startswith(f"{top}[].")}):
            has = F.exists(messages(top), lambda t: F.try_variant_get(t, f"$.{inner}", "variant").isNotNull())  # noqa: B023
            paths.append(F.when(has, F.array(F.lit(f"{top}[].{inner}"))).otherwise(none))
    known = F.array_sort(F.array_distinct(F.flatten(F.array(*paths))))
    rows = parsed.withColumn("paths", known).withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    exact = F.coalesce(*[F.when(F.col("fingerprint") == m.fingerprint, F.lit(m.name)) for m in mappings])
    subset = F.coalesce(*[F.when(F.size(F.array_except(F.array(*map(F.lit, m.paths)), F.col("paths"))) == 0, F.lit(m.name)) for m in mappings])
    rows = rows.withColumn("mapping", F.coalesce(exact, subset, F.lit("none")))
    turns = F.array().cast(TURNS)
    for m in mappings:
        if m.shape == "array":
            made = F.transform(messages(m.array), lambda t: _turn(F.try_variant_get(t, f"$.{m.role}", "string"), _variant_said(F.try_variant_get(t, f"$.{m.text}", "variant"))))  # noqa: B023
        else:
            made = _laid_out(m, lambda path: _variant_said(at(path)))
        made = F.coalesce(made.cast(TURNS), F.array().cast(TURNS))
        for path in SYSTEM:
            if path not in m.paths:
                made = _after_system(made, _variant_said(at(path)))
        turns = F.when(F.col("mapping") == m.name, made).otherwise(turns)
    return rows.select("conv_id", "fingerprint", "mapping", turns.alias("turns"))


def escape(text: Column) -> Column:
    """No control string is left in it: each ``<|``, whatever backslashes are between, gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds `formatted`, the text of the conversation under the template, and `loss_runs`.

    loss_runs holds lengths in code points of consecutive parts of `formatted`
    and whether the loss counts there: for each turn its head, its text and its
    end. Only the texts of assistant turns count.
    """
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    run = lambda n, loss: F.struct(n.cast("long").alias("n"), loss.alias("loss"))
    runs = lambda t: F.array(run(F.length(t["head"]), F.lit(False)), run(F.length(t["body"]), t["loss"]), run(F.lit(len(END)), F.lit(False)))
    return (
        turns.withColumn("parts", parts)
        .withColumn("formatted", F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))
        .withColumn("loss_runs", F.flatten(F.transform("parts", runs)))
        .drop("parts")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds `read`, the turns (role, text, loss) recovered from `formatted` and `loss_runs` alone."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(piece: Column, i: Column) -> Column:
        head = F.get("loss_runs", i * 3)["n"] - len(START)
        body = F.get("loss_runs", i * 3 + 1)
        return F.struct(
            _unescape_role(F.substring(piece, F.lit(1), (head - 1).cast("int"))).alias("role"),
            unescape(F.substring(piece, (head + 1).cast("int"), body["n"].cast("int"))).alias("text"),
            body["loss"].alias("loss"),
        )

    return formatted.withColumn("read", F.transform(pieces, turn))


def format_chats(df: DataFrame, conv_id: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """The whole operator for a typed table: canonical turns, then the template."""
    return format_turns(canonical_turns(df, conv_id, mappings))
