"""Chat formatting by schema fingerprints; DataFrame functions only.

Each record is a variant. The hash of its nested field paths selects a declarative mapping to canonical turns (role, text). A
template marks the turns and escapes its own control strings, so the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def path_text(example) -> str:
    """The nested field paths of an example, written as Spark writes a variant's schema, every scalar as S."""
    if isinstance(example, dict):
        return "OBJECT<" + ", ".join(f"{k}: {path_text(v)}" for k, v in sorted(example.items())) + ">"
    if isinstance(example, list):
        return f"ARRAY<{path_text(example[0])}>"
    return "S"


def fingerprint(record: Column) -> Column:
    """The hash of a variant's nested field paths; scalar types, nulls included, do not matter."""
    kinds = r"\b(VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), kinds, "S"), 256)


def _one(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def _listed(path: str, role: str, text: str, names: dict[str, str]) -> Callable[[Column], Column]:
    def turns(record: Column) -> Column:
        def one(x):
            named = x[role]
            for old, new in names.items():
                named = F.when(x[role] == old, F.lit(new)).otherwise(named)
            return F.struct(F.coalesce(named, F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))
        return F.transform(_get(record, path, f"array<struct<{role}:string,{text}:string>>"), one)
    return turns


def _pair(first: str, second: str) -> Callable[[Column], Column]:
    return lambda r: F.array(_one("user", _get(r, first)), _one(ASSISTANT, _get(r, second)))


def _instruction(r: Column) -> Column:
    asked = F.concat_ws("\n\n", _get(r, "instruction"), F.when(_get(r, "input") != "", _get(r, "input")))
    return F.array(_one("user", asked), _one(ASSISTANT, _get(r, "output")))


def _said(role: str, text: str) -> Callable[[Column], Column]:
    return lambda r: F.array(_one(role, _get(r, text)))


def _turn(r: Column) -> Column:
    return F.array(F.struct(F.coalesce(_get(r, "role"), F.lit("")).alias("role"), F.coalesce(_get(r, "text"), F.lit("")).alias("text")))


_HUMAN = {"human": "user", "gpt": ASSISTANT}
# Example of the layout -> its turns. A new layout is one more line.
LAYOUTS: dict[str, tuple[object, Callable[[Column], Column]]] = {
    "messages": ({"messages": [{"role": "", "content": ""}]}, _listed("messages", "role", "content", {})),
    "conversations": ({"conversations": [{"from": "", "value": ""}]}, _listed("conversations", "from", "value", _HUMAN)),
    "instruction_input": ({"instruction": "", "input": "", "output": ""}, _instruction),
    "instruction": ({"instruction": "", "output": ""}, _instruction),
    "prompt_completion": ({"prompt": "", "completion": ""}, _pair("prompt", "completion")),
    "prompt_response": ({"prompt": "", "response": ""}, _pair("prompt", "response")),
    "question_answer": ({"question": "", "answer": ""}, _pair("question", "answer")),
    "turn": ({"role": "", "text": "", "turn": 0}, _turn),
    "prompt_turn": ({"prompt": "", "turn": 0}, _said("user", "prompt")),
    "response_turn": ({"response": "", "turn": 0}, _said(ASSISTANT, "response")),
}


def canonical_turns(records: DataFrame, record: str = "record", layouts=None) -> DataFrame:
    """`records` with `layout`, the name of the mapping, and `turns`, an array of (role, text).

    A record of no known layout, a null one or one that is no object has a null layout and null turns; nothing is dropped. Columns
    of these two names are replaced, all others kept; equal rows stay as they are, and an empty table gives an empty result.
    """
    layouts = LAYOUTS if layouts is None else layouts
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for key, (example, mapping) in layouts.items():
        same = F.col("__field_paths") == hashlib.sha256(path_text(example).encode()).hexdigest()
        name = F.when(same, F.lit(key)).otherwise(name)
        turns = F.when(same, mapping(F.col(record)).cast(_TURNS)).otherwise(turns)
    return records.withColumn("__field_paths", fingerprint(F.col(record))).withColumns({"layout": name, "turns": turns}).drop("__field_paths")


def escaped(text: Column) -> Column:
    """Without the start of any mark; every backslash is doubled, so the step can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_turns(turns: DataFrame, key: str, order: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """One row per `key`: `formatted` and `loss_mask`, the (begin, length) in code points of each assistant text in it.

    Turns follow `order`, ties by role and text; repeated rows are repeated turns; null roles and texts are empty; a null key is
    a conversation of its own. One conversation is one row of the result, so its text has to fit a task; nothing else is
    gathered.
    """
    rows = turns.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)],
                        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    rows = rows.withColumns({"head": head, "body": escaped(F.col("text"))})
    rows = rows.withColumns({"piece": F.concat("head", "body", F.lit(END))})
    before = Window.partitionBy("key").orderBy(*[f"o{k}" for k in range(len(order))], "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))
    mask = F.when(F.col("role") == ASSISTANT, F.struct((F.col("begin") + F.char_length("head")).alias("begin"), F.char_length("body").cast("long").alias("length")))
    parts = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "piece"))).alias("parts"), F.sort_array(F.collect_list(mask)).alias("loss_mask"))
    return parts.select(F.col("key").alias(key), F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("formatted"), "loss_mask")


def read_back(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text holds."""
    def one(part):
        inner = F.substring(part, len(TURN) + 1, 1 << 30)
        role = F.substring_index(inner, BODY, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(inner, F.char_length(role) + len(BODY) + 1)).alias("text"))
    parts = F.split(formatted, r"<\|end\|>")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)
