"""Strict reading of JSON documents.

A document is parsed once, by a schema that has the asked-for paths and VARIANT leaves. The leaves still know their
JSON type, so a number where a text is due rejects the document, as does any required field that is absent. The first
failing field, in the order the fields are listed, is the reason.

The stages are SQL text: a reader has some hundred expressions, and one text per stage keeps the driver's part short.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from donorlake.functions.stages import computed_once
from donorlake.functions.text import UUID_PATTERN
from donorlake.schemas import WIDE_MONEY

NOT_JSON = "not json"
_CORRUPT = "_corrupt"

_MONEY = WIDE_MONEY.simpleString()
_TYPED = {
    "text": "CASE WHEN {t} = 'STRING' THEN try_cast({n} AS STRING) END",
    "whole": "CASE WHEN {t} = 'BIGINT' OR endswith({t}, ',0)') THEN try_cast({n} AS BIGINT) END",
    "flag": "CASE WHEN {t} = 'BOOLEAN' THEN try_cast({n} AS BOOLEAN) END",
    "number": (
        "CASE WHEN {t} = 'STRING' THEN CASE WHEN try_cast({n} AS STRING) RLIKE "
        r"r'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$' THEN " + f"try_cast({{n}} AS {_MONEY}) END "
        f"WHEN {{t}} IN ('BIGINT', 'DOUBLE') OR startswith({{t}}, 'DECIMAL') THEN try_cast({{n}} AS {_MONEY}) END"
    ),
}


@dataclass(frozen=True)
class Field:
    """One field of a document.

    ``kind`` is text, whole, flag, number (a JSON number or a quoted one), object, or a DDL type for nested values.
    ``then`` is SQL over ``{v}`` that refines the value; a present value that it maps to null rejects the document.
    """

    name: str
    path: str
    kind: str = "text"
    required: bool = True
    then: str = "{v}"


def _schema(fields: Sequence[Field]) -> str:
    """DDL of the paths the fields ask for."""
    tree: dict = {}
    for field in fields:
        at = tree
        for part in field.path.removeprefix("$.").split("."):
            at = at.setdefault(part, {})

    def struct(node: dict, mark: str) -> str:
        return ", ".join(f"`{k}`{mark} {'STRUCT<' + struct(v, ':') + '>' if v else 'VARIANT'}" for k, v in node.items())

    return f"{struct(tree, '')}, {_CORRUPT} STRING"


def read_documents(df: DataFrame, raw: str, fields: Sequence[Field], asked: Collection[str] | None = None) -> DataFrame:
    """Add one column per field and ``problem``: null for a valid document, else the first reason to reject it.

    All fields are checked. With ``asked``, the plain texts that are not named there are checked only and given as null.
    """
    doc = "_document"
    # A root that is not an object is kept by the parser as far as it goes; it has no fields as far as we are concerned.
    faults = [
        f"WHEN {doc} IS NULL OR startswith(ltrim({raw}), '[') THEN '{NOT_JSON}'",
        f"WHEN {doc}.{_CORRUPT} IS NOT NULL AND try_parse_json({raw}) IS NULL THEN '{NOT_JSON}'",
    ]
    types, typed, final, columns = [], [], [], {}
    for i, field in enumerate(fields):
        node = f"{doc}.`{field.path.removeprefix('$.').replace('.', '`.`')}`"
        names = {"n": node, "t": f"_t{i}", "v": f"_v{i}"}
        if field.kind == "object":
            faults.append(f"WHEN {node} IS NULL THEN '{field.name}'")
            continue
        if asked is not None and field.name not in asked and field.kind == "text" and field.then == Field.then:
            accepted, absent = ("'STRING'", "true") if field.required else ("'STRING', 'VOID'", "false")
            faults.append(f"WHEN coalesce(schema_of_variant({node}) NOT IN ({accepted}), {absent}) THEN '{field.name}'")
            columns[field.name] = F.lit(None).cast("string")
            continue
        types.append(f"schema_of_variant({node}) AS _t{i}")
        typed.append(_TYPED.get(field.kind, f"try_cast({{n}} AS {field.kind})").format(**names) + f" AS _v{i}")
        final.append(field.then.format(**names) + f" AS _f{i}")
        present = "" if field.required else f" AND coalesce(_t{i} <> 'VOID', false)"
        faults.append(f"WHEN _f{i} IS NULL{present} THEN '{field.name}'")
        columns[field.name] = F.col(f"_f{i}")

    read = df.withColumn(doc, F.from_json(F.col(raw), _schema(fields), {"columnNameOfCorruptRecord": _CORRUPT}))
    for stage in (types, typed, final):
        read = read.selectExpr("*", *stage)
    problem = F.expr(f"CASE {' '.join(faults)} END")
    return computed_once(read, {**columns, "problem": problem}, keep=df.columns)


# --- refinements -----------------------------------------------------------------------------------------------------

UUID = f"CASE WHEN lower({{v}}) RLIKE '{UUID_PATTERN.replace('{', '{{').replace('}', '}}')}' THEN lower({{v}}) END"
ISO_TIME = "try_to_timestamp({v})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def one_of(table: Mapping[str, str], of: str = "{v}") -> str:
    """The value a small fixed table gives; unknown -> null."""
    return f"CASE {of} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in table.items()) + " END"


def member_of(members: Sequence[str] | None) -> str:
    """Member whose text this is: underscores and case do not count. Without a list, any text will do."""
    if members is None:
        return "{v}"
    if not members:
        return "CAST(NULL AS STRING)"
    return one_of({m.lower(): m for m in members}, of="lower(replace({v}, '_', ''))")
