"""JSON schemas over JSON values, compiled to Columns (G1).

A value is a VARIANT; a schema is compiled once, keyword by keyword, into an
expression that gives the first failure's message or null, so a validation is
one projection without Python. Values below the root are read from the root by
their path, those of an array inside a higher-order function; the message of a
failure below the root begins with its place (``$.tags[2]: ...``).

Keywords: type (one or several), enum, const, minLength, maxLength, pattern,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, required, properties,
additionalProperties (false), items, minItems, maxItems, anyOf, allOf, not.
The order of this list is the order in which they're tried; properties go by
their order in the schema, items by position. Objects and arrays are shown as
their JSON text, other values as Python prints them.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTES = {"$schema", "$id", "title", "description", "default", "examples"}
KEYWORDS = ("type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
            "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "anyOf", "allOf", "not")
TYPES = ("object", "array", "string", "boolean", "null", "integer", "number")


class SchemaError(ValueError):
    """A schema uses a keyword or a value that isn't supported."""


def quoted(s: Column) -> Column:
    """Python ``repr`` of a str: double quotes when the text has a single quote and no
    double quote, else single quotes (escaping ``'``); backslash, newline, CR and
    tab are escaped. Other non-printable characters are left as they are."""
    esc = s
    for raw, rep in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(raw), F.lit(rep))
    use_double = (F.instr(s, "'") > 0) & (F.instr(s, '"') == 0)
    return F.when(use_double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


class _Node:
    """A value's place: a VARIANT column, a path below it, and how messages name it."""

    def __init__(self, root: Column, path: str, name: Column | None) -> None:
        self.root, self.path, self.name = root, path, name
        self.kind = F.schema_of_variant(F.variant_get(root, path, "variant"))

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.root, self.path, kind)

    @property
    def exists(self) -> Column:
        return F.variant_get(self.root, self.path, "variant").isNotNull()

    def child(self, key: str) -> _Node:
        if "'" in key:
            raise SchemaError(f"property names with a quote aren't supported: {key}")
        place = F.lit(f".{key}")
        return _Node(self.root, f"{self.path}['{key}']", F.concat(F.lit("$"), place) if self.name is None else F.concat(self.name, place))

    def is_a(self, name: str) -> Column:
        number = ~self.kind.rlike("^(OBJECT|ARRAY|STRING|BOOLEAN|VOID)")
        whole = number & (self.get("double") == F.floor(self.get("double")))
        return {"object": self.kind.startswith("OBJECT"), "array": self.kind.startswith("ARRAY"), "string": self.kind == "STRING",
                "boolean": self.kind == "BOOLEAN", "null": self.kind == "VOID", "number": number, "integer": whole}[name]

    @property
    def shown(self) -> Column:
        return (F.when(self.is_a("string"), quoted(self.get("string"))).when(self.is_a("boolean"), F.initcap(self.get("string")))
                .when(self.is_a("null"), F.lit("None")).otherwise(F.to_json(self.get("variant"))))


def _python(value) -> str:
    return json.dumps(value) if isinstance(value, (dict, list)) else repr(value)


def _equals(node: _Node, value) -> Column:
    if isinstance(value, bool):
        return node.is_a("boolean") & (node.get("boolean") == value)
    if value is None:
        return node.is_a("null")
    if isinstance(value, (int, float)):
        return node.is_a("number") & (node.get("double") == float(value))
    if isinstance(value, str):
        return node.is_a("string") & (node.get("string") == value)
    raise SchemaError("enum and const take strings, numbers, booleans and null")


def _first(errors: list[Column]) -> Column:
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


def _compile(node: _Node, schema: dict) -> Column:
    """Message of the first failure at or below ``node``; null if there's none."""
    unknown = set(schema) - set(KEYWORDS) - NOTES
    if unknown:
        raise SchemaError(f"unsupported schema keywords: {sorted(unknown)}")

    def fails(when: Column, *message: Column | str) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        return F.when(F.coalesce(when, F.lit(False)), text if node.name is None else F.concat(node.name, F.lit(": "), text))

    def check(keyword: str, want) -> list[Column]:
        if keyword == "type":
            names = [want] if isinstance(want, str) else list(want)
            if not set(names) <= set(TYPES):
                raise SchemaError(f"unsupported type: {want}")
            good = reduce(lambda a, b: a | b, [F.coalesce(node.is_a(n), F.lit(False)) for n in names])
            return [fails(~good, node.shown, " is not of type " + ", ".join(f"'{n}'" for n in names))]
        if keyword == "enum":
            good = reduce(lambda a, b: a | b, [F.coalesce(_equals(node, v), F.lit(False)) for v in want])
            return [fails(~good, node.shown, f" is not one of {want!r}")]
        if keyword == "const":
            return [fails(~F.coalesce(_equals(node, want), F.lit(False)), _python(want), " was expected")]
        if keyword in ("minLength", "maxLength"):
            size = F.char_length(node.get("string"))
            wrong, word = (size < want, "short") if keyword == "minLength" else (size > want, "long")
            return [fails(node.is_a("string") & wrong, node.shown, f" is too {word}")]
        if keyword == "pattern":    # (?d): ``$`` may match before a final \n only, as in Python
            return [fails(node.is_a("string") & ~node.get("string").rlike("(?d)" + want), node.shown, f" does not match '{want}'")]
        if keyword in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            x, low = node.get("double"), keyword.endswith("inimum")
            strict = keyword.startswith("exclusive")
            wrong = {(True, False): x < want, (True, True): x <= want, (False, False): x > want, (False, True): x >= want}[low, strict]
            words = f" is {'less' if low else 'greater'} than {'or equal to ' if strict else ''}the {'minimum' if low else 'maximum'} of {want}"
            return [fails(node.is_a("number") & wrong, node.shown, words)]
        if keyword == "required":
            return [fails(node.is_a("object") & ~node.child(k).exists, f"'{k}' is a required property") for k in want]
        if keyword == "properties":
            return [F.when(node.is_a("object") & node.child(k).exists, _compile(node.child(k), s)) for k, s in want.items()]
        if keyword == "additionalProperties":
            if want is not False:
                raise SchemaError("additionalProperties can only be false")
            known = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
            extra = F.array_sort(F.array_except(F.map_keys(node.get("map<string,variant>")), known))
            names = F.array_join(F.transform(extra, quoted), ", ")
            return [fails(node.is_a("object") & (F.size(extra) > 0), "Additional properties are not allowed (", names,
                          F.when(F.size(extra) == 1, " was unexpected)").otherwise(" were unexpected)"))]
        if keyword == "items":
            name = F.lit("$") if node.name is None else node.name
            errors = F.transform(node.get("array<variant>"),
                                 lambda x, i: _compile(_Node(x, "$", F.concat(name, F.lit("["), i.cast("string"), F.lit("]"))), want))
            return [F.when(node.is_a("array"), F.get(F.array_compact(errors), F.lit(0)))]
        if keyword in ("minItems", "maxItems"):
            size = F.size(node.get("array<variant>"))
            wrong, word = (size < want, "short") if keyword == "minItems" else (size > want, "long")
            return [fails(node.is_a("array") & wrong, node.shown, f" is too {word}")]
        if keyword == "anyOf":
            none = reduce(lambda a, b: a & b, [_compile(node, s).isNotNull() for s in want])
            return [fails(none, node.shown, " is not valid under any of the given schemas")]
        if keyword == "allOf":
            return [_compile(node, s) for s in want]
        return [fails(_compile(node, want).isNull(), node.shown, f" should not be valid under {json.dumps(want)}")]

    return _first([c for k in KEYWORDS if k in schema for c in check(k, schema[k])])


def json_error(text: Column, schema: dict) -> Column:
    """The first failure of a JSON text under ``schema``; null if it's valid.

    A null text is the value None; a text that isn't JSON says so.
    """
    parsed = F.try_parse_json(F.coalesce(text, F.lit("null")))
    return F.when(parsed.isNull(), F.lit("output is not valid JSON")).otherwise(_compile(_Node(parsed, "$", None), schema))
