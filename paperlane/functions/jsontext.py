"""JSON found in model responses, held as VARIANT so that unknown keys survive."""

from __future__ import annotations

from . import values
from .sql import case, first_value, lit, struct

_END = "end-of-response"

FIELDS = "map<string,struct<kind:string,value:string,filled:boolean>>"


def _wrapped(text: str) -> str:
    """The text in an array with a marker behind it.

    The parser stops after the first value; the marker is found in second place only if the text was a single value.
    """
    return f"try_parse_json(concat('[', {text}, {lit(f',"{_END}"]')}))"


def _single_object(text: str) -> str:
    """VARIANT of one JSON object, else NULL."""
    wrapped = _wrapped(text)
    alone = f"try_variant_get(w, '$[1]', 'string') = '{_END}'"
    value = "try_variant_get(w, '$[0]', 'variant')"
    is_object = f"startswith(schema_of_variant({value}), 'OBJECT')"
    return first_value(wrapped, "w", f"IF({alone} AND {is_object}, {value}, NULL)")


def strict_object(text: str) -> str:
    """VARIANT of a string that is one JSON object and nothing else, else NULL.

    A failing parse is costly, so text without braces at both ends is not tried.
    """
    bare = f"btrim({text}, ' \\t\\n\\r')"
    return f"IF(startswith({bare}, '{{') AND endswith({bare}, '}}'), {_single_object(text)}, NULL)"


def brace_span(text: str) -> str:
    """From the first opening to the last closing brace; empty if there is none."""
    return f"regexp_extract({text}, {lit(r'(?s)\{.*\}')}, 0)"


def span_object(text: str) -> str:
    return _single_object(f"nullif({brace_span(text)}, '')")


def _kind(shape: str) -> str:
    return case(
        [
            (f"coalesce({shape}, 'VOID') = 'VOID'", "'null'"),
            (f"{shape} = 'STRING'", "'string'"),
            (f"{shape} = 'BOOLEAN'", "'boolean'"),
            (f"startswith({shape}, 'ARRAY')", "'array'"),
            (f"startswith({shape}, 'OBJECT')", "'object'"),
        ],
        "'number'",
    )


def filled(kind: str, value: str) -> str:
    """Whether a value counts as given: not null, false, zero or empty."""
    return case(
        [
            (f"{kind} = 'string'", f"{value} <> ''"),
            (f"{kind} = 'number'", f"coalesce(try_cast({value} AS double), 0D) <> 0D"),
            (f"{kind} = 'boolean'", f"{value} = 'true'"),
            (f"{kind} = 'array'", f"{value} <> '[]'"),
            (f"{kind} = 'object'", f"{value} <> '{{}}'"),
        ],
        "false",
    )


def entry(kind: str, value: str) -> str:
    return struct(kind=kind, value=value, filled=f"coalesce({filled(kind, value)}, false)")


def fields_of(record: str) -> str:
    """Top level of a VARIANT object as map<name, (kind, value, filled)>.

    An absent key is absent from the map; a JSON null is an entry of kind `null`. Numbers are written without exponent.
    """
    members = f"try_variant_get({record}, '$', 'map<string,variant>')"
    typed = first_value(
        struct(shape="schema_of_variant(v)", value="try_variant_get(v, '$', 'string')"),
        "t",
        first_value(
            struct(kind=_kind("t.shape"), value="t.value"),
            "u",
            first_value(f"IF(u.kind = 'number', {values.plain_number('u.value')}, u.value)", "plain", entry("u.kind", "plain")),
        ),
    )
    return f"transform_values({members}, (k, v) -> {typed})"


def drop_private_keys(members: str) -> str:
    """Map without the keys that start with an underscore."""
    return f"map_filter({members}, (k, v) -> NOT startswith(k, '_'))"


_PRIVATE = r'"(_|\\u005[fF])'  # how a private key begins, as it is or as an escape
_STRING, _SCALAR = r'"(?:[^"\\]|\\.)*"', r'[^\s{}\[\],":]+'
# A public member with a plain value is one token with its comma; else a key with its colon, a brace, a comma or a value.
_TOKEN = rf'"(?!_|\\u005[fF])(?:[^"\\]|\\.)*"\s*:\s*(?:{_STRING}|{_SCALAR})\s*,?|{_STRING}\s*:?|[{{}}\[\],]|{_SCALAR}'


def has_private(text: str) -> str:
    return f"{text} RLIKE {lit(_PRIVATE)}"


def _without_private(text: str) -> str:
    """Valid JSON text without private members, numbers as they were written, no blanks between tokens.

    One pass over the tokens with the depth so far and, within a private member, the depth it stands at. The comma
    behind such a member goes with it; a comma that is left before a closing brace is taken back.
    """
    state = lambda out, depth, drop: struct(out=out, depth=depth, drop=drop)
    deeper = "s.depth + IF(t IN ('{', '['), 1, IF(t IN ('}', ']'), -1, 0))"
    private = f"(endswith(t, ':') AND (startswith(t, '\"_') OR startswith(t, {lit('"' + chr(92) + 'u005f')}) OR startswith(t, {lit('"' + chr(92) + 'u005F')})))"
    taken = "concat(IF(t = '}' AND endswith(s.out, ','), left(s.out, length(s.out) - 1), s.out), t)"
    step = case(
        [
            (f"s.drop IS NULL AND {private}", state("s.out", "s.depth", "s.depth")),
            ("s.drop IS NULL", state(taken, deeper, "int(NULL)")),
            ("s.drop = s.depth AND t = ','", state("s.out", "s.depth", "int(NULL)")),
            ("s.drop = s.depth AND t = '}'", state(taken, "s.depth - 1", "int(NULL)")),
        ],
        state("s.out", deeper, "s.drop"),
    )
    tokens = f"regexp_extract_all({text}, {lit(_TOKEN)}, 0)"
    return f"aggregate({tokens}, {state("''", '0', 'int(NULL)')}, (s, t) -> {step}, s -> s.out)"


def drop_private_nested(text: str) -> str:
    """JSON text without underscore keys at any depth; text without such keys, or that is no JSON, is left alone."""
    is_json = f"coalesce(try_variant_get({_wrapped(text)}, '$[1]', 'string') = '{_END}', false)"
    return f"CASE WHEN {has_private(text)} AND {is_json} THEN {_without_private(text)} ELSE {text} END"


def public_object(text: str) -> str:
    """`strict_object` without private keys at any depth."""
    clean = f"try_parse_json({_without_private(text)})"
    return first_value(strict_object(text), "o", f"CASE WHEN o IS NOT NULL AND {has_private(text)} THEN {clean} ELSE o END")


def items_total(record: str, amount) -> str:
    """Sum of the line items' `total_price`; NULL if `items` is absent or no list, or if the sum is too large to be exact."""
    items = f"try_variant_get({record}, '$.items', 'array<variant>')"
    zero = f"cast(0 AS {values.MONEY})"
    price = "try_variant_get(item, '$.total_price', 'variant')"
    written = f"try_variant_get({price}, '$', 'string')"
    written = f"IF(schema_of_variant({price}) = 'STRING', {written}, {values.plain_number(written)})"
    added = f"try_cast(total + IF({price} IS NULL, {zero}, {amount(written)}) AS {values.MONEY})"
    return f"aggregate({items}, {zero}, (total, item) -> {added})"
