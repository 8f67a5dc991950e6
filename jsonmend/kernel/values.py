"""JSON values: strict parsing, compact serialisation, kinds and equality.

Objects are dicts, arrays lists.  A float keeps the spelling it was read with,
so that a number turned into a string, or written again, looks the same.
"""

from __future__ import annotations

import json
from decimal import Decimal
from json.encoder import encode_basestring as quoted

#: Nesting that the strict parser accepts.
STRICT_DEPTH = 64
#: White space of the text rules: Unicode's, without the four ASCII separators that Python adds.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Spelled(float):
    """A float with its source spelling."""

    __slots__ = ("text",)

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __reduce__(self):
        return Spelled, (self.text,)


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(parse_float=Spelled, parse_constant=_refuse)


def depth_of(value) -> int:
    """Nested containers, counted without recursion."""
    deepest, stack = 0, [(value, 1)]
    while stack:
        node, level = stack.pop()
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else None
        if inner is not None:
            deepest = max(deepest, level)
            stack.extend((x, level + 1) for x in inner if isinstance(x, (dict, list)))
    return deepest


def parse(text: str):
    """The value of strict JSON; ValueError otherwise.  A repeated key keeps its last value."""
    try:
        start = len(text) - len(text.lstrip(" \t\r\n"))
        value, end = _decoder.raw_decode(text, start)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    if end < len(text) and text[end:].strip(" \t\r\n"):
        raise ValueError("extra data")
    if text.count("{") + text.count("[") > STRICT_DEPTH and depth_of(value) > STRICT_DEPTH:
        raise ValueError("nested too deeply")
    return value


def parse_document(text: str):
    """Like ``parse``; a bare null is no document."""
    value = parse(text)
    if value is None:
        raise ValueError("null is not a document")
    return value


def is_json(text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def is_document(text: str) -> bool:
    try:
        return parse(text) is not None
    except ValueError:
        return False


def number_text(value) -> str:
    if isinstance(value, Spelled):
        return value.text
    return str(value) if isinstance(value, (int, Decimal)) else double_text(value)


def double_text(value: float) -> str:
    """The shortest digits of a double: plain from 1E-04 up to below 1E+15, else with an exponent of at least two digits."""
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    places, spelled = len(digits) + exponent - 1, "".join(map(str, digits))
    if not value:
        return "-0" if sign else "0"
    if not -5 < places < 15:
        tail = f".{spelled[1:]}" if len(spelled) > 1 else ""
        return f"{'-' * sign}{spelled[0]}{tail}E{'-' if places < 0 else '+'}{abs(places):02}"
    if exponent >= 0:
        return "-" * sign + spelled + "0" * exponent
    spelled = spelled.rjust(1 - exponent, "0")
    return f"{'-' * sign}{spelled[:exponent]}.{spelled[exponent:]}"


def dumps(value) -> str:
    """Compact JSON; numbers keep their spelling."""
    out: list[str] = []
    _write(value, out)
    return "".join(out)


def _write(value, out: list[str]) -> None:
    if value is None:
        out.append("null")
    elif isinstance(value, bool):
        out.append("true" if value else "false")
    elif isinstance(value, str):
        out.append(quoted(value))
    elif isinstance(value, dict):
        lead = "{"
        for k, v in value.items():
            if type(v) is str:
                out.append(f"{lead}{quoted(k)}:{quoted(v)}")
            elif type(v) is int:
                out.append(f"{lead}{quoted(k)}:{v}")
            else:
                out.append(f"{lead}{quoted(k)}:")
                _write(v, out)
            lead = ","
        out.append("}" if value else "{}")
    elif isinstance(value, list):
        out.append("[")
        for n, v in enumerate(value):
            if n:
                out.append(",")
            _write(v, out)
        out.append("]")
    else:
        out.append(number_text(value))


def is_number(value) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def is_integer(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63


def kind_of(value) -> str:
    """The JSON type name that shape errors state."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return "number"


def equal(a, b) -> bool:
    """Deep equality that keeps booleans and numbers apart; object order does not count."""
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def utf16_length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


def blank(text: str) -> bool:
    return not text.strip(SPACES)
