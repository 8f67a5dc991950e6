"""Node steps: schema-guided changes to a parsed value.

A step gets a value and its schema and returns an ``Attempt`` with a new value,
or says that it does not apply.  Values are never changed in place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from typing import NamedTuple

from jsonmend.kernel.schema import Schema
from jsonmend.kernel.texts import FAILED, NOT_APPLICABLE, REPAIRED
from jsonmend.kernel.values import SPACES, is_number, number_text, parse


class NodeAttempt(NamedTuple):
    outcome: str
    value: object = None
    note: str | None = None


NOTHING = NodeAttempt(NOT_APPLICABLE)
_UNCHANGED = object()


def _rewrite(value, schema: Schema | None, change: Callable, branches: bool = True):
    """The value with ``change`` applied to every node, outside in; the same object if nothing changed."""
    if schema is None:
        return value
    if branches and schema.branches:
        schema = schema.branch_for(value)
        if schema is None:
            return value
    changed = change(value, schema)
    if changed is not _UNCHANGED:
        value = changed
    if isinstance(value, dict):
        out = value
        for k, v in value.items():
            own = schema.child(k)
            if own is not None and (inner := _rewrite(v, own, change, branches)) is not v:
                if out is value:
                    out = dict(value)
                out[k] = inner
        return out
    if isinstance(value, list) and (item := schema.item()) is not None:
        items = [_rewrite(v, item, change, branches) for v in value]
        return items if any(a is not b for a, b in zip(items, value, strict=True)) else value
    return value


def _attempt(value, schema: Schema, change: Callable, branches: bool = True, note: Callable[[], str] | None = None) -> NodeAttempt:
    out = _rewrite(value, schema, change, branches)
    return NOTHING if out is value else NodeAttempt(REPAIRED, out, note() if note else None)


def _holds_null(value) -> bool:
    """Whether a null is inside a container of the value."""
    stack = [value]
    while stack:
        node = stack.pop()
        for v in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
            if v is None:
                return True
            if isinstance(v, (dict, list)):
                stack.append(v)
    return False


def _fits(value, schema: Schema) -> bool:
    return not schema.errors(value)


# ---- conversions

_INTEGER = re.compile(r"[-+]?[0-9]+")
_DECIMAL = re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")
#: Fixed value: the largest magnitude that a 96-bit decimal holds.
_LARGEST = Decimal("79228162514264337593543950335")


def to_number(text: str):
    """An integer or decimal spelled by a trimmed string, or None."""
    text = text.strip(SPACES)
    if _INTEGER.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if not _DECIMAL.fullmatch(text):
        return None
    try:
        found = Decimal(text)
    except InvalidOperation:
        return None
    if abs(found) > _LARGEST:
        return None
    return Decimal(format(found, "f")) if -28 <= found.adjusted() else Decimal(0)


def to_boolean(text: str) -> bool | None:
    return {"true": True, "false": False}.get(text.strip(SPACES).lower())


def prepared(value, schema: Schema):
    """(True, value that validates), trying number then boolean for strings; else (False, None)."""
    if _fits(value, schema):
        return True, value
    if isinstance(value, str):
        for found in (to_number(value), to_boolean(value)):
            if found is not None and _fits(found, schema):
                return True, found
    return False, None


# ---- default steps


def remove_optional_nulls(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-optional-null-removal``: nulls that a declared, optional property forbids."""

    def change(node, own: Schema):
        if not isinstance(node, dict):
            return _UNCHANGED
        gone = [k for k, v in node.items() if v is None and own.defines(k) and not own.requires(k) and own.child(k) is not None and not own.child(k).allows_null]
        return {k: v for k, v in node.items() if k not in gone} if gone else _UNCHANGED

    return _attempt(value, schema, change) if _holds_null(value) else NOTHING


def expand_json_strings(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-json-string-expansion``: a JSON text where a container belongs."""

    def change(node, own: Schema):
        if not isinstance(node, str) or own.kind not in ("array", "object"):
            return _UNCHANGED
        try:
            inner = parse(node)
        except ValueError:
            return _UNCHANGED
        right = isinstance(inner, list if own.kind == "array" else dict)
        return inner if right and own.accepts(inner) else _UNCHANGED

    if isinstance(value, str) and schema.branches:
        try:
            inner = parse(value)
        except ValueError:
            return NOTHING
        if isinstance(inner, (dict, list)) and schema.accepts(inner):
            return NodeAttempt(REPAIRED, _rewrite(inner, schema, change))
        return NOTHING
    if not isinstance(value, str) and not schema.below & {"array", "object"}:
        return NOTHING
    return _attempt(value, schema, change)


def scalars_to_strings(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-scalar-to-string``: numbers and booleans by their spelling."""
    if "string" not in schema.reach:
        return NOTHING
    count = [0]

    def change(node, own: Schema):
        if own.kind != "string" or not (isinstance(node, bool) or is_number(node)):
            return _UNCHANGED
        spelled = ("true" if node else "false") if isinstance(node, bool) else number_text(node)
        if _fits(node, own) or not _fits(spelled, own):
            return _UNCHANGED
        count[0] += 1
        return spelled

    return _attempt(value, schema, change, note=lambda: f"Converted {count[0]} scalar value(s) to strings.")


# ---- coercions


def wrap_arrays(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-array-wrap``: one value where an array of such values belongs."""
    if "array" not in schema.reach:
        return NOTHING

    def change(node, own: Schema):
        if own.kind != "array" or isinstance(node, list) or own.item() is None or node is None and own.allows_null:
            return _UNCHANGED
        done, inner = prepared(node, own.item())
        return [inner] if done else _UNCHANGED

    root = schema.branch_for(value) if schema.branches else schema
    return _attempt(value, root, change, branches=False) if root is not None else NOTHING


def strings_to_numbers(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-string-to-number``."""
    if "number" not in schema.reach:
        return NOTHING

    def change(node, own: Schema):
        if not isinstance(node, str) or own.kind != "number" or _fits(node, own):
            return _UNCHANGED
        found = to_number(node)
        return found if found is not None and _fits(found, own) else _UNCHANGED

    return _attempt(value, schema, change)


def strings_to_booleans(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-string-to-boolean``."""
    if "boolean" not in schema.reach:
        return NOTHING

    def change(node, own: Schema):
        if not isinstance(node, str) or own.kind != "boolean" or _fits(node, own):
            return _UNCHANGED
        found = to_boolean(node)
        return found if found is not None and (node is value or _fits(found, own)) else _UNCHANGED

    return _attempt(value, schema, change)


def distance(a: str, b: str, most: int, swaps: bool = False) -> int:
    """Edit distance, optionally with neighbour swaps; ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    start, tail = 0, 0  # what both share at either end costs nothing
    shorter = min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    while tail < shorter - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most and (not swaps or i > 1 and min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


#: Edits within which an enum member is recognised, and a property name.
ENUM_EDITS, NAME_EDITS = 2, 1


def closest_member(text: str, members: list) -> str | None:
    """The enum member a string means: equal but for case or spaces, else the only nearest within two edits."""
    names = [m for m in members if isinstance(m, str)]
    trimmed = text.strip(SPACES)
    for m in names:
        if m == text or m.lower() == text.lower() or m == trimmed:
            return m
    scored = [(distance(trimmed, m, ENUM_EDITS), m) for m in names]
    best = min((d for d, _ in scored), default=ENUM_EDITS + 1)
    found = [m for d, m in scored if d == best]
    return found[0] if best <= ENUM_EDITS and len(found) == 1 else None


def match_enums(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-enum-fuzzy-match``: not at the root."""
    if "enum" not in schema.reach:
        return NOTHING

    def change(node, own: Schema):
        if not isinstance(node, str) or node is value or not own.enum or node in own.enum:
            return _UNCHANGED
        found = closest_member(node, own.enum)
        return found if found is not None else _UNCHANGED

    return _attempt(value, schema, change)


def prune_unknown(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-unknown-property-prune``: where the schema closes an object."""
    if "closed" not in schema.reach:
        return NOTHING

    def change(node, own: Schema):
        if not isinstance(node, dict) or not own.closed or all(map(own.defines, node)):
            return _UNCHANGED
        return {k: v for k, v in node.items() if own.defines(k)}

    return _attempt(value, schema, change)


# ---- reconciliation

#: Mappings that a note lists, and characters of each.
LISTED, LISTED_CHARS = 8, 256


def _note(mappings: list[str]) -> str:
    shown = [m[:LISTED_CHARS] for m in mappings[:LISTED]]
    more = len(mappings) - LISTED
    return "; ".join(shown) + (f"; {more} additional mappings omitted" if more > 0 else "")


@lru_cache(maxsize=4096)
def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def _walk(value, schema: Schema, path: str, visit: Callable):
    """Pre-order rewriting of objects; stops at unions that do not resolve."""
    if schema is not None and schema.branches:
        schema = schema.branch_for(value)
    if schema is None:
        return value
    if isinstance(value, dict):
        value = visit(value, schema, path)
        inner = {k: _walk(v, schema.child(k), f"{path}.{k}", visit) for k, v in value.items()}
        return inner if any(inner[k] is not value[k] for k in value) else value
    if isinstance(value, list) and schema.item() is not None:
        items = [_walk(v, schema.item(), f"{path}[{k}]", visit) for k, v in enumerate(value)]
        return items if any(a is not b for a, b in zip(items, value, strict=True)) else value
    return value


def _renamed(node: dict, moves: dict[str, tuple[str, object]]) -> dict:
    """``node`` with keys moved to the end under their new names."""
    return {k: v for k, v in node.items() if k not in moves} | dict(moves.values())


def _loose_ends(node: dict, own: Schema) -> tuple[list[str], list[str]]:
    """Unknown keys, and required keys that are missing."""
    return [k for k in node if not own.defines(k)], [n for n in own.required if n not in node and own.child(n) is not None]


@lru_cache(maxsize=65_536)
def _near(name: str, wanted: str) -> int | None:
    """Edits between two names, or None if they are too many; kept, since rows share their names."""
    a, b = _plain(name), _plain(wanted)
    if not a or not b:
        return None
    most = NAME_EDITS if min(len(a), len(b)) >= 4 else 0
    d = distance(a, b, most, swaps=True)
    return d if d <= most else None


def reconcile_required(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-required-property-reconciliation``: near-miss names of missing required keys."""
    mappings: list[str] = []

    def visit(node: dict, own: Schema, path: str) -> dict:
        unknown, missing = _loose_ends(node, own)
        chosen: dict[str, list[tuple[str, object]]] = {}
        for key in unknown:
            near: dict[int, list[str]] = {}
            for name in missing:
                d = _near(key, name)
                if d is not None and (node[key] is not None or own.child(name).allows_null):
                    near.setdefault(d, []).append(name)
            top: list[tuple[str, object]] = []
            for d in sorted(near):  # the nearest names that the value fits
                tried = ((name, prepared(node[key], own.child(name))) for name in near[d])
                top = [(name, inner) for name, (done, inner) in tried if done]
                if top:
                    break
            if len(top) == 1:
                chosen.setdefault(top[0][0], []).append((key, top[0][1]))
        moves = {sources[0][0]: (name, sources[0][1]) for name, sources in chosen.items() if len(sources) == 1}
        if not moves:
            return node
        mappings.extend(f"{path}.{key} -> {path}.{name}" for key, (name, _) in moves.items())
        return _renamed(node, moves)

    out = _walk(value, schema, "$", visit)
    return NOTHING if out is value else NodeAttempt(REPAIRED, out, _note(mappings))


def _telling(target: Schema, value) -> bool:
    """Whether a value's shape alone points at a target."""
    if isinstance(value, dict):
        if not target.has_properties or not value or not all(map(target.defines, value)):
            return False
        narrow = lambda k: any(target.properties[k].get(w) is not None for w in ("const", "enum", "type")) if isinstance(target.properties[k], dict) else False
        return any(map(target.requires, value)) or any(map(narrow, value))
    if isinstance(value, list):
        return bool(value) and target.item() is not None and all(isinstance(v, dict) and _telling(target.item(), v) for v in value)
    return bool(target.enum) and value in target.enum


def reconcile_structure(value, schema: Schema) -> NodeAttempt:
    """``schema-guided-structural-property-reconciliation``: unrelated names, matched by shape alone."""
    mappings: list[str] = []

    def visit(node: dict, own: Schema, path: str) -> dict:
        unknown, missing = _loose_ends(node, own)
        fits = {k: [n for n in missing if node[k] is not None and _fits(node[k], own.child(n)) and _telling(own.child(n), node[k])] for k in unknown}
        picked = {k: names[0] for k, names in fits.items() if len(names) == 1}
        moves = {k: (n, node[k]) for k, n in picked.items() if sum(n in names for names in fits.values()) == 1}
        if not moves:
            return node
        out = _renamed(node, moves)
        if len(own.errors(out)) >= len(own.errors(node)):
            return node
        mappings.extend(f"{path}.{k} -> {path}.{n}" for k, (n, _) in moves.items())
        return out

    out = _walk(value, schema, "$", visit)
    return NOTHING if out is value else NodeAttempt(REPAIRED, out, _note(mappings))


DEFAULT_STEPS = (
    ("schema-guided-optional-null-removal", remove_optional_nulls),
    ("schema-guided-json-string-expansion", expand_json_strings),
    ("schema-guided-scalar-to-string", scalars_to_strings),
)
COERCION_STEPS = (
    ("schema-guided-array-wrap", wrap_arrays),
    ("schema-guided-string-to-number", strings_to_numbers),
    ("schema-guided-string-to-boolean", strings_to_booleans),
    ("schema-guided-enum-fuzzy-match", match_enums),
    ("schema-guided-unknown-property-prune", prune_unknown),
)
REQUIRED_STEP = ("schema-guided-required-property-reconciliation", reconcile_required)
STRUCTURAL_STEP = ("schema-guided-structural-property-reconciliation", reconcile_structure)

__all__ = ["FAILED", "NodeAttempt", "NOTHING", "DEFAULT_STEPS", "COERCION_STEPS", "REQUIRED_STEP", "STRUCTURAL_STEP"]
