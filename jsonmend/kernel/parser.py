"""The tolerant parser: JSON with holes, guided by an optional schema.

An explicit stack of open containers is driven by one token at a time.  Each
repair is recorded as ``offset N: action`` and spends the correction budget.
``Broken`` unwinds to the container that waits for a value; with truncation
salvage on and the input used up, that container drops the member and closes.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from jsonmend.kernel.values import SPACES, utf16_length

HARD_DEPTH, HARD_CORRECTIONS = 512, 100_000
#: Characters that a look-ahead for a property name reads.
LOOKAHEAD = 1024


class LimitExceeded(Exception):
    """A depth, correction, input or output limit."""


class Broken(Exception):
    """No value can be read here."""


class Token(NamedTuple):
    kind: str  # a structural character, or num, true, false, null, word, other, end
    start: int
    end: int


_SPACE = "[" + re.escape(SPACES) + "]"
_SKIP = re.compile(rf"(?:{_SPACE}+|#[^\r\n]*|//[^\r\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_TOKEN = re.compile(r"(?P<mark>[{}\[\]:,\"'])|(?P<num>[-\d][-+.eE\d]*)|(?P<word>(?:[^\W\d]|\$)[\w$-]*)|(?P<other>.)", re.S)
#: Tokens of one character, the end, and what starts white space or a comment.
_MARKS = frozenset(["", *"{}[]:,\"'"])
_SKIPPED = frozenset(SPACES + "#/")
_NAME = re.compile(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"', re.S)
#: A quoted run without escapes.
_BARE = re.compile(r'"([^"\\]*+)"')
_PLAIN = re.compile(r'[^"\\]+')
_UNQUOTED = re.compile(r"[^'\\]+")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WHOLE = re.compile(r"[-+]?\d+")
_HEX = re.compile(r"[0-9a-fA-F]{4}")
_VALUE_STARTS = frozenset(["{", "[", '"', "'", "num", "true", "false", "null"])


_new = tuple.__new__  # a token without the call that names its parts


class Parsed(NamedTuple):
    """``root`` is meaningful only if ``ok``."""

    ok: bool
    root: object
    corrections: list[str]
    schema_strings: int
    outcome: str


class Budget:
    """Corrections left, shared with nested parses."""

    def __init__(self, most: int):
        self.most = min(most, HARD_CORRECTIONS)
        self.used = 0

    def spend(self) -> None:
        if self.used >= self.most:
            raise LimitExceeded(f"Tolerant recovery exceeded the maximum of {self.most} corrections.")
        self.used += 1


class _Open:
    """An open container: the value so far, its schema, and the property that waits for a value."""

    __slots__ = ("closer", "node", "schema", "item", "key", "mark", "waiting")

    def __init__(self, closer: str, schema):
        self.closer, self.schema = closer, schema
        self.node = {} if closer == "}" else []
        self.item = schema.item() if schema is not None and closer == "]" else None
        self.key, self.mark, self.waiting = None, 0, False


class TolerantParser:
    def __init__(self, text: str, schema=None, depth: int = 128, corrections: int = 10_000, salvage_truncated: bool = True, budget: Budget | None = None):
        self.text, self.schema = text, schema
        self.depth = min(depth, HARD_DEPTH)
        self.salvage_truncated = salvage_truncated
        self.budget = budget or Budget(corrections)
        self.at = 0
        self.memo: dict[int, Token] = {}
        self.ascii = text.isascii()
        self.wide = not self.ascii and any(c > "\uffff" for c in text)
        self.records: list[str] = []
        self.schema_strings = 0
        #: Closers and schemas of the open containers, innermost last.
        self.closers: list[str] = []
        self.shapes: list = []

    # ---- tokens

    def look(self, at: int | None = None) -> Token:
        if at is None:
            at = self.at
        token = self.memo.get(at)
        if token is None:
            text = self.text
            c = text[at : at + 1]
            if c in _MARKS:  # also at the end, where c is empty
                token = _new(Token, (c or "end", at, at + len(c)))
            else:
                start = _SKIP.match(text, at).end() if c in _SKIPPED else at
                m = _TOKEN.match(text, start)
                if m is None:
                    token = _new(Token, ("end", start, start))
                else:
                    kind = m.lastgroup
                    if kind == "mark":
                        kind = m.group()
                    elif kind == "word" and m.group() in ("true", "false", "null"):
                        kind = m.group()
                    token = _new(Token, (kind, start, m.end()))
            self.memo[at] = token
        return token

    def take(self, token: Token) -> None:
        self.at = token.end

    def record(self, at: int, action: str) -> None:
        self.budget.spend()
        self.records.append(f"offset {utf16_length(self.text[:at]) if self.wide else at}: {action}")

    # ---- look-ahead

    def name_at(self, token: Token) -> str | None:
        """The raw property name that starts at a token, if a colon follows it."""
        if token.kind == "word":
            return self.text[token.start : token.end] if self.look(token.end).kind == ":" else None
        if token.kind != '"':
            return None
        m = _NAME.match(self.text, token.start, token.end + LOOKAHEAD)
        return m.group(1) if m and self.look(m.end()).kind == ":" else None

    def property_at(self, start: int) -> bool:
        return self.name_at(self.look(start)) is not None

    @staticmethod
    def value_start(token: Token, schema) -> bool:
        return token.kind in _VALUE_STARTS or token.kind in ("word", "other") and schema is not None and schema.kind == "string"

    def continues(self, start: int, level: int) -> bool:
        """Whether what follows a comma fits the open container ``level`` steps out."""
        if level >= len(self.closers):
            return False
        token = self.look(start)
        if self.closers[-1 - level] == "}":
            return token.kind == "}" or self.property_at(token.start)
        return token.kind == "]" or self.value_start(token, None)

    def closes_string(self, quote: int) -> bool:
        """Whether the structure after a quote makes it the string's end."""
        token = self.look(quote + 1)
        if token.kind == "end":
            return True
        if token.kind == ",":
            return self.continues(token.end, 0)
        if token.kind not in ("}", "]"):
            return False
        level = 0
        while token.kind in ("}", "]"):  # replay the closers against the open containers
            outer = self.closers[::-1]
            if token.kind in outer[level:]:
                level = outer.index(token.kind, level) + 1
            token = self.look(token.end)
        if token.kind == "end":
            return True
        if token.kind != ",":
            return False
        if level >= len(self.closers):
            return self.property_at(self.look(token.end).start)
        return self.continues(token.end, level)

    def premature(self, token: Token, box: _Open) -> bool:
        """Whether a closer is better ignored, by a score of what follows it."""
        comma = self.look(token.end)
        if comma.kind != ",":
            return False
        after = self.look(comma.end)
        parent = self.shapes[-2] if len(self.shapes) > 1 else None
        parent_closer = self.closers[-2] if len(self.closers) > 1 else None
        here, there = (5 if parent_closer is None else 0), 1
        schema = box.schema
        if box.closer == "}":
            name = self.name_at(after)
            if not name or name in box.node:
                return False
            if schema is not None:
                here += 4 * schema.defines(name) + 3 * schema.requires(name)
            if parent is not None:
                there += 4 * parent.defines(name) + 2 * parent.requires(name)
        else:
            if not self.value_start(after, box.item) or parent_closer == "}" and self.property_at(after.start):
                return False
            if schema is not None and schema.kind == "array":
                here += 2
            if parent is not None and parent.kind == "array":
                there += 3
            elif parent_closer == "}":
                here += 4
        return here >= there + 2

    def belongs_outside(self, token: Token, schema) -> str | None:
        """The name of a property that only an outer container's schema declares."""
        if schema is None or not (schema.kind == "array" or schema.has_properties):
            return None
        name = self.name_at(token)
        if not name or schema.defines(name):
            return None
        return name if any(s is not None and s.defines(name) for s in self.shapes[:-1]) else None

    # ---- strings

    def escape(self, out: list[str], single: bool = False) -> None:
        text, at = self.text, self.at + 1
        if at >= len(text):
            out.append("\\")
            self.at = at
            return
        c = text[at]
        self.at = at + 1
        if c in _ESCAPES:
            out.append(_ESCAPES[c])
        elif c == "'" and single:
            out.append(c)
        elif c == "u" and _HEX.match(text, at + 1):
            out.append(chr(int(text[at + 1 : at + 5], 16)))
            self.at = at + 5
        else:
            out.append("\\" + c)

    def encoded(self) -> bool:
        """Whether a raw string shows escapes that only JSON encoding makes."""
        text, at = self.text, self.at
        while at < len(text):
            if text[at] == '"' and self.closes_string(at):
                return False
            if text[at] == "\\" and at + 1 < len(text):
                if text[at + 1] in '"\\/bfru':
                    return True
                at += 1
            at += 1
        return False

    def string(self, opened: bool, guided: bool) -> str:
        text = self.text
        self.at = self.look().start
        repaired = not opened
        if opened:
            self.at += 1
        else:
            self.record(self.at, "inserted opening string quote")
        decode = opened or guided and self.encoded()
        out: list[str] = []
        while self.at < len(text):
            c = text[self.at]
            if c == "\\":
                if decode:
                    self.escape(out)
                else:
                    out.append(c)
                    self.at += 1
            elif c == '"':
                if self.closes_string(self.at):
                    self.at += 1
                    self.schema_strings += guided and repaired
                    return _joined(out)
                out.append(c)
                self.record(self.at, "treated quote as embedded string content")
                repaired = True
                self.at += 1
            else:
                m = _PLAIN.match(text, self.at)
                out.append(m.group())
                self.at = m.end()
        self.record(self.at, "inserted closing string quote at end of input")
        self.schema_strings += guided
        return _joined(out)

    def single_quoted(self, token: Token) -> str:
        self.take(token)
        out: list[str] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "'":
                self.at += 1
                self.record(token.start, "converted single-quoted string")
                return _joined(out)
            if c == "\\":
                self.escape(out, single=True)
            else:
                m = _UNQUOTED.match(self.text, self.at)
                out.append(m.group())
                self.at = m.end()
        raise Broken

    def property_name(self) -> str:
        token = self.look()
        if token.kind == "word":
            self.take(token)
            self.record(token.start, "accepted unquoted property name")
            return self.text[token.start : token.end]
        if token.kind != '"':
            raise Broken
        if (m := _BARE.match(self.text, token.start)) is not None:
            self.at = m.end()
            return m.group(1) if self.ascii else _joined([m.group(1)])
        self.take(token)
        out: list[str] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self.escape(out)
            elif c == '"':
                self.at += 1
                return _joined(out)
            else:
                m = _PLAIN.match(self.text, self.at)
                out.append(m.group())
                self.at = m.end()
        raise Broken

    # ---- values

    def number(self, token: Token):
        self.take(token)
        spelled = self.text[token.start : token.end]
        try:
            value = int(spelled) if _WHOLE.fullmatch(spelled) else None
            if value is not None and -(1 << 63) <= value < 1 << 63:
                return value
            value = float(spelled)
        except ValueError:
            raise Broken from None
        if value in (float("inf"), float("-inf")):
            raise Broken
        return value

    def raw_string(self, token: Token) -> bool:
        """Whether a token in a string's place starts a string."""
        if token.kind in ('"', "word", "other"):
            return True
        if token.kind in ("num", "true", "false", "null"):
            return self.look(token.end).kind not in (",", "}", "]", "end")
        return False

    def expand(self, text: str, schema):
        """A container encoded as a string, parsed under the shared budget; None if it is none."""
        inner = schema.item() if schema.kind == "array" else schema
        nested = TolerantParser(text, inner, self.depth - len(self.closers), salvage_truncated=False, budget=self.budget)
        found = nested.parse()
        if not found.ok or not isinstance(found.root, list if schema.kind == "array" else dict):
            return None
        self.records += found.corrections
        self.schema_strings += 1
        return found.root

    def scalar(self, schema):
        """(True, value), or (False, token) at the start of a container."""
        token = self.look()
        kind = schema.kind if schema is not None else None
        if kind == "string" and self.raw_string(token):
            return True, self.string(token.kind == '"', True)
        if token.kind in ('"', "'"):
            value = self.string(True, False) if token.kind == '"' else self.single_quoted(token)
            if kind in ("array", "object"):
                expanded = self.expand(value, schema)
                if expanded is not None:
                    self.record(token.start, "expanded double-encoded JSON string into a schema-matching value")
                    return True, expanded
            return True, value
        if token.kind in ("{", "["):
            return False, token
        if token.kind == "num":
            return True, self.number(token)
        if token.kind in ("true", "false", "null"):
            self.take(token)
            return True, {"true": True, "false": False, "null": None}[token.kind]
        raise Broken

    def open(self, token: Token, schema) -> _Open:
        if len(self.closers) >= self.depth:
            raise LimitExceeded(f"Tolerant recovery exceeded the maximum nesting depth of {self.depth}.")
        self.take(token)
        box = _Open("}" if token.kind == "{" else "]", schema)
        self.closers.append(box.closer)
        self.shapes.append(schema)
        return box

    def insert_closer(self, at: int, name: str | None = None) -> None:
        closer = self.closers.pop()
        self.shapes.pop()
        self.record(at, f"inserted missing '{closer}'" + (f" before ancestor property '{name}'" if name is not None else ""))

    def step(self, box: _Open):
        """Read up to the next member: the member's schema, or ``box`` itself once it is closed."""
        while True:
            token = self.look()
            if box.schema is not None and box.closer == "]" and (name := self.belongs_outside(token, box.schema)) is not None:
                self.insert_closer(token.start, name)
                return box
            if token.kind == "end":
                self.insert_closer(token.start)
                return box
            if token.kind == box.closer:
                premature = self.premature(token, box)
                self.take(token)
                if premature:
                    found = "property for the current object" if box.closer == "}" else "value for the current array"
                    self.record(token.start, f"ignored premature '{box.closer}' after bounded lookahead found another {found}")
                    continue
                self.closers.pop()
                self.shapes.pop()
                return box
            if token.kind in ("}", "]"):
                if token.kind in self.closers[:-1]:
                    self.insert_closer(token.start)
                    return box
                self.take(token)
                self.record(token.start, f"ignored unmatched '{token.kind}'")
                continue
            if token.kind == ",":
                self.take(token)
                self.record(token.start, "ignored unexpected comma")
                continue
            if box.closer == "]":
                box.mark, box.waiting = token.start, True
                return box.item
            if box.schema is not None and (name := self.belongs_outside(token, box.schema)) is not None:
                self.insert_closer(token.start, name)
                return box
            box.key = self.property_name()
            token = self.look()
            box.mark, box.waiting = token.start, True
            if token.kind == ":":
                self.take(token)
            else:
                self.record(token.start, f"inserted ':' after property '{box.key}'")
            return box.schema.child(box.key) if box.schema is not None else None

    def add(self, box: _Open, value) -> bool:
        """Put a value into its container and read the separator; True if that closed the container."""
        box.waiting = False
        if box.closer == "}":
            if box.key in box.node:
                raise Broken
            box.node[box.key] = value
        else:
            box.node.append(value)
        token = self.look()
        if box.schema is not None and box.closer == "]" and (name := self.belongs_outside(token, box.schema)) is not None:
            self.insert_closer(token.start, name)
            return True
        if token.kind == ",":
            self.take(token)
        elif token.kind not in ("}", "]", "end"):
            if box.closer == "}" and self.property_at(token.start):
                self.record(token.start, "inserted ',' between object properties")
            elif box.closer == "]" and self.value_start(token, box.item):
                self.record(token.start, "inserted ',' between array values")
            else:
                raise Broken
        return False

    def drop(self, box: _Open) -> bool:
        """After a member failed: whether the container can close without it."""
        if not (box.waiting and self.salvage_truncated and self.look().kind == "end"):
            return False
        what = f"property '{box.key}'" if box.closer == "}" else "array element"
        self.record(box.mark, f"dropped incomplete {what} (input truncated)")
        return True

    def root(self):
        stack: list[_Open] = []
        schema, value, have = self.schema, None, False
        while True:
            try:
                if not have:
                    done, value = self.scalar(schema)
                    if not done:
                        stack.append(self.open(value, schema))
                    have = done
                while True:
                    if have:
                        if not stack:
                            return value
                        if self.add(stack[-1], value):
                            value = stack.pop().node
                            continue
                        have = False
                    found = self.step(stack[-1])
                    if found is stack[-1]:
                        value, have = stack.pop().node, True
                        continue
                    schema = found
                    break
            except Broken:
                while stack:
                    box = stack.pop()
                    if self.drop(box):
                        value, have = box.node, True
                        break
                else:
                    raise

    def parse(self) -> Parsed:
        try:
            root = self.root()
            while (token := self.look()).kind != "end":
                if token.kind not in (",", "}", "]"):
                    raise Broken
                self.take(token)
                self.record(token.start, f"ignored unmatched '{token.kind}'")
            if root is None:
                raise Broken
        except Broken:
            return Parsed(False, None, self.records, self.schema_strings, "failed: handwritten recovery could not rebuild a syntax tree")
        outcome = f"succeeded: handwritten recovery repaired {len(self.records)} token(s); recovered a syntax tree"
        if self.schema_strings:
            outcome = f"succeeded: schema-guided recovery repaired {self.schema_strings} string value(s); {outcome}"
        if self.records:
            outcome += f"; first correction: {self.records[0]}"
        return Parsed(True, root, self.records, self.schema_strings, outcome)


def _joined(parts: list[str]) -> str:
    """The string, with escaped surrogate pairs as one character."""
    text = "".join(parts)
    if not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text):
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text
