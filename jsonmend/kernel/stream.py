"""The stable prefix of a growing JSON text.

A character is stable once nothing that arrives later can make a consumer
misread it: after a string closes inside a container, after brackets, colons and
commas, after a bare token.  The last ``HOLD`` characters wait, and nothing is
stable before the first container or once closers outnumber openers.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

#: Characters held back at the end of what has arrived.
HOLD = 16


@dataclass
class StablePrefix:
    """Scanner state: all of it is plain numbers and flags, so it can be stored."""

    scanned: int = 0
    emitted: int = 0
    depth: int = 0
    seen: bool = False
    string: bool = False
    escaped: bool = False
    bare: bool = False
    boundary: int = 0

    def advance(self, text: str) -> tuple[int, str] | None:
        """Scan what is new; the next (offset, slice) of stable text, if any."""
        end = max(self.scanned, len(text) - HOLD)
        for at in range(self.scanned, end):
            self._read(text[at], at)
        self.scanned = end
        if not self.seen or self.depth < 0 or self.boundary <= self.emitted:
            return None
        found = self.emitted, text[self.emitted : self.boundary]
        self.emitted = self.boundary
        return found

    def _read(self, c: str, at: int) -> None:
        if self.string:
            if self.escaped:
                self.escaped = False
            elif c == "\\":
                self.escaped = True
            elif c == '"':
                self.string = False
                if self.depth > 0:
                    self.boundary = at + 1
            return
        if self.bare and (c.isspace() or c in '{}[],:"'):
            self.bare = False
            if self.depth > 0:
                self.boundary = at
        if c == '"':
            self.string = True
        elif c in "{[":
            self.depth += 1
            self.seen = True
            self.boundary = at + 1
        elif c in "}]":
            self.depth -= 1
            if self.depth >= 0:
                self.boundary = at + 1
        elif c in ":,":
            if self.depth > 0:
                self.boundary = at + 1
        elif not c.isspace():
            self.bare = True

    def state(self) -> dict:
        return asdict(self)
