"""Text steps: transport unwrapping and pseudo-literals, one function a step.

A step takes the text and returns an ``Attempt``.  The steps are pattern-driven:
each describes the damage it knows as a regular expression or a scan over the
structural characters that ``outline`` yields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from jsonmend.kernel.values import SPACES, is_document, is_json, quoted, utf16_length

NOT_APPLICABLE, FAILED, REPAIRED = "NotApplicable", "Failed", "Repaired"


class Attempt(NamedTuple):
    outcome: str
    text: str | None = None
    note: str | None = None


SKIP = Attempt(NOT_APPLICABLE)
_S = "[" + re.escape(SPACES) + "]"

# ---- fences

#: Fence labels that mark program code, not a payload.
CODE_LABELS = frozenset(
    "csharp cs c cpp python py javascript js typescript ts java rust go ruby bash shell sh sql html css xml yaml yml "
    "powershell ps1 kotlin swift php perl lua dart scala".split()
)
_FENCE = re.compile(rf"\ufeff?{_S}*(`{{3,}}|~{{3,}})([^\r\n]*?)[ \t]*(?:\r\n|\r|\n|\Z)")
_LABEL = re.compile(r"(?:[^\W_]|[-_./])+")


def unwrap_fence(text: str) -> Attempt:
    """``markdown-json-fence``: the body of a fence that starts the text."""
    if "```" not in text and "~~~" not in text:
        return SKIP
    opening = _FENCE.match(text)
    if opening is None:
        return SKIP
    run, label = opening.group(1), opening.group(2).strip(SPACES)
    if label and not (label.lower() in ("json", "jsonc", "application/json") or len(label) <= 24 and label.lower() not in CODE_LABELS and _LABEL.fullmatch(label)):
        return SKIP
    closing = re.compile(rf"(?:^|(?<=[\r\n]))[ \t]*{re.escape(run[0])}{{{len(run)},}}[ \t]*(?=[\r\n]|\Z)").search(text, opening.end())
    body = text[opening.end() : closing.start() if closing else len(text)].strip(SPACES)
    return Attempt(REPAIRED, body) if body else Attempt(FAILED, None, "The fence has no content.")


# ---- delimiters

#: Zero-width characters to delete, look-alike delimiters and what they stand for.
DELETED = "\ufeff\u200b\u200c\u200d"
LOOK_ALIKES = "\u201c\u201d\u201e\u201f\u2018\u2019\u201b\uff5b\uff5d\uff3b\uff3d\uff08\uff09\uff1a\uff0c"
STAND_FOR = "\"\"\"\"'''{}[]():,"
_DELIMITERS = str.maketrans(LOOK_ALIKES, STAND_FOR, DELETED)


def plain_delimiters(text: str) -> Attempt:
    """``unicode-delimiter-normalization``: everywhere, inside strings too."""
    if text.isascii():
        return SKIP
    out = text.translate(_DELIMITERS)
    return Attempt(REPAIRED, out) if out != text else SKIP


# ---- XML

_TAG = re.compile(r"<([^<>/ ][^<>/ ]*)[^<>]*>")
_CDATA = re.compile(r"<!\[CDATA\[(.*)\]\]>", re.S)
_SHELL = SPACES + "`~"


def unwrap_xml(text: str) -> Attempt:
    """``xml-wrapped-extraction``: the content of the one element around the payload."""
    opening = _TAG.search(text) if "<" in text else None
    if opening is None or text[: opening.start()].strip(_SHELL) or opening.group().endswith("/>"):
        return SKIP
    closing = re.compile(rf"</{re.escape(opening.group(1))}{_S}*>", re.I).search(text, opening.end())
    if closing is None or text[closing.end() :].strip(_SHELL):
        return SKIP
    body = text[opening.end() : closing.start()].strip(SPACES)
    wrapped = _CDATA.fullmatch(body)
    body = wrapped.group(1).strip(SPACES) if wrapped else body
    return Attempt(REPAIRED, body) if body else SKIP


# ---- concatenation and prose

#: Characters that the two extraction steps scan at most.
SCAN_LIMIT = 524_288
_STRUCTURE = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\Z)|([{\[])|([}\]])', re.S)
_OPENER, _OPENER_OR_QUOTE = re.compile(r"[{\[]"), re.compile(r'[{\["]')


def outline(text: str, start: int) -> Iterator[tuple[int, str]]:
    """(position, bracket) from ``start`` on, outside double-quoted strings."""
    for m in _STRUCTURE.finditer(text, start):
        if m.lastindex:
            yield m.start(), m.group()


@lru_cache(maxsize=2)
def balanced_end(text: str, start: int) -> int | None:
    """Position after the bracket that closes the one at ``start``; both kinds count alike.  Kept, since both extraction steps ask for it."""
    depth = 0
    for m in _STRUCTURE.finditer(text, start):
        kind = m.lastindex
        if kind is None:
            continue
        if m.start() >= SCAN_LIMIT:
            return None
        depth += 1 if kind == 1 else -1
        if depth == 0:
            return m.end()
    return None


def refuse_concatenation(text: str) -> Attempt:
    """``concatenated-json``: drops trailing junk, refuses a second value."""
    if utf16_length(text) > SCAN_LIMIT:
        return SKIP
    first = _OPENER_OR_QUOTE.search(text)
    if first is None or first.group() == '"':
        return SKIP
    end = balanced_end(text, first.start())
    if end is None or not text[end:].strip(SPACES):
        return SKIP
    if _OPENER.search(text, end):
        return Attempt(FAILED, None, "Several top-level JSON values were found; choosing one would be ambiguous.")
    return Attempt(REPAIRED, text[:end])


def strip_prose(text: str) -> Attempt:
    """``prose-wrapper-extraction``: the first container that is all there is but prose before it."""
    quotes, at = 0, 0
    for m in _OPENER.finditer(text, 0, SCAN_LIMIT):
        quotes += text.count('"', at, m.start())
        at = m.start()
        if quotes % 2:
            continue
        end = balanced_end(text, at)
        before = text[:at]
        if end is None:
            body, after = text[at:].rstrip(SPACES), ""
        else:
            body, after = text[at:end], text[end:]
            if after.lstrip(SPACES + "`~.!"):
                continue
        if before.strip(_SHELL) or after.strip(_SHELL):
            return Attempt(REPAIRED, body)
        return SKIP
    return SKIP


# ---- pseudo-literals

_VALUE_PLACE = re.compile(rf"[:\[,]{_S}*\Z")
_AFTER_VERBATIM = re.compile(rf'{_S}*(?:\Z|[}}\]]|,{_S}*(?:"(?:[^"\\]|\\.)*"{_S}*:|["\[{{@`]|[-\d]|true|false|null))', re.S)
_AFTER_TEMPLATE = re.compile(rf'{_S}*(?:\Z|[}}\]]|,{_S}*(?:\Z|[{{\[]|"(?:[^"\\]|\\.)*"{_S}*:))', re.S)
#: Bounds of the verbatim search: ends tried a literal, literals deep, candidates in all.
ENDS, NESTED, EXPANSIONS = 64, 32, 2048


def _in_value_place(text: str, at: int) -> bool:
    """Whether the last visible character before ``at`` lets a value follow."""
    k = at
    while k and text[k - 1] in SPACES:
        k -= 1
    return k > 0 and text[k - 1] in ":[,"


def _verbatim_starts(text: str, start: int) -> int:
    at = text.find('@"', start)
    while at >= 0 and not _in_value_place(text, at):
        at = text.find('@"', at + 2)
    return at


def verbatim_strings(text: str) -> Attempt:
    """``pseudo-csharp-verbatim-string``: ``@"…"`` values, ``""`` inside meaning a quote.

    Where a literal ends is guessed nearest first, depth first; the first choice
    that makes the whole text valid wins, else the nearest one of each stays.
    """
    if '@"' not in text or _verbatim_starts(text, 0) < 0:
        return SKIP
    left = [EXPANSIONS]

    def expand(current: str, start: int, level: int) -> tuple[str, bool]:
        at = _verbatim_starts(current, start)
        if at < 0 or level >= NESTED:
            return current, False
        ends = []
        k = current.find('"', at + 2)
        while k >= 0 and len(ends) < ENDS:
            if current[k + 1 : k + 2] == '"' and not _AFTER_VERBATIM.match(current, k + 1):
                k = current.find('"', k + 2)
                continue
            if _AFTER_VERBATIM.match(current, k + 1):
                ends.append(k)
            k = current.find('"', k + 1)
        nearest = None
        for end in ends:
            if left[0] <= 0:
                break
            left[0] -= 1
            literal = quoted(current[at + 2 : end].replace('""', '"'))
            candidate = current[:at] + literal + current[end + 1 :]
            if is_json(candidate):
                return candidate, True
            deeper, valid = expand(candidate, at + len(literal), level + 1)
            if valid:
                return deeper, True
            nearest = nearest or deeper
        return nearest or current, False

    out, _ = expand(text, 0, 0)
    return Attempt(REPAIRED, out) if out != text else Attempt(FAILED, None, "No end of a verbatim literal was found.")


_BACKTICK = re.compile(r"\\.|`", re.S)


def template_strings(text: str) -> Attempt:
    """``pseudo-javascript-template-string``: back-tick values; only an escaped back-tick is decoded."""
    if "`" not in text:
        return SKIP
    out, at = [], 0
    while (start := text.find("`", at)) >= 0:
        end = None
        if _in_value_place(text, start):
            for m in _BACKTICK.finditer(text, start + 1):
                if m.group() == "`" and _AFTER_TEMPLATE.match(text, m.end()):
                    end = m.start()
                    break
        if end is None:
            out.append(text[at : start + 1])
            at = start + 1
            continue
        out += [text[at:start], quoted(text[start + 1 : end].replace("\\`", "`"))]
        at = end + 1
    joined = "".join(out) + text[at:]
    return Attempt(REPAIRED, joined) if joined != text else SKIP


TEXT_STEPS = (
    ("markdown-json-fence", unwrap_fence),
    ("unicode-delimiter-normalization", plain_delimiters),
    ("xml-wrapped-extraction", unwrap_xml),
    ("concatenated-json", refuse_concatenation),
    ("prose-wrapper-extraction", strip_prose),
    ("pseudo-csharp-verbatim-string", verbatim_strings),
    ("pseudo-javascript-template-string", template_strings),
)

# ---- salvage

_WORD = r"(?:[^\W\d]|\$)[\w$]*"
_SALVAGE = re.compile(
    rf"""(?P<double>"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\Z))|(?P<comment>\#[^\r\n]*|//[^\r\n]*|/\*.*?(?:\*/|\Z))
    |'(?P<single>[^'\\]*+(?:\\.[^'\\]*+)*+)(?:'|\Z)|(?P<word>{_WORD})|(?P<control>[\x00-\x08\x0b\x0c\x0e-\x1f])""",
    re.S | re.X,
)
#: Literals of other languages and their JSON.
FOREIGN_WORDS = {"None": "null", "NaN": "null", "Infinity": "null", "True": "true", "False": "false"}
_CONTROLS = {c: json.dumps(chr(c))[1:-1] for c in range(32)}
_COLON = re.compile(rf"{_S}*:")
#: Closers that completion adds at most.
CLOSERS = 16


def _salvaged(m: re.Match) -> str:
    if m["double"] is not None:
        body = m["double"]
        closed = len(body) > 1 and body.endswith('"') and not _dangling(body)
        return body.translate(_CONTROLS) + ("" if closed else '"')
    if m["comment"] is not None:
        return " "
    if m["single"] is not None:
        body = m["single"].replace("\\'", "'")
        if '"' in body:
            return m.group()
        return '"' + body.translate(_CONTROLS) + '"'
    if m["word"] is not None:
        word = m["word"]
        if _COLON.match(m.string, m.end()):
            return f'"{word}"'
        return FOREIGN_WORDS.get(word) or f'"{word}"'
    return ""


def _dangling(run: str) -> bool:
    """Whether the last quote of a quoted run is escaped."""
    body = run[1:-1]
    return (len(body) - len(body.rstrip("\\"))) % 2 == 1


def close_containers(text: str) -> str:
    """The text with the closers it lacks, if they are few."""
    stack = []
    for _, c in outline(text, 0):
        if c in "{[":
            stack.append("}" if c == "{" else "]")
        elif stack and stack[-1] == c:
            stack.pop()
    return text + "".join(reversed(stack)) if 0 < len(stack) <= CLOSERS else text


def salvage(text: str) -> Attempt:
    """``salvage``: lossy clean-up of comments, quotes, words and missing closers."""
    cleaned = _SALVAGE.sub(_salvaged, text.lstrip("\ufeff").strip(SPACES))
    if not cleaned:
        return SKIP
    if not is_json(cleaned):
        first = next(outline_start(cleaned), 0)
        if first > 0:
            cleaned = cleaned[first:]
        if not is_json(cleaned):
            closed = close_containers(cleaned)
            cleaned = closed if is_json(closed) else cleaned
    return Attempt(REPAIRED, cleaned) if cleaned != text else SKIP


def outline_start(text: str) -> Iterator[int]:
    return (at for at, c in outline(text, 0) if c in "{[")


def strict_salvage(text: str) -> Attempt:
    """Our own variant: refuses prose, which ``salvage`` turns into one string."""
    found = salvage(text)
    return found if found.text and found.text.lstrip()[:1] in ("{", "[") and is_document(found.text) else SKIP


SALVAGE_STEPS = (("salvage", salvage),)
