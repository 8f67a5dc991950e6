"""Operator 9, chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths (arrays as ``[]``).  The
hash of that set is its fingerprint, and a table of declarative mappings keyed
by fingerprint says where roles and texts lie.  Mappings list required and
optional paths, so the table holds one fingerprint for each allowed set; a
record whose fingerprint is not listed is returned with layout null and no
turns.

The template writes one block a turn::

    ### <role>: <text></turn>\\n

Inside roles and texts a backslash goes before every backslash, ``###`` and
``</turn>``; inside roles also before ``:``.  A reader that treats a backslash
and what it guards as one symbol therefore meets a bare ``</turn>`` only where
a turn ends, and reads the turns back exactly.  The loss mask is the list of
(start, end) code point spans of the assistants' texts in the formatted string.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.llm.common import read_table

END = "</turn>"
LEARNED_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``turns`` lists (role, paths) for flat layouts, a turn's text being its
    non-empty paths joined with a blank line; or ``items`` names the array and
    ``role`` and ``text`` the fields of its elements.  ``roles`` renames.
    """

    layout: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()


_SHAREGPT = (("human", "user"), ("gpt", "assistant"))
_USUAL = ("user", "assistant", "system")
MAPPINGS = (
    Mapping("prompt", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("question", "answer"), ("context",), (("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("messages", ("messages",), ("messages[].role", "messages[].content", "messages[]"), (), "messages", "role", "content"),
    Mapping("conversations", ("conversations",), ("conversations[].from", "conversations[].value", "conversations[]"), (), "conversations", "from", "value", _SHAREGPT),
)
#: Fields that may stand beside any layout without changing it.
IGNORED = ("id", "conv_id", "source")


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves and of all arrays; object order and repetition do not count."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix or "{}"}
    if isinstance(value, list):
        return {prefix}.union(*(field_paths(v, f"{prefix}[]") for v in value))
    return {prefix}


def fingerprint(paths) -> str:
    kept = sorted(p for p in paths if p not in IGNORED)
    return hashlib.blake2b("\x1f".join(kept).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def mapping_table(mappings=MAPPINGS) -> dict[str, Mapping]:
    """Fingerprint to mapping, for every allowed choice of optional paths."""
    table = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for extra in itertools.combinations(m.optional, n):
                table.setdefault(fingerprint((*m.required, *extra)), m)
    return table


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def declared_paths(mappings=MAPPINGS) -> frozenset[str]:
    return frozenset(p for m in mappings for p in (*m.required, *m.optional))


def canonical_turns(record, table: dict[str, Mapping], declared: frozenset[str] = declared_paths()) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, [(role, text)]) of a parsed record; (None, []) for an unknown layout.

    Where no mapping has the whole fingerprint, that of the paths which some
    mapping declares decides, so fields beyond them change nothing.
    """
    paths = field_paths(record) if isinstance(record, dict) else set()
    found = table.get(fingerprint(paths)) or table.get(fingerprint(paths & declared)) if paths else None
    if found is None:
        return None, []
    roles = dict(found.roles)
    if found.items:
        items = record[found.items]
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            return None, []
        turns = [(_string(x.get(found.role)), _string(x.get(found.text))) for x in items]
    else:
        turns = [
            (role, "\n\n".join(t for p in paths if (t := _string(record.get(p)))))
            for role, paths in found.turns
            if role != "system" or any(record.get(p) for p in paths)
        ]
    return found.layout, [(roles.get(role, role), text) for role, text in turns]


_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_GUARDED = re.compile(r"\\(\\|###|</turn>|:)")
_BODY = r"(?:[^\\<]+|\\(?:\\|###|</turn>|:)|<(?!/turn>))*+"
_TURN = re.compile(rf"### ((?:[^\\:]+|\\(?:\\|###|</turn>|:))*+): ({_BODY})</turn>\n")


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"\1", text) if "\\" in text else text


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, _ROLE_CONTROL)}: ", escape(text)
        if role == LEARNED_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string; ValueError if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at offset {at}")
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return turns


def masked_text(formatted: str, mask: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in mask)


_FORMATTED = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def format_records(records: DataFrame, id_col: str, record_col: str, mappings=MAPPINGS) -> DataFrame:
    """One row per input row: the id, ``layout``, ``formatted`` and ``loss_mask``.

    ``record_col`` holds a JSON object.  A null, invalid or unknown record, or one
    nested too deeply to be read, gives layout null, an empty string and an empty
    mask; undeclared fields beside a known layout are left out.  Null texts and roles count
    as empty; null ids and repeated rows pass through.
    """
    picked = records.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, declared = mapping_table(mappings), declared_paths(mappings)
        for batch in batches:
            layouts, texts, masks = [], [], []
            for raw in batch.column(1).to_pylist():
                try:
                    layout, turns = canonical_turns(json.loads(raw) if raw else None, table, declared)
                except (ValueError, RecursionError):
                    layout, turns = None, []
                text, mask = format_turns(turns)
                layouts.append(layout)
                texts.append(text)
                masks.append([{"start": a, "end": b} for a, b in mask])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(_FORMATTED))],
                ["id", "layout", "formatted", "loss_mask"],
            )

    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, layout string, formatted string, loss_mask array<struct<start:bigint,end:bigint>>"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, id_col: str) -> DataFrame:
    """Digests read back from ``format_records``' output: turns, loss text, length."""
    picked = formatted.select(F.col(id_col).alias("id"), "formatted", "loss_mask")
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = masked_text(text, [(m["start"], m["end"]) for m in mask])
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("id", id_col)


def pack_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): the turn rows of each conversation as one record.

    Records come in three layouts: one question with its answer as ``prompt`` and
    ``completion``; other conversations between the usual roles as
    ``conversations`` if the number of turns is even; all else as ``messages``.

    Turns are ordered by turn (null first), then role, then text; null roles and
    texts count as empty; repeated rows stay.  Rows with a null id form one
    conversation.  A conversation is one string in the end, so its rows meet in
    one record whatever their number.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    packed = rows.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    roles = F.col("turns")["role"]
    pair = F.struct(F.col("turns")[0]["content"].alias("prompt"), F.col("turns")[1]["content"].alias("completion"))
    names = F.create_map(*[F.lit(x) for name, role in (*_SHAREGPT, ("system", "system")) for x in (role, name)])
    spoken = F.transform("turns", lambda t: F.struct(names[t["role"]].alias("from"), t["content"].alias("value")))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    usual = F.forall(roles, lambda r: r.isin(*_USUAL)) & (F.size("turns") % 2 == 0)
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(pair["prompt"].alias("prompt"), pair["completion"].alias("completion"))))
        .when(usual, F.to_json(F.struct(spoken.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return packed.select(F.col("id").alias(id_col), record.alias("record"))


#: The added conversation: its texts hold the template's own marks.
TRAP_ID, TRAP_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(TRAP_ID, 0, "user", TRAP_TEXT), (TRAP_ID, 1, "assistant", TRAP_TEXT)], "conv_id long, turn long, role string, text string")
    packed = pack_conversations(rows.unionByName(trap))
    return read_back(format_records(packed, "conv_id", "record"), "conv_id")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(regexp_replace(role, '\\|###|</turn>|:', 'x', 'g')) - length(regexp_replace(role, '\\|###|</turn>|:', '', 'g'))
      + length(text) + length(regexp_replace(text, '\\|###|</turn>', 'x', 'g')) - length(regexp_replace(text, '\\|###|</turn>', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
