"""The repair engine: options, the ordered phases, and the audited result.

Strict gate, text steps, tolerant parse, salvage, schema-guided node steps with
rollback, shape validation.  One text in, one ``Result`` out; a bad row becomes
an error in its result, never an exception, unless ``failfast`` is set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import NamedTuple

from jsonmend.kernel import nodes, texts
from jsonmend.kernel.parser import LimitExceeded, TolerantParser
from jsonmend.kernel.schema import Schema, compile_schema
from jsonmend.kernel.values import blank, dumps, equal, parse_document, utf16_length

SKIPPED, NOT_APPLICABLE, FAILED, SUCCEEDED = "Skipped", "NotApplicable", "Failed", "Succeeded"
NOT_EVALUATED, MATCHED, MISMATCHED = "NotEvaluated", "Matched", "Mismatched"
# Fixed value: the note on a candidate that no phase accepted.
SPECULATIVE = "Produced a speculative candidate that was not accepted by this phase."


@dataclass(frozen=True)
class Limits:
    """Most UTF-16 units in and out, nesting depth, and corrections."""

    input: int = 4_194_304
    output: int = 8_388_608
    depth: int = 128
    corrections: int = 10_000

    def __post_init__(self):
        if min(self.input, self.output, self.depth, self.corrections) <= 0:
            raise ValueError("limits must be positive")


Step = tuple[str, Callable]


@dataclass(frozen=True)
class Options:
    """Ordered steps of each phase, limits and the truncation policy; every change is a copy."""

    text_steps: tuple[Step, ...] = texts.TEXT_STEPS
    salvage_steps: tuple[Step, ...] = texts.SALVAGE_STEPS
    node_steps: tuple[Step, ...] = nodes.DEFAULT_STEPS
    limits: Limits = field(default_factory=Limits)
    salvage_truncated: bool = True
    failfast: bool = False

    PHASES = ("text", "salvage", "node")

    def _with(self, phase: str, steps) -> Options:
        if phase not in self.PHASES:
            raise ValueError(f"unknown phase {phase}")
        names = [n for n, _ in steps]
        if len(set(names)) < len(names):
            raise ValueError("a step is registered twice")
        if not all(callable(f) and isinstance(n, str) and n for n, f in steps):
            raise ValueError("a step is a name and a callable")
        return replace(self, **{f"{phase}_steps": tuple(steps)})

    def steps(self, phase: str) -> tuple[Step, ...]:
        return getattr(self, f"{phase}_steps")

    def add(self, phase: str, name: str, step: Callable) -> Options:
        return self._with(phase, [*self.steps(phase), (name, step)])

    def insert_after(self, phase: str, anchor: str, name: str, step: Callable) -> Options:
        at = [n for n, _ in self.steps(phase)]
        if anchor not in at:
            raise ValueError(f"no step {anchor} in the {phase} phase")
        k = at.index(anchor) + 1
        return self._with(phase, [*self.steps(phase)[:k], (name, step), *self.steps(phase)[k:]])

    def remove(self, phase: str, name: str) -> Options:
        if name not in [n for n, _ in self.steps(phase)]:
            raise ValueError(f"no step {name} in the {phase} phase")
        return self._with(phase, [s for s in self.steps(phase) if s[0] != name])

    def clear(self, phase: str) -> Options:
        return self._with(phase, [])

    def without_salvage(self) -> Options:
        return self.clear("salvage")

    def _ordered(self, extra) -> Options:
        """The canonical order: defaults, required and structural reconciliation, coercions, then the rest."""
        have = dict(self.node_steps) | dict(extra)
        rank = [n for n, _ in (*nodes.DEFAULT_STEPS, nodes.REQUIRED_STEP, nodes.STRUCTURAL_STEP, *nodes.COERCION_STEPS)]
        return self._with("node", sorted(have.items(), key=lambda s: rank.index(s[0]) if s[0] in rank else len(rank)))

    def with_coercions(self) -> Options:
        return self._ordered(nodes.COERCION_STEPS)

    def with_required_reconciliation(self) -> Options:
        return self._ordered([nodes.REQUIRED_STEP])

    def with_structural_reconciliation(self) -> Options:
        return self._ordered([nodes.STRUCTURAL_STEP])


class Report(NamedTuple):
    name: str
    status: str
    note: str | None = None


@lru_cache(maxsize=4096)
def _told(name: str, status: str) -> Report:
    """A report without a note, made once."""
    return Report(name, status)


class Tolerant(NamedTuple):
    succeeded: bool
    outcome: str
    correction_count: int
    schema_string_correction_count: int
    corrections: list[str]


@dataclass
class Result:
    """A repaired document and its audit."""

    succeeded: bool
    was_repaired: bool = False
    repaired_text: str | None = None
    value: object = None
    shape_status: str = NOT_EVALUATED
    shape_errors: list[str] = field(default_factory=list)
    text_repairs: list[Report] = field(default_factory=list)
    node_repairs: list[Report] = field(default_factory=list)
    tolerant: Tolerant | None = None
    error: tuple[str, str] | None = None

    @property
    def is_repair_accepted(self) -> bool:
        return self.succeeded and self.shape_status != MISMATCHED

    @property
    def succeeded_by(self) -> str | None:
        """The last step that succeeded, node steps first, if the result is accepted."""
        if not self.is_repair_accepted:
            return None
        for reports in (self.node_repairs, self.text_repairs):
            for r in reversed(reports):
                if r.status == SUCCEEDED:
                    return r.name
        return None

    @property
    def confidence(self) -> float:
        """0 if failed, 1 if untouched, else 1 less what each kind of change costs."""
        if not self.succeeded:
            return 0.0
        if not self.was_repaired:
            return 1.0
        done = [r.name for r in self.text_repairs if r.status == SUCCEEDED]
        shaped = [r.name for r in self.node_repairs if r.status == SUCCEEDED]
        corrections, strings = (self.tolerant.correction_count, self.tolerant.schema_string_correction_count) if self.tolerant else (0, 0)
        score = 1 - 0.05 * len(done) - min(0.30, 0.02 * corrections) - min(0.15, 0.03 * strings)
        score -= 0.08 * len(shaped) + 0.07 * (nodes.STRUCTURAL_STEP[0] in shaped)
        score *= 0.6 if "salvage" in done else 1
        score *= 0.7 if EXTRACTIONS & set(done) else 1
        score *= 0.5 if self.shape_status == MISMATCHED else 1
        return min(1.0, max(0.0, score))

    def is_confident(self, least: float) -> bool:
        return self.confidence >= least

    def value_or_raise(self):
        if self.error:
            raise ValueError(self.error[1])
        if not self.succeeded:
            raise ValueError("The text could not be repaired: " + ", ".join(f"{r.name}={r.status}" for r in self.text_repairs))
        return self.value

    def text_or_raise(self) -> str:
        self.value_or_raise()
        return self.repaired_text

    def object_or_raise(self) -> dict:
        """The value if it is an object."""
        if not isinstance(value := self.value_or_raise(), dict):
            raise ValueError("The repaired value is no object.")
        return value

    def array_or_raise(self) -> list:
        """The value if it is an array."""
        if not isinstance(value := self.value_or_raise(), list):
            raise ValueError("The repaired value is no array.")
        return value

    def check(self) -> Result:
        """This result, or ValueError if its parts contradict each other."""
        if self.succeeded:
            if self.repaired_text is None:
                raise ValueError("A success needs its text.")
            if not equal(parse_document(self.repaired_text), self.value):
                raise ValueError("Text and value of a success must be the same JSON value.")
        elif self.was_repaired:
            raise ValueError("A failure cannot count as repaired.")
        if self.error and self.succeeded:
            raise ValueError("A success cannot carry an error.")
        if (self.shape_status == MISMATCHED) != bool(self.shape_errors):
            raise ValueError("Shape errors and shape status must agree.")
        return self


#: Steps that choose part of a text.
EXTRACTIONS = {"concatenated-json", "prose-wrapper-extraction", "xml-wrapped-extraction"}


def changes(a, b, most: int) -> int:
    """Nodes that differ between two values; counting stops beyond ``most``."""
    count, stack = 0, [(a, b)]
    while stack and count <= most:
        x, y = stack.pop()
        if isinstance(x, dict) and isinstance(y, dict):
            both = 0
            for k, v in x.items():
                if k in y:
                    both += 1
                    if y[k] is not v:  # steps keep the nodes that they do not change
                        stack.append((v, y[k]))
            count += len(x) + len(y) - 2 * both
        elif isinstance(x, list) and isinstance(y, list):
            count += abs(len(x) - len(y))
            stack.extend(zip(x, y, strict=False))
        elif not equal(x, y):
            count += 1
    return count


class RepairEngine:
    """Applies one set of options to many texts."""

    def __init__(self, options: Options | None = None):
        self.options = options or Options()
        idle = lambda *phases: [Report(n, SKIPPED) for phase in phases for n, _ in self.options.steps(phase)]
        self._skipped, self._idle, self._unshaped = idle("text", "salvage"), idle("salvage"), idle("node")

    @classmethod
    def create(cls, configure: Callable[[Options], Options] | None = None) -> RepairEngine:
        return cls(configure(Options()) if configure else Options())

    def repair(self, text: str, schema: Schema | str | None = None) -> Result:
        """Repair one text; ``schema`` is compiled or a JSON Schema text."""
        if isinstance(schema, str):
            schema = compile_schema(schema)
        try:
            if blank(text):
                raise ValueError("The input is empty or white space.")
            size = utf16_length(text)
            if size > self.options.limits.input:
                raise LimitExceeded(f"Input length {size} exceeds the configured maximum of {self.options.limits.input} characters.")
            return self._repair(text, schema)
        except (LimitExceeded, ValueError) as e:
            if self.options.failfast:
                raise
            return Result(False, repaired_text=None, error=("limit" if isinstance(e, LimitExceeded) else "invalid_input", str(e)))

    # ---- phases

    def _parse(self, text: str, schema: Schema | None):
        limits = self.options.limits
        return TolerantParser(text, schema, limits.depth, limits.corrections, self.options.salvage_truncated).parse()

    @staticmethod
    def _run(steps, text: str, accept: Callable[[str], bool]) -> tuple[str, bool, list[Report]]:
        """Chain the steps until a text is accepted: (last text, accepted, one report a step)."""
        reports: list[Report] = []
        candidates: list[int] = []
        for n, (name, step) in enumerate(steps):
            try:
                found = step(text)
                if found is texts.SKIP:
                    reports.append(_told(name, NOT_APPLICABLE))
                    continue
                found = found if isinstance(found, texts.Attempt) else texts.Attempt(*found)
            except LimitExceeded:
                raise
            except Exception as e:  # a step must not fail its row
                reports.append(Report(name, FAILED, f"{type(e).__name__}: {e}"))
                continue
            if found.outcome != texts.REPAIRED:
                reports.append(Report(name, NOT_APPLICABLE if found.outcome == texts.NOT_APPLICABLE else FAILED, found.note))
                continue
            if found.text is None or blank(found.text) or found.text == text:
                reports.append(Report(name, FAILED, found.note or "The step returned no change."))
                continue
            text = found.text
            candidates.append(len(reports))
            reports.append(Report(name, FAILED, f"{found.note} {SPECULATIVE}" if found.note else SPECULATIVE))
            if accept(text):
                for k in candidates:
                    note = (reports[k].note or "").removesuffix(SPECULATIVE).strip() or None
                    reports[k] = Report(reports[k].name, SUCCEEDED, note)
                reports += [_told(name, SKIPPED) for name, _ in steps[n + 1 :]]
                return text, True, reports
        return text, False, reports

    def _repair(self, text: str, schema: Schema | None) -> Result:
        options = self.options
        try:
            return self._finish(text, text, parse_document(text), schema, list(self._skipped), None)
        except ValueError:
            pass
        read: list = []

        def whole(t: str) -> bool:
            try:
                read[:] = [parse_document(t)]
            except ValueError:
                return False
            return True

        candidate, accepted, reports = self._run(options.text_steps, text, whole)
        idle = self._idle
        if accepted:
            return self._finish(text, candidate, read[0], schema, reports + idle, None)
        ranked = []
        for order, t in enumerate(dict.fromkeys((candidate, text))):
            found = self._parse(t, schema)
            wrong = len(schema.errors(found.root)) if schema is not None and found.ok else 0
            ranked.append((not found.ok, wrong, len(found.corrections), order, t, found))
        failed, _, _, _, chosen, found = min(ranked, key=lambda r: r[:4])
        if not failed:
            if chosen == candidate and candidate != text:  # the chain's candidates led here
                reports = [Report(r.name, SUCCEEDED, (r.note or "").removesuffix(SPECULATIVE).strip() or None) if (r.note or "").endswith(SPECULATIVE) else r for r in reports]
            return self._finish(text, chosen, found.root, schema, reports + idle, found)
        last = chosen
        for start in dict.fromkeys((chosen, text)):
            kept: list = []

            def accept(t: str, kept=kept) -> bool:
                kept[:] = [self._parse(t, schema)]
                return kept[0].ok

            salvaged, accepted, more = self._run(options.salvage_steps, start, accept)
            if accepted:
                return self._finish(text, salvaged, kept[0].root, schema, reports + more, kept[0])
            last = salvaged
        return Result(False, repaired_text=last, text_repairs=reports + (more if options.salvage_steps else []), tolerant=_report(found))

    def _finish(self, original: str, text: str, value, schema: Schema | None, reports: list[Report], parsed) -> Result:
        tolerant = _report(parsed) if parsed is not None else None
        node_reports, shaped, errors = list(self._unshaped), value, []
        if schema is not None:
            shaped, errors, node_reports = self._shape(value, schema, len(parsed.corrections) if parsed else 0)
        changed = shaped is not value or text != original or parsed is not None
        out = dumps(shaped) if changed else original
        if utf16_length(out) > self.options.limits.output:
            raise LimitExceeded(f"Repaired output length {utf16_length(out)} exceeds the configured maximum of {self.options.limits.output} characters.")
        status = NOT_EVALUATED if schema is None else MISMATCHED if errors else MATCHED
        return Result(True, changed, out, shaped, status, errors, reports, node_reports, tolerant)

    def _shape(self, value, schema: Schema, spent: int):
        """Run the node steps in a chain; keep the shortest prefix with the fewest shape errors."""
        most = self.options.limits.corrections
        states = [(schema.errors(value), 0, value)]
        reports: list[Report] = []
        made: dict[int, int] = {}
        current = value
        for n, (name, step) in enumerate(self.options.node_steps):
            try:
                found = step(current, schema)
                if found is nodes.NOTHING:
                    reports.append(_told(name, NOT_APPLICABLE))
                    continue
                found = found if isinstance(found, nodes.NodeAttempt) else nodes.NodeAttempt(*found)
            except LimitExceeded:
                raise
            except Exception as e:  # a step must not fail its row
                reports.append(Report(name, FAILED, f"{type(e).__name__}: {e}"))
                continue
            if found.outcome != nodes.REPAIRED:
                reports.append(Report(name, NOT_APPLICABLE if found.outcome == nodes.NOT_APPLICABLE else FAILED, found.note))
                continue
            cost = changes(current, found.value, most)
            if not cost:
                reports.append(Report(name, FAILED, found.note or "The step returned no change."))
                continue
            if spent + sum(c for _, c, _ in states[1:]) + cost > most:
                raise LimitExceeded(f"Repair exceeded the maximum of {most} corrections.")
            current = found.value
            made[n] = len(states)
            states.append((schema.errors(current), cost, current))
            reports.append(Report(name, FAILED, found.note))
        wrong = [len(e) for e, _, _ in states]
        keep = wrong.index(min(wrong))
        for n, place in made.items():
            note = reports[n].note
            reports[n] = Report(reports[n].name, SUCCEEDED, note) if place <= keep else Report(reports[n].name, FAILED, f"{note} {SPECULATIVE}" if note else SPECULATIVE)
        return states[keep][2], states[keep][0], reports


def _report(parsed) -> Tolerant:
    return Tolerant(parsed.ok, parsed.outcome, len(parsed.corrections), parsed.schema_strings, list(parsed.corrections))


@lru_cache(maxsize=16)
def engine_for(options: Options) -> RepairEngine:
    return RepairEngine(options)


def repair_text(text: str, schema: str | None = None, configure: Callable[[Options], Options] | None = None) -> Result:
    """One-shot helper: builds an engine for a single call."""
    return RepairEngine.create(configure).repair(text, schema)
