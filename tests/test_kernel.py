"""The repair kernel: cases by phase."""

import dataclasses
import json
import random

import pytest

from jsonmend.kernel import nodes, texts
from jsonmend.kernel.engine import Limits, Options, RepairEngine, repair_text
from jsonmend.kernel.parser import LimitExceeded, TolerantParser
from jsonmend.kernel.schema import Schema, compile_schema, schema_of_type
from jsonmend.kernel.stream import StablePrefix
from jsonmend.kernel.values import dumps, is_document, parse

ENTRY = {"type": "object", "properties": {"at": {"type": "string"}, "said": {"type": "string"}, "level": {"type": "integer"}}, "required": ["said"]}
LOG = {"type": "object", "properties": {"entries": {"type": "array", "items": ENTRY}, "station": {"type": "string"}, "closed": {"type": "boolean"}}, "required": ["entries"]}
MOTTO = {"type": "object", "properties": {"motto": {"type": "string"}, "rank": {"type": "integer"}}, "required": ["motto"]}


def tolerant(text, schema=None, **more):
    return TolerantParser(text, Schema(schema) if schema else None, **more).parse()


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"value":[1,2', {"value": [1, 2]}),
        ('{"value":[1,2,]}', {"value": [1, 2]}),
        ("{value:'text'}", {"value": "text"}),
        ('{"first":1 "second":2}', {"first": 1, "second": 2}),
        ('{"outer":{"inner":[[]]}}', {"outer": {"inner": [[]]}}),
        ("[1],2]", [1, 2]),
        ("[[1],2]", [[1], 2]),
        ('{"a":1},"b":2}', {"a": 1, "b": 2}),
        ('{"a":1 // c\n,"b":2 /* d */}', {"a": 1, "b": 2}),
        ("{\"text\":'\\u0041'}", {"text": "A"}),
        ("{\"text\":'\\q'}", {"text": "\\q"}),
        ("{\"text\":'it\\'s'}", {"text": "it's"}),
        ('{"a" 1}', {"a": 1}),
        ('{"a":1,,"b":2}', {"a": 1, "b": 2}),
        ('{"n":12345678901234567890}', {"n": 1.2345678901234567e19}),
    ],
)
def test_tolerant_values(text, value):
    found = tolerant(text)
    assert found.ok and found.root == value


@pytest.mark.parametrize("text", ["", "null", "{'a':1}", '{"a":1,"a":2}', '{"x":1e400}', "{[}x", '{"a":foo}'])
def test_tolerant_failures(text):
    assert not tolerant(text).ok


@pytest.mark.parametrize(
    ("text", "schema", "check"),
    [
        ('{"entries":[{"at":"07:00","said":"fog"\n],"station":"pier 4"}', LOG, lambda v: v["entries"][0]["said"] == "fog" and v["station"] == "pier 4"),
        ('{"entries":[{"level":3,"said": wind from "Skagen";\nsea calm;\n"}]}', LOG, lambda v: v["entries"][0]["said"] == 'wind from "Skagen";\nsea calm;\n'),
        ('{"entries":[{"said":"the captain said "hold" twice"}]}', LOG, lambda v: v["entries"][0]["said"] == 'the captain said "hold" twice'),
        ('{"closed":true,"entries":[{"level":1,"said":"rain stop', LOG, lambda v: v == {"closed": True, "entries": [{"level": 1, "said": "rain stop"}]}),
        ('{"rank":1,"motto":"planks of 5" or less"}', MOTTO, lambda v: v["motto"] == 'planks of 5" or less'),
        ('{"rank":1,"motto": see D:\\tides\\new;', MOTTO, lambda v: "D:\\tides\\new" in v["motto"]),
        ('{"rank":1,"motto": at first \\"light\\";\\n up"}', MOTTO, lambda v: v["motto"] == 'at first "light";\n up'),
        ('{"rank":1,"motto":"caf\\u00e9', MOTTO, lambda v: v["motto"] == "caf\u00e9"),
        ('{"entries":[{"said":"ebb"}]]}', LOG, lambda v: v == {"entries": [{"said": "ebb"}]}),
        ('{"entries":[{"said":"ebb"}]}}', LOG, lambda v: v == {"entries": [{"said": "ebb"}]}),
        ('{"entries":"[{\\"said\\":\\"flood\\",\\"level\\":2}]","station": buoy nine', LOG, lambda v: v == {"entries": [{"said": "flood", "level": 2}], "station": "buoy nine"}),
    ],
)
def test_schema_guided_parse(text, schema, check):
    found = tolerant(text, schema)
    assert found.ok and check(found.root), found


def test_premature_closers_follow_the_schema():
    inner = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "required": ["a", "b"]}
    assert tolerant('{"outer":{"a":1},"b":2}}', {"type": "object", "properties": {"outer": inner}, "required": ["outer"]}).root == {"outer": {"a": 1, "b": 2}}
    own = {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}
    both = {"type": "object", "properties": {"outer": own, "b": {"type": "integer"}}, "required": ["outer", "b"]}
    assert tolerant('{"outer":{"a":1},"b":2}', both).root == {"outer": {"a": 1}, "b": 2}


def test_ancestor_property_closes_containers():
    leaf = {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}
    schema = {"type": "object", "properties": {"items": {"type": "array", "items": leaf}, "gaps": {"type": "array"}}, "required": ["items", "gaps"]}
    found = tolerant('{"items":[{"name":"x","gaps":[]}', schema)
    assert found.root == {"items": [{"name": "x"}], "gaps": []}
    assert any("before ancestor property 'gaps'" in c for c in found.corrections)


def test_limits():
    with pytest.raises(LimitExceeded, match="maximum nesting depth"):
        tolerant("[" * 513, depth=10_000)
    schema = {"type": "object", "properties": {"value": {"type": "object"}}}
    with pytest.raises(LimitExceeded):
        TolerantParser('{"value":"{broken: true}"}', Schema(schema), corrections=1).parse()
    tight = RepairEngine(Options(limits=Limits(input=5)))
    assert tight.repair('{"a":1}').error[0] == "limit"
    with pytest.raises(LimitExceeded):
        RepairEngine(Options(limits=Limits(input=5), failfast=True)).repair('{"a":1}')
    with pytest.raises(ValueError):
        Limits(depth=0)


@pytest.mark.parametrize(
    ("step", "text", "out"),
    [
        (texts.unwrap_fence, '```json\n{"a":1}\n```', '{"a":1}'),
        (texts.unwrap_fence, '```json\n{"a":1}', '{"a":1}'),
        (texts.unwrap_fence, '~~~JSON\r\n{"a":1}\r\n~~~~~\r\nTrailing prose.', '{"a":1}'),
        (texts.unwrap_fence, '```tool_call\n{"a":1}\n```', '{"a":1}'),
        (texts.unwrap_fence, '```csharp\n{"a":1}\n```', None),
        (texts.unwrap_fence, "plain text", None),
        (texts.plain_delimiters, "{“a”：true，“b”：null}", '{"a":true,"b":null}'),
        (texts.plain_delimiters, "\ufeff{}\u200b", "{}"),
        (texts.unwrap_xml, '<answer>{"ok": true}</answer>', '{"ok": true}'),
        (texts.unwrap_xml, '<a x="1"><![CDATA[{"ok":1}]]></A >', '{"ok":1}'),
        (texts.unwrap_xml, "<answer>{}</answering>", None),
        (texts.unwrap_xml, "prose <answer>{}</answer>", None),
        (texts.refuse_concatenation, '{"first": 1}]', '{"first": 1}'),
        (texts.strip_prose, 'As asked for {"gate": [12, "B"]}', '{"gate": [12, "B"]}'),
        (texts.strip_prose, '{"a":1}', None),
        (texts.verbatim_strings, '{"content": @"line1\nline2"}', '{"content": "line1\\nline2"}'),
        (texts.verbatim_strings, '{"a": @"x ""q"" y", "b": @"z"}', '{"a": "x \\"q\\" y", "b": "z"}'),
        (texts.template_strings, '{"a": `x\ny`, "b": `\\`q`}', '{"a": "x\\ny", "b": "`q"}'),
        (texts.template_strings, '{"a": "in ` side"}', None),
        (texts.salvage, "{name: None}", '{"name": null}'),
        (texts.salvage, "{'name': 'emit', 'count': 1}", '{"name": "emit", "count": 1}'),
        (texts.salvage, '{"a": 1 # c\n, "b": 2}', None),
    ],
)
def test_text_steps(step, text, out):
    found = step(text)
    if step is texts.salvage and out is None:
        assert parse(found.text) == {"a": 1, "b": 2}
    elif out is None:
        assert found.outcome == texts.NOT_APPLICABLE
    else:
        assert (found.outcome, found.text) == (texts.REPAIRED, out)


def test_concatenation_is_refused():
    found = texts.refuse_concatenation('{"first": 1}{"second": 2}')
    assert found.outcome == texts.FAILED and "ambiguous" in found.note


def test_adversarial_literals_end():
    assert texts.verbatim_strings("{" + '"k": @"value",' * 400).outcome in (texts.REPAIRED, texts.FAILED)
    many = "{" + ",".join(f'"k{n}": `v{n}`' for n in range(1000)) + "}"
    assert len(parse(texts.template_strings(many).text)) == 1000


@pytest.mark.parametrize(
    ("text", "schema", "confidence"),
    [
        ('{"a":1}', None, 1.0),
        ('{"a":1,}', None, 1.0),
        ('```json\n{"a":1}\n```', None, 0.95),
        ('<answer>{"a":1}</answer>', None, 0.665),
        ('Here: {"a":1}', None, 0.665),
        ('Here: {"a":1} bye', None, 0.63),
        ("{a:1}", None, 0.98),
        ('{"a":[1,2', None, 0.96),
        ('[{"gate": 12}, {"pier":', None, 0.96),
        ("{name: None}", None, 0.57),
        ('{"entries":"[3, 4]"}', '{"type":"object","required":["entries"],"properties":{"entries":{"type":"array","items":{"type":"string"}}}}', 0.84),
    ],
)
def test_confidence(text, schema, confidence):
    assert round(repair_text(text, schema).confidence, 6) == confidence


def test_untouched_text_keeps_its_bytes():
    text = ' {"a" : 1.50,\t"b":"é" } '
    assert repair_text(text).repaired_text == text and not repair_text(text).was_repaired


def test_failure_without_salvage():
    found = repair_text("not json at all", None, Options.without_salvage)
    assert not found.succeeded and found.confidence == 0 and found.shape_status == "NotEvaluated"
    with pytest.raises(ValueError):
        found.value_or_raise()
    assert not repair_text('[{"gate": 12}, {"pier":', None, lambda o: dataclasses.replace(o.without_salvage(), salvage_truncated=False)).succeeded


def test_steps_are_reported_once_in_order():
    found = repair_text('```json\n{"a":1}\n```')
    names = [r.name for r in found.text_repairs]
    assert names == [n for n, _ in (*texts.TEXT_STEPS, *texts.SALVAGE_STEPS)]
    assert [r.status for r in found.text_repairs] == ["Succeeded"] + ["Skipped"] * 7


def test_a_failing_step_is_contained():
    def bad(_):
        raise RuntimeError("boom")

    found = repair_text("{a:1}", None, lambda o: o.add("text", "bad", bad))
    assert found.succeeded and any(r.name == "bad" and r.note == "RuntimeError: boom" for r in found.text_repairs)


def run(schema, text, options=None):
    return RepairEngine(options or Options()).repair(text, Schema(schema))


def obj(required=(), closed=False, **properties):
    return {"type": "object", "properties": properties, "required": list(required)} | ({"additionalProperties": False} if closed else {})


INT, STR, NUM, BOOL = ({"type": t} for t in ("integer", "string", "number", "boolean"))


@pytest.mark.parametrize(
    ("schema", "text", "value"),
    [
        (obj(count=INT), '{"count":"42"}', {"count": 42}),
        (obj(flag=BOOL), '{"flag":"True"}', {"flag": True}),
        (obj(tags={"type": "array", "items": STR}), '{"tags":"red"}', {"tags": ["red"]}),
        (obj(status={"type": "string", "enum": ["Active", "Closed"]}), '{"status":"Actve"}', {"status": "Active"}),
        (obj(status={"type": "string", "enum": ["cat", "bat"]}), '{"status":"hat"}', {"status": "hat"}),
        (obj(closed=True, known=INT), '{"known":1,"invented":true}', {"known": 1}),
        (obj(items={"type": "array", "items": INT}), '{"items":"42"}', {"items": [42]}),
        (obj(items={"type": "array", "items": INT}), '{"items":"4.2"}', {"items": "4.2"}),
        (obj(items={"type": "array", "items": INT}), '{"items":true}', {"items": True}),
        (obj(n=NUM), '{"n":"1e400"}', {"n": "1e400"}),
    ],
)
def test_coercions(schema, text, value):
    found = run(schema, text, Options().with_coercions())
    assert found.value == value


def test_decimals_stay_exact():
    found = run(obj(n=NUM), '{"n":"2.5029078750958928222839028732"}', Options().with_coercions())
    assert found.repaired_text == '{"n":2.5029078750958928222839028732}'


@pytest.mark.parametrize(
    ("wanted", "given", "renamed"),
    [("query", "qurey", True), ("query", "Query", True), ("user_name", "user_nam", True), ("maxResults", "maxResult", True), ("id", "ix", False), ("query", "other", False)],
)
def test_required_reconciliation(wanted, given, renamed):
    found = run(obj([wanted], **{wanted: STR}), json.dumps({given: "x"}), Options().with_required_reconciliation())
    assert (found.value == {wanted: "x"}) is renamed


def test_required_reconciliation_coerces_and_refuses():
    options = Options().with_required_reconciliation()
    assert run(obj(["count"], count=INT), '{"cont":"42"}', options).value == {"count": 42}
    assert run(obj(["count"], count=INT), '{"cont":"x"}', options).value == {"cont": "x"}
    assert run(obj(["count"], count=INT), '{"cont":1,"coun":2}', options).value == {"cont": 1, "coun": 2}


def test_structural_reconciliation():
    options = Options().with_structural_reconciliation()
    forecast = obj(["city", "days"], city=STR, days=INT)
    assert run(obj(["forecast"], forecast=forecast), '{"payload":{"city":"Manila","days":3}}', options).value == {"forecast": {"city": "Manila", "days": 3}}
    assert run(obj(["tide"], tide={"enum": ["ebb", "flood"]}), '{"it_is":"flood"}', options).value == {"tide": "flood"}
    assert run(obj(["motto"], motto=STR), '{"it_is":"flood"}', options).value == {"it_is": "flood"}
    assert run(obj(["a", "b"], a=forecast, b=forecast), '{"payload":{"city":"M","days":3}}', options).value == {"payload": {"city": "M", "days": 3}}


def test_null_removal_and_rollback():
    schema = obj(["id"], id=STR, module=STR)
    assert run(schema, '{"id":"x","module":null}').value == {"id": "x"}
    assert run(schema, '{"id":null}').value == {"id": None}
    named = obj(["crew"], crew={"type": "array", "items": STR})
    only = Options(node_steps=(nodes.DEFAULT_STEPS[1],))
    rolled = run(named, '{"crew":"[8, 9, 10]"}', only)
    assert rolled.repaired_text == '{"crew":"[8, 9, 10]"}' and rolled.node_repairs[0].status == "Failed" and not rolled.is_repair_accepted


def test_option_order_and_validation():
    options = Options().with_coercions().with_structural_reconciliation().with_required_reconciliation()
    names = [n for n, _ in options.node_steps]
    assert names == [n for n, _ in (*nodes.DEFAULT_STEPS, nodes.REQUIRED_STEP, nodes.STRUCTURAL_STEP, *nodes.COERCION_STEPS)]
    with pytest.raises(ValueError):
        Options().add("text", "salvage-x", lambda t: None).add("text", "salvage-x", lambda t: None)
    with pytest.raises(ValueError):
        Options().insert_after("text", "nowhere", "x", lambda t: None)
    assert Options().insert_after("text", "markdown-json-fence", "x", lambda t: None).text_steps[1][0] == "x"
    assert not Options().remove("salvage", "salvage").salvage_steps


VESSELS = {"oneOf": [obj(["name", "load"], name={"const": "ferry"}, load=obj(cars=INT, lanes={"type": "array"})), obj(["name", "load"], name={"const": "tug"}, load=obj(pull=INT, rope=STR))]}


def test_unions():
    schema = Schema(VESSELS)
    assert schema.branch_for({"name": "tug"}).child("load").defines("rope")
    assert schema.branch_for({"name": "raft"}) is None
    text = '{"name":"tug","load":"{\\"pull\\":40,\\"rope\\":\\"hemp\\"}"}'
    assert nodes.expand_json_strings(parse(text), schema).value["load"] == {"pull": 40, "rope": "hemp"}
    assert nodes.expand_json_strings(parse(text.replace("tug", "ferry")), schema).outcome == texts.NOT_APPLICABLE


def test_schema_normalisation():
    schema = Schema({"$defs": {"user": obj(["id"], id=INT)}, "type": "object", "properties": {"owner": {"$ref": "#/$defs/user"}, "list": {"items": {"$ref": "#/$defs/user"}}}})
    assert schema.child("owner").requires("id") and schema.child("list").kind == "array" and schema.child("list").item().defines("id")
    loop = Schema({"type": "object", "properties": {"next": {"$ref": "#"}}})
    assert loop.child("next").kind == "object"
    folded = Schema({"allOf": [obj(["a"], a=INT), obj(["b"], b=STR)]})
    assert folded.required == ["a", "b"] and folded.kind == "object"
    assert Schema({"enum": [1, 2]}).kind == "string" and Schema({"type": "string", "nullable": True}).allows_null
    assert compile_schema("") is None and compile_schema("{bad") is None
    errors = Schema(obj(["a"], closed=True, a=INT, b={"type": "array", "items": STR})).errors({"b": [1], "c": 2})
    assert errors == ["$.a is required.", "$.b[0] expected string but found number.", "$.c is not declared by the schema."]


def test_schema_of_dataclass():
    @dataclasses.dataclass
    class Item:
        name: str
        count: int = 0
        tags: list[str] | None = None

    found = Schema(schema_of_type(Item))
    assert found.required == ["name"] and found.child("tags").kind == "array" and found.child("tags").allows_null


@pytest.mark.parametrize("cut", [1, 3, 7, 50])
def test_stream_deltas_are_contiguous(cut):
    text = 'Here is the payload: {"name": "svc-1", "replicas": [1, 2]} done.'
    scan, seen, out = StablePrefix(), "", ""
    for at in range(0, len(text), cut):
        seen += text[at : at + cut]
        found = scan.advance(seen)
        if found:
            assert found[0] == len(out)
            out += found[1]
    assert text.startswith(out) and scan.scanned == len(text) - 16


def test_nothing_is_emitted_inside_an_open_string():
    scan = StablePrefix()
    found = scan.advance('{"a": "open stri' + "x" * 40)
    assert found == (0, '{"a":')


def _random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return {f"k{n}": _random_value(rng, depth + 1) for n in range(rng.randrange(4))}
    if kind == 6:
        return [_random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.randrange(-999, 999), rng.random(), 'te"x\\t \u00e9\n'][kind]


def test_valid_documents_are_untouched_and_repair_is_idempotent():
    rng = random.Random(5)
    for _ in range(200):
        text = json.dumps({"a": _random_value(rng), "b": _random_value(rng)})
        assert repair_text(text).repaired_text == text
        for _ in range(3):
            at = rng.randrange(len(text))
            damaged = text[:at] + rng.choice(["", '"', "}", "]", ",", "x"]) + text[at + 1 :]
            found = repair_text(damaged)
            if found.succeeded:
                assert is_document(found.repaired_text)
                assert repair_text(found.repaired_text).repaired_text == found.repaired_text


def test_every_prefix_terminates():
    text = '{"closed":false,"entries":[{"said":"so \\"far\\", {so} // good"},{"level":-2}],"odd":[null,0.5,[]],"station":"x: y"}'
    for k in range(1, len(text) + 1):
        found = repair_text(text[:k], json.dumps(LOG))
        assert found.error is None
        assert not found.succeeded or is_document(found.repaired_text)


@pytest.mark.parametrize(
    ("given", "written"),
    [("1.50", "1.5"), ("-1.5e3", "-1500"), ("0.0001", "0.0001"), ("1e-5", "1E-05"), ("123456789012345.0", "123456789012345"), ("1e15", "1E+15"), ("9223372036854775808", "9.223372036854776E+18"), ("-0.0", "-0"), ("9223372036854775807", "9223372036854775807")],
)
def test_recovered_numbers_are_written_as_integers_or_shortest_doubles(given, written):
    assert repair_text(f"{{n:{given}}}").repaired_text == f'{{"n":{written}}}'


def test_dumps_keeps_spelling():
    assert dumps(parse('{"a":1.50,"b":1e5,"c":[]}')) == '{"a":1.50,"b":1e5,"c":[]}'


def test_names_that_rows_share_are_compared_once(monkeypatch):
    names = [f"shared_{n:02}" for n in range(12)]
    schema = json.dumps({"type": "object", "properties": {n: {"type": "integer"} for n in names}, "required": names})
    compared, fitted = [], []
    distance, prepared = nodes.distance, nodes.prepared
    monkeypatch.setattr(nodes, "distance", lambda *a, **k: compared.append(a) or distance(*a, **k))
    monkeypatch.setattr(nodes, "prepared", lambda *a: fitted.append(a) or prepared(*a))
    engine = RepairEngine(Options().with_required_reconciliation())
    for row in range(20):
        found = engine.repair(json.dumps({n.title(): row for n in names}), schema)
        assert found.value == {n: row for n in names} and found.shape_status == "Matched"
    assert len(compared) <= 12 * 12 and len(fitted) == 20 * 12


def test_a_value_that_the_nearest_name_refuses_goes_to_the_next():
    schema = {"type": "object", "properties": {"total": {"type": "array"}, "totals": {"type": "integer"}}, "required": ["total", "totals"]}
    found = nodes.reconcile_required({"Total": 5}, Schema(schema))
    assert found.value == {"totals": 5}


def test_edit_distance_without_shared_ends_is_the_plain_one():
    def plain(a, b, swaps):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    pick = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(pick.choice("abc") for _ in range(pick.randrange(7))) for _ in "ab")
        for most in (0, 1, 2):
            for swaps in (False, True):
                assert nodes.distance(a, b, most, swaps) == min(plain(a, b, swaps), most + 1)


def test_a_batch_repairs_a_repeated_text_once(monkeypatch):
    import pyarrow as pa

    from jsonmend.functions.repair import repaired
    from jsonmend.functions.result import ARROW_TYPE, as_array, as_row

    seen, repair = [], RepairEngine.repair
    monkeypatch.setattr(RepairEngine, "repair", lambda self, text, schema=None: seen.append(text) or repair(self, text, schema))
    schema = '{"type":"object","properties":{"k":{"type":"string"}}}'
    each = ["{a:1", None, "", "not json", '{"k":1,}', "{a:1", '```json\n{"a":1}\n```', "{'a':None}", '{"k":1', "[1,2", '{"a":"é😀",}', '{"k":1}']
    texts, schemas = each * 60, ([None] * len(each) + [schema] * len(each)) * 30
    got = repaired(texts, schemas, Options())
    assert len(seen) == 2 * len({t for t in each if t is not None})
    want = [None if t is None else as_row(RepairEngine().repair(t, s)) for t, s in zip(texts, schemas, strict=True)]
    assert got.type == ARROW_TYPE and got.equals(pa.array(want, ARROW_TYPE)) and got.to_pylist() == want
    assert as_array([]).to_pylist() == [] and as_array([None]).to_pylist() == [None]


def test_marks_are_read_without_a_pattern(monkeypatch):
    from jsonmend.kernel import parser

    tried, pattern = [], parser._TOKEN
    monkeypatch.setattr(parser, "_TOKEN", type("Counted", (), {"match": staticmethod(lambda text, at: tried.append(at) or pattern.match(text, at))}))
    assert tolerant('{"a" "b","c":[[],{}], k:1').root == {"a": "b", "c": [[], {}], "k": 1}
    assert len(set(tried)) == len(tried) <= 6


def test_names_without_escapes_are_read_by_one_pattern(monkeypatch):
    from jsonmend.kernel import parser

    monkeypatch.setattr(parser, "_PLAIN", None)  # the reader of runs between escapes
    assert tolerant('{"k" 1,"long name":2,"é":3,}').root == {"k": 1, "long name": 2, "é": 3}


def test_members_of_one_object_are_written_without_a_call_each(monkeypatch):
    from jsonmend.kernel import values

    calls, write = [], values._write
    monkeypatch.setattr(values, "_write", lambda value, out: (calls.append(value), write(value, out)))
    assert dumps({"k": 1, "s": 'a"b', "t": True, "n": None, "e": {}, "l": [1, "x"]}) == '{"k":1,"s":"a\\"b","t":true,"n":null,"e":{},"l":[1,"x"]}'
    calls.clear()
    assert dumps({"k": 1, "s": "O", "p": "1-URGENT"}) == '{"k":1,"s":"O","p":"1-URGENT"}' and len(calls) == 1


def test_steps_that_a_schema_rules_out_walk_no_value(monkeypatch):
    walked, rewrite = [], nodes._rewrite
    monkeypatch.setattr(nodes, "_rewrite", lambda value, *more: (walked.append(value), rewrite(value, *more))[1])
    schema = {"type": "object", "properties": {"k": {"type": "integer"}, "p": {"type": "string", "enum": ["HIGH", "LOW"]}}}
    found = repair_text('{"k":1,"p":"HGH"}', json.dumps(schema), Options.with_coercions)
    assert found.repaired_text == '{"k":1,"p":"HIGH"}'
    assert sum(isinstance(v, dict) for v in walked) == 3  # scalars, numbers, enums


def test_reach_sees_what_unions_references_and_items_hold():
    inner = {"anyOf": [{"type": "object", "properties": {"b": {"type": "boolean"}}, "additionalProperties": False}, {"type": "array", "items": {"enum": ["x"]}}]}
    for _ in range(24):  # each union shares its members with its branch
        inner = {"oneOf": [{"type": "object", "properties": {"n": inner}}]}
    schema = Schema(inner)
    assert {"object", "array", "boolean", "enum", "closed", "string"} <= schema.reach and "number" not in schema.reach
    assert "object" not in Schema({"type": "object", "properties": {"k": {"type": "integer"}}}).below
    assert "number" in Schema({"type": "object", "additionalProperties": {"type": "number"}}).below


def test_both_extractions_look_for_the_end_once():
    text = '{"k":[{"a":"}"},7' + "[" * 50
    texts.balanced_end.cache_clear()
    texts.refuse_concatenation(text), texts.strip_prose(text)
    assert texts.balanced_end.cache_info()[:2] == (1, 1)
    assert texts.balanced_end('{"a":"}\\"]"}x', 0) == 12 and texts.balanced_end('{"a":"\\', 0) is None


def test_verbatim_strings_are_quoted_without_an_encoder(monkeypatch):
    monkeypatch.setattr(texts.json, "dumps", None)
    assert texts.verbatim_strings('{"s":@"a""b\\c","t":1}').text == '{"s":"a\\"b\\\\c","t":1}'


def test_depth_is_counted_only_where_openers_are_many(monkeypatch):
    from jsonmend.kernel import values

    counted, depth = [], values.depth_of
    monkeypatch.setattr(values, "depth_of", lambda value: (counted.append(1), depth(value))[1])
    assert parse('{"k":1,"zz":"3-MEDIUM"}') and not counted
    assert not is_document("[" * 65 + "]" * 65) and is_document("[" * 64 + "]" * 64) and len(counted) == 1


def test_shape_errors_of_the_kept_value_are_found_once(monkeypatch):
    judged, errors = [], Schema.errors
    monkeypatch.setattr(Schema, "errors", lambda self, value: (judged.append(value), errors(self, value))[1])
    found = repair_text('{"k":1}', '{"type":"object","properties":{"k":{"type":"integer"}},"required":["s"]}')
    assert found.shape_errors == ["$.s is required."] and len(judged) == 1


def test_rows_share_the_reports_of_steps_that_did_not_apply():
    a, b = repair_text('{"k":1,"s":"O","p":'), repair_text('{"k":2,"s":"P","p":')
    assert a.text_repairs[:7] == b.text_repairs[:7] and all(x is y for x, y in zip(a.text_repairs[:7], b.text_repairs[:7], strict=True))


def test_texts_without_a_tag_are_not_searched_for_elements(monkeypatch):
    monkeypatch.setattr(texts, "_TAG", None)
    assert texts.unwrap_xml('{k:1,s:"O"}') is texts.SKIP


def test_template_strings_are_quoted_without_an_encoder(monkeypatch):
    monkeypatch.setattr(texts.json, "dumps", None)
    assert texts.template_strings('{"s":`a\\`"b`}').text == '{"s":"a`\\"b"}'


def test_strings_are_expanded_only_where_a_container_may_be(monkeypatch):
    asked = []
    monkeypatch.setattr(nodes, "parse", lambda text: (asked.append(text), parse(text))[1])
    flat, nested = ({"type": "object", "properties": {"p": {"type": kind, "items": {"type": "string"}}}} for kind in ("string", "array"))
    walked, rewrite = [], nodes._rewrite
    monkeypatch.setattr(nodes, "_rewrite", lambda value, *more: (walked.append(value), rewrite(value, *more))[1])
    assert nodes.expand_json_strings({"p": '["x"]'}, Schema(flat)) is nodes.NOTHING and not asked and not walked
    assert nodes.expand_json_strings({"p": '["x"]'}, Schema(nested)).value == {"p": ["x"]}
    assert nodes.expand_json_strings('{"p":"x"}', Schema(flat)).value == {"p": "x"}


def test_nulls_are_looked_for_before_the_walk(monkeypatch):
    schema = Schema({"type": "object", "properties": {"p": {"type": "string"}, "o": {"type": "object", "properties": {"q": {"type": "string"}}}}})
    assert nodes.remove_optional_nulls({"p": "x", "o": {"q": None}}, schema).value == {"p": "x", "o": {}}
    monkeypatch.setattr(nodes, "_rewrite", None)
    assert nodes.remove_optional_nulls({"p": 42, "o": {"q": [1]}}, schema) is nodes.NOTHING


def test_strings_are_sought_in_an_enum_without_a_comparison_each(monkeypatch):
    from jsonmend.kernel import schema as kernel_schema

    judge = Schema({"type": "object", "properties": {"e": {"enum": ["1", 2, None, True]}, "f": {"type": ["integer", "boolean"], "enum": [1]}}})
    assert judge.errors({"f": True}) and not judge.errors({"f": 1})
    monkeypatch.setattr(kernel_schema, "equal", None)
    assert not judge.errors({"e": "1"}) and judge.errors({"e": "2"}) == ["$.e did not match an allowed enum value."]


@pytest.mark.parametrize("text", ['{"k":1,"s":`O`}', '```json\n{"k":1}\n```', "<a>\n[1]\n</a>", '{"k":1}{"z":1}'])
def test_a_text_that_a_step_makes_valid_is_parsed_once(monkeypatch, text):
    from jsonmend.kernel import values

    read = []
    monkeypatch.setattr(values, "parse", lambda t: (read.append(t), parse(t))[1])
    found = RepairEngine().repair(text)
    assert found.succeeded and found.tolerant is None and found.value == parse(found.repaired_text)
    assert read == [text, found.repaired_text]


def test_members_that_a_step_keeps_are_not_compared(monkeypatch):
    from jsonmend.kernel import engine

    kept, lists = {"deep": [1, {"x": None}]}, [{"x": 1}]
    for before, after, wanted in (
        ({"k": 1, "o": kept, "p": 42}, {"k": 1, "o": kept, "p": "42"}, 1),
        ({"k": 1, "gone": 2, "l": lists}, {"k": True, "new": None, "more": 1, "l": lists}, 4),
        ({"l": [lists[0], 1, 2]}, {"l": [{"x": "1"}]}, 3),
        (kept, {"deep": [1, {"x": None}]}, 0),
    ):
        assert engine.changes(before, after, 10) == wanted
    compared, equal = [], engine.equal
    monkeypatch.setattr(engine, "equal", lambda a, b: (compared.append((a, b)), equal(a, b))[1])
    assert engine.changes({"k": 1, "o": kept, "p": 42}, {"k": 1, "o": kept, "p": "42"}, 10) == 1 and compared == [(42, "42")]
