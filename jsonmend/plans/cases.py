"""Cases of damage and schema, each a text with ``<K>`` for the order key: (text, repaired text, corrections, confidence[, schema]).

``repaired text`` None means that no text comes back; a failing row has
confidence 0 and keeps its last text.
"""

from __future__ import annotations


def _object(properties: str, required: str = "") -> str:
    return f'{{"type":"object","properties":{{{properties}}}' + (f',"required":[{required}]' if required else "") + "}"


_INT, _STR = '{"type":"integer"}', '{"type":"string"}'
_LIST = '{"type":"array","items":{"type":"integer"}}'
_KS = _object(f'"k":{_INT},"s":{_STR},"t":{_INT}')
_B = _object(f'"b":{_INT}')
_NESTED = _object(f'"a":{_B},"c":{_INT},"d":{_INT}')
_NEEDED = _object(f'"a":{_B},"c":{_INT},"d":{_INT}', '"c","d"')
_LISTED = _object(f'"l":{{"type":"array","items":{_B}}},"c":{_INT}')
_K = _object(f'"k":{_INT}')

#: Objects: premature and stray closers, commas, re-parenting, names, duplicates.
OBJECTS = [
    ('{"a":{"b":<K>},"c":1,},"d":2}', '{"a":{"b":<K>},"c":1,"d":2}', 2, 0.96, _NEEDED),
    ('{k:<K>],s:"x"}', '{"k":<K>}', 3, 0.623, None),
    ('[{"k":<K>],', '[{"k":<K>}]', 2, 0.96, None),
    ('{,"k":<K>,,"s":1}', '{"k":<K>,"s":1}', 2, 0.96, None),
    ('{"a":{"b":<K>,"c":1}', '{"a":{"b":<K>},"c":1}', 2, 0.96, _NESTED),
    ('{"l":[{"b":<K>,"c":1}', '{"l":[{"b":<K>}],"c":1}', 3, 0.94, _LISTED),
    ('{"k\\u0041":<K>,}', '{"kA":<K>}', 0, 1.0, None),
    ('{"k":<K>,"k":1,}', '{"k":<K>,"k":1,}', 0, 0.0, None),
    ('[1,{"k":<K>,"s":', '[1,{"k":<K>}]', 2, 0.96, None),
]
#: Arrays: closers, commas, ends.
ARRAYS = [
    ("[1,,<K>,]", "[1,<K>]", 1, 0.98, None),
    ("[<K>,2", "[<K>,2]", 1, 0.98, None),
    ('{"l":[<K>},"c":1', '{"l":[<K>],"c":1}', 4, 0.92, _object(f'"l":{_LIST},"c":{_INT}')),
    ("[<K>},2]", "[<K>]", 2, 0.637, None),
    ('[1,<K>,"a', '[1,<K>,"a"]', 2, 0.96, None),
    ('{"a":[<K>,{"b":', '{"a":[<K>,{}]}', 3, 0.94, None),
    ("[<K> 2 3]", "[<K>,2,3]", 2, 0.96, None),
]
#: Strings: raw ones, evidence of escapes, escapes, single quotes.
STRINGS = [
    ('{"k":<K>,"s":free text, with comma","t":1}', '{"k":<K>,"s":"free text, with comma","t":1}', 1, 0.95, _KS),
    ('{"s":C:\\temp\\new","k":<K>}', '{"s":"C:\\\\temp\\\\new","k":<K>}', 1, 0.95, _KS),
    ('{"s":say \\"hi\\" now","k":<K>}', '{"s":"say \\"hi\\" now","k":<K>}', 1, 0.95, _KS),
    ('{k:"a\\q\\u00zz\\n<K>"}', '{"k":"a\\\\q\\\\u00zz\\n<K>"}', 1, 0.98, None),
    ("{k:'it\\'s <K>'}", '{"k":"it\'s <K>"}', 2, 0.96, None),
    ('{"k":<K>,"s":"open', '{"k":<K>,"s":"open"}', 2, 0.96, None),
]
#: Numbers, literals, containers inside strings.
VALUES = [
    ("{k:<K>,a:-1.5e3,b:9223372036854775808}", '{"k":<K>,"a":-1500,"b":9.223372036854776E+18}', 3, 0.94, None),
    ("{k:<K>,a:true,b:false,c:null}", '{"k":<K>,"a":true,"b":false,"c":null}', 4, 0.92, None),
    ('{k:<K>,"l":"[1,2,]"}', '{"k":<K>,"l":[1,2]}', 2, 0.93, _object(f'"k":{_INT},"l":{_LIST}')),
    ('{k:<K>,"o":"{a:1}"}', '{"k":<K>,"o":{"a":1}}', 3, 0.91, _object(f'"k":{_INT},"o":{{"type":"object"}}')),
]
#: Salvage: byte-order mark, comments, control characters, bare words, prose, missing closers.
SALVAGE = [
    ("\ufeff  {'k':<K>}  ", '{"k":<K>}', 0, 0.57, None),
    ("{'k':<K>, // note\n 'b':1 /* c */ # tail\n}", '{"k":<K>,"b":1}', 0, 0.57, None),
    ("{'k':<K>,\"s\":\"a\tb\nc\"}", '{"k":<K>,"s":"a\\tb\\nc"}', 0, 0.57, None),
    ("{'k':<K>,'s':hello}", '{"k":<K>,"s":"hello"}', 0, 0.57, None),
    ("{'k':<K>,'t':true}", '{"k":<K>,"t":"true"}', 0, 0.57, None),
    ("{'k':\x01<K>\x02}", '{"k":<K>}', 0, 0.57, None),
    ("Answer follows 'k': {'k':<K>}", '{"k":<K>}', 0, 0.57, None),
    ("{'k':[<K>,{'a':1", '{"k":[<K>,{"a":1}]}', 0, 0.57, None),
]
#: Without salvage: texts that cannot be recovered keep their last form.
FAILURES = [
    ("not json <K>", "not json <K>", 0, 0.0, None),
    ('{"k":<K>,"k":1,}', '{"k":<K>,"k":1,}', 0, 0.0, None),
    ("{'k':<K>}", "{'k':<K>}", 0, 0.0, None),
    ("  ", None, 0, 0.0, None),
    ("{a:" + "[" * 200 + "<K>", None, 0, 0.0, None),
]
#: Schemas: references with siblings, pointers and cycles, allOf, unions, inferred and nullable types, enums; with coercions.
SCHEMAS = [
    ('{"k":"<K>"}', '{"k":<K>}', 0, 0.92, _object('"k":{"$ref":"#/$defs/n"}')[:-1] + f',"$defs":{{"n":{_INT}}}}}'),
    ('{"k":"<K>"}', '{"k":<K>}', 0, 0.92, _object('"k":{"$ref":"#/$defs/n","type":"integer"}')[:-1] + f',"$defs":{{"n":{_STR}}}}}'),
    ('{"k":"<K>"}', '{"k":<K>}', 0, 0.92, _object('"k":{"$ref":"#/$defs/a~1b/anyOf/1"}')[:-1] + f',"$defs":{{"a/b":{{"anyOf":[{_STR},{_INT}]}}}}}}'),
    ('{"k":"<K>"}', '{"k":"<K>"}', 0, 1.0, _object('"k":{"$ref":"#/$defs/none"}')),
    ('{"k":"<K>","next":{"k":"1"}}', '{"k":<K>,"next":{"k":1}}', 0, 0.92, _object(f'"k":{_INT},"next":{{"$ref":"#"}}')),
    ('{"k":"<K>","s":"x"}', '{"k":<K>,"s":"x"}', 0, 0.46, f'{{"allOf":[{_K},{{"properties":{{"s":{_STR}}},"required":["t"]}}]}}'),
    ('{"k":<K>,"e":1}', '{"k":"<K>","e":"1"}', 0, 0.92, f'{{"properties":{{"k":{_STR},"e":{{"enum":["1","2"]}}}}}}'),
    ('{"k":null,"s":<K>}', '{"k":null,"s":"<K>"}', 0, 0.92, _object('"k":{"type":"integer","nullable":true},"s":{"type":["string","null"]}', '"k"')),
    ('{"k":<K>}', '{"k":<K>}', 0, 1.0, _object('"k":{"type":"integer","enum":[{"a":1},[2]]}')),
]
_PULL = _object(f'"pull":{_INT}')
_FERRY, _TUG = _object(f'"name":{{"const":"ferry"}},"load":{_STR}'), _object(f'"name":{{"const":"tug"}},"load":{_PULL}')
_VESSELS = f'{{"oneOf":[{_FERRY},{_TUG}]}}'
_CLOSED_O, _L = _object(f'"o":{_INT}')[:-1] + ',"additionalProperties":false}', _object(f'"l":{_LIST}', '"l"')
#: Branches by their constant, no branch, and a branch by its keys.
UNIONS = [
    ('{"name":"tug","load":"{\\"pull\\":<K>}"}', '{"name":"tug","load":{"pull":<K>}}', 0, 0.92, _VESSELS),
    ('{"name":"ferry","load":"{\\"pull\\":<K>}"}', '{"name":"ferry","load":"{\\"pull\\":<K>}"}', 0, 1.0, _VESSELS),
    ('{"name":"raft","load":"{\\"pull\\":<K>}"}', '{"name":"raft","load":"{\\"pull\\":<K>}"}', 0, 1.0, _VESSELS),
    ('{"l":"[<K>]"}', '{"l":[<K>]}', 0, 0.92, f'{{"anyOf":[{_CLOSED_O},{_L}]}}'),
]
