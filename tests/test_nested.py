import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.functions.payload import parse_payload
from strandline.operators.structural import StructuralIndex
from strandline.operators.nested import FIELDS, elements_of, flatten_elements, nested_tables

KEYS = ["content", "inserted", "messages", "messageSeqs", "type", "role", "a", "k\\\"y", "text", "日", ""]
scalars = st.none() | st.booleans() | st.integers(-5, 10**12) | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet='ab"\\,:[]{} \n\té日😀', max_size=6)
values = st.recursive(scalars, lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from(KEYS), c, max_size=4), max_leaves=25)


def kind(field, e):
    if field == "messageSeqs":
        return json.dumps(e) if isinstance(e, (int, float)) and not isinstance(e, bool) else ""
    if field == "content" and isinstance(e, str):
        return "text"
    x = e.get(FIELDS[field]) if isinstance(e, dict) else None
    return x if isinstance(x, str) else ""


def brute(value, path=""):
    if isinstance(value, dict):
        for k, x in value.items():
            at = f"{path}.{k}" if path else k
            if k in FIELDS:
                for i, e in enumerate(x if isinstance(x, list) else [x]):
                    if e is not None:
                        yield f"{at}[{i}]", kind(k, e)
                if isinstance(x, dict):  # the only element of its field
                    at += "[0]"
            yield from brute(x, at)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from brute(x, f"{path}[{i}]")


def named(v):
    """Whether every type or role is a string or absent, as kinds are defined for."""
    if isinstance(v, dict):
        return all(not (k in ("type", "role") and not isinstance(x, str)) and named(x) for k, x in v.items())
    return not isinstance(v, list) or all(map(named, v))


@settings(max_examples=300, deadline=None)
@given(st.lists(values.filter(lambda v: isinstance(v, (dict, list)) and named(v)), min_size=1, max_size=4), st.sampled_from([None, 1, 7]), st.booleans())
def test_elements_equal_a_tree_walk(docs, indent, ascii_only):
    texts = [json.dumps(d, indent=indent, ensure_ascii=ascii_only) for d in docs]
    which, cols = elements_of([t.encode() for t in texts])
    got = sorted(zip(which.tolist(), cols["path"], cols["kind"]))
    assert got == sorted((i, p, k) for i, d in enumerate(docs) for p, k in brute(d))
    for v in cols["value"].to_pylist() if got else []:
        assert v and json.loads(v) is not None


@settings(max_examples=300, deadline=None)
@given(values, st.integers(0, 200), st.booleans())
def test_payload_parses_like_json(v, cut, wrap):
    text = json.dumps(v)
    text = json.dumps(text) if wrap else text
    text = text[: len(text) - cut] if cut < len(text) and cut % 3 == 0 else text

    def strict(t):
        value = json.loads(t)
        return strict_once(value) if isinstance(value, str) else value

    def strict_once(t):
        return json.loads(t)

    try:
        strict(text)
        ok = True
    except ValueError:
        ok = False
    assert parse_payload(text)[0] == ok


def test_payload_edges():
    deep = "[" * 200_000 + "]" * 200_000
    value = parse_payload('{"id":"x","deep":' + deep + "}")[2]
    assert value["id"] == "x" and isinstance(value["deep"], list)
    assert parse_payload(deep)[0] and not parse_payload(deep[:-1])[0] and not parse_payload(deep[:-1] + "}")[0]
    for bad in (None, "", " ", "NaN", '{"a":Infinity}', '{"a":1}x', "[1,]", '{"a"}', '"text"', '"{\\"a\\":"'):
        assert not parse_payload(bad)[0]
    assert parse_payload('"{\\"a\\":1}"')[1] == '{"a":1}'


CHARS = '{}[],:"\\ \n\t0123456789.eE+-truefalsnu\x01aé'


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(values, st.lists(st.tuples(st.integers(0, 300), st.integers(0, 2), st.sampled_from(CHARS)), max_size=3)), min_size=1, max_size=5))
def test_index_tells_valid_documents(docs):
    texts = []
    for v, edits in docs:
        t = json.dumps(v)
        for at, how, c in edits:
            at %= len(t) + 1
            t = t[:at] + (c, "", c)[how] + t[at + (how > 0) :]
        texts.append(t)

    def ok(t):
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return False
        return True

    assert StructuralIndex([t.encode() for t in texts]).valid.tolist() == [ok(t) for t in texts]


def test_empty_keys_put_no_dot():
    docs = [{"": {"a": {"content": "x"}}}, {"": {"": {"content": "x"}}}, {".": {"content": "x"}}, {"": [{"content": "x"}]}]
    _, cols = elements_of([json.dumps(d).encode() for d in docs])
    assert cols["path"] == [p for d in docs for p, _ in brute(d)]


def test_depth_has_no_limit():
    deep = '{"a":' * 60_000 + '{"content":[{"type":"t"}]}' + "}" * 60_000
    which, cols = elements_of([b'{"content":"x"}', deep.encode(), deep[:-1].encode()])
    assert which.tolist() == [0, 1] and cols["path"][1] == "a." * 60_000 + "content[0]" and cols["kind"] == ["text", "t"]


def test_tables_link_parents_and_take_dirty_rows(spark):
    long = json.dumps({"content": [{"type": "text", "text": "x" * 300_000}]})
    rows = [
        (1, '{"message":{"content":[null,{"type":"tool-result","content":[{"type":"text"},"plain"]}]}}'), (1, '{"inserted":{"role":"user","content":"hi"}}'), (None, '{"messageSeqs":[3,null,4.5]}'),
        (2, None), (3, ""), (4, '{"content":['), (5, long), (6, '{"content":[]}'), (7, '{"\\u0063ontent":"e","role":"x"}'),
    ]
    df = spark.createDataFrame([(i, t, "clash", 9) for i, t in rows], "line_id bigint, data string, path string, record_id int")
    got = {(r.record_id, r.path): (r.kind, r.parent_path, r.position) for r in flatten_elements(df, "line_id", "data").collect()}
    assert got[1, "message.content[1]"] == ("tool-result", None, 1)
    assert got[1, "message.content[1].content[0]"] == ("text", "message.content[1]", 0)
    assert got[1, "message.content[1].content[1]"] == ("text", "message.content[1]", 1)
    assert got[1, "inserted[0]"] == ("user", None, 0) and got[1, "inserted[0].content[0]"] == ("text", "inserted[0]", 0)
    assert got[None, "messageSeqs[2]"][0] == "4.5" and got[5, "content[0]"][0] == "text" and got[7, "content[0]"][0] == "text"
    assert len(got) == 9
    tables = nested_tables(df, "line_id", "data")
    assert set(tables) == set(FIELDS) and [r.seq for r in tables["messageSeqs"].collect()] == [3, None] or [r.seq for r in tables["messageSeqs"].collect()] == [3, 4]
    assert {(r.path, r.parent_field): r.text for r in tables["content"].where("record_id = 1").collect()}["inserted[0].content[0]", "inserted"] == "hi"
    assert flatten_elements(df.limit(0), "line_id", "data").count() == 0


def test_invalid_texts_are_whole_or_nothing(spark):
    random.seed(4)
    text = '{"content":[{"type":"a\\\\\\"b","x":[1,2,{"y":null}]}]}'
    df = spark.createDataFrame([(n, text[:n]) for n in range(len(text) + 1)], "line_id bigint, data string")
    assert [r.record_id for r in flatten_elements(df, "line_id", "data").collect()] == [len(text)]


if __name__ == "__main__":
    pytest.main([__file__])
