import json

import pytest

from notefold.functions.jsontext import _parse_deep, parse
from notefold.operators import nested as N


def brute(payload):
    """p3 rows by plain recursion."""
    try:
        v = json.loads(payload, parse_constant=lambda c: 1 / 0)
    except Exception:
        return []
    while isinstance(v, dict) and ("meta" in v or "records" in v):
        v = v.get("meta", v.get("records"))
    out = []

    def meta(m, pos, path):
        if not isinstance(m, dict):
            return
        c = m.get("construction")
        if isinstance(c, str):
            c = json.loads(c)
        ts = (m.get("basic_info") or {}).get("time_signature")
        ts = "" if ts is None else "/".join(str(x) for x in ts) if isinstance(ts, list) else f"{ts['beats']}/{ts['unit']}" if isinstance(ts, dict) else ts.replace(" ", "")
        for i, s in enumerate(c if isinstance(c, list) else [] if c is None else [c]):
            e = s.get("edits")
            e = [] if e is None else e if isinstance(e, list) else [e]
            for k in range(len(e)) or [-1]:
                out.append((pos, "/".join([*path, str(i)]), k, s.get("kind") or "", ts))
            if isinstance(s.get("source"), dict):
                meta(s["source"], pos, [*path, str(i)])

    for i, m in enumerate(v if isinstance(v, list) else [v]):
        meta(m, i, [])
    return out


CASES = [
    '{"construction": {}}', '[{"construction": [{"kind": "a", "edits": [{}, {}]}, {"edits": []}]}, {}]', '{"meta": {"basic_info": {"time_signature": [6, 8]}, "construction": {"edits": {"x": 1}}}}',
    '{"records": [{"basic_info": {"time_signature": {"unit": 4, "beats": 3}}, "construction": "[{\\"kind\\": \\"t\\", \\"edits\\": null}]"}]}',
    '{"basic_info": {"time_signature": "4 / 4"}, "construction": [{"source": {"basic_info": {"time_signature": null}, "construction": [{"kind": null}, {"source": {"construction": {"kind": "deep", "edits": [{}]}}}]}}]}',
    '{"construction": {', "", "null", "3", "[]", "{}", '{"construction": NaN}', '{"construction": {"kind": "\\ud800"}}',
]


def test_parser_agrees_with_json():
    for text in [*CASES, '[1, -2.5e3, "a\\n\\u00e9", true, false, null, {"a": {"b": []}}]', "[1,]", '{"a" 1}', "01", "[1] x", '{"a":1,}']:
        try:
            want = json.loads(text, parse_constant=lambda c: 1 / 0)
        except Exception:
            with pytest.raises(Exception):
                _parse_deep(text)
        else:
            assert _parse_deep(text) == want


def test_depth_has_no_limit():
    deep = '{"construction": {"source": ' * 50_000 + "{}" + "}}" * 50_000
    value = parse(deep)
    assert "construction" in value
    nodes = list(N.shred(deep[:0] + '{"construction": {"source": ' * 3000 + '{"construction": {"kind": "x"}}' + "}}" * 3000, N.METAS))
    assert len(nodes) == 2 * 3000 + 2
    while value:  # taken apart by hand: a value this deep must not be freed by recursion
        value = next(iter(value.values()), None) if isinstance(value, dict) else None


def test_found_against_recursion(spark, rows, tmp_path):
    data = [(i, "f", c) for i, c in enumerate(CASES)] + [(100, "f", None), (1, "f", CASES[1])]
    spark.createDataFrame(data, "record_id long, feed string, payload string").write.parquet(str(tmp_path / "meta_raw.parquet"))
    got = rows(N.p3_found(spark, str(tmp_path)))
    want = {(i, *r) for i, _, c in data if c for r in brute(c)}
    assert got == sorted(((*r[:4], "?" if "\ud800" in r[4] else r[4], r[5]) for r in want), key=repr)


def test_tables_and_parents(spark, rows):
    d = spark.createDataFrame([(1, CASES[4], "x", 5)], "record_id long, payload string, kind string, node int")  # clashing names
    n = N.nodes(d, "record_id", "payload", N.METAS)
    metas, steps = N.metas_table(n), N.steps_table(n)
    assert steps.join(metas, [steps.parent_id == metas.meta_id]).count() == steps.count() == 4
    assert rows(metas.select("meta_id", "parent_id")) == sorted([("m0", None), ("m0.s0.m0", "m0.s0"), ("m0.s0.m0.s1.m0", "m0.s0.m0.s1")], key=repr)


def test_empty(spark, rows):
    d = spark.createDataFrame([], "record_id long, payload string")
    assert rows(N.steps_table(N.nodes(d, "record_id", "payload", N.METAS))) == []
