import hashlib
import json

from credograph.operators import trace
from credograph.sources import event_logs as L

GOOD = {"event_id": "e", "seq": 0, "ts": "2024-05-01T10:00:00Z", "kind": "decision", "actor": "a"}
HEAD = {"arm_id": "m", "session_id": "s", "trace_id": "t", "created_at": "2024-05-01T10:00:00Z"}


def canonical(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def full(e):
    """An event as the original hashes it."""
    return {"inputs": {}, "outputs": None, "reason": None, "refs": [], "parent_event_id": None, "tool": None, "error": None} | {k: v for k, v in e.items() if k != "prev_hash"}


def test_both_layouts_with_bad_records(spark, tmp_path):
    ref = {"claim_id": "c", "review_id": "r1", "relation": "uses"}
    bad = [
        ("{", "", "json decode"), ("[1]", "", "must be an object"), (json.dumps(GOOD) + "}", "", "json decode"), (json.dumps(GOOD | {"seq": -1}), ".seq", "must not be negative"), (json.dumps(GOOD | {"seq": "1"}), ".seq", "must be a whole number"),
        (json.dumps(GOOD | {"kind": "x"}), ".kind", "unknown kind"), (json.dumps({k: v for k, v in GOOD.items() if k != "actor"}), ".actor", "missing"), (json.dumps(GOOD | {"actor": ""}), ".actor", "must not be empty"),
        (json.dumps(GOOD | {"more": 1}), ".more", "unknown field"), (json.dumps(GOOD | {"ts": "noon"}), ".ts", "must be a time"), (json.dumps(GOOD | {"refs": [ref | {"relation": "likes"}]}), ".refs", "unknown reference"),
        (json.dumps(GOOD | {"inputs": []}), ".inputs", "must be an object"), (json.dumps(GOOD | {"event_id": None}), ".event_id", "must not be null"),
    ]
    events = [GOOD | {"event_id": "é1", "inputs": {"b": 1, "a": [True, None, "x"]}, "reason": 'say "so"\n'}, GOOD | {"seq": 1, "refs": [ref], "outputs": None, "ts": "2024-05-01T10:00:00.250000Z"}]
    lines = ["", json.dumps(HEAD), json.dumps(events[0]), *[x for x, _, _ in bad], "  ", json.dumps(events[1])]
    (tmp_path / "one.jsonl").write_text("\n".join(lines))
    (tmp_path / "two.json").write_text(json.dumps({"manifest": HEAD | {"arm_id": 3}, "events": [events[0], {"event_id": "z"}]}, indent=1))
    (tmp_path / "three.json").write_text("[]")
    (tmp_path / "four.jsonl").write_text("\n\n")
    (tmp_path / "five.json").write_text("{")
    found = L.read(spark, f"file://{tmp_path}")
    name = lambda r: r.file.rsplit("/", 1)[1]
    issues = sorted((name(r), r.location, r.message) for r in found["issues"].collect())
    want = [("one.jsonl", f"line:{i + 4}{field}", message) for i, (_, field, message) in enumerate(bad)] + [("two.json", "manifest.arm_id", "must be text"), ("three.json", "<file>", "root must be object"), ("four.jsonl", "<file>", "empty file"), ("five.json", "<file>", "json decode")]
    want += [("two.json", f"events[1].{k}", "missing") for k in ("seq", "ts", "kind", "actor")]
    assert issues == sorted(want)
    rows = sorted(found["events"].collect(), key=lambda r: (r.file, r.order))
    assert [(name(r), r.event_id) for r in rows] == [("one.jsonl", "é1"), ("one.jsonl", "e"), ("two.json", "é1")]
    assert rows[0].inputs_json == '{"a":[true,null,"x"],"b":1}' and rows[1].refs[0].review_id == "r1" and rows[1].outputs_json is None
    assert [name(r) for r in found["manifests"].collect()] == ["one.jsonl"]
    lost = L.unresolved_references(found["events"], spark.createDataFrame([("r2",)], "review_id string")).collect()
    assert [(r.event_id, r.seq, r.place, r.review_id) for r in lost] == [("e", 1, 0, "r1")]
    # the root of the good events, as the original computes it
    root = hashlib.sha256(canonical([full(e) for e in events]).encode()).hexdigest()
    head = {"schema_version": "1", "signature": None, "events_root": root} | HEAD
    good = head | {"manifest_hash": hashlib.sha256(canonical(head).encode()).hexdigest()}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_text("\n".join(map(json.dumps, [good, *events])))
    (tmp_path / "sub" / "b.jsonl").write_text("\n".join(map(json.dumps, [good | {"events_root": "f" * 64}, *events])))
    again = L.read(spark, f"file://{tmp_path}/sub")
    wrong = {(name(r), r.field): (r.declared, r.recomputed) for r in L.manifest_mismatches(again["manifests"], again["events"]).collect()}
    assert set(wrong) == {("b.jsonl", "events_root"), ("b.jsonl", "manifest_hash")} and wrong["b.jsonl", "events_root"] == ("f" * 64, root)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = ["", json.dumps(HEAD), *[json.dumps(GOOD | {"seq": i, "event_id": f"e{i}"}) if i % 7 else "broken" for i in range(1, 400)]]
    (tmp_path / "long.jsonl").write_text("\n".join(lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "2k")
        found = L.read(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 3
        assert sorted(r.location for r in found["issues"].collect()) == sorted(f"line:{i + 2}" for i in range(7, 400, 7))
        assert found["manifests"].count() == 1 and found["events"].count() == 399 - 57
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_payload_refuses_what_has_several_spellings(spark):
    import pytest

    with pytest.raises(TypeError):
        trace.payload(spark.createDataFrame([(0.1,)], "x double"))


def test_records_are_parsed_once(spark, tmp_path):
    """What is read from checked records must not parse them again, field by field."""
    (tmp_path / "a.jsonl").write_text('{"arm_id":"a"}\n{"event_id":"e"}\n')
    for rows in L.read(spark, f"file://{tmp_path}").values():
        assert "parse_json" not in rows._jdf.queryExecution().optimizedPlan().toString() or rows.columns == ["file", "location", "message"]
