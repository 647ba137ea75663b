import json

from tracemill.operators import nested as N

B = [{"type": "text", "text": "a"}, "stray", {"no": 1}, {"type": 5}, {"type": "tool_result", "content": [{"type": "text"}, {"type": "x", "content": [{"type": "y"}]}]}, {"type": "t", "content": "[{}]"}]
WANT = {("0", "", "text"), ("4", "", "tool_result"), ("4.0", "4", "text"), ("4.1", "4", "x"), ("4.1.0", "4.1", "y"), ("5", "", "t")}


def run(spark, *payloads):
    df = spark.createDataFrame([(i, "f", p, 1) for i, p in enumerate(payloads)], "record_id long, file_name string, payload string, depth int")
    return {(r.record_id, r.block_path, r.parent_path, r.block_type) for r in N.found(df).collect()}, df


def test_shapes(spark):
    agent = {"type": "progress", "data": {"type": "agent_progress", "message": {"message": {"content": B}}}}
    texted = {"type": "progress", "data": json.dumps({"type": "agent_progress", "message": json.dumps({"message": json.dumps({"content": B})})})}
    payloads = [
        json.dumps({"type": "user", "message": {"content": B}}), json.dumps({"type": "assistant", "message": json.dumps({"content": B})}), json.dumps(agent), json.dumps(texted),
        json.dumps({"type": "user", "message": {"content": json.dumps(B)}}), json.dumps({"type": "system", "message": {"content": B}}), "not json", None, "", "[]", "[" * 300_000,
    ]
    got, df = run(spark, *payloads)
    assert got == {(i, *w) for i in range(4) for w in WANT}
    recs = {r.record_id: r.readable for r in N.records_table(df).collect()}
    assert len(recs) == len(payloads) and [i for i, ok in recs.items() if not ok] == [6, 7, 8, 9, 10]
    assert {(r.block_path, r.n_children) for r in N.children_per_block(df).filter("record_id = 0").collect()} == {("0", 0), ("4", 2), ("4.0", 0), ("4.1", 1), ("4.1.0", 0), ("5", 0)}


def test_empty_and_deep(spark):
    assert run(spark)[0] == set()
    b = {"type": "leaf"}
    for _ in range(300):
        b = {"type": "n", "content": [b]}
    got, _ = run(spark, json.dumps({"type": "user", "message": {"content": [b]}}))
    assert len(got) == 301 and max(len(p.split(".")) for _, p, _, _ in got) == 301
