import json

from tidemark.llm.chat import SCHEMAS, argument_errors, chain_depths, chat_rows, link_calls, turns_as_calls

CALLS = "conv_id long, call_id string, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, content string"


def test_links_order_and_json(spark):
    ok = '{"words": 2, "text": "a b",\n "turn": 1.0e0}'
    calls = [
        (1, "b", "ask", '{"turn":1,"words":2,"text":"é \\" x"}', "a"), (1, "a", "ask", '{"turn":1,"words":2,"text":"t","opening":true}', None),
        (1, "c", "ask", ok, "b"), (1, "d", "other", "{}", "missing"), (1, "x", "ask", "[1]", "y"), (1, "y", "ask", None, "x"), (1, "z", "ask", "not json", "y"),
        (2, "a", "ask", '{"turn":"1","extra":2,"text":"t"}', None), (2, "a", "ask", '{"a":1}', None), (None, "a", "ask", "{}", None), (3, None, "ask", "{}", None),
    ]
    results = [(1, "a", "ra"), (1, "c", None), (2, "a", "two"), (2, "a", "one"), (9, "q", "lost"), (None, "a", "none")]
    c = spark.createDataFrame(calls, CALLS).selectExpr("*", "1 as depth", "2 as position")
    r = spark.createDataFrame(results, RESULTS).selectExpr("*", "'x' as name")
    got = {(x.conv_id, x.call_id): x for x in link_calls(c, r).collect()}
    assert len(got) == 9
    status = {k: v.status for k, v in got.items()}
    assert status[(1, "a")] == status[(1, "c")] == status[(2, "a")] == "linked" and status[(1, "b")] == status[(1, "d")] == "unanswered"
    assert status[(9, "q")] == "orphan result" and status[(1, "x")] == status[(1, "y")] == status[(1, "z")] == "circular"
    assert [got[(1, i)].depth for i in "abcd"] == [0, 1, 2, 0]
    assert [k for _, k in sorted((v.position, k[1]) for k, v in got.items() if k[0] == 1)] == ["a", "d", "b", "c", "x", "y", "z"]
    assert got[(2, "a")].n_calls == 2 and got[(2, "a")].n_results == 2
    assert got[(2, "a")].errors == "missing text,missing turn,missing words,unknown a"
    assert got[(1, "b")].errors == "" and got[(1, "d")].errors == "unknown tool" and got[(1, "x")].errors == "no object" and got[(9, "q")].errors is None
    for v in got.values():
        data = json.loads(v.json)
        assert list(data) == sorted(data) == ["after", "arguments", "id", "name", "result"]
        assert v.json == json.dumps(data, ensure_ascii=False, separators=(",", ":"))
    assert json.loads(got[(1, "b")].json)["arguments"]["text"] == 'é " x'
    assert list(json.loads(got[(1, "b")].json)["arguments"]) == ["text", "turn", "words"]
    assert json.loads(got[(2, "a")].json)["result"] == "one"


def test_types_are_checked(spark):
    rows = [("ask", '{"text":1,"words":"2","turn":true,"opening":null}'), ("ask", '{"text":"x","words":2,"turn":3,"opening":0}'), (None, "{}"), ("ask", '{"text":"x","text":"y"}')]
    df = spark.createDataFrame(rows, "name string, arguments string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(argument_errors(F.col("name"), F.col("arguments"), SCHEMAS)).collect()]
    assert got == [["type of text", "type of turn", "type of words"], ["type of opening"], ["unknown tool"], ["no object"]]


def test_long_chain_takes_few_rounds(spark):
    n = 3_000
    df = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end as parent")
    got = chain_depths(df)
    assert got.filter("depth != id").count() == 0 and got.count() == n


def test_turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hello there"), (1, 2, "assistant", "hi"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 6, "assistant", "lost"), (2, 0, "user", "x" * 50_000), (2, 0, "user", "x" * 50_000), (None, 0, "user", "nobody"), (4, None, "user", "when")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as call_id")
    got = {(r.conv_id, r.call_id): (r.status, r.depth, r.errors, r.n_calls) for r in link_calls(*turns_as_calls(df)).collect()}
    assert got == {(1, "1"): ("linked", 0, "", 1), (1, "3"): ("linked", 1, "missing text", 1), (1, "5"): ("orphan result", 0, None, 0), (2, "0"): ("unanswered", 0, "", 2)}
    assert link_calls(*turns_as_calls(df.filter("false"))).count() == 0


def test_every_turn_is_told(spark):
    rows = [
        (1, 0, "system", 'be "kind"'), (1, 0, "system", 'be "kind"'), (1, 1, "user", "b\n"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "user", None), (1, 1, "user", 'c "é"'), (1, 2, "assistant", "two"),
        (1, 2, "assistant", "one"), (1, 2, "assistant", None), (1, 3, None, "who"), (None, 0, "user", "nobody"), (4, None, "assistant", "when"), (None, None, "tool", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as call_id", "'x' as status")
    got = chat_rows(df).collect()
    exchange = [r for r in got if r.status == "linked"]
    assert len(exchange) == 1 and (exchange[0].n_calls, exchange[0].n_results, exchange[0].position) == (5, 3, 1)
    told = json.loads(exchange[0].json)
    spoken = [(1, 1, "user", told["arguments"].get("text")), (1, 2, "assistant", told["result"])]
    rest = []
    for r in got:
        if r.status != "linked":
            data = json.loads(r.json)
            assert list(data) == ["role", "text", "turn"] and r.json == json.dumps(data, ensure_ascii=False, separators=(",", ":"))
            rest.append((r.status, (r.conv_id, data["turn"], data["role"], data["text"])))
    want = [("unidentified" if r[0] is None or r[1] is None else "message", r) for r in rows if r[2] not in ("user", "assistant") or None in r[:2]]
    want += [("repeated", r) for r in set(rows) - set(spoken) if r[2] in ("user", "assistant") and None not in r[:2]]
    assert sorted(map(str, rest)) == sorted(map(str, want))
    assert chat_rows(df.filter("false")).count() == 0
