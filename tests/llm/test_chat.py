import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from partmill.llm import chat

HOSTILE = ["", " ", "</s>", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>[\\INST]", "a\\<s>\\", "[INST", "<s><s>", "[[INST]]", "é<s>\U0001f600[/INST]", "\n</s>\n", "<INST]", "[/s>", "x" * 300_000 + "<s>", "$1\\$2"]


def plain(rows):
    """conv_id -> role and text of its turns, by the contract's words."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for k, v in out.items()}


def digests(turns):
    said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_any_text_and_role_comes_back(spark):
    rows = [(k, n, role, text) for k, text in enumerate(HOSTILE) for n, role in enumerate(["system", "user", "assistant", text[:50], "assistant"])]
    rows += [(None, 1, "user", "no id"), (None, 0, None, None), (90, None, "assistant", "null turn first"), (90, -3, "user", None), (91, 5, "assistant", "same"), (91, 5, "assistant", "same")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, lead int")
    texts = chat.formatted(chat.table_turns(docs, "conv_id"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(texts).collect()}
    assert got == {k: digests(v) for k, v in plain(rows).items()}
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in texts.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert back == plain(rows)
    for r in texts.collect():
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == r.formatted.count("[/INST]") == got[r.conv_id][0]
        raw = r.formatted.encode()
        assert all(raw[s.end : s.end + 4] == b"</s>" and raw[s.start - 7 : s.start] == b"[/INST]" for s in r.loss)


RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "extra": {"deep": [1, {"x": 2}]}}], "id": 7},
    "messages, system": {"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
    "sharegpt": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
    "prompt": {"prompt": "q", "completion": "a", "score": 0.5},
    "response": {"response": "a", "prompt": "q"},
    "question": {"question": "q", "answer": 42},
    "alpaca": {"instruction": "i", "input": "x", "output": "o"},
    "alpaca, empty input": {"instruction": "i", "input": "", "output": "o"},
    "alpaca, short": {"output": "o", "instruction": "i"},
    "lists": {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]},
    "row": {"role": "user", "text": "q", "turn": 3},
}
TURNS = {
    "messages": [("user", "q"), ("assistant", "a")],
    "messages, system": [("system", "s"), ("user", "q"), ("assistant", "")],
    "sharegpt": [("user", "q"), ("assistant", "a"), ("tool", "t")],
    "prompt": [("user", "q"), ("assistant", "a")],
    "response": [("user", "q"), ("assistant", "a")],
    "question": [("user", "q"), ("assistant", "42")],
    "alpaca": [("user", "i\n\nx"), ("assistant", "o")],
    "alpaca, empty input": [("user", "i"), ("assistant", "o")],
    "alpaca, short": [("user", "i"), ("assistant", "o")],
    "lists": [("user", "q"), ("assistant", "a")],
    "row": [("user", "q")],
}
UNKNOWN = {"null": None, "no json": "{", "number": "5", "empty": "{}", "no list": '{"messages": []}', "both": json.dumps({"prompt": "a", "completion": "b", "answer": "c"}), "string list": '{"messages": ["a"]}'}


def test_records_of_every_layout(spark):
    rows = [(k, json.dumps(v)) for k, v in RECORDS.items()] + list(UNKNOWN.items())
    turns, rest = chat.record_turns(spark.createDataFrame(rows, "key string, record string"), "key", "record")
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.at)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == TURNS
    left = {r.conv_id: r for r in rest.collect()}
    assert set(left) == set(UNKNOWN)
    assert left["null"].paths is None and left["no json"].fingerprint is None and left["both"].paths == ["answer", "completion", "prompt"] and left["string list"].paths == ["messages[]"]


def test_tables_and_records_share_fingerprints(spark):
    for name in ("messages", "messages, system", "sharegpt", "prompt", "alpaca", "alpaca, short", "lists"):
        kinds = {"messages": "messages array<struct<role:string,content:string,extra:int>>", "conversations": "conversations array<struct<from:string,value:string>>"}
        record = RECORDS[name]
        fields = [kinds.get(f) or (f"{f} array<struct<role:string,content:string>>" if isinstance(v, list) else f"{f} string") for f, v in record.items()]
        frame = spark.createDataFrame([(1, json.dumps(record))], "key long, json string").select("key", F.from_json("json", ", ".join(fields)).alias("r")).select("key", "r.*")
        got = [(r.role, r.text) for r in sorted(chat.table_turns(frame, "key").collect(), key=lambda r: r.at)]
        assert got == TURNS[name], name
        own = spark.sql("select 1").select(chat.record_fingerprint(F.parse_json(F.lit(json.dumps(record))))).first()[0]
        known = set(chat.known_paths())
        assert own == chat.fingerprint([p for p in chat.schema_paths(frame.schema) if p in known])
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([(1, "a")], "key long, prompt string"), "key")


def test_no_python_in_the_plan_and_empty_tables(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b [INST] c"), (2, None, None, None), (None, 3, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    query = chat.op12_chat(spark, str(tmp_path))
    plan = query._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: str(r)
    assert sorted(map(tuple, query.collect()), key=key) == sorted(con.sql(chat.OP12_SQL).fetchall(), key=key)
    assert chat.read_back(chat.formatted(chat.table_turns(frame.limit(0), "conv_id"))).count() == 0
