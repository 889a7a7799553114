import json
import subprocess

import pytest

from larkspur.operators import conversations as cv
from larkspur.sources import readers as rd


def test_transcripts(spark):
    def entry(kind, content, n=0, **more):
        return json.dumps({"type": kind, "sessionId": "s", "timestamp": f"t{n}", "message": {"role": kind, "content": content, "usage": {"output_tokens": 5, "input_tokens": 9}}} | more)

    lines = [
        entry("user", "hello"), entry("assistant", [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "1", "name": "Read"}, {"type": "tool_use", "id": "2", "name": "Bash"}]),
        entry("user", [{"type": "tool_result", "tool_use_id": "1", "content": "z" * 600}], toolUseResult={"filenames": ["f.ts"]}), entry("user", [{"type": "tool_result", "tool_use_id": "2", "content": "y" * 600}]),
        entry("assistant", [{"type": "text", "text": "b"}]), "{broken", json.dumps({"type": "progress", "sessionId": "s"}), entry("user", "bye"),
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    e = rd.parse_entries(df)
    t = {r.turn_index: r for r in cv.fold_turns(rd.turn_events(e, "n")).collect()}
    assert (t[0].user_text, t[0].assistant_text, t[0].tools_used, t[0].files_referenced, t[0].token_cost) == ("hello", "a\nb", ["Read", "Bash"], ["f.ts"], 10)
    assert t[1].user_text == "bye" and len(t) == 2
    assert [r.tool for r in rd.tool_outputs(e).collect()] == ["Bash"]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(2):
        (tmp_path / "f").write_text(str(k))
        run("add", "f")
        run("commit", "-qm", f"change {k}\n\nbody")
    got = rd.read_git_log(spark, str(tmp_path)).collect()
    assert {r.message for r in got} == {"change 0\n\nbody", "change 1\n\nbody"} and all(r.author == "A B" and not r.is_merge for r in got)
    n = rd.parse_numstat(spark.createDataFrame([("h\t3\t-\ta b.ts",), ("junk",)], "value string")).collect()
    assert [(r.file_path, r.insertions, r.deletions) for r in n] == [("a b.ts", 3, 0)]


def test_benchmark_and_config(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"query": "q", "expected": ["a"]}]))
    assert rd.load_benchmark(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps([{"query": "q", "expected": []}]))
    with pytest.raises(ValueError):
        rd.load_benchmark(spark, str(tmp_path / "c.json"))
    c = rd.Config.load('{"top_k": 3, "include": "no", "hybrid_weight": 1, "other": 1}')
    assert c.top_k == 3 and c.hybrid_weight == 1 and c.include == rd.Config().include and rd.Config.load("{") == rd.Config()
