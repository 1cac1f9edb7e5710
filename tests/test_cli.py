import json

import pytest

from lectern.cli import main
from lectern.config import load_config
from lectern.engine import Engine
from lectern.errors import ConfigError
from lectern.sources.embedder import HashEmbedder


@pytest.fixture()
def cli(spark, tmp_path, capsys):
    def call(*arguments, code=0):
        assert main(["--store", str(tmp_path / "store"), *arguments], spark) == code
        text = capsys.readouterr().out
        return [json.loads(line) for line in text.splitlines()] if text.startswith("{") else text

    return call


def test_commands(cli, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "pump.md").write_text("# Pump\n\nThe pump stops at noon. Nobody knows why.\n\n## Start\n\nThe pump starts at two.", encoding="utf-8")
    (folder / "cats.txt").write_text("Cats sleep at night.", encoding="utf-8")
    assert cli("ask", "When?")[0]["reason"] == "empty_knowledge_base"
    log = {r["doc_id"]: r for r in cli("ingest", str(folder))}
    assert log["pump"]["chunks_added"] == 2 and log["cats"]["status"] == "ok"
    assert {r["doc_id"] for r in cli("documents")} == {"pump", "cats"}
    bars = tmp_path / "bars.json"
    cases = tmp_path / "cases.jsonl"
    rows = [
        {"id": "1", "question": "when does the pump stop at noon", "split": "dev", "gold": [{"doc": "pump.md", "must_contain": "stops at noon"}]},
        {"id": "2", "question": "who sings opera loudly", "split": "dev", "gold": []},
    ]
    cases.write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    assert cli("calibrate", str(cases), code=1)[0]["error"]["code"] == "CONFIG_ERROR"
    told = cli("--thresholds", str(bars), "calibrate", str(cases))[0]
    assert told["calibrated"] and told["version"] == 1 and told["model_id"] == "hash-embedder"
    report = cli("--thresholds", str(bars), "eval", str(cases))
    assert report.startswith("# Evaluation") and "| dev |" in report
    answer = cli("--thresholds", str(bars), "ask", "when does the pump stop at noon", "?", "--debug")
    assert answer[0]["status"] == "answered" and "The pump stops at noon." in answer[0]["answer"]
    assert answer[0]["citations"][0]["section"] == "Pump" and answer[0]["citations"][0]["document"] == "pump.md"
    assert answer[0]["debug"]["gate"]["passed"] and answer[0]["debug"]["candidates"][0]["rank"] == 1
    assert answer[1]["status"] == "invalid_question"
    assert cli("delete", "cats")[0]["chunks_removed"] == 1
    assert cli("delete", "cats", code=1)[0]["error"]["code"] == "DOCUMENT_NOT_FOUND"
    assert cli("check-storage")[0]["drift"] == {"orphaned": 1}
    assert cli("reconcile") == [{"finding": "orphaned", "count": 1}]
    assert {r["table"] for r in cli("compact")} >= {"chunks", "events", "vectors"}
    held = cli("check-storage")[0]
    assert held["drift"] == {} and held["documents"] == {"active": 1, "deleted": 1} and held["rows"]["chunks"] == 2


def test_filters_narrow_an_answer(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path / "s"))
    files = [("a.txt", "The pump stops at noon."), ("b.txt", "The pump stops at noon today.")]
    engine.job.ingest(spark.createDataFrame([(n, bytearray(x.encode())) for n, x in files], "filename string, content binary"))
    asked = spark.createDataFrame([("1", "pump stops noon")], "question_id string, question string")
    cited = lambda **kw: {c.doc_id for c in engine.ask(asked, **kw).first().citations or []}
    assert cited() == {"a", "b"} and cited(doc_ids=["b"]) == {"b"} and cited(top_k=1) < {"a", "b"}
    assert engine.ask(asked, doc_ids=[]).first().reason == "no_relevant_content"
    assert engine.ask(asked, language="de").first().status == "invalid_question"
    with pytest.raises(ConfigError):
        Engine.open(spark, str(tmp_path / "s"), lambda: HashEmbedder(dimension=8))


def test_settings_files(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"top_k": 3, "dense_weight": 1}', encoding="utf-8")
    assert load_config(str(path)).top_k == 3
    for text in ('{"top_k": "secret"}', '{"nothing": 1}', "[]", "x", '{"top_k": 0}'):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(ConfigError) as refused:
            load_config(str(path))
        assert "secret" not in str(refused.value.envelope())
