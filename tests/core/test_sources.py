"""Files and session stores."""

import json
import sqlite3

import pytest

from factloom.operators import sessions
from factloom.sources import files, session_store


def test_draft_folders(spark, tmp_path):
    rows = [(1, "a", "cli", None, "p", None, None, ["x"], 5, "text", "pending"), (1, "b", "mcp", "g", None, None, "u", [], 6, "more", "accepted")]
    df = spark.createDataFrame(rows, files.DRAFT_SCHEMA + ", state string")
    files.write_drafts(df, f"{tmp_path}/d")
    back = files.read_drafts(spark, f"{tmp_path}/d")
    assert {(r.id, r.state, r.raw_text) for r in back.collect()} == {("a", "pending", "text"), ("b", "accepted", "more")}
    assert [r.id for r in back.filter("state = 'pending'").collect()] == ["a"]


def test_sweep_takes_text_files_that_say_something(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, text in (("a.md", "hello\nyou"), ("deep/b.txt", "x"), ("c.markdown", " \n\t"), ("d.py", "print()")):
        (tmp_path / name).write_text(text)
    assert sorted((r.path.rpartition("/")[2], r.raw_text) for r in files.sweep(spark, str(tmp_path)).collect()) == [("a.md", "hello\nyou"), ("b.txt", "x")]


def test_scores_name_what_is_wrong(spark, tmp_path):
    good = dict(scenario="s", baseline="A", minutes=None, correct=1, prompted=0, wrong=0, silent=0, hallucinations=0, decision_total=2, stale_occurrences=0, input_tokens=1, output_tokens=1)
    (tmp_path / "s.json").write_text(json.dumps([good, good | {"wrong": -1}, {k: v for k, v in good.items() if k != "silent"}]))
    assert [r.problem for r in files.read_scores(spark, f"{tmp_path}/s.json").collect()] == [None, "negative wrong", "missing silent"]


def test_scenarios_name_what_is_wrong(spark, tmp_path):
    text = dict.fromkeys(("status", "title", "source_markdown", "situation", "cold_start_prompt", "work_instruction_test"), "x")
    good = dict(
        schema_version=1, **text, cutoff_minutes=10, baselines=[dict(id=b, name="n", preserved_state="s") for b in "ABCD"],
        ground_truth=[dict(id="g1", category="c", text="t", source_refs=["r"], auto_fail_if_wrong=True)], staleness_tests=[],
    )
    changed = {
        "ok": {}, "version": {"schema_version": 2}, "blank": {"title": " "}, "cutoff": {"cutoff_minutes": 2.5}, "arms": {"baselines": good["baselines"][:3]},
        "twice": {"ground_truth": good["ground_truth"] * 2}, "flag": {"ground_truth": [good["ground_truth"][0] | {"auto_fail_if_wrong": None}]},
        "stale": {"staleness_tests": [dict(id="s", superseded_fact="a", current_fact="", expected_behavior="b")]}, "named": {"id": "other"},
    }
    for name, change in changed.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, **good, **change}))
    got = {r.file: r.problem for r in files.read_scenarios(spark, str(tmp_path)).collect()}
    assert got == {"ok": None, "version": "schema_version", "blank": "title", "cutoff": "cutoff_minutes", "arms": "baselines", "twice": "ground_truth", "flag": "ground_truth", "stale": "staleness_tests", "named": "file name"}


def test_review_artifacts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("vote", 1, "p1", 0.5), ("output", 1, "p2", None), ("vote", 2, "p1", 1.0)], "kind string, episode_id long, participant_id string, confidence double")
    files.write_artifacts(rows, f"{tmp_path}/q")
    files.write_artifacts(rows.limit(1), f"{tmp_path}/q")
    back = files.read_artifacts(spark, f"{tmp_path}/q", "kind string, episode_id long, participant_id string, confidence double")
    assert back.filter("kind = 'vote' and episode_id = 1").count() == 2 and back.count() == 4


def test_session_store(spark, tmp_path):
    path = str(tmp_path / "s.db")
    con = sqlite3.connect(path)
    for name, columns in sessions.EXPECTED.items():
        if name != "session_refs":
            con.execute(f"CREATE TABLE {name} ({', '.join(columns)}, extra)")
    con.execute("INSERT INTO sessions VALUES ('1', 'o/r', 'main', 'sum', '2024', NULL, 'x')")
    con.execute("INSERT INTO turns VALUES ('1', 0, 'hi', NULL, '2024', 'x')")
    con.commit()
    con.close()
    spark.dataSource.register(session_store.SessionStoreSource)
    read = lambda t: spark.read.format("session_store").option("path", path).option("table", t).load()
    assert [tuple(r) for r in read("sessions").collect()] == [("1", "o/r", "main", "sum", "2024", None)]
    assert read("turns").first().turn_index == 0
    assert session_store.problems(path) == [("session_refs", "")]
    with pytest.raises(Exception, match="session_refs"):
        read("session_refs").collect()
    with pytest.raises(sqlite3.OperationalError), session_store.open_read_only(path) as own:
        own.execute("DELETE FROM turns")
