import ast
from pathlib import Path

from turnloom.streaming import incremental

ROOT = Path(__file__).resolve().parents[1]


def test_streamed_edges(spark, tmp_path):
    schema = "episode string, scene_id int, sentence_id int, start_s double, end_s double, speaker string"
    spark.createDataFrame([("e", 1, i, float(i), i + 0.5, s) for i, s in enumerate("ABA")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = incremental.write_scene_edges(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["sentence_id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.source, r.target, r.weight) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A", "B", 3.25)]


def test_streamed_sessions(spark, tmp_path):
    spark.sql("select 1L user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,h) ts from values (0),(1),(9) t(h)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.event_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n_events for r in spark.sql("select * from sessions").collect()) == [1, 2]


def test_nothing_else_imports_the_optional_subpackage():
    for f in (ROOT / "turnloom").rglob("*.py"):
        if "llm" in f.relative_to(ROOT / "turnloom").parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), f


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "episode_edges" in entry.queries()
