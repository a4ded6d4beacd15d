import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from veriframe.llm import quotes

from . import data

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "conv_id long, turn long, role string, text string, path string, position long"

CHAT = [
    (1, 0, "user", "Hello there\nsecond line\n\nNew para here"), (1, 1, "assistant", "> Hello there\n> second line\n\nhi"), (1, 2, "user", "more"), (1, 3, "user", "> new  PARA here\nanswer to zero"),
    (1, 4, "assistant", "> answer to zero\n>> new para here\nok"), (1, 5, "user", "> hi\nback to one"), (1, 6, "user", "cont"), (1, 7, "a", ">> hi\n> back to one\nz"), (1, 8, None, None),
    (1, 9, "u", "> more\nx"), (1, 9, "u", "> more\nx"), (1, 10, "u", "> hi\n> back to one\n\n\n"), (2, 0, "user", "a"), (2, 5, "user", "> zzz\nb"), (None, 3, "x", "q"), (None, None, "x", "> q\nr"),
    (3, None, "u", "t"), (3, 1, "u", "> t\ns"), (4, 0, "u", "w " * 30_000), (4, 1, "u", "> " + "w " * 30_000 + "\nyes"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "taken", 3) for r in rows], SCHEMA)


def by_sql(rows):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    return Counter(con.execute(f"SELECT conv_id, part, n_messages, n_linked, chat FROM ({quotes.OP2_SQL})").fetchall())


def long_chat(n=700):
    """Every seventh message quotes one of 40 turns before; every fourth of those quotes with two levels."""
    rows = []
    for i in range(n):
        text = f"message number {i} says this"
        if i % 7 == 0 and i > 40:
            text = f"> message number {i - 40} says this\n" + (f">> message number {i - 41} says this\n" if i % 4 == 0 else "") + text
        rows.append((9, i, "user" if i % 2 else "assistant", text))
    return rows


@pytest.mark.parametrize("rows", [CHAT, long_chat(), CHAT + long_chat(300)])
def test_chats_match_the_sql(spark, rows):
    assert Counter(tuple(r) for r in quotes.format_chats(frame(spark, rows)).collect()) == by_sql(rows)


def test_chats_of_nothing_and_parts(spark):
    assert quotes.format_chats(frame(spark, [])).collect() == []
    parts = quotes.format_chats(frame(spark, long_chat(130)), part=50).collect()
    assert sorted(r.n_messages for r in parts) == [30, 50, 50]
    assert not any(line.startswith(">") for r in parts for line in r.chat.split("\n"))


def test_no_python_on_the_main_path(spark):
    plan = quotes.format_chats(frame(spark, CHAT))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages_on_edges(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    docs = data.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / f"stage{i}")
        out.write.parquet(path)
        if i < 4:
            assert out.columns == docs.columns
        now = spark.read.parquet(path)
    assert now.count() > 0
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())
    assert got == Counter(tuple(r) for r in now.select("doc_id", "piece", "length", "ids_crc32").collect())
    none = data.empty(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, str(tmp_path))
        assert out.collect() == [] and (i == 4 or out.columns == docs.columns)


def test_entry_works_without_this_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('veriframe.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
