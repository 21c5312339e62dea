import importlib

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 5))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else str(v)


CORE = [m for m in entry._CORE]


@pytest.mark.parametrize("name", [k for m in CORE for k in importlib.import_module(m).QUERIES])
def test_query_equals_its_sql(spark, data, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    import os

    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in rows) == want


def test_diversity_chooses_from_its_candidates(spark, data):
    chosen = entry.queries()["hybrid_search_mmr"](spark, "/root/testdata/sf0.01").collect()
    candidates = {(r.query_id, r.id): r.score for r in entry.queries()["hybrid_mmr_candidates"](spark, "/root/testdata/sf0.01").collect()}
    assert chosen and all(abs(candidates[r.query_id, r.id] - r.score) < 1e-5 for r in chosen)
    per_query = {}
    for r in chosen:
        per_query.setdefault(r.query_id, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, 21)) for v in per_query.values())


def test_hits_come_before_payloads(spark, data):
    plan = entry.queries()["context_build"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan  # the few hits are sent to the chunks, and only what they pick is moved
    reads = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(reads) == 1 and "chunk" in reads[0] and "dense" not in reads[0].partition("ReadSchema")[2]


def test_entry(spark, data):
    got = entry.entry(spark)
    assert got.columns == ["query_id", "rank", "id", "score"] and got.limit(1).count() == 1


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "lodestack"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lodestack\.llm|from lodestack import llm", p.read_text()), p
