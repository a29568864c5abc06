"""Second-order degrees: what is stored of them, and arrays of a stretch of time."""

import numpy as np
import pytest

from tidemark.operators import degrees as D


@pytest.mark.parametrize(("scope", "direction"), [("intra", "in"), ("ecosystem", "in"), ("intra", "out"), ("ecosystem", "out")])
def test_no_pair_of_edges_is_stored(spark, monkeypatch, scope, direction):
    from tidemark.operators import graph

    edges = spark.range(90).selectExpr("1L src", "0L tgt", "'c' label", "7L project", "id ts", "id seq", "1L m")
    other = "2L src, 1L tgt" if direction == "in" else "1L src, 2L tgt"
    edges = edges.unionByName(spark.sql(f"select {other}, 'c' label, 7L project, -1L ts, -1L seq, 1L m"))
    queries = spark.sql(f"select 1L id, 95L ts, 95L seq, 0L u, {7 if scope == 'intra' else 8}L project")
    stored, keep = [], graph.shared_table
    monkeypatch.setattr(graph, "shared_table", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    assert [r.degree for r in graph.second_order_degree(queries, edges, 1000, scope, direction, ("c",)).collect()] == [90 * 91 // 2]
    assert max(t.observed_rows for t in stored) == 91


@pytest.mark.parametrize("intra", [True, False])
def test_events_in_small_pieces(monkeypatch, intra):
    rng, n = np.random.default_rng(4), 400
    x = {c: rng.integers(0, k, n) for c, k in (("n", 9), ("u", 6), ("p", 3), ("ts", 900), ("label", 2), ("into", 3), ("every", 3))}
    x |= {"ts": x["ts"] - 100, "seq": np.arange(n), "own": np.minimum(x["every"], rng.integers(0, 2, n))}

    def told() -> dict:
        out: dict = {}
        for some in D._events(x, 0, 400, 100, intra, 2):
            for u, p, label, kind, ts, seq, ends, *v in zip(*some.values(), strict=True):
                key = (int(u), int(p), int(label), int(kind), int(ts), int(seq), bool(ends))
                out[key] = out.get(key, 0) + np.array(v)
        return {k: tuple(v.tolist()) for k, v in out.items() if v.any()}

    want = told()
    ends = [k for k in want if k[-1]]
    assert ends and any(k[3] >= D._LEFT for k in ends) and sum(map(sum, want.values())) == 0  # all that begins ends
    monkeypatch.setattr(D, "PAIRS", 7)
    monkeypatch.setattr(D, "CELLS", 5)
    assert told() == want


def test_people_and_integrators_of_the_same_numbers(spark, tmp_path):
    import duckdb

    from tests.oracle import compare
    from tidemark.plans import catalog

    con = duckdb.connect()
    for name in ("part", "orders", "lineitem"):
        con.execute(f"CREATE TABLE all_{name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    con.execute("UPDATE all_lineitem SET l_suppkey = CASE WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN NULL ELSE (l_orderkey * 7 + l_linenumber * l_linenumber) % 110 END")
    con.execute("UPDATE all_orders SET o_custkey = CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 100 END, o_orderdate = CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END")
    for name in ("part", "orders", "lineitem"):
        con.execute(f"COPY all_{name} TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for query in ("second_order_in_eco", "second_order_out_intra", "second_order_in_intra", "second_order_out_eco"):
        assert compare(con, catalog.QUERIES[query](spark, str(tmp_path)), catalog.ORACLE_SQL[query]) == "", query
