import json
import re

import numpy as np
import pytest

from kiln.llm import catalog, mix, neighbours, tool_calls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_mix_meets_its_targets(docs, empty):
    rows = mix.mix(docs).collect()
    assert len(rows) == docs.count()
    size, weight = {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = (5, 2, 1)[i % 3]
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        for s in size:
            target[s] = 2.0 * size[s] if s in capped else weight[s] * left / sum(weight[x] for x in size if x not in capped)
        over = {s for s in size if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in size:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == size[s]
        assert abs(sum(r.taken for r in own) - target[s]) <= len(own)
    assert all(r.size == len(WORD.findall(t.text or "")) for r, t in zip(sorted(rows, key=lambda r: repr(r.doc_id)), sorted(docs.collect(), key=lambda r: repr(r.doc_id)), strict=True))
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted(map(repr, mix.mix(docs).collect())) == sorted(map(repr, rows))
    assert mix.mix(empty).count() == 0
    out = mix.mixed(docs)
    assert out.columns == docs.columns and mix.mixed(empty).count() == 0


@pytest.mark.parametrize("kind", ["null", "equal id", "equal rows"])
def test_rows_that_share_an_id_are_cut_among_themselves(spark, kind):
    size = {"a": 400, "b": 1000}
    data = []
    for s, n in size.items():
        for i in range(n):
            same = i % 3 == 0 if s == "b" else i >= 0
            words = 4 if kind == "equal rows" and same else 1 + i % 7
            text = " ".join(["same" if kind == "equal rows" and same else f"{s}{i}"] * words)
            data.append(((None if kind == "null" else -1) if same else i, text, s))
    docs = spark.createDataFrame([*data, (None, None, "a"), (7, "", "b")], "doc_id long, text string, source string").repartition(5)
    for share in (0.2, 0.55, 1.5):
        state = {r.source: (r.target, r.source_size) for r in mix.mix(docs, share=share).select("source", "target", "source_size").distinct().collect()}
        out = mix.mixed(docs, share=share).collect()
        for s, (target, whole) in state.items():
            words = sum(len((r.text or "").split()) for r in out if r.source == s)
            assert abs(words - target) <= 8, (share, s, words, target, whole)
        assert {r.text for r in out if not r.text} == {None, ""}


def test_a_larger_budget_takes_all_that_a_smaller_one_takes(docs):
    small, large = ({repr((r.doc_id, r.size)): r.taken for r in mix.mix(docs, share=s).collect()} for s in (0.3, 0.6))
    assert all(large[k] >= v - 1 for k, v in small.items())


def test_rows_taken_do_not_depend_on_partitions(spark):
    """A third of the rows have no id, some are equal: other partitions, the same rows."""
    data = [(None if i % 3 else i, f"t{i % 40} " * (1 + i % 5), "ab"[i % 2], i % 40) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, extra int")
    one, other = (sorted(map(repr, mix.mixed(docs.repartition(n), share=0.7).collect())) for n in (2, 5))
    assert one == other and 0 < len(one) < 400


def test_neighbours_in_many_shards(spark, monkeypatch):
    """Vectors of two lengths over seven shards: the queries meet them all, none twice."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, [1.0, float(i)]) for i in range(40)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "SHARD", 230)
    rows = neighbours.nearest(table, table.where("vec_id % 20 = 0")).collect()
    y, hit = x.astype(np.float64), 0
    for q in range(0, 1500, 20):
        own = [r.vec_id for r in rows if r.query_id == q]
        assert len(own) == len(set(own)) == 20 and q not in own and max(own) < 1500
        score = y @ y[q]
        score[q] = -np.inf
        hit += len(set(own) & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.95 * 75 * 20
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 2000] == list(range(2001, 2021))


@pytest.mark.parametrize("n, dims, most", [(16_000, 64, 0.4), (4_000, 64, 0.6), (500, 64, 1.0)])
def test_recall_and_share_verified_in_a_shard(n, dims, most):
    """Random vectors, the hardest case: recall of the 20 nearest, and the share of the shard that collides often enough."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, dims))
    asked = rng.choice(n, 60, replace=False)
    shard = neighbours.Shard(x, np.arange(n), float(np.sqrt((x * x).sum(1)).max()))
    found, hit = shard.collided(x[asked], 20), 0
    for q, near in zip(asked, found, strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(near.tolist()) & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.92 * 20 * len(asked)
    assert np.mean([len(f) for f in found]) <= most * n


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:160] = x[40]
    data = [(i, v.tolist(), "id") for i, v in enumerate(x)] + [(5000, None, "id"), (5001, [0.0] * 16, "id"), (5002, [float("nan")] * 16, "id"), (5003, [None] * 16, "id"), (None, x[0].tolist(), "id")]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, id string")
    rows = neighbours.nearest(table, table.where("vec_id % 20 = 0")).collect()
    y, hit = x.astype(np.float64), 0
    for q in range(0, 3000, 20):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(y[r.vec_id] @ y[q]), abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        score = np.round(y @ y[q], 9)
        score[q] = -np.inf
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(3000), -score))[:20].tolist()))
    assert hit >= 0.9 * 150 * 20
    assert {r.query_id for r in rows} == set(range(0, 3000, 20))
    few = spark.createDataFrame(data[:5], table.schema)
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 4
    assert neighbours.nearest(table.where("false"), table.where("false")).count() == 0


SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "calc": {"x": ("number", True)}, "ping": {}}
CALL = "conv_id long, call_id string, turn long, tool string, arguments string, after array<string>"
RESULT = "conv_id long, call_id string, turn long, content string, json string"


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "search", '{"query":"x","limit":3}', None),
            (1, "b", 1, "search", '{"limit":"3"}', ["a"]),
            (1, "c", 2, "calc", '{"x":1.5,"z":1}', ["b", "a", "unheard"]),
            (1, "c", 3, "calc", '{"x":2}', []),
            (2, "a", 0, "nope", "{}", ["b"]),
            (2, "b", 1, "calc", "[1]", ["a"]),
            (2, "d", 1, "ping", None, []),
            (None, "q", 1, "calc", '{"x":2}', []),
            (3, "a", 0, "calc", '{"x":2}', []),
        ],
        CALL,
    )
    results = spark.createDataFrame([(1, "a", 2, "late", "-"), (1, "a", 1, "first", "-"), (1, "c", 3, "c", "-"), (1, "x", 3, "lost", "-"), (3, "a", 1, None, "-")], RESULT)
    got = {(r.conv_id, r.call_id, r.kind, r.turn): r for r in tool_calls.link(calls, results, SCHEMAS).collect()}
    assert len(got) == 10
    a = got[1, "a", "call", 0]
    assert (a.depth, a.errors, a.n_results, a.result) == (0, [], 2, "first")
    assert a.json == '{"arguments":{"limit":3,"query":"x"},"conversation":1,"id":"a","result":"first","tool":"search"}'
    assert got[1, "b", "call", 1].errors == ["missing query", "type limit", "no result"]
    assert (got[1, "c", "call", 2].depth, got[1, "c", "call", 2].errors) == (2, ["unexpected z"])
    assert got[1, "c", "call", None].errors == ["duplicate id"]
    assert got[2, "a", "call", 0].errors == ["unknown tool", "cycle", "no result"]
    assert got[2, "b", "call", 1].errors == ["not an object", "cycle", "no result"]
    assert got[2, "d", "call", 1].errors == ["not an object", "no result"]
    assert got[None, "q", "call", 1].errors == ["no id"]
    assert got[1, "x", "orphan", 3].errors == ["no call"]
    assert tool_calls.link(calls.where("false"), results.where("false"), SCHEMAS).count() == 0


def brute_depths(calls):
    """Depth of each (conversation, call) that waits for no cycle."""
    known, out = {(c, i): a for c, i, a in calls}, {}
    for _ in range(len(calls) + 1):
        for (c, i), after in known.items():
            deps = [(c, d) for d in after if (c, d) in known]
            if (c, i) not in out and all(d in out for d in deps):
                out[c, i] = 1 + max((out[d] for d in deps), default=-1)
    return out


def test_depths_equal_brute_force(spark):
    import random

    random.seed(6)
    calls = []
    for c in range(30):
        for i in range(25):
            deps = [f"k{random.randint(0, 24 if c % 3 == 0 else max(0, i - 1))}" for _ in range(random.choice((0, 1, 1, 1, 2, 3)))]
            calls.append((c, f"k{i}", sorted({d for d in deps if c % 3 == 0 or d != f"k{i}"} | ({"none"} if i % 5 == 0 else set()))))
    calls += [(50, "self", ["self"]), (50, "on self", ["self"]), (50, "both", ["self", "free"]), (50, "free", [])]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.depth for r in tool_calls.depths(frame).collect()}
    want = brute_depths(calls)
    assert got == want and len(want) < len(calls) and max(want.values()) > 5


def test_a_chain_of_a_thousand_calls(spark):
    import time

    calls = spark.createDataFrame([(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(1000)], "conv_id long, call_id string, after array<string>")
    start = time.time()
    assert {r.call_id: r.depth for r in tool_calls.depths(calls).collect()} == {f"c{i}": i for i in range(1000)}
    assert time.time() - start < 60  # 30 s on a machine with nothing else to do


def test_tool_calls_carry_whole_texts(spark):
    odd = ["Étion dans l'été", 'say "hi" \\ twice', "line\nfeed\ttab \x01\x1f", "日本 😀", "{[1,2]}", "", None, "plain words " * 30, "x" * 13, "y" * 26]
    data = [(c, t, ("system", "assistant", "user", "assistant", "tool", None)[t], odd[(c + t) % 10]) for c in range(40) for t in range(6)]
    data += [(100 + n, 0, "assistant", "é" * n) for n in range(80)]
    calls, results = catalog.chat_calls(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    text = {(c, t): x or "" for c, t, _, x in data}
    assert sorted(r.turn for r in results.collect()) == sorted(t for _, t, role, _ in data if role != "assistant")
    for r in calls.collect():
        got = json.loads(r.arguments)
        assert text[r.conv_id, r.turn] in (got if isinstance(got, list) else got.values())
    rows = tool_calls.link(calls, results, catalog.TOOLS).collect()
    assert len(rows) == len(data) - sum(r.n_results for r in rows)
    valid = 0
    for r in rows:
        if r.kind == "orphan":
            assert r.result == text[r.conv_id, r.turn]
            continue
        line = json.loads(r.json)
        assert line["result"] == r.result == (text[r.conv_id, r.turn + 1] if r.n_results else None)
        if line["arguments"]:
            valid += 1
            assert text[r.conv_id, r.turn] in line["arguments"].values()
    assert valid > 20


@pytest.mark.parametrize("key", sorted(catalog.oracle_sql()))
def test_oracle(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    names = sorted(catalog.queries()[key](spark, SF).columns)
    mine = sorted(repr(tuple(r[c] for c in names)) for r in catalog.queries()[key](spark, SF).collect())
    sql = con.execute(f"select {', '.join(names)} from ({catalog.oracle_sql()[key]})").fetchall()
    assert mine == sorted(map(repr, sql))


def test_collisions_counted_in_cells():
    """Counts of whole blocks of queries equal a plain loop over projections, whose windows end at borders of cells."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 24))
    x[7] = x[8]
    shard = neighbours.Shard(x, np.arange(3000), float(np.sqrt((x * x).sum(1)).max()))
    at = (x[:5] / np.sqrt((x[:5] * x[:5]).sum(1, keepdims=True))) @ shard.axes[:-1]
    half = np.array([0.01, 0.3, 1.0, 2.5, 100.0])
    count = shard._counted(at, half)
    for q in range(5):
        want = np.zeros(3000, int)
        for j in range(neighbours.PROJECTIONS):
            lo, hi = (int(np.clip((at[q, j] + h - shard.low[j]) / shard.cell[j], 0, 255)) for h in (-half[q], half[q]))
            want += (shard.cells[j] >= lo) & (shard.cells[j] <= hi)
        assert count[q].tolist() == want.tolist()
    assert (count[4] == neighbours.PROJECTIONS).all() and (count[:, 7] == count[:, 8]).all()
