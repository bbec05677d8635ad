import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtable.llm import ann, chat, topk


def vectors(spark, n=900, dims=16, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(dims)]) for i in range(n)]
    rows += [(n + k, rows[7][1]) for k in range(40)]  # ties
    rows += [(2000, None), (2050, [None] * dims), (2100, [float("nan")] * dims), (2150, [float("inf")] + [0.0] * (dims - 1)), (2200, [0.0] * dims), (None, rows[1][1]), (2250, []), (2300, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def usable(rows, zero):
    out = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    if not zero:
        out = [(i, v) for i, v in out if v.any()]
    return [(i, np.pad(v, (0, 16 - len(v)))) for i, v in out]


def test_top_k(spark):
    rows, df = vectors(spark)
    have = usable(rows, True)
    ids = np.array([i for i, _ in have])
    m = np.floor(256 * np.array([v for _, v in have])).astype(int)
    want = []
    for k in np.flatnonzero(ids % 50 == 0):
        s = m @ m[k]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:5]
        want += [(ids[k], r, ids[j], s[j]) for r, j in enumerate(best, 1)]
    got = topk.top_k(df.withColumn("q", F.lit(1)).withColumn("score", F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    small = topk.top_k(df.where("vec_id < 3"))
    assert sorted((r["query_id"], r["rank"]) for r in small.collect()) == [(0, 1), (0, 2)]
    assert topk.top_k(df.where("false")).count() == 0
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(huge)


def test_top_k_in_small_blocks(spark, monkeypatch):
    from loomtable.llm import vectors as v

    rows, df = vectors(spark, 300)
    whole = sorted(map(tuple, topk.top_k(df).collect()))
    monkeypatch.setattr(v, "QUERY_BLOCK_BYTES", 300)
    assert sorted(map(tuple, topk.top_k(df).collect())) == whole


def test_collision_search(spark):
    rows, df = vectors(spark, 1900)
    have = usable(rows, False)
    ids, m = np.array([i for i, _ in have]), np.array([v for _, v in have])
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == sorted(set(ids[queries].tolist()))
    recall = []
    for k in queries:
        s = m @ m[k]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:20]
        found = sorted(got[ids[k]])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(np.isclose(x, s[ids == i][0], rtol=1e-12, atol=1e-12) for _, i, x in found)
        assert [(-x, i) for _, i, x in found] == sorted((-x, i) for _, i, x in found)
        recall.append(len({i for _, i, _ in found} & set(ids[best].tolist())) / 20)
    assert np.mean(recall) >= 0.9
    assert ann.nearest(df.where("false")).count() == 0 and ann.nearest(df.where("vec_id = 2200")).count() == 0


def test_collisions_count_windows():
    r = np.random.default_rng(1)
    keys = r.standard_normal((10, 50)).astype(np.float32)
    order = np.argsort(keys, axis=1)
    ranked = np.take_along_axis(keys, order, 1)
    ranks = np.argsort(order, axis=1).astype(np.uint16)
    found = ann.collisions(ranked, ranks, keys[:, [3, 8]], 7, 10)[0]
    half = np.float32(ann.HALF_WIDTH)
    while (now := np.flatnonzero((np.abs(keys - keys[:, 3:4]) <= half).sum(axis=0) >= 7)).size < 10:
        half *= np.float32(ann.WIDEN)
    assert found.tolist() == now.tolist()
    assert [len(x) for x in ann.collisions(ranked, ranks, keys[:, [3, 4, 5]], 7, 50)] == [50] * 3


def test_escape_is_reversible():
    for x in ["", "\\", "a\\b", "</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>x<|im_end|>", "\\</s>", "<\\/s>", "<<SYS>>", "<<s>", "é中"]:
        e = chat.escape(x)
        assert chat.unescape(e) == x and not any(c in e for c in chat.CONTROL)
        t, _ = chat.format_turn(x, x)
        assert chat.read_chat(t * 2) == [(x, x)] * 2


def test_chat_digests(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "a<|im_end|>b"), (1, 2, "assistant", "a<|im_end|>b"), (2, 5, None, "x"), (2, 4, "assistant", ""), (None, 0, "user", "null id"), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(4)
    for part in (1 << 20, 100):
        got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(chat.turn_rows(df), part)).collect()}
        assert set(got) == {1, 2, None, -7, 9}
        for i, r in got.items():
            turns = sorted(((t, a or "", x or "") for c, t, a, x in rows if c == i), key=lambda t: (t[0], t[1], t[2]))
            loss = "".join(x for _, a, x in turns if a == "assistant")
            assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            assert r["formatted_chars"] == sum(len(chat.format_turn(a, x)[0]) for _, a, x in turns)
    assert chat.digests(chat.format_chat(chat.turn_rows(df.where("false")))).count() == 0
    with pytest.raises(ValueError):
        chat.turn_rows(df.drop("role"))


def test_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do", "output": "done"},
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"other": 1},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, None), (91, "{broken")], "id long, record string")
    got = {}
    for r in chat.canonical_turns(df, "id", "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    assert got[0] == [("prompt", "user", "p"), ("prompt", "assistant", "c")]
    assert got[1] == [("instruction", "user", "do\n\nthis"), ("instruction", "assistant", "done")]
    assert got[2][0] == ("instruction_short", "user", "do")
    assert got[3] == [("messages", "user", "hi"), ("messages", "assistant", "yo")]
    assert got[4] == [("share", "user", "q"), ("share", "assistant", "a")]
    assert all(got[k] == [("unknown", None, None)] for k in (5, 90, 91))
    assert len(chat.registry(chat.MAPPINGS)) == len(chat.MAPPINGS)


def test_extra_fields_keep_their_turns(spark):
    """Fields that no mapping names don't hide a layout, at the top or in a message."""
    records = [
        {"id": 1, "source": {"name": "x", "tags": []}, "prompt": "p", "completion": "c"},
        {"id": 2, "messages": [{"role": "user", "content": "hi", "name": "ann"}, {"role": "assistant", "content": "yo"}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id long, record string")
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"], r["layout"]) for r in chat.canonical_turns(df, "id", "record").collect())
    assert got == [(0, 0, "user", "p", "prompt"), (0, 1, "assistant", "c", "prompt"), (1, 0, "user", "hi", "messages"), (1, 1, "assistant", "yo", "messages")]


def test_turn_rows_look_up_the_registry(spark, monkeypatch):
    """The mapping of op5 is the one that the registry has under the hash of the table's fields."""
    asked = []
    known = chat.registry
    monkeypatch.setattr(chat, "registry", lambda mappings: asked.append(known(mappings)) or asked[-1])
    df = spark.createDataFrame([(1, 0, "user", "hi", "x")], "conv_id long, turn long, role string, text string, prompt string")
    assert [tuple(r) for r in chat.turn_rows(df).collect()] == [(1, 0, "user", "hi")]
    assert list(asked[0]) == [chat.fingerprint({"conv_id", "turn", "role", "text"})]


def test_odd_records_are_unknown(spark):
    odd = ['{"messages":[{"role":"user","content":5}]}', '{"prompt": 3, "completion": "x"}', '{"a":' * 5000 + "1" + "}" * 5000, '{"prompt":"\\ud800","completion":"x"}', '{"messages":[{"role":"user","content":"x"}, "y"]}', "[1]", "", None]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, record string")
    assert {(r["conv_id"], r["turn"], r["role"], r["text"], r["layout"]) for r in chat.canonical_turns(rows, "id", "record").collect()} == {(k, None, None, None, "unknown") for k in range(len(odd))}


def test_collision_search_in_a_whole_shard(spark):
    """Recall where a shard is full, so that a small share of its rows is verified."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64))
    m = centres[rng.integers(0, 40, ann.SHARD_ROWS + 300)] + rng.standard_normal((ann.SHARD_ROWS + 300, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.nearest(df, every=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for k in range(0, len(m), 100):
        s = m @ m[k]
        s[k] = -np.inf
        recall.append(len(got[k] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9
    keys = ann.projections(m[: ann.SHARD_ROWS], norm := np.linalg.norm(m, axis=1).max())
    order = np.argsort(keys, axis=1)
    centres = ann.directions(64)[:, :-1] @ (m[:1000:10] / np.linalg.norm(m[:1000:10], axis=1, keepdims=True)).T
    want = 20 + ann.VERIFY_MORE + int(ann.VERIFY * ann.SHARD_ROWS)
    found = ann.collisions(np.take_along_axis(keys, order, 1).astype("f4"), np.argsort(order, axis=1).astype("u2"), centres, int(np.ceil(ann.COLLIDE * len(keys))), want)
    assert norm > 0 and want <= np.mean([len(x) for x in found]) < 0.2 * ann.SHARD_ROWS
