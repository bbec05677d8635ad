import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomtable.llm import jaccard, language, licenses, mixing, packing, suffix_tree, wavelet
from loomtable.llm.bpe import SegmentEncoder, default_vocabulary
from loomtable.llm.common import work_dir, file_system
from loomtable.llm.packing import shortest_pack_first, slots
from loomtable.llm.wavelet import WaveletShard, encode_shard
from loomtable.llm.words import shingle_sets, word_hashes

from .conftest import documents

ALL = {
    "op1": suffix_tree.score, "op2": mixing.mix, "op3": licenses.scan, "op4": jaccard.join, "op7": wavelet.token_output, "op8": packing.pack, "op9": language.language_id,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_and_clashing(docs, empty, clashing, name):
    f = ALL[name]
    assert f(empty).count() == 0
    rest = {"op2": lambda r: r.select("_row.doc_id", "_size", "_source_size", "_target", "_taken")}.get(name, lambda r: r)
    assert sorted(map(str, rest(f(clashing)).collect())) == sorted(map(str, rest(f(docs)).collect()))


@pytest.fixture(scope="module")
def tokenizer():
    return SegmentEncoder(default_vocabulary()).tokenizer


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_library(tokenizer):
    import random

    r = random.Random(1)
    parts = list("ab AB\n\t é  中1²'s.,!?_<|×÷Ã") + ["<|endoftext|>", "'ll", " the", "\0", "\x1c", "\u2028", "\u00a0", "\u3000", "  ", "\n\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(20_000)] + [t[1] or "" for t in documents()]
    got = SegmentEncoder(default_vocabulary(), 50).encode([t.encode() for t in texts])
    assert all(g == ids_of(tokenizer, t).tobytes() for t, g in zip(texts, got, strict=True))


def test_added_tokens_equal_a_fresh_tokenizer(spark):
    """Strings of added tokens give the ids of the library as it comes, in texts with and without them in one call, and in both operators."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_vocabulary())
    ids = lambda t: np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4")
    texts = ["x <|endoftext|> y", "plain words, here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b \0", "<|endoftext", "|> é", "", "the cat <|endoftext|>\nthe cat. " * 300]
    assert ids(texts[0]).tolist() == [87, 220, 50256, 331]
    enc = SegmentEncoder(default_vocabulary())
    for _ in range(3):
        assert enc.encode([t.encode() for t in texts]) == [ids(t).tobytes() for t in texts]
    whole = [np.append(ids(t), np.array([0], "<u4")) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    starts = np.cumsum([0, *map(len, whole)]).tolist()
    assert sorted(map(tuple, wavelet.token_output(df).collect())) == [(k, starts[k], len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(whole)]
    pieces = {(k, at, zlib.crc32(x[at : at + 1024].tobytes())) for k, x in enumerate(whole) for at in range(0, len(x), 1024)}
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.pack(df).collect()} == pieces


def test_wavelet_shard():
    r = np.random.default_rng(0)
    for n in (0, 1, 1000):
        ids = r.integers(0, 300, n).astype(np.uint16)
        import io

        s = WaveletShard(io.BytesIO(encode_shard(ids, np.array([0, n]), [7], 9)))
        assert (s.all_ids() == ids).all() and s.doc_ids() == [7]
        for k in range(0, n, 97):
            assert s.access(k) == ids[k]
        for symbol in (0, 5, 299, 511, 1 << 20):
            where = np.flatnonzero(ids == symbol).tolist()
            assert s.occurrences(symbol) == where and s.count(symbol) == len(where)
            assert s.count(symbol, n // 3, n // 2) == sum(n // 3 <= w < n // 2 for w in where)


def test_token_output(spark, docs, tokenizer):
    path = work_dir(spark, "shards")
    got = sorted(map(tuple, wavelet.token_output(docs, path=path).collect()), key=lambda r: r[1])
    want, at = [], 0
    for t in sorted(documents(), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "")):
        ids = np.append(ids_of(tokenizer, t[1]), np.array([0], "<u4"))
        want.append((t[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    fs, root = file_system(path)
    name = spark.read.parquet(f"{path}/manifest").orderBy("partition", "part").first()["path"]
    with fs.open_input_file(name) as f:
        shard = WaveletShard(f)
        assert shard.occurrences(0) == (shard.starts()[1:] - 1).tolist()


def test_packing(docs, tokenizer):
    rows = [r.asDict() for r in packing.pack(docs, size=64).collect()]
    whole = Counter()
    for t in documents():
        ids = np.append(ids_of(tokenizer, t[1]), np.array([0], "<u4"))
        for k in range(0, len(ids), 64):
            whole[t[0], k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == whole
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for sequence in by.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and all(r["sequence_tokens"] == at for r in sequence)
    assert sorted(by) == list(range(len(by)))
    padding = sum(s[0]["sequence_padding"] for s in by.values())
    assert padding < 0.05 * sum(r["length"] for r in rows)


def test_shortest_pack_first():
    import random

    for seed in range(60):
        r = random.Random(seed)
        size = r.choice([16, 64, 1024])
        h = Counter(r.choice([size, r.randint(1, size), r.randint(1, max(1, size // 4))]) for _ in range(r.randint(1, 2000)))
        patterns, got = shortest_pack_first(h, size), Counter()
        for count, lengths in patterns:
            assert count > 0 and sum(lengths) <= size
            for x in lengths:
                got[x] += count
        assert got == h and len(patterns) <= 2 * len(h)
        for length in h:
            ranks = sorted((a, b) for x, a, b, _, _ in slots(patterns) if x == length)
            assert ranks[0][0] == 0 and ranks[-1][1] == h[length] and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:], strict=False))


@pytest.mark.parametrize("full", [0, 1, 50])
def test_packing_of_one_hot_length(full):
    """Full packs don't keep pieces of a common length apart."""
    import random

    def padding(h):
        patterns = shortest_pack_first({k: n for k, n in h.items() if n}, 1024)
        got, total = Counter(), 0
        for count, lengths in patterns:
            total += count
            for x in lengths:
                got[x] += count
        assert got == Counter({k: n for k, n in h.items() if n}) and len(patterns) <= 2 * len(h)
        return total, 1 - sum(k * n for k, n in h.items()) / (1024 * total)

    assert padding({1024: full, 300: 3000})[0] == full + 1000
    assert padding({1024: full, 900: 10, 300: 3000})[0] == full + 10 + 1000
    r = random.Random(full)
    h = Counter(r.randint(1, 1024) for _ in range(2000)) + Counter({1024: full, 300: 1000})
    assert padding(h)[1] < 0.05
    # a hot length with few shorter pieces: its own packs can't be fuller than three to a pack
    h = Counter({1024: full, 300: 3000}) + Counter(r.randint(1, 1024) for _ in range(100))
    assert padding(h)[0] <= full + 1000 + 60


def words(text):
    return (text or "").encode().lower().split()


def test_mixing(docs):
    rows = [(r["_row"]["doc_id"], r["_row"]["source"], r["_size"], r["_source_size"], r["_target"], r["_taken"]) for r in mixing.mix(docs).collect()]
    sizes, size_of = Counter(), Counter()
    for t in documents():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t[1] or ""))
        sizes[t[3]] += n
        size_of[t[0], t[3], n] += 1
    assert Counter((r[0], r[1], r[2]) for r in rows) == size_of
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
    taken, largest = Counter(), Counter()
    for _, s, n, source, t, k in rows:
        assert source == sizes[s] and math.isclose(t, target[s], abs_tol=1e-6) and 0 <= k <= 3
        taken[s] += n * k
        largest[s] = max(largest[s], n)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = sorted((str(r["_row"]), r["_taken"]) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((str(r["_row"]), r["_taken"]) for r in mixing.mix(docs).collect())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r[5] for r in rows)


def test_licenses(docs):
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect()}
    want = set()
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for t in documents():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t[1] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        starts = [k for k, _ in places]
        want.add((t[0], len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == want
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    assert labels[16] == ("mit", 1.0) and labels[17] == ("apache,gpl", 1.0) and labels[0] == ("mit", 0.5) and labels[4] == ("", 0.0)


def test_template_automata():
    a = licenses.TokenAutomaton("one <<optional>>two <<optional>>deep<</optional>><</optional>> three <<var:2>> end")
    ok = ["one three end", "one two three end", "one two deep three x end", "one three x y end", "pre one three end post"]
    no = ["one deep three end", "one three x y z end", "one two end", "three end", "one three"]
    assert all(a.first(licenses.words_of(x.encode())) is not None for x in ok)
    assert all(a.first(licenses.words_of(x.encode())) is None for x in no)
    for bad in ("<<var:2>>", "<<optional>>a", "a<</optional>>", "<<optional>>a<</optional>>"):
        with pytest.raises(ValueError):
            licenses.TokenAutomaton(bad)


def test_jaccard(docs):
    sets = []
    for t in documents():
        w = words(t[1])
        sets.append((t[0], frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    known = [(i, s) for i, s in sets if i is not None]
    parent = {i: i for i, _ in known}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(known):
        for j, b in known[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()) == want
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i, _ in {(i, find(i)) for i, _ in known} if find(i) == i] + [None, None])


def test_jaccard_of_many_near_copies(spark):
    """A group whose members have other words at random places: all links must be found."""
    import random

    r = random.Random(4)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(80), r.randint(0, 5)):
            w[k] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for _, t in rows]
    parent = list(range(120))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(120)}


def test_jaccard_pairs_of_many_tokens_come_once(spark):
    """Classes that share many tokens give a pair once, not once a token; a pair of a late token isn't lost."""
    zero = [f"0L AS {w}" for w in jaccard.SIGN]
    rows = [(t, k, 300, t, k) for k in range(12) for t in range(40)]  # alike
    rows += [(1000 + 10 * k + t, k, 300, 40 + t, k) for k in range(12) for t in range(8)] + [(5000, k, 300, 48, k) for k in (20, 21)] + [(6000 + k, k, 300, 2, k) for k in (20, 21)]
    placed = spark.createDataFrame(rows, "token long, node long, n long, at int, root long")
    signs = placed.select("node", "n").distinct().selectExpr("node", "n", *zero)
    got = [(min(r), max(r)) for r in jaccard._apart(placed, signs, 80).collect()]
    assert sorted(got) == sorted([(i, j) for j in range(12) for i in range(j)] + [(20, 21)])
    # every third token is missing in each class: again all pairs, and few of them twice
    some = placed.where("node < 12 AND token < 40 AND hash(token, node) % 3 != 0")
    got = [(min(r), max(r)) for r in jaccard._apart(some, signs, 80).collect()]
    assert set(got) == {(i, j) for j in range(12) for i in range(j)} and len(got) < 100


def test_jaccard_sets_of_classes(spark, docs, monkeypatch):
    """The list and the filter find the same sets: of a class's own row alone, one of two texts with its id included."""
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(4, "another text under the id of four"), (300, None)], "doc_id long, text string")).where("doc_id IS NOT NULL")
    texts = jaccard._texts(more)
    want = {}
    for r in more.collect():
        (s,) = jaccard.shingle_sets([(r["text"] or "").encode()], 5)
        if len(s):
            x = jaccard._node(s)
            want[x] = (min(r["doc_id"], want.get(x, (r["doc_id"],))[0]), jaccard._set_cell(s))
    wanted = spark.createDataFrame([(x, i) for x, (i, _) in want.items() if i % 3 or i == 300], "node long, rep long")
    for listed in (jaccard.LISTED, -1):
        monkeypatch.setattr(jaccard, "LISTED", listed)
        got = {(r["node"], bytes(r["cell"])) for r in jaccard._sets(texts, wanted, 5).collect()}
        assert got == {(x, c) for x, (i, c) in want.items() if i % 3}
        assert jaccard._sets(texts, wanted.limit(0), 5).collect() == []


def test_jaccard_verification(spark):
    """Similar pairs of a hot class and of others, from one copy of each set; a class without a set is an error."""
    r = np.random.default_rng(6)
    base = np.unique(r.integers(0, 2**63, 100).astype(np.uint64))
    sets = {k: np.unique(np.concatenate([base[: 100 - k % 30], r.integers(0, 2**63, k % 7).astype(np.uint64)])) for k in range(400)}
    pairs = [(k, 0) for k in range(1, 400)] + [(k, k + 1) for k in range(1, 399, 2)] + [(0, 7)]
    cells = spark.createDataFrame([(k, jaccard._set_cell(s)) for k, s in sets.items()], "node long, cell binary")
    frame = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    want = Counter((u, v) for u, v in pairs if 100 * len(np.intersect1d(sets[u], sets[v])) >= 80 * len(np.union1d(sets[u], sets[v])))
    assert 0 < sum(want.values()) < len(pairs)
    assert Counter(map(tuple, jaccard._verified(frame, cells, 80).collect())) == want
    with pytest.raises(Exception, match="no set of class 0"):
        jaccard._verified(frame, cells.where("node != 0"), 80).collect()


def test_word_hashes():
    texts = [(t[1] or "").encode() for t in documents()]
    h, counts = word_hashes(texts)
    want = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.lower().split()) for t in texts] and len(h) == len(want)
    assert len(set(h.tolist())) == len(set(want)) == len(set(zip(want, h.tolist(), strict=True)))
    assert [len(s) for s in shingle_sets([b"", b"a b", b"a b c d e f a b c d e f"])] == [0, 1, 6]


def test_suffix_tree(docs):
    s = suffix_tree.Settings()
    end = object()
    rows = [(t[0], [*words(t[1]), end]) for t in documents()]
    train = [w for i, w in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    grams = Counter(tuple(w[k : k + d]) for w in train for d in range(1, s.depth + 2) for k in range(len(w) - d + 1))
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    following = defaultdict(dict)
    for g, c in grams.items():
        if len(g) > 1 and c >= 2:
            following[g[:-1]][g[-1]] = c
    states = {}

    def p(context, x):
        if not context:
            return (grams[(x,)] + s.add) / (n + s.add * (v + 1))
        q = p(context[1:], x)
        if context not in states:
            return q
        c, kept = grams[context], states[context]
        return (following[context].get(x, 0) + (s.strength + c - kept) * q) / (c + s.strength)

    for d in range(1, s.depth + 1):
        new = {}
        for g, c in grams.items():
            if len(g) == d and g[-1] is not end and c >= s.least:
                kept = sum(following[g].values()) if g in following else 0
                gain = sum(k * math.log((k - 0.5) / (c + s.strength) / p(g[1:], x)) for x, k in following.get(g, {}).items())
                if gain + (c - kept) * math.log((s.strength + c - kept) / (c + s.strength)) >= s.divergence:
                    new[g] = kept
        states |= new
    assert len({len(g) for g in states}) == 2
    want = Counter()
    for i, w in rows:
        base = sum(math.log10(p((), x)) for x in w)
        score = sum(math.log10(p(tuple(w[max(0, k - s.depth) : k]), x)) for k, x in enumerate(w))
        want[i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else None, len(w), sum(grams[(x,)] > 0 for x in w), n, round(base, 6), round(score, 6)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in suffix_tree.score(docs).collect())
    assert got == want
    for g in list(states)[:20]:  # a state's distribution sums to one, with 0.1 for all words never seen
        total = sum(p(g, x[0]) for x in grams if len(x) == 1) + p(g, object())
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_language(docs):
    rows = {(r["doc_id"], r["held_out"], r["lang_pred"]): r["score"] for r in language.language_id(docs).collect()}
    text = {t[0]: t for t in documents()}
    right = total = 0
    for (i, held, lang), score in rows.items():
        assert 0 <= score <= 1 and held == (zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else None)
        if i in (1, 2, 3, 15):
            assert lang == "und"
        if i is not None and i >= 100 and held:
            total += 1
            right += lang == text[i][2]
    assert total > 10 and right == total


def test_language_uses_text_alone(docs):
    from pyspark.sql import functions as F

    model = language.train(docs)
    cut = lambda d: sorted(map(str, language.identify(d.select("doc_id", "text"), model).select("lang_pred", "score").collect()))
    assert cut(docs) == cut(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)))


def test_ftrl_learns_sparse_weights():
    r = np.random.default_rng(0)
    rows = [(np.array([k % 3, 3 + int(r.integers(50))]), np.array([1.0, 0.3])) for k in range(300)]
    w = language.Ftrl(l1=1.0).fit(rows, np.arange(300) % 3, 3, 60)
    assert [int((w[k]).argmax()) for k in range(3)] == [0, 1, 2] and (w == 0).mean() > 0.8
    logits, labels = np.array([[5.0, 0.0]] * 10), np.array([0] * 7 + [1] * 3)
    p = language.softmax(logits / language.temperature(logits, labels))[0, 0]
    assert abs(p - 0.7) < 0.01


def test_language_sample_is_bounded(spark):
    """Rows that repeat one id are sampled once; of too many languages those with the most rows are learned; one language is predicted alone."""
    rows = [(i, f"wort nummer {i} und noch eines", "de") for i in range(1, 40)] + [(1, "immer das gleiche", "de")] * 200
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.language_id(one).collect()} == {("de", 1.0)}
    many = spark.createDataFrame([(i, f"text {i % 600} text", f"l{i % 600:03d}") for i in range(1500)], "doc_id long, text string, lang string")
    assert len(language.train(many, ftrl=language.Ftrl(), every=5).languages) == language.MOST_LANGUAGES


def test_jaccard_signatures(spark):
    """Bits that differ are never more than the shingles that do, and equal sets have equal signatures."""
    r = np.random.default_rng(3)
    for n in (1, 5, 300, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n // 3).astype(np.uint64) << np.uint64(1)]))
        bits = int(np.bitwise_count(jaccard.signature(a) ^ jaccard.signature(b)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (jaccard.signature(a) == jaccard.signature(a.copy())).all()
    x = np.array([0, 1, 127, 128, 5000, 10**6, 2**40])
    assert (np.diff(jaccard.counter_code(x).astype(int)) >= 0).all() and jaccard.counter_code(x)[:3].tolist() == [0, 1, 127]
    i, j = jaccard._pairs_within(np.array([0, 3, 4]), np.array([3, 1, 2]))
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 2), (4, 5)]
