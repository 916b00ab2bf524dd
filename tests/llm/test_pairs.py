"""Near copies, components, neighbours and passages against brute force."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest

from matchloom.llm import near_copies, neighbours, passages
from matchloom.llm.components import components
from matchloom.llm.shingles import Words, shingles

VOCABULARY = [f"w{i}" for i in range(400)]


def words_of(seed: int, n: int) -> list[str]:
    return random.Random(seed).choices(VOCABULARY, k=n)


def edited(words: list[str], seed: int, edits: int) -> list[str]:
    r, words = random.Random(seed), list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.random()}"
    return words


def jaccard(a: str, b: str) -> float:
    sets = []
    for t in (a, b):
        w = re.findall(r"[^\W_]+", t.lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def texts():
    found = {}
    for g in range(12):
        base = words_of(g, 120)
        found[f"{g:02}a"] = " ".join(base)
        for v, edits in enumerate((1, 3, 6, 9)):
            found[f"{g:02}{'bcde'[v]}"] = " ".join(edited(base, g * 10 + v, edits))
    return found


def test_links_equal_brute_force(spark, texts):
    rows = [*texts.items(), ("00a", texts["00a"]), ("null", None), ("empty", ""), ("short", "w1 w2 w3"), ("00z", texts["00a"]), (None, texts["01a"])]
    table = spark.createDataFrame([(k, t, "clash") for k, t in rows], "key string, text string, lo string")
    got = {tuple(r) for r in near_copies.spelled(*near_copies.similar(table)).collect()}
    every = texts | {"00z": texts["00a"]}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(every), 2) if jaccard(every[a], every[b]) >= 0.7}


def test_links_of_nothing(spark):
    table = spark.createDataFrame([], "key string, text string")
    links, membership = near_copies.similar(table)
    assert links.count() == membership.count() == 0 == near_copies.spelled(links, membership).count()


def test_hot_group_of_copies_is_a_star(spark):
    text = " ".join(words_of(99, 60))
    near = text + " tail"
    table = spark.createDataFrame([(f"{i:04}", text) for i in range(300)] + [("near", near)], "key string, text string")
    got = {tuple(r) for r in near_copies.spelled(*near_copies.similar(table)).collect()}
    assert got == {("0000", f"{i:04}") for i in range(1, 300)} | {("0000", "near")}


def test_differing_texts_of_one_shingle_set_keep_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 32)
    words = words_of(98, 60)
    rows = [(f"{i:04}", " ".join([*words[:-1], words[-1] + "!" * (i + 1)])) for i in range(80)]
    rows += [(f"c{i:03}", rows[5][1]) for i in range(70)] + [("near", " ".join([*words, "tail"]))]
    table = spark.createDataFrame(rows, "key string, text string")
    got = [tuple(r) for r in near_copies.spelled(*near_copies.similar(table)).collect()]
    keys = [f"{i:04}" for i in range(80)] + ["near"]
    assert sorted(got) == sorted([*itertools.combinations(keys, 2), *(("0005", f"c{i:03}") for i in range(70))])


def test_blocks_keep_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    sign = bytes(128)
    rows = [(i, sign, [1, 2] if i < 2 else [1]) for i in range(30)] + [(40, sign, [3]), (41, bytes(range(1, 129)), [1])]
    first = spark.createDataFrame(rows, "id long, sign binary, bands array<long>")
    got = [tuple(r) for r in near_copies.candidates(first, 0.7).collect()]
    assert sorted(got) == list(itertools.combinations(range(30), 2))


def test_components(spark):
    chain = [(f"a{i:02}", f"a{i + 1:02}") for i in range(25)]
    star = [("b00", f"b{i:02}") for i in range(1, 40)]
    links = spark.createDataFrame([*chain, *star, ("c", "c"), (None, "d"), chain[0]], "lo string, hi string")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {f"a{i:02}": "a00" for i in range(26)} | {f"b{i:02}": "b00" for i in range(40)}
    assert components(links.limit(0)).count() == 0


def test_groups(spark, tmp_path, texts):
    rows = [(k, t) for k, t in texts.items() if k.startswith(("00", "01"))]
    spark.createDataFrame(rows, "document_id string, text string").write.parquet(f"{tmp_path}/docling_outputs.parquet")
    groups = {r.document_id: r.group_id for r in near_copies.p1_groups(spark, str(tmp_path)).collect()}
    assert set(groups.values()) == {"00a", "01a"}


def test_groups_are_those_of_all_pairs(spark, texts, monkeypatch):
    """Chains of edits, in which ends are no longer similar, and a bucket of many texts that are all alike."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    every = dict(texts)
    for g in range(4):
        words = words_of(50 + g, 120)
        for step in range(12):
            every[f"chain{g}-{step:02}"] = " ".join(words)
            words = edited(words, g * 100 + step, 4)
    base = words_of(77, 200)
    every |= {f"hot{i:03}": " ".join([*base, f"end{i}"]) for i in range(150)}
    rows = [*every.items(), ("copy", every["hot007"]), ("null", None), ("hot000", every["hot000"])]
    table = spark.createDataFrame(rows, "key string, text string")
    links, membership = near_copies.similar(table)
    stars = membership.where("key <> root").selectExpr("root lo", "key hi")
    expected = {tuple(r) for r in components(links.select("lo", "hi").unionAll(stars)).collect()}
    assert {tuple(r) for r in near_copies.grouped(table).collect()} == expected
    assert {r for k, r in expected if k.startswith("hot")} == {"copy"} and near_copies.grouped(table.limit(0)).count() == 0


def test_shingles_are_order_sensitive():
    words = Words()
    a, b = (shingles(t, 3, 3, words) for t in ("a b c", "c b a"))
    assert len(a) == len(b) == 1 and a[0] != b[0] and shingles("A, b! c", 3, 3, words)[0] == a[0] and shingles("a b", 3, 3, words) is None


def brute_passages(texts: dict[int, str], least: int) -> set:
    grams: dict[str, set] = {}
    for k, t in texts.items():
        for i in range(len(t) - least + 1):
            grams.setdefault(t[i : i + least], set()).add(k)
    return {p for ks in grams.values() for p in itertools.combinations(sorted(ks), 2)}


def test_passages_equal_brute_force(spark):
    r = random.Random(5)
    letters = "abcdefgh \n"
    noise = lambda n: "".join(r.choices(letters, k=n))
    shared = [noise(n) for n in (238, 239, 240, 241, 260, 400, 900)]
    texts = {k: noise(r.randrange(0, 700)) for k in range(40)}
    for s in shared * 3:
        for k in r.sample(range(40), 2):
            texts[k] = texts[k][: r.randrange(len(texts[k]) + 1)] + s + noise(50) + texts[k][:300]
    texts[40] = "z" * 500
    texts[41] = noise(10) + "z" * 260
    rows = [(k, t, "x") for k, t in texts.items()] + [(42, None, "x"), (43, "", "x"), (0, texts[0], "x"), (None, texts[1], "x")]
    spans, membership = passages.shared_spans(spark.createDataFrame(rows, "key long, text string, lo string"))
    got = {tuple(r) for r in near_copies.spelled(spans.select("lo", "hi").distinct(), membership).collect()}
    assert got == brute_passages(texts, 240)
    for s in spans.collect():
        assert texts[s.lo][s.start_lo : s.start_lo + s.length] == texts[s.hi][s.start_hi : s.start_hi + s.length] and s.length >= 240


def test_windows_hold_every_run():
    hashes = np.random.default_rng(3).integers(0, 50, 300).astype(np.uint64)
    found = passages.windows(hashes, 10)
    for i in range(0, 290, 7):
        for j in (i + 9, min(299, i + 60)):
            low = hashes[i : j + 1].min()
            assert any(a <= i and j <= b and i <= c <= j and hashes[c] == low for a, c, b in found)


def test_passages_of_copies_and_nothing(spark):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    rows = spark.createDataFrame([(i, text) for i in range(100)] + [(200, text[:250] + "!")], "key long, text string")
    got = {tuple(r) for r in near_copies.spelled(*(lambda s, m: (s.select("lo", "hi").distinct(), m))(*passages.shared_spans(rows))).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(0, 200)}
    assert passages.shared_spans(rows.limit(0))[0].count() == 0


def test_periodic_texts_have_few_windows(spark):
    dots = passages.gram_hashes(passages.codes("." * 1_000_000), 120, passages.Powers())
    (left, centres, right), = passages.tied(dots, 121)
    assert (left, right, len(centres)) == (0, len(dots) - 1, len(dots)) and passages.runs(centres, 120) == [(0, len(dots), 1)]
    assert passages.runs(np.array([1, 2, 3, 4, 10, 16, 22, 300, 900]), 120) == [(1, 4, 1), (10, 3, 6), (300, 1, 0), (900, 1, 0)]
    assert passages.runs(np.array([1, 2, 4, 6, 8]), 120) == [(1, 2, 1), (4, 3, 2)]
    r = random.Random(6)
    noise = ["".join(r.choices("abcdefgh ", k=200)) for _ in range(6)]
    texts = {1: noise[0] + "." * 300, 2: "." * 1200 + noise[1], 3: noise[2] + "ab" * 200 + noise[0][:130], 4: "ab" * 125 + noise[3], 5: "." * 200 + noise[4], 6: noise[5] + "." * 239}
    texts |= {7: "." * 150 + noise[4], 8: "xy" * 60 + noise[3] + "." * 100_000, 9: "." * 50_000}
    spans, membership = passages.shared_spans(spark.createDataFrame(list(texts.items()), "key long, text string"))
    found = spans.collect()
    assert {(s.lo, s.hi) for s in found} == brute_passages({k: t[:2_000] for k, t in texts.items()}, 240)
    for s in found:
        assert texts[s.lo][s.start_lo : s.start_lo + s.length] == texts[s.hi][s.start_hi : s.start_hi + s.length] and s.length >= 240
    covered = sorted((s.start_lo, s.start_lo + s.length) for s in found if (s.lo, s.hi) == (8, 9))
    reach = covered[0][0]
    for a, b in covered:
        assert a <= reach
        reach = max(reach, b)
    assert reach == len(texts[8])


def test_extension():
    x, y = passages.codes("aaXhello worldY" * 3), passages.codes("bbXhello worldZ")
    assert passages.extended(x, y, 5, 5) == (3, 9) and passages.extended(x, x, 0, 0) == (0, len(x))


def test_neighbours_with_ties_and_dirt(spark):
    random_ = np.random.default_rng(2)
    data = random_.normal(size=(300, 64)).astype(np.float32)
    data[10] = data[11] = data[12]
    near = data[:40] + random_.normal(size=(40, 64)).astype(np.float32) * 0.05
    every = np.vstack([data, near])
    rows = [(f"v{i:03}", v.tolist()) for i, v in enumerate(every)]
    rows += [("null", None), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0] * 3), ("v000", every[0].tolist()), (None, every[1].tolist()), ("hole", [None] * 64)]
    links, membership = neighbours.neighbours(spark.createDataFrame(rows, "key string, vec array<float>"), 5, 0.9, 1.0)
    got = {tuple(r) for r in near_copies.spelled(links.selectExpr("least(lo, hi) lo", "greatest(lo, hi) hi").distinct(), membership).collect()}
    unit = every.astype(float) / np.linalg.norm(every, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -2)
    kth = np.sort(sims, axis=1)[:, -5]
    assert got == {tuple(sorted((f"v{a:03}", f"v{b:03}"))) for a, b in zip(*np.nonzero((sims >= 0.9) & (sims >= kth[:, None])))}


def test_dense_leaves_send_k_rows(spark, monkeypatch):
    """Vectors that are all near each other: at most k rows and ties leave a task for each, in every split into buckets."""
    monkeypatch.setattr(neighbours, "BUCKET", 300)
    random_ = np.random.default_rng(5)
    data = (np.ones((1_000, 64)) + random_.normal(size=(1_000, 64)) * 0.05).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i:04}", v.tolist()) for i, v in enumerate(data)], "key string, vec array<float>")
    links, _ = neighbours.neighbours(rows, 5, 0.9, 1.0)
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    expected = {(f"v{a:04}", f"v{b:04}") for a in range(1_000) for b in np.argsort(-sims[a])[:5]}
    assert {(r.lo, r.hi) for r in links.collect()} == expected


def test_buckets_hold_neighbouring_leaves():
    found = neighbours.Buckets.of(np.array([10, 20, 80, 5, 250, 40, 30]), 100)
    assert found.first.tolist() == [0, 0, 1, 1, 2, 5, 5] and found.parts.tolist() == [1, 1, 1, 1, 3, 1, 1]


def test_tree_visits_are_best_first():
    data = np.random.default_rng(4).normal(size=(900, 64)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    tree = neighbours.fit(data, 4, 40)
    order = tree.visits(data[:20], len(tree.leaves))
    parent = {c: p for p, children in tree.children.items() for c in children}
    cost = 1 - data[:20] @ tree.centres.T
    for q in range(20):
        assert sorted(order[q]) == sorted(tree.leaves.values())

        def highest(node):
            best = -1.0
            while node != -1:
                best = max(best, cost[q, node])
                node = parent[node]
            return best

        node_of = {leaf: node for node, leaf in tree.leaves.items()}
        seen = [highest(node_of[leaf]) for leaf in order[q]]
        assert all(a <= b + 1e-9 for a, b in zip(seen, seen[1:]))
    assert (tree.assign(data) >= 0).all()


def test_calibration_holds_no_orders_of_all_leaves(spark):
    """With a leaf for each vector, orders of all leaves for all queries would take over 100 MB of the driver."""
    data = np.random.default_rng(6).normal(size=(1200, 64)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    tree = neighbours.fit(data, 2, 1)
    firsts = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(data)], "id long, vec binary").localCheckpoint()
    tracemalloc.start()
    try:
        visits = neighbours.calibrated(firsts, tree, 1200, 5, -1.0, 1.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(tree.leaves) > 1000 and 1 < visits <= len(tree.leaves) and peak < 40e6


def test_recall_is_reached(spark, sf):
    assert all(r.recall >= 0.9 for r in neighbours.p3_recall(spark, sf).collect())


def test_neighbours_of_few(spark):
    one = spark.createDataFrame([("a", [1.0] * 64)], "key string, vec array<float>")
    assert neighbours.neighbours(one)[0].count() == 0 == neighbours.neighbours(one.limit(0))[0].count()
