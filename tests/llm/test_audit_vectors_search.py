"""Filter audit, embedding near-dedup and ranked search against brute force, on odd rows too."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import filter_audit, ranked_search, vector_dedup

DOC = "doc_id bigint, text string, lang string, part string, mask string, term string, leaf string, n string"


def words(rng, n, low=1):
    return " ".join(rng.choice("abcdefgh") * rng.randint(low, 3) + rng.choice(["er", "on", "tion", "é", "X9"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "ALL CAPS # " * 40, " ".join(f"w{k}" for k in range(300)), words(rng, 4000), "漢字 ß \x00 \U0001f600 Ünï"]
    texts += [words(rng, rng.randint(10, 250)) + rng.choice(["", " $", " | A B C"]) for _ in range(80)]
    texts += texts[8:40] + texts[8:12] * 5
    out = [(k, t, rng.choice(["en", "de", "", None]), "p", "m", "t", "l", "n") for k, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[3], out[3], *((None, t, "en", "p", "m", "t", "l", "n") for t in ("no id", "no id", texts[9]))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


LABELS = [(k, k % 3 == 0, k % 5 == 0) for k in range(0, 90, 2)] + [(4, True, None), (6, None, None), (None, True, True), (5000, True, True)]


def fails(text):
    found = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(found) < 100,
        "B": 100 * len(set(found)) < 80 * len(found),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def test_filter_audit(spark, docs, rows):
    labels = spark.createDataFrame([(i, g if g is None else int(g), t if t is None else int(t)) for i, g, t in LABELS], "doc_id bigint, quality int, toxic int")
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *x in LABELS if x[k] and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, lang, *_ in rows:
        f = fails(t or "") | {"E": i is not None and i > first[t or ""]}
        parts[lang or ""].append((f, i in good, i in toxic))
    want, value = {}, Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = list(members)
            for step, c in enumerate(order, 1):
                gone = [m for m in left if m[0][c]]
                left = [m for m in left if not m[0][c]]
                value[part, c] += len(gone)
                failing = sum(m[0][c] for m in members)
                alone = sum(m[0][c] and sum(m[0].values()) == 1 for m in members)
                want[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(m[1] for m in gone), sum(m[2] for m in gone)]
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == len(want) == 600 * len(parts)
    for r in got:
        assert list(r)[3:9] == want[r.part, r.filter_order, r.step]
        assert r.shapley == value[r.part, r.filter_order[r.step - 1]]


def test_filter_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOC), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels).collect()} == {0}


def test_polynomial_is_the_expected_removal():
    counts = [random.Random(k).randint(0, 50) for k in range(32)]
    coefficients = filter_audit.polynomial(counts)
    x = [0.3, 0.9, 0.0, 1.0, 0.5]
    at_x = sum(c * math.prod(x[i] for i in range(5) if s >> i & 1) for s, c in enumerate(coefficients))
    assert at_x == pytest.approx(sum(n * (1 - math.prod(1 - x[i] for i in range(5) if m >> i & 1)) for m, n in enumerate(counts)))
    assert sum(filter_audit.shapley(coefficients, b) for b in range(5)) == sum(counts[1:])


VEC = "vec_id bigint, embedding array<float>, label int, node string, n string, x string"


def brute(rows, cosine):
    def usable(v):
        return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    linked = defaultdict(set)
    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if i is not None and usable(v) else None for i, v in rows]
    for width in {len(u) for u in units if u is not None}:
        at = [k for k, u in enumerate(units) if u is not None and len(u) == width]
        x = np.stack([units[k] for k in at])
        for a, b in zip(*np.nonzero(x @ x.T >= cosine - 1e-12)):
            if a != b:
                linked[at[a]].add(at[b])
    out, seen = {}, {}
    for k in range(len(rows)):
        if k in seen:
            continue
        todo, group = [k], {k}
        while todo:
            for o in linked[todo.pop()] - group:
                group.add(o)
                todo.append(o)
        least = min((rows[j][0] for j in group), default=None) if rows[k][0] is not None else None
        seen |= dict.fromkeys(group, least)
    for k, (i, _) in enumerate(rows):
        out[k] = (i, len(linked[k]), seen[k], i is None or seen[k] == i)
    return Counter(out.values())


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    u = v / np.linalg.norm(v)
    z -= z @ u * u
    return cosine * u + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    base = [rng.standard_normal(24) for _ in range(300)]
    out = base + [near(rng, base[k], c) * 3 for k, c in enumerate(rng.uniform(0.86, 0.99, 150))]
    out += [near(rng, base[0], c) for c in rng.uniform(0.90, 0.97, 400)] + [base[1]] * 30  # a loose large group, and copies
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(out)]
    bad = [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] + [1.0] * 23]
    rows += [(5000 + k, v) for k, v in enumerate(bad)] + [(6000, [1.0, 2.0]), (6001, [1.0, 2.1]), (6002, [-1.0, -2.0]), (6003, [1e38, 2e38]), (6004, [7.0]), (6005, [0.5])]
    return rows + [rows[5], (None, rows[7][1])]


@pytest.mark.parametrize("block", [512, 16])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], VEC).repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect())
    want = brute(rows, 0.9)
    assert sum((want - got).values()) == 0, list((want - got).items())[:5]
    assert max(n for _, n, _, _ in want) > 2 * vector_dedup.WINDOW  # more links than a window holds


def test_near_vectors_of_nothing(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((4000, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(10_000 + k, near(rng, base[k], 0.901).tolist()) for k in range(1000)]
    df = spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], VEC).repartition(4)
    found = vector_dedup.near_vectors(df).where("vec_id >= 10000 and n_links = 1 and component_id = vec_id - 10000").count()
    assert found >= 995


def test_passes_grow_with_the_vectors():
    assert vector_dedup.passes_for(10) == vector_dedup.PASSES < vector_dedup.passes_for(10**6) < vector_dedup.passes_for(10**9) < 200


def ranked(rows, items):
    def terms(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    docs = [(i, Counter(found), len(found)) for i, t, *_ in rows if (found := terms(t))]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for i, c, size in docs:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "first", "terms"), [(256, 8, 500_000), (4, 1, 20)])
def test_search(spark, docs, rows, monkeypatch, shard, first, terms):
    for name, value in (("SHARD", shard), ("FIRST", first), ("MORE", 2), ("QUERY_TERMS", terms), ("CHUNK", shard * 8)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(8)
    items = [(k, words(rng, 6, 2)) for k in range(12)] + [(20, None), (21, "..."), (22, "NOWHERE"), (23, "w7 W7 w9"), (23, "漢字"), (None, "aaer é"), (24, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, doc_id string, score int")
    got = sorted(map(tuple, ranked_search.search(docs, df).collect()), key=str)
    assert got == ranked(rows, items)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked_search.search(spark.createDataFrame([], DOC), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_bisection_brings_topics_together():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat([0, 1], 200))
    texts = [np.unique(rng.integers(0, 100, 30)) + 100 * t for t in topic]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    left, right = ranked_search.bisect(starts, np.concatenate(texts), np.arange(400), 200)
    assert sorted([*left, *right]) == list(range(400)) and topic[left].mean() in (0, 1)


def test_shards_are_pruned(spark):
    """With topics, a query's topic is enough: most shards stay below its tenth score."""
    rng = random.Random(5)
    text = lambda k: " ".join(f"t{k % 16}x{rng.randint(0, 400)}" for _ in range(40))
    docs = spark.createDataFrame([(k, text(k)) for k in range(4000)], "doc_id bigint, text string")
    stats = ranked_search.lengths(docs).groupBy().sum("n").first()[0]
    index = ranked_search.build_index(docs.select("doc_id", "text"), 4000, stats)
    q = ranked_search.Queries([[f"t3x{k}" for k in range(20)]])
    q.weight[:] = 1000
    shards, met = index.count(), ranked_search.shard_bounds(index, spark.sparkContext.broadcast(q)).count()
    assert shards >= 16 and met <= shards / 4


def test_search_hands_python_small_batches(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    def largest(docs, *_):
        return docs.coalesce(1).mapInArrow(sizes, "size long").agg({"size": "max"}).first()[0]

    docs = spark.range(9000).selectExpr("id as doc_id", "repeat('a', 1000) as text")
    monkeypatch.setattr(ranked_search, "_search", largest)
    before = largest(docs)
    assert ranked_search.search(docs, docs) < 5 << 20 < before == largest(docs)
