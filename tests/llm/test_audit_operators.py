"""Divergence, context trees and hard negatives, against DuckDB, plain Python and enumeration."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import contexttree, divergence, negatives, queries


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(queries.ORACLE[name])
    places = [want.columns.index(c) for c in sorted(want.columns)]
    found = rows(queries.QUERIES[name](spark, sf))
    assert found and found == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_divergence", "op13_negatives"])
def test_queries_equal_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


# ------------------------------------------------------------------ divergence


def brute_audit(docs, least=3, top=200):
    docs = [(t or "", a or "", s or "") for t, a, s in docs]
    cut = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or c >= "\x80" else " " for c in t).split(" ")
    words = [([w for w in cut(t) if w], a, s) for t, a, s in docs]
    out = []
    for lang in {a for _, a, _ in docs}:
        seen, counts, groups = defaultdict(int), defaultdict(lambda: defaultdict(int)), sorted({s for _, a, s in docs if a == lang})
        for ws, a, s in words:
            if a == lang:
                for w in set(ws):
                    seen[w] += 1
                for w in ws:
                    counts[s][w] += 1
        kept = sorted(w for w, n in seen.items() if n >= least)
        total = {s: sum(counts[s][w] for w in kept) for s in groups}
        whole = {w: sum(counts[s][w] for s in groups) for w in kept}
        p = {s: {w: 1 + 10**9 * (counts[s][w] + 1) // (total[s] + len(kept)) for w in kept} for s in groups}
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + len(kept)) for w in kept}
        for s in groups:
            pair = sorted(((-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in groups if o != s))
            term = sorted((-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            out += [(item.decode(), lang, part, i + 1, s, -value) for part, found in (("pair", pair), ("term", term)) for i, (value, item) in enumerate(found)]
    return sorted(out, key=repr)


def test_divergence_of_odd_tables(spark, odd, nothing):
    assert rows(divergence.audit(odd)) == brute_audit([(r.text, r.lang, r.source) for r in odd.collect()])
    assert divergence.audit(nothing).count() == 0
    one = spark.createDataFrame([(None, None, None)], "text string, lang string, source string")
    assert divergence.audit(one).count() == 0


def test_divergence_over_several_blocks(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(" ".join(rng.choice("aÉbCdefgh日") + str(rng.randrange(9)) + rng.choice(["x", "Y", "zz", "é"]) * rng.randrange(3) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "é", None])) for _ in range(80)]
    docs += [("", "fr", "only"), (None, "fr", "other"), ("x-ray " * 9, "fr", "third")] + [("Ties ties", "it", s) for s in "abc"]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).withColumn("block", F.lit(3))
    want = brute_audit(docs)
    assert rows(divergence.audit(df)) == want
    monkeypatch.setattr(divergence, "BLOCK", 4)
    assert rows(divergence.audit(df)) == want and any(part == "pair" and value == 0 for _, _, part, _, _, value in want)


def test_gallop_finds_what_a_search_finds():
    rng = np.random.default_rng(5)
    for few, many in ((0, 5), (5, 0), (1, 1000), (400, 1000), (1000, 30), (64, 64), (65, 5000)):
        a, b = (np.sort(rng.choice(6000, n, replace=False)) for n in (few, many))
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()


def test_shares_of_counts_beyond_64_bits():
    assert divergence.shares(np.array([0, 10**13]), 10**14).tolist() == [1, 1 + 10**9 * (10**13 + 1) // 10**14]


# ------------------------------------------------------------------ context trees


def brute_scores(texts, trains, depth):
    """log10 probability of each text by the recursion over nodes, one at a time."""
    counts = defaultdict(lambda: [0, 0])

    def walk(text):
        s = b"\xff" * depth + text + b"\xff"
        for i in range(depth, len(s)):
            for j in range(8):
                yield [(s[i - d : i], (1 << j) | (s[i] >> (8 - j))) for d in range(depth + 1)], (s[i] >> (7 - j)) & 1

    for text, own in zip(texts, trains, strict=True):
        for path, bit in walk(text) if own else ():
            for node in path:
                counts[node][bit] += 1
    longer = defaultdict(list)
    for context, bits in list(counts):
        if context:
            longer[context[1:], bits].append((context, bits))
    weighted = {}

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = estimate(*counts[node])
        if len(node[0]) < depth:
            below = sum(weighted[n] for n in longer[node])
            high = max(own, below)
            own = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
        weighted[node] = own
    out = []
    for text in texts:
        total = 0.0
        for path, bit in walk(text):
            p = None
            for node in reversed(path):
                if node in counts:
                    own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                    w = 1 / (1 + math.exp(min(700, sum(weighted[n] for n in longer[node]) - estimate(*counts[node]))))
                    p = own if p is None else w * own + (1 - w) * p
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


TEXTS = ["the cat sat on the mat. " * 3, "the dog sat", "", "Été 日本語 the CAT", "zzz qqq", "the cat sat on a dog", None, "a\x00b \n\t x", "the dog sat"]


@pytest.mark.parametrize("depth", [3, 5])
def test_context_tree_against_the_recursion(spark, monkeypatch, depth):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    trains = [i % 3 != 0 for i in range(len(TEXTS))]
    want = brute_scores([(t or "").encode().lower() for t in TEXTS], trains, depth)
    for batch, part, shard in ((1 << 25, 1 << 21, 1 << 25), (40, 20, 30)):  # one batch and shard, or many
        monkeypatch.setattr(contexttree, "BATCH", batch)
        monkeypatch.setattr(contexttree, "PART", part)
        monkeypatch.setattr(contexttree, "SHARD", shard)
        got = {r.doc_id: r.lm for r in contexttree.score(docs, F.col("doc_id") % 3 != 0, depth=depth).collect()}
        assert [got[i].score for i in range(len(TEXTS))] == pytest.approx(want, abs=1e-7)
    # A model is a probability: what may follow a start sums to 1.
    first = [bytes([b]) for b in range(256)]
    assert sum(10**s for s in after_start(first, depth)) == pytest.approx(1)


def after_start(symbols, depth):
    runs = np.array([int.from_bytes(b"\xff" * depth + s, "big") for s in symbols], np.uint64)
    train = contexttree.Batch(depth)
    for t in TEXTS:
        train.add((t or "").encode().lower(), True)
    train.code(True)
    keys, counts = contexttree.added([*[k for k, _ in train.runs], runs], [*[c for _, c in train.runs], np.zeros(len(runs), np.int64)])
    prices, own, totals, longer = contexttree.subtrees(keys, counts, depth)
    found = [contexttree.nodes(own, totals, bit) for bit in range(8)]
    key = np.concatenate([((f[0] >> np.uint64(b)) << np.uint64(8)) | np.uint64(1 << b) | (f[0] & np.uint64((1 << b) - 1)) for b, f in enumerate(found)]).astype(np.int64)
    above = contexttree.weighed(pa.table({"key": key, "zeros": np.concatenate([f[2] for f in found]), "ones": np.concatenate([f[3] for f in found]), "longer": np.concatenate(longer)}))
    told = [(0, 0)]
    told = contexttree.answers(depth, above)(pa.table({"batch": [0], "kind": pa.array([contexttree.RUNS], pa.int32()), "shard": [0], "keys": [contexttree.packed(keys)], "counts": [contexttree.packed(counts)]}))
    values = np.frombuffer(contexttree.zstandard.decompress(told["values"][0].as_py()), np.float64)
    return values[np.searchsorted(keys, runs)]


def test_base_scores_of_held_out_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("held")).collect()
    counts = defaultdict(int)
    words = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in table}
    for r in table:
        for w in words[r.doc_id] if not r.held else ():
            counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op12_context_tree(spark, sf).collect()}
    assert len(got) == len(table)
    for r in table:
        own = [counts.get(w, 0) for w in words[r.doc_id]]
        x = got[r.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (r.held, len(own), sum(c > 0 for c in own), n)
        assert x.base_score == pytest.approx(sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own), abs=1e-6) and x.score < 0


def test_context_tree_prefers_text_like_its_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) > 200")
    other = docs.limit(20).select((-F.col("doc_id") - 1).alias("doc_id"), F.reverse("text").alias("text"))
    got = {r.doc_id: r.lm for r in contexttree.score(docs.unionByName(other), F.col("doc_id") % 5 > 0).collect()}
    held = [x.bits_per_byte for i, x in got.items() if i >= 0 and i % 5 == 0]
    assert np.mean(held) < 3 and np.mean([x.bits_per_byte for i, x in got.items() if i < 0]) > np.mean(held) + 1


def test_context_tree_of_odd_and_empty_tables(spark, odd, nothing):
    df = odd.withColumn("batch", F.lit(1)).withColumn("kind", F.lit("k")).withColumn("lm", F.lit("gone")).withColumn("map", F.create_map(F.lit("a"), F.lit(1)))
    out = contexttree.score(df, F.col("doc_id") % 2 == 0)
    found = out.collect()
    assert out.columns == [*[c for c in df.columns if c != "lm"], "lm"] and len(found) == 11 and all(r.batch == 1 and r.kind == "k" and r.map == {"a": 1} for r in found)
    assert {r.text: r.doc_id for r in found if r.doc_id != 5} == {r.text: r.doc_id for r in df.collect() if r.doc_id != 5}
    assert {r.lm.n_tokens for r in found if not (r.text or "").split()} == {1} and all(math.isfinite(r.lm.score) and r.lm.score < 0 for r in found)
    assert contexttree.score(nothing, F.lit(True)).count() == 0
    untrained = contexttree.score(odd, F.lit(False)).collect()
    assert all(r.lm.score == pytest.approx(-8 * (len((r.text or "").encode()) + 1) * math.log10(2)) and r.lm.base_score == pytest.approx(0) for r in untrained)


# ------------------------------------------------------------------ hard negatives


def brute_mine(vectors):
    usable = [(i, y, v) for i, v, y in vectors if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, y, v in usable]
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in own if i % 100 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in own]  # noqa: B905
        for s, j, _ in sorted(x for x in scored if x[2] == y and x[1] != i)[:5]:
            inside = sorted(x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, k, -t, j, -s, r + 1) for r, (t, k, _) in enumerate(inside)]
    return sorted(out, key=repr)


def test_strassen_equals_the_product_where_sums_wrap():
    rng = np.random.default_rng(7)
    for m, k, n in ((1, 1, 1), (5, 64, 3), (37, 64, 50), (64, 64, 64), (65, 33, 129), (40, 0, 7)):
        a, b = rng.integers(-(2**25), 2**25, (m, k)), rng.integers(-(2**25), 2**25, (k, n))
        for leaf in (1, 4, 16):
            assert (negatives.strassen(a, b, leaf) == a @ b).all()
    big = np.full((8, 8), 2**30)
    assert (negatives.strassen(big, big, 1) == big @ big).all()


def test_negatives_with_ties_repeats_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 5) / 4 + 0.25], int(rng.integers(0, 3))) for i in range(420)]
    vectors += [(7, [1.0] * 5, 1), (200, [0.5] * 5, 2), (200, [0.5] * 5, 2), (300, [-1.0] * 5, 0), (5, [0.75, 0.5], 1), (6, [], 0), (-100, [1.0] * 5, 2)]  # repeats, ties, short and empty vectors
    vectors += [(800, None, 1), (900, [1.0] * 5, None), (None, [1.0] * 5, 1), (1000, [1.0, None, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 5, 1), (1200, [float("inf")] * 5, 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("a", F.lit("x")).withColumn("score", F.lit("y"))
    want = brute_mine(vectors)
    assert len(want) > 100 and rows(negatives.mine(df)) == want
    monkeypatch.setattr(negatives, "CELLS", 200)
    monkeypatch.setattr(negatives, "ANCHOR_CELLS", 10)
    monkeypatch.setattr(negatives.tiles, "__defaults__", ((2, 16),))
    assert rows(negatives.mine(df)) == want


def test_negatives_of_empty_tables_and_huge_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(empty).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [5e29, 1.0], 2), (7, [1e-3, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    assert all(abs(r.negative_score) < 2**63 for r in negatives.mine(huge).collect())
    alone = spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(alone).count() == 0
