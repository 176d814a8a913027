"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. For radius r, bit i gets a
non-zero vector m(i) of r+1 bits; each non-zero v gives a table that keeps the bits with <m(i), v> = 1. Any r
differing bits pose r equations in r+1 unknowns, so some v masks all of them: every pair within the radius
meets in some table, with no chance of a miss.

Tables are grouped by (table, masked value). A group of more than ``block`` fingerprints is dealt into
blocks and then pairs of them, so no comparison holds an unbounded group, and each yields a spanning forest of its
links, not all pairs. A link counts in the first table in which its two fingerprints meet.

Null and empty texts have the fingerprint zero and link like any other. Repeated rows share a fingerprint
and a component. A null id never becomes a component's id unless all its ids are null. An empty table gives an
empty one. Texts of any length are read whole. Only the key and the text are read, so other columns can't clash.

Small sides of joins are written before they are joined, so that Spark can split the partition of a hot key (a
fingerprint that a third of all rows share, the root of a large component) among tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import forget, fresh, saved

BITS = 64
#: Fingerprints of a table's group that are compared in one task, in expectation.
BLOCK = 1024
#: Keys that a task deals out, about.
KEYS = 1 << 21


def fingerprint_of(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Fingerprint of a text in UTF-8, as a signed long."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    return _majority(hashes)


def fingerprint(text: Column, width: int = 4, seed: int = 42) -> Column:
    """Fingerprint column (signed long) of a text column."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        forget()
        return pa.array([fingerprint_of(t.as_py() or b"", width, seed) for t in texts.cast(pa.binary())], pa.int64())

    return run(text)


#: Independent fingerprints of word pairs that find near copies, and the differing bits of five-word shingles'
#: fingerprints up to which they count as such: shingles of a similarity of 0.8 or more differ in so many bits or fewer in 19 cases of 20.
SEEDS, SHINGLE_BITS = 8, 14
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with each bit spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed long."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def sketch_of(text: bytes) -> list[int]:
    """A text's fingerprints of word pairs, one for each seed, then that of its five-word shingles; zeros without words."""
    words = text.lower().split()
    if not words:
        return [0] * (SEEDS + 1)
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 42)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(width: int) -> np.ndarray:
        width = min(width, len(own))
        out = np.zeros(len(own) - width + 1, np.uint64)
        for i in range(width):
            out = _mixed(out * _STEP + own[i : i + len(out)])
        return out

    with np.errstate(over="ignore"):
        pairs = shingles(2)
        return [_majority(_mixed(pairs + np.uint64(k + 1) * _STEP)) for k in range(SEEDS)] + [_majority(shingles(5))]


def sketch(text: Column) -> Column:
    """Array column of a text's fingerprints: those that find near copies, and last the one that confirms them."""

    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        forget()
        return pa.array([sketch_of(t.as_py() or b"") for t in texts.cast(pa.binary())], pa.list_(pa.int64()))

    return run(text)


def masks(radius: int) -> np.ndarray:
    """The 2^(radius+1) - 1 bit masks whose tables cover the radius."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(BITS)]
    return np.array([sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() & 1) for v in range(1, n + 1)], np.uint64)


def _forest(fps: np.ndarray, table: int, radius: int, covering: np.ndarray, sure: np.ndarray | None = None, bits: int = 0, roots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Trees of the links whose first common table is this one, as stars: the place of a tree's first member, and of each member that it reaches.

    With sure, other fingerprints of the same texts, these may differ in so many bits at most. With roots, those of one
    root are linked already: they are not named again.
    """
    out, left = [], np.ones(len(fps), bool)

    def reached(x: int) -> list[int]:
        same = np.array([x]) if roots is None else np.flatnonzero(left & (roots == roots[x]))
        left[same] = False
        return same.tolist()

    for root in range(len(fps)):
        if not left[root]:
            continue
        queue = reached(root)
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            apart = fps[rest] ^ fps[at]
            near = np.bitwise_count(apart) <= radius
            if sure is not None:
                near &= np.bitwise_count(sure[rest] ^ sure[at]) <= bits
            rest, apart = rest[near], apart[near]
            if len(rest):
                for x in rest[((apart[:, None] & covering) == 0).argmax(axis=1) == table].tolist():
                    if left[x]:
                        queue += reached(x)
                        out.append((root, x))
    return out


def links(nodes: DataFrame, radius: int = 4, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """(a, b): pairs that connect what links connect; all nodes within the radius are linked.

    nodes has distinct longs node, and an array fp of fingerprints. Two nodes are linked if they are within the radius at
    any place of the array. With bits, the last fingerprint finds nothing: it may differ in so many bits at most.

    All tables are searched within their groups' blocks first. Groups of several blocks that are not one part by then are
    searched between these: pairs are of parts. A task's pairs are one for each node that it links, so that those of a dense
    group grow about as its size. Keys are dealt once, with their nodes alone; the fingerprints are joined to what shares a key.
    """
    covering = masks(radius)
    n, size = nodes.agg(F.count("*"), F.max(F.size("fp"))).first()
    places, tables = (size or 1) - (0 if bits is None else 1), len(covering)
    span = 1 << (places * tables - 1).bit_length()
    keys = F.flatten(F.transform(F.slice("fp", 1, places), lambda f, i: F.array(*[F.xxhash64(f.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(-span)).bitwiseOR((i * tables + t).cast("long")) for t, m in enumerate(covering.view(np.int64).tolist())])))
    # The low bits of a key are its table. Texts whose keys' hashes clash are told apart when they are compared.
    keyed = nodes.repartition(1 + n * places * tables // KEYS).select("node", F.explode(keys).alias("key"))
    members = saved(keyed.withColumn("n", F.count("*").over(W.partitionBy("key"))).filter("n > 1"), "members")

    def dealt(members: DataFrame, known: DataFrame, others: Callable[[Column, Column], Column]) -> DataFrame:
        """(key, i, j, of): the members of each two blocks of a key, or of one."""
        table, blocks = F.col("key").bitwiseAND(F.lit(span - 1)), F.ceil(F.col("n") / block).cast("int")
        own, place = F.element_at("fp", (table / tables).cast("int") + 1), F.pmod(F.xxhash64("node"), blocks).cast("int")
        member = F.struct("node", own.alias("own"), F.element_at("fp", -1).alias("sure"), "root")
        rows = members.join(known, "node").select("key", member.alias("member"), place.alias("block"), F.explode(others(place, blocks)).alias("other"))
        groups = rows.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list("member").alias("of"))
        return groups.select((table % tables).cast("int").alias("table"), "of").filter(F.size("of") > 1)

    alone = nodes.withColumn("root", F.col("node"))
    found = saved(_parted(dealt(members, alone, lambda place, _: F.array(place)), radius, covering, bits), "links")
    if (many := members.filter(F.col("n") > block)).isEmpty():
        return found
    stars = components(found)
    known = saved(nodes.join(stars.withColumnRenamed("root", "to"), "node", "left").select("node", "fp", F.coalesce("to", "node").alias("root")), "known")
    # A group that is one part already has nothing to give, however large it is.
    apart = many.join(known.select("node", "root"), "node").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    many = many.join(saved(apart.select("key"), "keys"), "key")
    between = _parted(dealt(many, known, lambda place, blocks: F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: x != place)), radius, covering, bits)
    return stars.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(between)


def _parted(groups: DataFrame, radius: int, covering: np.ndarray, bits: int | None) -> DataFrame:
    """(a, b): roots of groups' members (node, own, sure, root) that links of the groups' tables connect: the least of those that a task connects, and each other."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged(batch["table"], batch["of"])], names=["a", "b"])

    def merged(table: pa.Array, groups: pa.Array) -> tuple[list[int], list[int]]:
        offset, own, sure = groups.offsets.to_numpy(), *(groups.values.field(c).to_numpy().view(np.uint64) for c in ("own", "sure"))
        root, table, n = groups.values.field("root").to_numpy(), table.to_numpy(), np.diff(offset)
        found: dict[int, list[tuple[int, int]]] = {}
        two = np.flatnonzero(n == 2)
        at = offset[two]
        apart = own[at] ^ own[at + 1]
        near = (np.bitwise_count(apart) <= radius) & (root[at] != root[at + 1])
        if bits is not None:
            near &= np.bitwise_count(sure[at] ^ sure[at + 1]) <= bits
        two, at, apart = two[near], at[near], apart[near]
        first = ((apart[:, None] & covering) == 0).argmax(axis=1) == table[two]
        found.update((g, [(x, x + 1)]) for g, x in zip(two[first].tolist(), at[first].tolist(), strict=True))
        for g in np.flatnonzero(n > 2).tolist():
            by = offset[g] + np.argsort(root[offset[g] : offset[g + 1]])
            if root[by[0]] < root[by[-1]]:
                tree = _forest(own[by], int(table[g]), radius, covering, None if bits is None else sure[by], bits or 0, root[by])
                found[g] = [(by[a], by[x]) for a, x in tree]
        up: dict[int, int] = {}

        def least(x: int) -> int:
            while (above := up.setdefault(x, x)) != x:
                up[x] = up[above]
                x = up[x]
            return x

        both = np.array([x for tree in found.values() for x in tree], np.int64).reshape(-1, 2)
        for x, y in root[both].tolist():
            lo, hi = sorted((least(x), least(y)))
            up[hi] = lo
        pairs = [(y, x) for x in up if (y := least(x)) != x]
        return [a for a, _ in pairs], [b for _, b in pairs]

    return groups.mapInArrow(forest, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, by alternating large and small stars."""

    def settled(df: DataFrame) -> bool:
        """Each larger end has one smaller end, which is no larger end itself."""
        ends = df.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("n")), F.struct(F.col("b").alias("x"), F.lit(0).alias("n")))).alias("e")).select("e.x", "e.n")
        return ends.groupBy("x").agg(F.sum("n").alias("larger"), F.min("n").alias("least")).filter("larger > 1 OR (larger = 1 AND least = 0)").isEmpty()

    at = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for k in range(rounds):
        if settled(at):
            break
        if k == rounds - 1:
            raise RuntimeError("components did not settle")
        # Large star: a node sends its larger neighbours, and itself, to the least of its neighbourhood.
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "stars")
        # Small star: a node sends its smaller neighbours, and itself, to the least of them.
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = saved(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, least): each node's least value over its component; nodes has node and its own value least.

    Only linked nodes are grouped by root; the small table of roots is written, so that the join to a large
    component's nodes can be split.
    """
    roots = components(edges)
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    own = saved(linked.join(nodes.select("node", "least"), "node"), "linked")
    best = saved(own.groupBy("root").agg(F.min("least").alias("best")), "roots")
    return nodes.select("node", "least").join(own.join(best, "root").select("node", "best"), "node", "left").select("node", F.coalesce("best", "least").alias("least"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, radius: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(key, fp, component): one row per document with its fingerprint and the least key it reaches by links."""
    marked = saved(docs.select(F.col(key).alias("key"), fingerprint(docs[text], width, seed).alias("node")), "fingerprints")
    # A null is a group's key only if the group has no other: it sorts last.
    least = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id")).alias("least")
    nodes = marked.groupBy("node").agg(F.min("key").alias("least")).select("node", F.array("node").alias("fp"), least)
    named = saved(grouped(nodes, links(nodes.select("node", "fp"), radius, block)).select("node", F.col("least.id").alias("component")), "components")
    return marked.join(named, "node").select(F.col("key").alias(key), F.col("node").alias("fp"), "component")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, bits: int = SHINGLE_BITS, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near copies: the one with the least id, null last, then the least hash.

    Near copies are within the radius in one of several fingerprints of word pairs, which the masks find without a
    miss, and within ``bits`` in that of five-word shingles. Groups are of texts, so rows that share an id, or have
    none, stay apart if their texts do. A text's fingerprints are known by 64 bits of hash, a row by 128 bits over its
    values and its nulls; of rows that are equal throughout, one stays.
    """
    a, b, n = fresh(docs, "a", "b", "n")
    values = [*map(F.col, docs.columns), *[F.col(c).isNull() for c in docs.columns]]
    hashes = [F.xxhash64(F.lit(i), *values) for i in (0, 1)]
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), hashes[0].alias("a"), hashes[1].alias("b"))
    marked = docs.select(row.alias("row"), sketch(docs[text]).alias("fp"))
    nodes = saved(marked.groupBy("fp").agg(F.min("row").alias("least")).select(F.xxhash64("fp").alias("node"), "fp", "least"), "fingerprints")
    kept = grouped(nodes, links(nodes.select("node", "fp"), radius, block, bits)).select(F.col("least.a").alias(a), F.col("least.b").alias(b)).distinct()
    # The window and the join share one shuffle of the texts; the hashes are merged, not broadcast, as their number
    # grows with the input.
    once = docs.select("*", hashes[0].alias(a), hashes[1].alias(b)).withColumn(n, F.row_number().over(W.partitionBy(a, b).orderBy(F.lit(0)))).filter(F.col(n) == 1)
    return once.join(kept.hint("merge"), [a, b], "left_semi").select(*docs.columns)


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
