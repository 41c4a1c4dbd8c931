"""Near-duplicate documents by a chosen-path similarity join over sets of word shingles.

Documents with one and the same set are one class, found by a digest of the set before anything else, so copies cost
nothing further. A class has a signature of ``COORDINATES`` minwise tokens. In each of the independent trees a node
chooses two coordinates; the classes that agree in one of them, token included, go to the same child. A pair of
similarity 0.8 or more reaches a small node of a tree with a probability above 15/16, so ``trees`` follows from the
recall asked for. The first levels are Spark shuffles, for as long as a node holds more than ``NODE_LIMIT``
classes; below that a task branches on in memory. Small nodes are compared exhaustively by signature. A node that does
not shrink is a cluster: its classes are hung on leaders.

No link is taken from a signature. Candidates that span the nodes are confirmed on the full sets and give components;
then every other candidate whose ends are not connected yet is confirmed as well. Within a cluster, each member outside
the largest component is compared with all members on the full sets, in blocks of bounded size and through an index of
their shingles: no pairs are emitted but the links. What could be lost is bounded by the trees' recall and four standard
deviations of the signature's estimate.

Null texts and texts without words have the empty set and are linked with nothing. A text of fewer words than a
shingle is one shingle. Repeated rows share a class and get the same result. A null doc_id is passed through and
is never the smallest of a component that has another. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, row_hash, text_of, utf8
from sluicebox.llm.components import components
from sluicebox.scratch import written

COORDINATES = 64
BRANCHES = 2
#: Of pairs at the threshold, if trees were independent; they share coordinates, so it is 0.9997.
RECALL = 0.9999
#: Classes that a task takes into memory as one node.
NODE_LIMIT = 20_000
#: Classes of a node that are compared exhaustively.
SMALL = 24
#: A node is a cluster when a chosen token keeps this share of it.
DENSE = 0.6
#: Levels that Spark branches before a large node counts as a cluster.
MAX_LEVELS = 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CACHED_WORDS = 300_000
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, on 64-bit numbers."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_SEEDS = _mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15))
_MULTIPLIERS = (_SEEDS[:COORDINATES] >> _U64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (_SEEDS[COORDINATES:] >> _U64(32)).astype(np.uint32)


def node_hash(*parts: int) -> int:
    """64 bits from a path through a tree."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; keeps the hashes of frequent words."""

    def __init__(self, size: int = 2):
        self.size = size
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _CACHED_WORDS:
                self.known.clear()
            found = self.known[word] = xxhash.xxh64_intdigest(word)
        return found

    def shingles(self, text: bytes) -> np.ndarray:
        words = text.translate(_LOWER).split()
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        hashes = np.fromiter(map(self._word, words), dtype=np.uint64, count=n)
        width = min(n, self.size)
        total = np.full(n - width + 1, width, dtype=np.uint64)
        for i in range(width):
            total = total * _U64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i]
            total ^= total >> _U64(29)
        return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> bytes:
    """For each coordinate 16 bits of the hash of the minwise token."""
    least = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> _U64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, (short[at : at + 2048, None] * _MULTIPLIERS + _ADDENDS).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def trees_for(recall: float, percent: int) -> int:
    """Trees that find a pair at the threshold with this probability."""
    s, p = percent / 100, 1.0
    for _ in range(50):
        p = 1 - (1 - s * p) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """Written rows (doc_id, content, digest of the set, n_shingles, signature)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler(size)
        for batch in batches:
            digests, counts, signatures = [], [], []
            for text in utf8(batch["text"]):
                shingles = shingler.shingles(text)
                counts.append(len(shingles))
                digests.append(hashlib.md5(shingles.tobytes(), usedforsecurity=False).digest())
                signatures.append(signature(shingles))
            same = {"doc_id": batch["doc_id"], "content": batch["content"]}
            yield same | {"digest": digests, "n_shingles": counts, "signature": signatures}

    texts = docs.select("doc_id", F.md5(text_of("text")).alias("content"), text_of("text").alias("text"))
    schema = "doc_id bigint, content string, digest binary, n_shingles bigint, signature binary"
    return written(map_batches(texts, run, schema), "sets")


def classes_of(rows: DataFrame) -> DataFrame:
    """Written classes: number, digest, smallest doc_id, members, n_shingles, signature."""
    grouped = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("members"), F.first("n_shingles").alias("n"),
        F.first("signature").alias("signature"),
    )
    return written(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")


def _choices(node: int) -> list[int]:
    """The coordinates that a node branches on."""
    first = node % COORDINATES
    return [first, (first + 1 + (node >> 8) % (COORDINATES - 1)) % COORDINATES]


_NODE = "parent bigint, node bigint, family bigint, class bigint, n bigint, signature binary"
_ROW = ["node", "family", "class", "n", "signature"]


def _branched(roots: list[int] | None):
    """Children of the nodes in the rows, or of the trees' roots."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            classes, ns, signatures = (batch[c].to_pylist() for c in ("class", "n", "signature"))
            nodes = batch["node"].to_pylist() if roots is None else None
            keys: dict[tuple, int] = {}
            out: list[tuple] = []
            for i, sig in enumerate(signatures):
                for node in roots if nodes is None else [nodes[i]]:
                    for c in _choices(node):
                        key = (node, c, sig[2 * c : 2 * c + 2])
                        if key not in keys:
                            keys[key] = node_hash(*key)
                        out.append((node, keys[key], 0, classes[i], ns[i], sig))
            yield dict(zip(("parent", *_ROW), zip(*out, strict=True), strict=True))

    return run


def _in_blocks(nodes: DataFrame, limit: int) -> DataFrame:
    """Nodes that do not shrink, in blocks of about ``limit`` classes; each block has the node's first class as well."""
    shape = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("pivot"))
    shape = shape.select(F.col("node").alias("of"), F.ceil(F.col("size") / limit).cast("int").alias("blocks"), "pivot")
    placed = nodes.join(shape, F.col("node") == F.col("of"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    every = F.when(F.col("class") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return placed.withColumn("block", F.explode(every)).select(
        F.xxhash64("node", "block").alias("node"), F.col("node").alias("family"), "class", "n", "signature"
    )


def small_nodes(classes: DataFrame, trees: int, limit: int = NODE_LIMIT) -> DataFrame:
    """Rows (node, family, class, n, signature) of nodes of about ``limit`` classes at most.

    Larger nodes are branched again; one that a chosen token keeps together is a ``family`` and split into blocks. Each
    level is written once, so that no job on a later level branches the earlier ones again.
    """
    roots = [node_hash("root", t) for t in range(trees)]
    level = written(map_batches(classes.select("class", "n", "signature"), _branched(roots), _NODE).drop("parent"), "level")
    done: list[DataFrame] = []
    for depth in count():
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
        large = written(sizes.select(F.col("node").alias("large"), "size"), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done, level)
        done.append(level.join(large, F.col("node") == F.col("large"), "left_anti"))
        big = level.join(large, F.col("node") == F.col("large"), "left_semi")
        if depth == MAX_LEVELS:
            return reduce(DataFrame.unionByName, done, _in_blocks(big, limit))
        children = written(map_batches(big, _branched(None), _NODE), "level")
        kept = children.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("kept"))
        kept = kept.join(large, F.col("parent") == F.col("large")).where(F.col("kept") >= DENSE * F.col("size"))
        dense = written(kept.select(F.col("parent").alias("dense")).distinct(), "dense")
        done.append(_in_blocks(big.join(dense, F.col("node") == F.col("dense"), "left_semi"), limit))
        level = children.join(dense, F.col("parent") == F.col("dense"), "left_anti").drop("parent")


class _Comparer:
    """Compares the classes of one node at a time; collects candidates."""

    def __init__(self, percent: int):
        self.percent = percent
        s = percent / 100
        self.least = s - 4 * math.sqrt(s * (1 - s) / COORDINATES)
        self.sure = s + 2 * math.sqrt(s * (1 - s) / COORDINATES)
        self.out: list[tuple] = []

    def node(self, node: int, family: int, classes: np.ndarray, n: np.ndarray, signatures: np.ndarray) -> None:
        self.classes, self.n, self.signatures = classes, n, signatures
        order = np.argsort(classes, kind="stable")
        if family:
            self._cluster(family, order)
        else:
            self._explore(node, order)

    def _near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Estimated similarity of i and others, 0 where the sizes rule a link out."""
        same = (self.signatures[others] == self.signatures[i]).mean(axis=1)
        a, b = np.minimum(self.n[others], self.n[i]), np.maximum(self.n[others], self.n[i])
        return np.where(100 * a >= self.percent * b, same, 0.0)

    def _pair(self, i: int, j: int, first: bool) -> None:
        a, b = int(self.classes[i]), int(self.classes[j])
        self.out.append((0 if first else 1, min(a, b), max(a, b)))

    def _explore(self, node: int, idx: np.ndarray) -> None:
        if len(idx) < 2:
            return
        if len(idx) <= SMALL:
            for k in range(1, len(idx)):
                near = self._near(idx[k], idx[:k])
                hits = np.flatnonzero(near >= self.least)
                if len(hits):
                    best = hits[near[hits].argmax()]
                    for h in hits:
                        self._pair(idx[k], idx[h], h == best)
            return
        children = []
        for c in _choices(node):
            tokens = self.signatures[idx, c]
            order = np.argsort(tokens, kind="stable")
            bounds = np.flatnonzero(np.diff(tokens[order])) + 1
            groups = np.split(idx[order], bounds)
            if max(map(len, groups)) >= DENSE * len(idx):
                self._cluster(node, idx)
                return
            children += [(node_hash(node, c, int(self.signatures[g[0], c])), np.sort(g)) for g in groups if len(g) > 1]
        for child, group in children:
            self._explore(child, group)

    def _cluster(self, node: int, idx: np.ndarray) -> None:
        leaders = np.zeros(0, dtype=np.int64)
        for i in idx:
            near = self._near(i, leaders) if len(leaders) else np.zeros(1)
            best = int(near.argmax())
            if near[best] >= self.least:
                self._pair(i, leaders[best], True)
            if near[best] < self.sure:
                leaders = np.append(leaders, i)
            self.out.append((2, node, int(self.classes[i])))


def _by_group(batches: Iterator[dict], key: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The groups of a stream that is sorted by ``key``; numeric columns and signatures as arrays."""
    held: list[dict] = []
    for batch in batches:
        columns = {}
        for name, column in batch.items():
            if name == "signature":
                columns[name] = np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, COORDINATES)
            else:
                columns[name] = np.asarray(column)
        keys = columns[key]
        bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for first, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = {name: values[first:end] for name, values in columns.items()}
            if held and held[0][key][0] != part[key][0]:
                yield int(held[0][key][0]), {name: np.concatenate([h[name] for h in held]) for name in held[0]}
                held = []
            held.append(part)
    if held:
        yield int(held[0][key][0]), {name: np.concatenate([h[name] for h in held]) for name in held[0]}


_EMIT = 20_000


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Rows (kind, a, b): 0 spanning candidates, 1 other candidates, 2 members (b) of a cluster (a)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        comparer = _Comparer(percent)
        for node, group in _by_group(batches, "node"):
            if len(group["class"]) > 1:
                comparer.node(node, int(group["family"][0]), group["class"], group["n"], group["signature"])
            if len(comparer.out) >= _EMIT:
                yield dict(zip(("kind", "a", "b"), zip(*comparer.out, strict=True), strict=True))
                comparer.out = []
        if comparer.out:
            yield dict(zip(("kind", "a", "b"), zip(*comparer.out, strict=True), strict=True))

    dealt = nodes.repartition(F.col("node")).sortWithinPartitions("node")
    return written(map_batches(dealt, run, "kind int, a bigint, b bigint").distinct(), "candidates")


#: Bytes of sets on either side when a task compares members of a cluster.
BLOCK_BYTES = 1 << 23


def _asking(clusters: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (node, block, round, asks, class, component) of the clusters whose members are not all connected.

    The members are the targets of one block each; those outside the cluster's largest component ask in all blocks, in a
    round of their own. Both blocks and rounds are of bounded size.
    """
    members = clusters.join(classes.select("class", "n"), F.col("member") == F.col("class"))
    own = known.select(F.col("node").alias("of"), F.col("component").alias("part"))
    members = members.join(own, F.col("class") == F.col("of"), "left").select(
        "node", "class", "n", F.coalesce("part", "class").alias("component")
    )
    parts = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    shape = parts.groupBy(F.col("node").alias("at")).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max(F.struct("size", "component", "n")).alias("top")
    ).where("parts > 1")
    blocks = lambda n: F.ceil(8 * n / F.lit(BLOCK_BYTES)).cast("int")
    shape = shape.select(
        "at", F.col("top.component").alias("largest"), blocks(F.col("n")).alias("blocks"),
        blocks(F.col("n") - F.col("top.n")).alias("rounds"),
    )
    placed = members.join(shape, F.col("node") == F.col("at"))
    own_block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    own_round = F.pmod(F.xxhash64("class", F.lit(1)), F.col("rounds")).cast("int")

    def part(block: Column, turn: Column, asks: bool) -> Column:
        return F.struct(block.alias("block"), turn.alias("round"), F.lit(asks).alias("asks"))

    targets = F.transform(F.sequence(F.lit(0), F.col("rounds") - 1), lambda turn: part(own_block, turn, False))
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda block: part(block, own_round, True))
    both = F.when(F.col("component") == F.col("largest"), targets).otherwise(F.concat(targets, asking))
    return placed.select("node", "class", "component", F.inline(both))


class _Targets:
    """The sets of a block's targets as an index from shingles to targets."""

    def __init__(self, classes: list[int], components: list[int], sets: list[np.ndarray]):
        self.classes, self.components = np.array(classes), np.array(components)
        self.sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.shingles, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))

    def links(self, component: int, shingles: np.ndarray, percent: int) -> list[int]:
        """A similar target of each component but the one given."""
        at = np.searchsorted(self.shingles, shingles)
        known = at < len(self.shingles)
        at = at[known][self.shingles[at[known]] == shingles[known]]
        owners = [self.owners[a:b] for a, b in zip(self.starts[at], self.ends[at], strict=True)]
        common = np.bincount(np.concatenate(owners) if owners else np.zeros(0, int), minlength=len(self.classes))
        union = self.sizes + len(shingles) - common
        hits = np.flatnonzero((100 * common >= percent * union) & (self.components != component))
        first = np.unique(self.components[hits], return_index=True)[1]
        return self.classes[hits[first]].tolist()


def _cluster_links(asking: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components within the clusters, confirmed on the full sets where they are compared."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        current, targets, held = None, None, []
        for batch in batches:
            found = []
            columns = [batch[c].to_pylist() for c in ("node", "block", "round", "asks", "class", "component", "shingles")]
            for node, block, turn, asks, number, component, shingles in zip(*columns, strict=True):
                if (node, block, turn) != current:
                    current, targets, held = (node, block, turn), None, []
                shingles = np.frombuffer(shingles, dtype=np.uint64)
                if not asks:
                    held.append((number, component, shingles))
                    continue
                if targets is None and held:
                    targets, held = _Targets(*map(list, zip(*held, strict=True))), []
                if targets is not None:
                    found += [(number, other) for other in targets.links(component, shingles, percent)]
            if found:
                yield dict(zip(("u", "v"), zip(*found, strict=True), strict=True))

    place = ["node", "block", "round"]
    dealt = asking.join(sets, "class").repartition(*place).sortWithinPartitions(*place, "asks", "class")
    return written(map_batches(dealt, run, "u bigint, v bigint"), "links")


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Written (class, shingles) of the classes in ``wanted``, from the text of a member with the smallest doc_id.

    Rows that repeat that doc_id meet in a task, which passes one of them on; a class that several tasks give is harmless.
    """
    chosen = classes.join(wanted, "class", "left_semi").select("class", F.col("digest"), F.col("least_id").alias("id"))
    texts = docs.select("doc_id", text_of("text").alias("text"))
    members = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("id"))).select("class", "digest", "text")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, done = Shingler(size), set()
        for batch in batches:
            classes, sets = [], []
            for number, digest, text in zip(batch["class"].to_pylist(), batch["digest"].to_pylist(), utf8(batch["text"]), strict=True):
                if number in done:
                    continue
                shingles = shingler.shingles(text).tobytes()
                if hashlib.md5(shingles, usedforsecurity=False).digest() == digest:
                    done.add(number)
                    classes.append(number)
                    sets.append(shingles)
            yield {"class": classes, "shingles": sets}

    return written(map_batches(members, run, "class bigint, shingles binary"), "full")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (a, b) whose full sets are similar."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            hit = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                hit.append(100 * both >= percent * (len(p) + len(q) - both))
            yield {"u": batch["a"].filter(np_bool(hit)), "v": batch["b"].filter(np_bool(hit))}

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return written(map_batches(joined, run, "u bigint, v bigint"), "links")


def np_bool(values: list[bool]):
    import pyarrow as pa

    return pa.array(values, type=pa.bool_())


def _component_of(column: str, known: DataFrame, name: str) -> tuple[DataFrame, Column]:
    renamed = known.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(name))
    return renamed, F.col(column) == F.col(f"{name}_node")


def linked_classes(
    docs: DataFrame, classes: DataFrame, size: int, percent: int, recall: float = RECALL, limit: int = NODE_LIMIT
) -> DataFrame:
    """(node, component) of the classes that have a link."""
    found = candidates(small_nodes(classes, trees_for(recall, percent), limit), percent)
    first = found.where("kind = 0").select("a", "b")
    others = found.where("kind = 1").select("a", "b").join(first, ["a", "b"], "left_anti")
    wanted = found.where("kind < 2").select(F.explode(F.array("a", "b")).alias("class")).unionByName(
        found.where("kind = 2").select(F.col("b").alias("class"))
    ).distinct()
    sets = full_sets(docs, classes, wanted, size)
    links = confirmed(first, sets, percent)
    known = written(components(links), "components")
    own_a, is_a = _component_of("a", known, "component_a")
    own_b, is_b = _component_of("b", known, "component_b")
    part_a, part_b = F.coalesce("component_a", "a"), F.coalesce("component_b", "b")
    unconnected = others.join(own_a, is_a, "left").join(own_b, is_b, "left").where(part_a != part_b).select("a", "b")
    clusters = found.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("member"))
    within = _cluster_links(_asking(clusters, classes, known), sets, percent)
    more = confirmed(unconnected, sets, percent).unionByName(within)
    if more.isEmpty():
        return known
    return written(components(links.unionByName(more)), "components")


def _decided(docs: DataFrame, size: int, percent: int, recall: float, limit: int) -> DataFrame:
    rows = document_sets(docs, size)
    classes = classes_of(rows)
    known = linked_classes(docs, classes, size, percent, recall, limit)
    placed = classes.join(known, F.col("class") == F.col("node"), "left").select("digest", "least_id", "members", "component")
    least = placed.where("component IS NOT NULL").groupBy(F.col("component").alias("of")).agg(F.min("least_id").alias("least"))
    shared = placed.where("component IS NOT NULL OR members > 1").join(least, F.col("component") == F.col("of"), "left").select(
        F.col("digest").alias("set"), F.coalesce("least", "least_id").alias("smallest")
    )
    joined = rows.select("doc_id", "content", "n_shingles", "digest").join(
        shared, (F.col("digest") == F.col("set")) & (F.col("n_shingles") > 0), "left"
    )
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return joined.select(
        "doc_id", "content", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, recall: float = RECALL, limit: int = NODE_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _decided(docs, size, percent, recall, limit).drop("content")


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the row with the smallest doc_id, once.

    Rows of one doc_id and text are one row; if texts of one component share the smallest doc_id, all of them stay.
    """
    decided = _decided(docs, size, percent, recall, NODE_LIMIT)
    dropped = decided.where("NOT kept").select(F.col("doc_id").alias("gone"), F.col("content").alias("text_gone")).distinct()
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.md5(text_of("text")).alias("content"))
    same = F.col("id").eqNullSafe(F.col("gone")) & (F.col("content") == F.col("text_gone"))
    once = Window.partitionBy("id", "content").orderBy(row_hash(docs, "doc"))
    stays = packed.join(dropped, same, "left_anti").withColumn("place", F.row_number().over(once))
    return stays.where("place = 1").select("doc.*")
