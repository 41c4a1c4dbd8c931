"""How filters interact: what each removes at each place of each order, alone, first, or only after others.

A filter is a bit of a mask; the documents that fail it, within a part and a range of document numbers, are a posting list
in ascending order. Lists of one range meet in one task, ``RANGE`` documents at most, and unions and differences are found by
merges that gallop: the list with the smallest head moves in doubling steps up to the next head of another list, and
everything it passes belongs to the result as one run. Sizes for every filter and every set of earlier filters are emitted and
added up over the ranges by Spark, so a part of any size is spread over its ranges and memory stays bounded. The sizes answer
all orders: a filter removes what it fails and the union of those before it does not.

Documents are numbered by row, so repeated rows and repeated doc_ids are documents of their own. A null text is empty, a null part
the empty string; a null doc_id has no label, repeats no text and has none that repeats it. Labels of one doc_id count
together. An empty table has no parts and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, text_of, utf8
from sluicebox.scratch import written

#: The rules of ``text_failures``, one bit each; a text repeated from a smaller doc_id is the last bit.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
_SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_CONTINUATIONS = bytes(range(0x80, 0xC0))

#: Bits of a document's number within its range.
RANGE = 16
#: A digest is frequent above this number of rows and above a ten-thousandth of all rows: ten thousand digests at most.
FREQUENT = 1_000


def text_failures(text: bytes) -> int:
    """The mask of the rules that look at one text: A too few words, B too few different ones, C capitals, D symbols."""
    words = text.split()
    points = len(text.translate(None, _CONTINUATIONS))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    mask = len(words) < MIN_WORDS
    mask |= (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2
    return mask | any(symbol in text for symbol in _SYMBOLS) << 3


def gallop(ids: Sequence[int], x: int, at: int) -> int:
    """The first place from ``at`` on that holds ``x`` or more."""
    step, n = 1, len(ids)
    low = at
    while at < n and ids[at] < x:
        low = at + 1
        at += step
        step <<= 1
    return bisect_left(ids, x, low, min(at, n))


def union(lists: Sequence[list[int]]) -> list[int]:
    """The ids in any of the ascending lists, ascending."""
    out: list[int] = []
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heads)
    while len(heads) > 1:
        _, k, at = heads[0]
        limit = min(head[0] for head in heads[1:3])
        ids = lists[k]
        end = gallop(ids, limit, at)
        out += ids[at:end]
        if end < len(ids) and ids[end] == limit:  # the other list gives it
            end += 1
        if end < len(ids):
            heapreplace(heads, (ids[end], k, end))
        else:
            heappop(heads)
    for _, k, at in heads:
        out += lists[k][at:]
    return out


def difference(ids: list[int], gone: list[int]) -> list[int]:
    """The ids that are not in ``gone``; both ascending."""
    out: list[int] = []
    at = place = 0
    while at < len(ids) and place < len(gone):
        end = gallop(ids, gone[place], at)
        out += ids[at:end]
        at = end
        if at < len(ids):
            if ids[at] == gone[place]:
                at += 1
            if at < len(ids):
                place = gallop(gone, ids[at], place)
    return out + ids[at:]


def common_size(ids: list[int], marked: list[int]) -> int:
    """How many ids stand in both ascending lists."""
    return len(ids) - len(difference(ids, marked))


def interactions(lists: Sequence[list[int]], good: list[int], toxic: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(filter, mask of earlier filters, removed, removed by all of them, good and toxic among the removed) for each filter and set."""
    n = len(lists)
    united = [union([ids for i, ids in enumerate(lists) if earlier >> i & 1]) for earlier in range(1 << n)]
    for i, ids in enumerate(lists):
        for earlier in range(1 << n):
            if not earlier >> i & 1:
                removed = difference(ids, united[earlier])
                both = len(united[earlier | 1 << i])
                yield i, earlier, len(removed), both, common_size(good, removed), common_size(toxic, removed)


def failures(docs: DataFrame, part: str) -> DataFrame:
    """Written rows (row, doc_id, part, digest, mask) of all documents; the repeated texts are not marked yet."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = utf8(batch["text"])
            digests = [hashlib.sha256(t).digest() for t in texts]
            yield {"doc_id": batch["doc_id"], "part": batch["part"], "digest": digests, "mask": list(map(text_failures, texts))}

    texts = docs.select(F.col("doc_id").cast("bigint"), text_of(part).alias("part"), text_of("text").alias("text"))
    found = map_batches(texts, run, "doc_id bigint, part string, digest binary, mask int")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "failures")


def mark_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with the bit set where a smaller doc_id has the same digest.

    The smallest doc_id of a digest is a partial minimum. Frequent digests, of which there are few whatever the table,
    are joined by broadcast and move no rows; the others are too rare to fill a task.
    """
    known = rows.where("doc_id IS NOT NULL")
    least = known.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = written(least.where("least < last").select("of", "least", "n"), "repeated")
    frequent = F.col("n") > F.greatest(F.lit(FREQUENT), F.floor(F.lit(rows.count()) / 10_000))
    hot, rest = repeated.where(frequent).select("of", "least"), repeated.where(~frequent).select("of", "least")
    same = F.col("digest") == F.col("of")
    marked = F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(1 << bit)).otherwise(F.col("mask"))
    columns = ["row", "doc_id", "part", marked.alias("mask")]
    from_hot = rows.join(F.broadcast(hot), same).select(*columns)
    others = rows.join(F.broadcast(hot), same, "left_anti").join(rest, same, "left").select(*columns)
    return from_hot.unionByName(others)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    with_id = rows.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("of"), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    without = rows.where("doc_id IS NULL").select("part", "row", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return with_id.select("part", "row", "mask", *flags).unionByName(without)


def sizes(failing: DataFrame, n_filters: int) -> DataFrame:
    """(part, filter, earlier, removed, united, good, toxic) over all ranges, from rows (part, row, mask, good, toxic)."""

    def result(part: str, ids: list[list[int]]) -> dict:
        columns = zip(*interactions(ids[:n_filters], *ids[n_filters:]), strict=True)
        out = dict(zip(("filter", "earlier", "removed", "united", "good", "toxic"), columns, strict=True))
        return out | {"part": [part] * len(out["filter"])}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        current, ids = None, []
        for batch in batches:
            names = ("part", "range", "row", "mask", "good", "toxic")
            for part, block, row, mask, good, toxic in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if (part, block) != current:
                    if ids:
                        yield result(current[0], ids)
                    current, ids = (part, block), [[] for _ in range(n_filters + 2)]
                for i in range(n_filters):
                    if mask >> i & 1:
                        ids[i].append(row)
                if good:
                    ids[n_filters].append(row)
                if toxic:
                    ids[n_filters + 1].append(row)
        if ids:
            yield result(current[0], ids)

    ranged = failing.where("mask <> 0").withColumn("range", F.shiftright("row", RANGE))
    dealt = ranged.repartition("part", "range").sortWithinPartitions("part", "range", "row")
    schema = "part string, filter int, earlier int, removed bigint, united bigint, good bigint, toxic bigint"
    counts = ["removed", "united", "good", "toxic"]
    return map_batches(dealt, run, schema).groupBy("part", "filter", "earlier").agg(*[F.sum(c).alias(c) for c in counts])


def orders(names: str) -> list[dict]:
    """Each step of each order of the filters: order, step, filter, mask of the filters before it."""
    steps = []
    for order in permutations(range(len(names))):
        label = "".join(names[i] for i in order)
        steps += [
            {"filter_order": label, "step": k + 1, "filter": i, "earlier": sum(1 << j for j in order[:k])} for k, i in enumerate(order)
        ]
    return steps


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, as counts of documents."""
    n = len(FILTERS)
    rows = failures(docs, part)
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("documents"))
    found = sizes(_labelled(mark_repeats(rows, n - 1), labels), n)
    own = Window.partitionBy("part", "filter")  # 16 rows
    # Orders in which exactly the earlier filters come before this one.
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("earlier") + 1)
    everything = F.lit((1 << n) - 1) - F.pow(F.lit(2), F.col("filter")).cast("int")
    found = found.select(
        "*", F.sum(F.col("removed") * times).over(own).alias("shapley"),
        F.max(F.when(F.col("earlier") == 0, F.col("removed"))).over(own).alias("fails"),
        F.max(F.when(F.col("earlier") == everything, F.col("removed"))).over(own).alias("unique_fails"),
    )
    entry = F.struct(F.col("filter") * (1 << n) + F.col("earlier"), F.struct("removed", "united", "good", "toxic", "shapley", "fails", "unique_fails"))
    by_part = found.groupBy(F.col("part").alias("of")).agg(F.map_from_entries(F.collect_list(entry)).alias("sizes"))
    step = F.from_json(F.lit(json.dumps(orders(FILTERS))), "array<struct<filter_order: string, step: int, filter: int, earlier: int>>")
    steps = totals.join(by_part, F.col("part") == F.col("of"), "left").select("part", "documents", "sizes", F.inline(step))
    here = F.col("sizes")[F.col("filter") * (1 << n) + F.col("earlier")]
    number = lambda name: F.coalesce(here[name], F.lit(0)).cast("bigint")
    return steps.select(
        "part", "filter_order", "step", (F.col("documents") - number("united")).alias("kept"), number("removed").alias("removed"),
        (number("fails") - number("removed")).alias("redundant"), number("unique_fails").alias("unique_fails"),
        number("good").alias("good_lost"), number("toxic").alias("toxic_lost"), number("shapley").alias("shapley"),
    )
