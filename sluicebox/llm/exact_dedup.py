"""Exact deduplication through a cuckoo-filter index of live digests.

Every task first folds its own rows through an index, so that a text that holds a third of all rows leaves each task
as one entry. The entries are then dealt by digest, sorted by bucket (a prefix of the digest), and one index for each
bucket decides. A hit of the filter is a candidate only: it is verified against the bucketed content, the stored
256-bit digests. When a row with a larger doc_id arrives, the live entry is deleted and the newer one inserted; when
the filter overflows, it is built anew at twice the size from the stored keys. Memory is bounded by one bucket.

Null texts count as empty. Rows that repeat a doc_id within a group: exactly one of them stays. A null doc_id is
smaller than any other. An empty table gives an empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, row_hash, text_of
from sluicebox.scratch import written

SLOTS = 4
MAX_KICKS = 200
#: Entries that a task folds before it hands them on; bounds its memory, not the result.
FOLD = 200_000
BUCKET_BYTES = 3
#: Finished entries that are handed on together.
EMIT = 10_000
_LOWEST = -(2**63)
_ENTRIES = "digest binary, keep_id bigint, keep_row bigint, group_size bigint, withdrawn boolean"


class CuckooIndex:
    """A cuckoo filter over 32-byte digests whose slots point at the stored keys.

    Two groups of four slots are open to each key; the second follows from the first and the fingerprint alone, so
    an entry can be moved without its key.
    """

    def __init__(self, groups: int = 16):
        self.live: dict[int, tuple] = {}
        self.slots = SLOTS
        self._fresh = 0
        self._build(groups)

    def _build(self, groups: int) -> None:
        self.groups = groups
        self.mask = groups - 1
        self.table: list[list[tuple[int, int]]] = [[] for _ in range(groups)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[-10:-8], "little") or 1
        first = int.from_bytes(key[-8:], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, group: int, mark: int) -> int:
        return group ^ ((mark * 0x5BD1E995 + 1) & self.mask)

    def find(self, key: bytes) -> int | None:
        """The handle of a live key: filter hits, verified against the stored digest."""
        mark, first, second = self._places(key)
        for group in (first, second):
            for seen, handle in self.table[group]:
                if seen == mark and self.live[handle][0] == key:
                    return handle
        return None

    def insert(self, key: bytes, *values) -> int:
        handle, self._fresh = self._fresh, self._fresh + 1
        self.live[handle] = (key, *values)
        if not self._place(key, handle):
            self._resize()
        return handle

    def delete(self, key: bytes) -> tuple:
        """Take a live key out of the index; gives what was stored with it."""
        handle = self.find(key)
        if handle is None:
            raise KeyError(key)
        mark, first, second = self._places(key)
        group = self.table[first] if (mark, handle) in self.table[first] else self.table[second]
        group.remove((mark, handle))
        return self.live.pop(handle)

    def _place(self, key: bytes, handle: int) -> bool:
        mark, first, second = self._places(key)
        for group in (first, second):
            if len(self.table[group]) < self.slots:
                self.table[group].append((mark, handle))
                return True
        group, entry = second, (mark, handle)
        for kick in range(MAX_KICKS):
            slots = self.table[group]
            slots[kick % self.slots], entry = entry, slots[kick % self.slots]
            group = self._other(group, entry[0])
            if len(self.table[group]) < self.slots:
                self.table[group].append(entry)
                return True
        return False

    def _resize(self) -> None:
        """Overflow: twice the groups, refilled from the stored keys.

        Keys that agree in all bits that choose a group stay together at any size; then a group gets more slots.
        """
        groups = self.groups * 2
        while True:
            if groups > 64 * (SLOTS + len(self.live)):
                groups, self.slots = 16, 2 * self.slots
            self._build(groups)
            if all(self._place(stored[0], handle) for handle, stored in self.live.items()):
                return
            groups *= 2

    def fold(self, key: bytes, keep_id: int | None, keep_row: int, size: int, withdrawn: bool) -> None:
        """Insert a digest, or join it to the live entry: the largest (doc_id, row) stays."""
        handle = self.find(key)
        if handle is None:
            self.insert(key, keep_id, keep_row, size, withdrawn)
            return
        _, old_id, old_row, old_size, old_withdrawn = self.live[handle]
        old, new = (_LOWEST if old_id is None else old_id, old_row), (_LOWEST if keep_id is None else keep_id, keep_row)
        if new > old:
            self.delete(key)
            self.insert(key, keep_id, keep_row, old_size + size, withdrawn or old_withdrawn)
        else:
            self.live[handle] = (key, old_id, old_row, old_size + size, withdrawn or old_withdrawn)


_NAMES = ("digest", "keep_id", "keep_row", "group_size", "withdrawn")


def _emit(entries: list[tuple]) -> dict[str, list]:
    return dict(zip(_NAMES, map(list, zip(*entries, strict=True)), strict=True))


def _folded(bounded_by_bucket: bool):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        index, bucket, done = CuckooIndex(), None, []
        for batch in batches:
            for key, *values in zip(*(batch[c].to_pylist() for c in _NAMES), strict=True):
                here = key[:BUCKET_BYTES] if bounded_by_bucket else None
                if index.live and (here != bucket or (not bounded_by_bucket and len(index.live) >= FOLD)):
                    done += index.live.values()
                    index = CuckooIndex()
                bucket = here
                index.fold(key, *values)
            if len(done) >= EMIT:
                yield _emit(done)
                done = []
        done += index.live.values()
        if done:
            yield _emit(done)

    return run


def digests(docs: DataFrame) -> DataFrame:
    """Written rows (doc_id, digest, row): the row number tells repeated rows apart."""
    rows = docs.select("doc_id", F.unhex(F.sha2(text_of("text"), 256)).alias("digest"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return written(rows, "digests")


def groups(rows: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """One row for each distinct text: digest, keep_id, keep_row, group_size, withdrawn."""
    entries = rows.select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(False).alias("withdrawn"),
    )
    if withdrawn is not None:
        taken = withdrawn.select(F.unhex(F.sha2(text_of("text"), 256)).alias("digest"))
        none = F.lit(None).cast("bigint")
        entries = entries.unionByName(
            taken.select("digest", none.alias("keep_id"), F.lit(-1).cast("bigint").alias("keep_row"),
                         F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("withdrawn"))
        )
    folded = map_batches(entries, _folded(False), _ENTRIES)
    dealt = folded.repartition(F.col("digest")).sortWithinPartitions(F.substring("digest", 1, BUCKET_BYTES))
    return map_batches(dealt, _folded(True), _ENTRIES).where("group_size > 0")


def deduplicate(docs: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Texts of ``withdrawn`` (a column ``text``) are deleted from
    the index: no row of theirs stays.
    """
    rows = digests(docs)
    found = groups(rows, withdrawn)
    shared = found.where("group_size > 1 OR withdrawn").withColumnRenamed("digest", "_digest")
    joined = rows.join(shared, rows["digest"] == shared["_digest"], "left")
    single = F.col("_digest").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | ((F.col("row") == F.col("keep_row")) & ~F.col("withdrawn"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = deduplicate(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.sha2(text_of("text"), 256).alias("sha"))
    stays = packed.join(decided, packed["id"].eqNullSafe(decided["_id"]) & (packed["sha"] == decided["_sha"]), "left_semi")
    first = Window.partitionBy("sha", "id").orderBy(row_hash(docs, "doc"))
    return stays.withColumn("place", F.row_number().over(first)).where("place = 1").select("doc.*")
