"""Fill-in-the-middle, decontamination and the filter audit over awkward rows, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from sluicebox.llm import decontaminate, filter_audit, infilling
from test_operators import LONG, PROSE, SCHEMA, awkward, empty

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11

def plain_infill(doc_id, text):
    text = text or ""
    n = len(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_infill_of_awkward_rows(spark):
    docs = awkward(spark).union(spark.createDataFrame(
        [(100 + i, t, None, None, None, None, None, i, None) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<", "é😀漢" * 50, "P>S>M>" * 9] * 5)], SCHEMA
    ))
    found = infilling.read_back(infilling.transform(docs)).collect()
    assert ordered(found) == ordered(plain_infill(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infilling.read_back(infilling.transform(empty(spark))).collect() == []


def test_infill_between_words(spark):
    docs = awkward(spark)
    texts = [r.text or "" for r in docs.collect()]
    rows = infilling.transform(docs, seed=3, units="words").collect()
    assert sorted(infilling.restored(r.output, r.form) for r in rows) == sorted(texts)
    cut = [r for r in rows if r.form != "plain"]
    assert len(cut) > 5
    for r in cut:
        text = infilling.restored(r.output, r.form)
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        allowed = {0, len(text), *ends}
        assert r.n in (len(ends), len(ends) + 1) and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= allowed
    with pytest.raises(ValueError):
        infilling.transform(docs, units="lines")


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1024, 1025, 40_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(0, 9, n)
    index = infilling.SkipList(widths)
    ends = [0, *np.cumsum(widths).tolist()]
    assert len(index) == n
    ranks = range(n + 1) if n < 2000 else [*range(0, n + 1, 37), n]
    assert [index.code_points(r) for r in ranks] == [ends[r] for r in ranks]
    if n:
        index.resize(n // 2, 1000)
        assert index.code_points(n) == ends[n] - widths[n // 2] + 1000 and index.code_points(n // 2) == ends[n // 2]
    with pytest.raises(IndexError):
        index.code_points(n + 1)


# 12

def plain_leaks(docs, benchmark, width=10):
    windows = set()
    for item, text in benchmark:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        windows |= {(tuple(words[i : i + width]), str("" if item is None else item)) for i in range(max(1, len(words) - width + 1)) if words}
    out = []
    for doc_id, text in docs:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for window, item in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i] == window[0] and tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    items.add(item)
        out.append((doc_id, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def leak_tables(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["The", "cat", "x9", "été", "漢字", "on", "A", "mat"])
    items = [(i, rng.choice(" -,\n") .join(word() for _ in range(rng.choice([1, 2, 9, 10, 11, 14])))) for i in range(25)]
    items = [(i, t) for i, t in items if len(ITEM_WORD.findall(t)) > 1] + [(90, None), (91, " .,"), (None, "zebra crossing"), (7, "Second text of seven"), items[-1], items[-1]]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + k, f"Intro, {t}! {'pad ' * 12}{(t or '').upper()} outro") for k, (_, t) in enumerate(items)]
    docs += [(None, "a ZEBRA  crossing"), (200, None), (201, ""), (202, LONG + " zebra\ncrossing"), docs[0], docs[0], (203, "zebra crossings")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), benchmark


def test_leaks_in_one_block_and_in_many(spark):
    docs, items, table, benchmark = leak_tables(spark)
    plain = ordered(plain_leaks(docs, items))
    assert ordered(decontaminate.report(decontaminate.find(table, benchmark)).collect()) == plain
    assert sum(r[5] for r in plain) > 20 and not all(r[5] for r in plain)
    assert len(decontaminate.broadcast_blocks(benchmark, block_bytes=800)) > 2
    assert ordered(decontaminate.report(decontaminate.find(table, benchmark, block_bytes=800)).collect()) == plain


def test_leaks_are_verified_word_by_word(monkeypatch):
    monkeypatch.setattr(decontaminate, "window_hashes", lambda words, width: np.zeros(len(words) - width + 1, dtype=np.uint64))
    known = decontaminate.WindowSet([b"a b", b"c d", b"c d", b"e"], ["1", "2", "3", "4"])
    words = b"x c d a b y".split()
    hits = list(known.hits(words, np.zeros(len(words), dtype=np.uint64)))
    assert hits == [(1, 3, b"c d"), (3, 5, b"a b")] and known.items[b"c d"] == ["2", "3"]


def test_leaks_are_removed_and_other_columns_stay(spark):
    item = "one two Three four five six seven eight nine ten eleven"
    rows = [
        (1, f"Start ({item}), end.", "en", "s", 1, None, "d", 1, "c"), (2, "clean text", None, None, 7, True, None, 2, None),
        (None, item.upper(), "en", None, 5, None, None, 3, None), (3, None, None, None, None, None, None, 4, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("digest", "spans").withColumnRenamed("kept", "items")
    benchmark = spark.createDataFrame([(5, item, 1)], "item_id bigint, text string, row int")
    cleaned = decontaminate.clean(docs, benchmark)
    assert cleaned.columns == docs.columns
    found = {r.row: (r.text, r.n_chars) for r in cleaned.collect()}
    assert found == {1: ("Start (), end.", 14), 2: ("clean text", 7), 3: ("", 0), 4: (None, None)}
    assert sorted(r.row for r in decontaminate.clean(docs, benchmark, remove="documents").collect()) == [2, 4]
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean(docs, nothing).count() == 4
    assert not decontaminate.report(decontaminate.find(awkward(spark), nothing)).where("contaminated OR n_items > 0").count()
    assert decontaminate.find(empty(spark), benchmark).collect() == []
    with pytest.raises(ValueError):
        decontaminate.clean(docs, benchmark, remove="words")


# 13

def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and i > least[text] else set()
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out, removed_in = [], {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                fails = sum(f in r[0] for r in rows)
                removed_in[part, f] = removed_in.get((part, f), 0) + len(gone)
                only = sum(r[0] == {f} for r in rows)
                out.append((part, order, k + 1, len(left), len(gone), fails - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone)))
    return [(*r, removed_in[r[0], r[1][r[2] - 1]]) for r in out]


def test_audit_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE", 2)
    monkeypatch.setattr(filter_audit, "FREQUENT", 2)
    docs = awkward(spark).union(spark.createDataFrame(
        [(300 - i, ["Same ABC", PROSE * 3 + "#", "", LONG + "|"][i % 4], ["en", "", None, "de"][i % 3], None, None, None, None, i, None) for i in range(40)], SCHEMA
    ))
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (5, 0, 1), (None, 1, 1), (300, 1, None), (296, None, 1), (291, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    plain = plain_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], labels)
    assert ordered(filter_audit.audit(docs, table).collect()) == ordered(plain)
    assert filter_audit.audit(empty(spark), table).collect() == []
    one = spark.createDataFrame([(1, LONG, "xx")], "doc_id bigint, text string, lang string")
    rows = filter_audit.audit(one, table.limit(0)).collect()
    assert len(rows) == 600 and all((r.part, r.kept, r.removed, r.shapley) == ("xx", 1, 0, 0) for r in rows)


def test_gallop_union_and_difference():
    rng = random.Random(2)
    for size in (0, 1, 3, 40, 299):
        for _ in range(40):
            lists = [sorted(rng.sample(range(300), rng.randint(0, size))) for _ in range(4)]
            assert filter_audit.union(lists) == sorted(set().union(*lists))
            assert filter_audit.difference(lists[0], lists[1]) == sorted(set(lists[0]) - set(lists[1]))
            assert filter_audit.common_size(lists[0], lists[1]) == len(set(lists[0]) & set(lists[1]))
            x, at = rng.randint(-1, 301), rng.randint(0, len(lists[2]))
            assert filter_audit.gallop(lists[2], x, at) == next((k for k in range(at, len(lists[2])) if lists[2][k] >= x), len(lists[2]))
