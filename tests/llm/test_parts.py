"""The parts of the operators that need no Spark, against plain versions."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from sluicebox.llm import chat, html_text, near_dedup, packing, quality_rules, rans, token_store
from sluicebox.llm.classifier import FEATURES, discriminant, document_vector
from sluicebox.llm.exact_dedup import CuckooIndex

TEXTS = st.text(alphabet=" \t\n\v\f\r\x1c\x85\xa0abABé#$|<>漢😀.", max_size=60)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_base_statistics(text):
    assert quality_rules.text_statistics(text.encode()) == brute.base_statistics(text)


def test_lines_of_one_text():
    lines = quality_rules.text_lines(("One 12\nTwo\n\nONE  7\n" + "long " * 41).encode())
    assert sorted(x["words"] for x in lines) == [1, 4, 41]
    gone = {x["line"] for x in quality_rules.text_lines(b"TWO")}
    assert quality_rules.without_lines("One 12\ntwo \n\nthree", gone) == "One 12\n\nthree"


CONTROL = st.sampled_from(
    ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]", "<", "[", "\\", "/", "s>", "INST]", " ", "\n", "x", "é", "<\\s>", "[\\\\INST]"]
)
HOSTILE = st.lists(CONTROL, max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | HOSTILE, HOSTILE), max_size=5))
@settings(max_examples=500, deadline=None)
def test_chat_round_trip(turns):
    made = [chat.render(role, text) for role, text in turns]
    formatted = "".join(m[0] for m in made)
    assert chat.parse(formatted) == turns
    parser, read = chat.Parser(), []
    for c in formatted:  # piece by piece
        read += parser.feed(c)
    parser.close()
    assert read == turns
    for (rendered, start, end), (_, text) in zip(made, turns, strict=True):
        assert chat.unescape(rendered[start:end]) == text


def test_ordinary_texts_are_not_escaped():
    assert chat.render("user", "a < b [1]")[0] == "[INST] a < b [1] [/INST]"
    assert chat.render("assistant", None)[0] == "<s></s>"
    with pytest.raises(ValueError):
        chat.parse("<s>open")


@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 20), st.integers(0, 40)), max_size=120), st.sampled_from([3, 100]))
@settings(max_examples=150, deadline=None)
def test_packing_is_best_fit(rows, frequent):
    capacity = 100
    last = lambda n: (n - 1) % capacity + 1 if n else 0
    rows = sorted(rows, key=lambda r: -last(r[0]))
    before, packing.FREQUENT = packing.FREQUENT, frequent
    try:
        made = list(packing.pack_shard(
            np.array([r[0] for r in rows], dtype=np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64), capacity
        ))
    finally:
        packing.FREQUENT = before
    plain = brute.packed([(i, n, s, c) for i, (n, s, c) in enumerate(rows)], capacity)
    # Empty pieces fit anywhere; a full bin of a long text is no bin of the order.
    assert [(r, p, s, n) for r, p, s, n, _, _ in made] == [(r, p, s, n) for r, p, s, n, _, _ in plain]
    assert [(b, x) for *_, b, x in made] == [(b, x) for *_, b, x in plain]


@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=300))
@settings(max_examples=100, deadline=None)
def test_cuckoo_index(steps):
    index, live = CuckooIndex(1), {}
    for number, insert in steps:
        key = number.to_bytes(32, "big") if number % 3 else bytes(22) + b"\1\1" + bytes(7) + bytes([number])  # marks collide
        if insert and key not in live:
            index.insert(key, number)
            live[key] = number
        elif not insert and key in live:
            assert index.delete(key)[1] == live.pop(key)
        else:
            assert (index.find(key) is not None) == (key in live)
    assert {k: v[0] for k, *v in index.live.values()} == live
    for key in live:
        assert index.live[index.find(key)][0] == key
    with pytest.raises(KeyError):
        index.delete(b"x" * 32)


def test_keys_that_share_their_groups():
    index = CuckooIndex(1)
    keys = [bytes(22) + b"\1\1" + bytes(7) + bytes([i]) for i in range(40)]
    for i, key in enumerate(keys):
        index.insert(key, i)
    assert [index.live[index.find(k)][1] for k in keys] == list(range(40))
    assert [index.delete(k)[1] for k in keys[::2]] == list(range(0, 40, 2))
    assert [index.find(k) is None for k in keys] == [True, False] * 20


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_coded_blocks(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype(np.uint32)
    table = rans.Table(rans.pack_table(ids))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    parts = [rans.decode(block, table, k, k + 1) for k in range(rans.checkpoints(block))]  # any order, each by itself
    assert (np.concatenate([np.zeros(0, np.uint32), *parts]) == ids).all()
    if n > 1024:
        assert len(block) < 2 * n + 30_000
        with pytest.raises(ValueError, match="checksum"):
            rans.decode(block[:100] + bytes([block[100] ^ 1]) + block[101:], table)


def test_one_symbol_takes_no_words():
    ids = np.full(5000, 7, dtype=np.uint32)
    table = rans.Table(rans.pack_table(ids))
    assert (rans.decode(rans.encode(ids, table), table) == 7).all()


def test_parts_give_the_ids_of_whole_texts():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    coder, r = token_store.Encoder(path), random.Random(3)
    atoms = [" ", "  ", "   ", "\n", " \n", "\n ", "\t", "foo", "Bar", "'s", "'", ".", "é", " ", "　", "12", " x", "\x1c", "\x85", "<|endoftext|>", ",", "!!", "straße", "ǅ", "ʰ", "²", "’s", "\u0301"]
    for _ in range(3000):
        text = "".join(r.choice(atoms) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(coder.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_forgotten_parts_are_learnt_again(monkeypatch):
    import public_tokenizers

    coder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"word{i} other{i} x" for i in range(50)]
    known = [coder.encode(t) for t in texts]
    monkeypatch.setattr(token_store, "KEPT", 3)
    assert [coder.encode(t) for t in texts] == known


PAGE = (
    '<html><head><title>x</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">q</a></nav><!-- c --><div class="ad">buy'
    '<div>now</div></div><article><h1>T &amp; u</h1><p><b>One<br><p>two  <i>x</i>\n y&nbsp;z</p><aside>no</aside><form>f</form>'
    '<div class="comments">c</div><p>3 &lt; 4</p><script>var a="</p>";</script></article><section class=sidebar>s</section><footer>f</footer>'
)


def test_main_text_of_an_article():
    assert html_text.main_text(PAGE) == "T & u\nOne\ntwo x y z\n3 < 4"


def test_main_text_without_an_article():
    page = "<ul><li><a>Home</a><li><a>About</a></ul>" + "<p>A long enough sentence of the text.</p><p>Be.</p>" * 3 + "<div id='footer'>(c)</div>"
    assert html_text.main_text(page) == "\n".join(["A long enough sentence of the text.", "Be."] * 3)


def test_main_text_of_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("only text") == "only text"
    assert html_text.main_text("<div class=ad>never closed <article><p>kept</p></article>") == "kept"
    assert html_text.main_text("<form><div class='page has-sidebar'><p>out</p><article><p>in</p></article></div></form>") == "in"
    assert html_text.main_text("<main><p>a</p><div class='comment-list'><p>b</p></div><div role='alert'>c</div></main><p>d</p>") == "a"
    assert html_text.main_text("<article>" + "<p>" * 3000 + "deep</article>") == "deep"
    assert html_text.main_text("<article><p>x" * 2 + "y") == "x\nxy"
    assert html_text.main_text("<article>" + "<div class='ad'>a</div>" * 5 + "<p>one</p>" + "<aside>b</aside>" * 9 + "<p>two</p></article>") == "one\ntwo"


PARAGRAPHS = ["".join(f"<p>{c}{'word ' * 60}</p>" for c in part) for part in ("ab", "cd")]


def starts(page):
    return "".join(line[0] for line in html_text.main_text(page).split("\n") if line)


def test_a_small_article_element_does_not_replace_the_body():
    body = "".join(PARAGRAPHS)
    card = "<article><h2>Xteaser</h2><p>Ya card</p></article>"
    for page in (f"<div>{body}</div>{card}", f"{card}<div>{body}</div>", f"<div>{PARAGRAPHS[0]}{card}{PARAGRAPHS[1]}</div>"):
        assert starts(page) == "abcd"
    assert starts(f"<div>{body}</div><article><p>z{'reply ' * 40}</p></article>").startswith("abcd")
    assert starts(f"<p>elsewhere</p><article>{body}</article><p>elsewhere</p>") == "abcd"


def test_what_looks_hidden():
    body = "".join(PARAGRAPHS)
    thread = "<div id=comments><h3>C</h3><ol class=comment-list>" + f"<li class=comment><article class=comment-body><p>z{'reply ' * 70}</p></article></li>" * 9 + "</ol></div>"
    cards = f"<aside class=related><article><p>z{'card ' * 90}</p></article></aside>"
    for around in ("<article>{}</article>", "<div>{}</div>", "<div class='content has-sidebar'>{}</div>", "<article class='post has-sidebar'>{}</article>"):
        assert starts(around.format(body) + thread + cards) == "abcd"
    assert starts(f"<h1>title</h1><div class='page menu-open'><div class=sidebar>z</div>{body}{thread}</div>") == "tabcd"
    assert starts("".join(f"<div class='row has-sidebar'>{part}</div>" for part in PARAGRAPHS)) == "abcd"
    assert starts(f"<article>{body}</article><div class=comments><p>z{'reply ' * 300}</p></div>") == "abcd"
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>tex</annotation></semantics></math>"
    assert html_text.main_text(f"<article><p>so {formula} holds</p></article>") == "so E=m holds"


def test_one_very_long_paragraph_drops_nothing_else():
    lines = ["t" * 40, "a" * 100, "b" * 100, "c" * 5000]
    assert html_text.main_text("".join(f"<p>{x}</p>" for x in lines)) == "\n".join(lines)
    gap = "<div class=ad>ad</div><aside>more</aside><div class=widget>w</div>"
    parts = ["c" * 5000, *(x * 300 for x in "def"), "g" * 100]
    page = f"<p>{parts[0]}</p>{gap}" + "".join(f"<p>{x}</p>" for x in parts[1:4]) + gap + f"<p>{parts[4]}</p>{gap}<p>junk</p>"
    assert html_text.main_text(page) == "\n".join(parts)


@given(st.text(alphabet="<>/\"'= apnvdi!-&;\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    assert isinstance(html_text.main_text(page), str)


@given(TEXTS, st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_shingle_sets(text, size):
    assert len(near_dedup.Shingler(size).shingles(text.encode())) == len(brute.shingles(text, size))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    error = []
    for _ in range(60):
        a = r.integers(0, 2**63, 900, dtype=np.uint64)
        b = np.concatenate([a[:800], r.integers(0, 2**63, 100, dtype=np.uint64)])
        x, y = (np.frombuffer(near_dedup.signature(np.unique(v)), "<u2") for v in (a, b))
        error.append((x == y).mean() - 0.8)
    assert abs(np.mean(error)) < 0.02 and np.max(np.abs(error)) < 0.2
    assert near_dedup.trees_for(0.9999, 80) == 4


def test_targets_find_exactly_the_similar_sets():
    r = np.random.default_rng(9)
    base = r.integers(0, 2**64, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(120) < keep], r.integers(0, 2**64, int(r.integers(0, 20)), dtype=np.uint64)])) for keep in r.uniform(0.75, 1, 60)]
    targets = near_dedup._Targets(list(range(60)), list(range(60)), sets)
    for i, x in enumerate(sets):
        alike = [j for j, y in enumerate(sets) if j != i and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))]
        assert sorted(targets.links(i, x, 80)) == alike
    grouped = near_dedup._Targets(list(range(60)), [i % 3 for i in range(60)], sets)
    assert {t % 3 for t in grouped.links(0, sets[0], 10)} == {1, 2}


def test_discriminant_is_the_ratio_of_two_normal_densities():
    r = np.random.default_rng(2)
    x = [r.normal(0, 1, (500, 3)), r.normal(1, [1, 2, 3], (900, 3))]
    model = discriminant(np.array([500.0, 900.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    point = np.array([[0.3, -1.0, 2.0]])
    density = []
    for c, v in enumerate(x):
        lower = np.linalg.inv(model.inverses[c])
        covariance = lower @ lower.T
        d = point[0] - v.mean(0)
        density.append(np.log(len(v) / 1400) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * d @ np.linalg.solve(covariance, d))
    assert model.scores(point)[0] == pytest.approx(1 / (1 + np.exp(density[0] - density[1])))
    assert discriminant(np.array([0.0, 5.0]), x[0][:2], np.zeros((2, 3, 3))).scores(point) == [1.0]
    assert discriminant(np.zeros(2), x[0][:2], np.zeros((2, 3, 3))).scores(point) == [0.5]
    assert len(document_vector(b"")) == len(document_vector("a é #".encode())) == len(FEATURES)


def test_checksum_of_ids():
    assert zlib.crc32(np.array([2], dtype="<u4").tobytes()) == zlib.crc32(b"\2\0\0\0")


def test_raw_elements_that_are_never_closed_take_linear_time():
    import time

    from sluicebox.llm import html_text

    body = f"<p>{'plain words of an article ' * 20}</p>"
    for raw in ("<script>", "<svg>", "<StYle media=x>"):
        begin = time.perf_counter()
        text = html_text.main_text(body + raw * (1_000_000 // len(raw)))
        assert time.perf_counter() - begin < 20 and text.startswith("plain words")
    mixed = f"<script>a</script x>b</ScRiPt >{body}<style>c<p>d</style><svg><title>e</title></svg>"
    assert html_text.main_text(mixed) == " ".join(["plain words of an article"] * 20)


def test_line_blocks_decide_on_uncertain_class_names():
    from sluicebox.llm.html_text import main_text

    prose = "Earlier work on this question looked at far smaller tables, and found that most of them were sorted before they were ever read."
    links = "".join(f"<li><a href='/{i}'>An earlier story of much the same kind, number {i}</a></li>" for i in range(9))
    for name in ("related-work", "search-history", "social_policy", "menu-engineering", "share-prices"):
        page = f"<article><p>{prose}</p><section class='x {name}'><h2>More</h2><p>{prose}</p></section><p>The end.</p></article>"
        assert main_text(page) == "\n".join([prose, "More", prose, "The end."]), name
        page = page.replace(f"<h2>More</h2><p>{prose}</p>", f"<h2>More</h2><ul>{links}</ul>")
        assert main_text(page) == f"{prose}\nThe end.", name
    # Names of layout, and of comments, adverts and notices, are no matter of length.
    for name in ("related", "related-posts", "search-box", "comment-history", "ad-history", "cookie-policy", "social share-buttons"):
        page = f"<article><p>{prose}</p><div class='{name}'><p>{prose} Again.</p></div><p>The end.</p></article>"
        assert main_text(page) == f"{prose}\nThe end.", name
    # An uncertain block in and around others, never closed, and empty.
    page = f"<article><p>{prose}</p><div class='related-work'><div class='ad'>{prose}</div><div class='share-prices'><p>{prose}</p></div></div></article>"
    assert main_text(page) == f"{prose}\n{prose}"
    assert main_text(f"<p>{prose}</p><div class='related-work'><p>a</p>") == f"{prose}\na"
    assert main_text(f"<article><p>{prose}</p><div class='related-work'></div><p>b</p></article>") == f"{prose}\nb"
    assert main_text(f"<p>{prose}</p><div class='related-work'><article><p>{prose}</p></article></div><p>b</p>").count(prose) >= 1
    assert main_text(f"<p>{prose}</p><div class='related-work'><p>short</p><aside>x</div><p>y</aside><p>b</p>") == f"{prose}\nb"
    assert main_text(f"<p>{prose}</p><div class='related-work'><p>short</p><aside>x</div><p>y</aside>b") == f"{prose}\nb"
