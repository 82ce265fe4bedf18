"""Pure-Python parts against plain versions of the same."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import align, classifier, decontam, neardup, quality_rules, tokens, url_rules
from folioflow.llm.common import plain_words


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30), st.integers(0, 25))
def test_banded_distance(a, b, limit):
    d = plain_distance(a, b)
    assert align.banded_distance(a, b, limit) == (d if d <= limit else None)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=60))
def test_repeated_words(text):
    words = text.split()
    hits = set()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hits |= {i, i + 1, i + 2}
    assert quality_rules.repeated_words(words) == len(hits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab*?", max_size=6), min_size=1, max_size=30), st.lists(st.text(alphabet="abc", max_size=8), max_size=8))
def test_glob_automaton(globs, texts):
    import re

    machine = url_rules.GlobAutomaton.build(globs)
    got = machine.matches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
            assert got[i, k] == bool(re.fullmatch(pattern, t, re.S))


def test_order_sketch_is_the_smallest_kmers_in_text_order():
    p = neardup.NearDupParams(sketches=5, dense=5)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    h = neardup.kmer_hashes(words, p.k)
    assert len(set(h.tolist())) == len(h) == 196
    keys = neardup.order_sketches(h, p)
    shuffled = neardup.order_sketches(h[::-1].copy(), p)
    assert (keys != shuffled).all()  # the order of the k-mers counts
    cells = neardup._CELLS
    try:
        neardup._CELLS = 64  # long texts are sketched in parts
        assert (neardup.order_sketches(h, p) == keys).all()
    finally:
        neardup._CELLS = cells


@pytest.mark.parametrize("size", [31, 45, 60, 75, 76, 100, 280])
def test_sketch_recall_by_length(size):
    """Texts edited at random up to the limit of the similarity share a sketch in 0.9 of all cases and more."""
    p, rng = neardup.NearDupParams(), random.Random(size)
    limit = align.edit_limit(size, p.similarity)
    for rate in (0.05, 0.1, 0.15, 0.2):
        met = held = 0
        for _ in range(150):
            a = [rng.getrandbits(62) for _ in range(size)]
            b = list(a)
            for _ in range(max(1, min(round(rate * size), limit))):
                at, kind = rng.randrange(len(b)), rng.randrange(3)
                b[at : at + (kind != 2)] = [] if kind == 1 else [rng.getrandbits(62)]
            if align.banded_distance(a, b, align.edit_limit(max(len(a), len(b)), p.similarity)) is None:
                continue
            x, y = (neardup.order_sketches(neardup.kmer_hashes(np.array(t, np.uint64), p.k), p, p.sketches_of(len(t))) for t in (a, b))
            n = min(len(x), len(y))
            held += 1
            met += bool((x[:n] == y[:n]).any())
        assert held > 100 and met >= 0.9 * held, (rate, met, held)


def test_repeated_kmers_get_occurrence_numbers():
    words = np.array([1, 2] * 20, np.uint64)
    h = neardup.kmer_hashes(words, 2)
    assert len(set(h.tolist())) == len(h)


TEXTS = ["", " ", "\n\n  x", "It's  a test\twith   spaces \n", "naïve café — “quotes” … 100%", "日本語 text", "a" * 5000, "emoji 😀 here", "end <|endoftext|> more", "x y", "\x1cfile\x85", "don't can't WE'LL 's", "1234 5678abc", "___ -- *** ###", "\n", "a\n\nb", "a\n\n\nb", "a\n b", "a \nb", "\na", "3.14, ok... (a) --", None, "tab\there"]


def encoded(texts):
    ids, ends = tokens.piece_table(tokens.tokenizer_path()).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def library(text):
    return tokens.splitter(tokens.tokenizer_path()).whole(text or "")


def test_token_table_equals_the_library():
    """One batch of all kinds of texts, in any order, and each alone."""
    assert encoded(TEXTS) == [library(t) for t in TEXTS]
    assert encoded(TEXTS[::-1]) == [library(t) for t in TEXTS[::-1]]
    assert all(encoded([t]) == [library(t)] for t in TEXTS) and encoded([]) == []


def test_words_with_marks_after_them_are_cut_as_the_library_cuts_them():
    words = ["ab", "Ä", "1", "a1", "a'b", "ª", ""]
    texts = [f"x{gap}{w}{marks} y{gap}{w}{marks}" for gap in (" ", "\n", "\n\n") for w in words for marks in ["", "_", "'", "''", "'s", "...", "$$$", '.")', "-a", "_!", "***1", "." * 80]]
    assert encoded(texts) == [library(t) for t in texts]


def test_commas_and_full_stops_are_cut_as_the_library_cuts_them():
    words = ["ab", "Ä", "1", "a's", "_", ")", "(a", "", ",", "\n", "½", "\x01", "ª"]
    texts = [f"{before}{w}{mark}{after}" for before in ("", "x ", "x\n") for w in words for mark in (",", ".", ".,", ",\x01") for after in (" y", "\ny", ", y", "y", "", " ", "\n", " , y.")]
    assert encoded(texts) == [library(t) for t in texts]
    assert all(encoded([t]) == [library(t)] for t in texts[::7])


def test_unknown_words_are_encoded_together(monkeypatch):
    """As the model encodes each; no word's ids depend on the words beside it, in the same call or not."""
    rng = random.Random(3)
    words = list(dict.fromkeys(rng.choice(["", " "]) + "".join(rng.choice("abcdeÄßñłé") for _ in range(rng.choice([1, 4, 9, 70]))) for _ in range(700)))
    own = tokens.Splitter(tokens.tokenizer_path())
    want = [np.array([t.id for t in own.tokens(w)], "<u4").tobytes() for w in words]
    calls = []
    tokenize = own.model.tokenize
    own.model = type("Counted", (), {"tokenize": lambda self, text: calls.append(text) or tokenize(text), "__getattr__": lambda self, name: getattr(own.tok.model, name)})()
    assert own.words(words) == want and own.words([]) == [] and len(calls) == -(-len(words) // tokens.TOGETHER)
    own.between = None
    assert own.words(words) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab'1 \n.,-\tÄ", max_size=40)), max_size=6))
def test_token_table_on_any_texts(texts):
    assert encoded(texts) == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab'1 \n.,-\tÄ", max_size=40)))
def test_pretokens_have_the_sizes_of_the_library(text):
    own = tokens.splitter(tokens.tokenizer_path())
    for t, pieces in own.cut(pa.array([text])):
        if pieces is not None:
            assert "".join(pieces) == t == text and sum(len(own.tokens(p)) for p in pieces) == len(library(text))


def test_token_table_keeps_its_bound(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 10_000)
    table = tokens.PieceTable(tokens.tokenizer_path())
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 80]))) for _ in range(30))
        assert table.encode(pa.array([text]))[0].tolist() == library(text)
        assert len(table) <= 70 and len(table.older) <= 70


def _edit(words, edits, rng, pool):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(pool)
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.choice(pool))
    return out


@pytest.mark.parametrize("size", [8, 12, 20, 40, 59, 100, 200])
def test_decontamination_recall_by_length(size):
    """Of passages edited as often as the limit allows, 0.9 and more are found at every rate; distances are right."""
    rng = random.Random(size)
    pool = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(size))) for i in range(60)]
    p = decontam.DecontamParams()
    index = decontam.ItemIndex(items, p)
    limit = align.edit_limit(size, p.similarity)
    for rate in (0.05, 0.1, 0.15, 0.2):
        found = wanted = 0
        texts = [[rng.choice(pool) for _ in range(30)] + _edit(t.split(), max(1, round(rate * size)), rng, pool) + [rng.choice(pool) for _ in range(30)] for _, t in items]
        for (i, text), words, hits in zip(items, texts, index.search([" ".join(t) for t in texts])):
            target = text.split()
            for item, (d, start, n, full) in hits.items():
                assert (n, full) == (size, size) and align.banded_distance(words[start : start + n], items[item][1].split(), limit) == d
            if any(align.banded_distance(words[s : s + size], target, limit) is not None for s in range(28, 33)):
                wanted += 1
                found += i in hits
        assert wanted >= 5 and found >= 0.9 * wanted, (size, rate, found, wanted)


def test_short_items_are_found_exactly():
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(40)]
    p = decontam.DecontamParams()
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 7)))) for i in range(50)]
    texts = [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(60)] + ["", None]
    got = decontam.ItemIndex(items, p).search(texts)
    for text, hits in zip(texts, got):
        words = (text or "").split()
        for i, target in items:
            target = target.split()
            n, limit = len(target), align.edit_limit(len(target), p.similarity)
            found = [d for s in range(len(words)) if (d := align.banded_distance(words[s : s + n], target, limit)) is not None]
            assert (hits[i][0] if i in hits else None) == min(found, default=None)


def test_long_items_are_searched_in_bounded_pieces():
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(5000)]
    long = [rng.choice(pool) for _ in range(20_000)]
    index = decontam.ItemIndex([(1, " ".join(long)), (2, " ".join(long[:30]))], decontam.DecontamParams())
    hits = index.search([" ".join(["x"] + [w if rng.random() > 0.03 else "y" for w in long] + ["z"]), " ".join(long[:40])])
    assert 1 in hits[0] and 2 in hits[1] and 1 not in hits[1] and index.rows < 100


def test_windows_that_lack_words_of_an_item_are_not_aligned(monkeypatch):
    item = [f"w{i}" for i in range(40)]
    aligned = []
    monkeypatch.setattr(decontam, "banded_distance", lambda a, b, limit, f=decontam.banded_distance: aligned.append(len(a)) or f(a, b, limit))
    index = decontam.ItemIndex([(1, " ".join(item))], decontam.DecontamParams())
    assert index.search([" ".join(item[:25] * 8), "x " * 9 + " ".join([*item[:39], "y"])]) == [{}, {1: (1, 9, 40, 40)}]
    # Only windows of the second text, and at most twice the edit limit of them.
    assert 1 <= len(aligned) <= 17


def test_exact_passages_are_always_found():
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(8, 60)))) for i in range(40)]
    index = decontam.ItemIndex(items, decontam.DecontamParams())
    texts = [f"{' '.join(rng.choice(pool) for _ in range(k))} {t.upper()}!" for k, (_, t) in enumerate(items)]
    got = index.search(texts)
    assert [got[i][i][:2] for i in range(40)] == [(0, i) for i in range(40)]
    assert index.search([" ".join(rng.choice(pool) for _ in range(3000))]) == [{}]


def test_classifier_learns_and_ignores_empty_texts():
    good = ["the calm river went on and on through the old green valley today"] * 20
    bad = ["BUY!! NOW!! CHEAP!! PILLS!! HERE!!"] * 20
    p = classifier.FtrlParams(bits=12)
    rows = [(*classifier.features(t, p.bits), y) for pair in zip(good, bad) for t, y in zip(pair, (1, 0))]
    w = classifier.train_ftrl(rows, p)
    assert classifier.score("a calm green valley and an old river", w, 12) > 0.7 > 0.5 > classifier.score("WIN!! MONEY!!", w, 12)
    assert 0 < classifier.score(None, w, 12) == classifier.score("", w, 12) < 1


def test_ftrl_equals_a_plain_version():
    """Per-coordinate updates written out one by one, over dictionaries."""
    import math

    rng = random.Random(3)
    p = classifier.FtrlParams(bits=8, epochs=2)
    rows = [(*classifier.features(" ".join(rng.choice(["a", "b", "C", "d!", "EE", "f"]) for _ in range(rng.randint(0, 12))), p.bits), rng.randrange(2)) for _ in range(40)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for slots, values, label in rows:
            w = [weight(i) for i in slots.tolist()]
            guess = 1 / (1 + math.exp(-sum(a * float(v) for a, v in zip(w, values))))
            for i, v, a in zip(slots.tolist(), values.tolist(), w):
                g = (guess - label) * v
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i], n[i] = z.get(i, 0.0) + g - step * a, n.get(i, 0.0) + g * g
    got = classifier.train_ftrl(rows, p)
    assert np.count_nonzero(got) > 5
    assert all(abs(got[i] - weight(i)) < 1e-4 for i in range(len(got)))


def test_plain_words():
    assert plain_words("A b, C-d!") == ["a", "b", "c", "d"]
    assert plain_words("!!! ???") == ["!!!", "???"]
    assert plain_words("  ") == []


def test_line_rules():
    r = quality_rules.judge("Good line of text here.\n" + "menu | home | about | contact | more |\n" + "A B C!! D!! E!! F!! G!!\nAccept our cookie policy.\n")
    assert r["n_failed_lines"] == 3 and r["base_failed"]
    assert quality_rules.clean_text("ok.\nhome | a | b | c\n") == "ok.\n"
    assert quality_rules.judge(None) == quality_rules.judge("") and not quality_rules.judge("")["kept"]


def test_blocks_meet_by_rare_words_alike(monkeypatch):
    """Texts around one passage: the links are those of counting all shared words, without counting them."""
    rng = random.Random(12)
    words = [np.array([*range(60), *rng.sample(range(1000, 90_000), 60)]) for _ in range(150)]
    for k in range(60):
        near = words[k].copy()
        near[rng.sample(range(120), rng.choice([3, 20, 24]))] = [rng.randrange(100_000, 200_000) for _ in range(1)][0]
        words.append(near[: rng.choice([100, 118, 120])])
    order = rng.sample(range(len(words)), len(words))
    words = [words[k].astype(np.int64) for k in order]
    for split in (0, 90):
        args = (list(range(len(words))), list(range(len(words))), words, split, 0.8)
        monkeypatch.setattr(neardup, "_DENSE", 1 << 40)
        dense = neardup.block_links(*args)
        monkeypatch.setattr(neardup, "_DENSE", 12)
        with monkeypatch.context() as m:
            m.setattr(neardup, "shared_words", None)
            assert neardup.block_links(*args) == dense and len(dense) >= 10
