"""N-gram join, divergence audit and collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docsift.llm import collocations, divergence, ngram_join

from .test_operators import ROWS, SCHEMA, docs, empty, rows  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copies(seed=5):
    """(doc_id, text, lang, source): texts with edits at random places, copies, and one passage that most hold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    out = []
    for family in range(12):
        base = rng.choices(words, k=rng.choice([6, 30, 120, 300]))
        for _ in range(rng.choice([1, 4, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text) + (f"\n{passage}" if rng.random() < 0.5 else ""))
    out += out[:20] + [t.upper().replace(" ", "  ") for t in out[20:30]]
    return [(i, t, f"l{i % 2}", f"s{i % 3}") for i, t in enumerate(out)]


# --- n-gram join -----------------------------------------------------------


def plain_join(table, k, percent):
    """(doc_id, size, links, component) by comparing all pairs."""
    sets = []
    for _, text in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([" ".join(w)] if w else []))
    distinct = sorted(set(sets), key=sorted)
    links = defaultdict(set)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[a].add(b)
                links[b].add(a)
    out = []
    for (doc_id, _), s in zip(table, sets):
        reached, todo = {s}, [s]
        while todo:
            for other in links[todo.pop()] - reached:
                reached.add(other)
                todo.append(other)
        ids = [i for (i, _), x in zip(table, sets) if x in reached and i is not None]
        out.append((doc_id, len(s), len(links[s]), (min(ids) if ids else None) if s else doc_id))
    return sorted(out, key=repr)


def joined(df, **how):
    return rows(ngram_join.join_documents(df, **how).select("doc_id", "n_shingles", "n_links", "component_id"))


@pytest.mark.parametrize("percent", [30, 80, 100])
def test_tree_links_are_those_of_all_pairs(percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "TABLE_CELLS", 500)
    rng = np.random.default_rng(percent)
    pool = rng.integers(-(1 << 62), 1 << 62, 60)
    known = {frozenset(rng.choice(pool[: rng.integers(3, 60)], rng.integers(1, 30)).tolist()) for _ in range(60)}
    sets = sorted((sorted(s) for s in known), key=repr)
    extra = rng.integers(0, 3, len(sets))  # n-grams that no other set has
    sizes = np.array([len(s) for s in sets]) + extra
    count = Counter(g for s in sets for g in s)
    ordered = [np.array(sorted(s, key=lambda g: (count[g], np.uint64(g % (1 << 64)))), np.int64) for s in sets]
    often = [np.array([count[g] for g in s]) for s in ordered]

    def expected(i, j):
        both = len(set(sets[i]) & set(sets[j]))
        return 100 * both >= percent * (sizes[i] + sizes[j] - both)

    n = len(sets)
    i, j = ngram_join.tree_links(ordered, often, sizes, None, percent)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(n) for b in range(n) if a != b and expected(a, b)]
    sides = np.arange(n) % 2
    i, j = ngram_join.tree_links(ordered, often, sizes, sides, percent)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(0, n, 2) for b in range(1, n, 2) if expected(a, b)]


def test_packed_numbers_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (ngram_join._rising(ngram_join._gaps(x)) == x).all()
    assert (ngram_join._unpack(ngram_join._pack(x), np.uint64) == x).all()


@pytest.mark.parametrize("how", [{}, {"flush_grams": 300, "max_grams": 700}, {"words": 2, "percent": 50, "flush_grams": 2000}])
def test_join_against_all_pairs(spark, how):
    table = [r[:2] for r in near_copies()]
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    expected = plain_join(table, how.get("words", 5), how.get("percent", 80))
    assert sum(links for *_, links, _ in expected) > 100
    assert joined(df, **how) == expected


def test_join_of_awkward_rows(docs, empty):  # noqa: F811
    assert joined(docs) == plain_join([r[:2] for r in ROWS], 5, 80)
    assert joined(empty) == []


def test_gram_sets_of_texts_in_pieces(monkeypatch):
    from docsift.llm import simhash

    text = " ".join(str(i % 50) for i in range(3000)) + "\n\tend"
    whole = ngram_join.gram_set(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert (ngram_join.gram_set(text) == whole).all() and len(whole) == 51


# --- divergence ------------------------------------------------------------


def plain_audit(table, min_docs=3, top=200):
    counts, docs_of = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for text, lang, source in table:
        w = [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or ""][source or ""].update(w)
        docs_of[lang or ""].update(set(w))
    out = []
    for lang, by in counts.items():
        kept = [t for t, n in docs_of[lang].items() if n >= min_docs]
        p = {}
        for s, c in [*by.items(), (None, sum(by.values(), Counter()))]:
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in by.items():
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in by if o != s)
            terms = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if c[t] and p[s][t] > p[None][t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"block_entries": 200, "tile": 2, "top_terms": 5}])
def test_audit_against_plain_python(spark, how):
    table = [r[1:] for r in near_copies()] + [(None, "l0", "s0"), ("", "l1", "none"), ("é é É", None, None), ("é é", None, "x"), ("é", None, "y")]
    df = spark.createDataFrame(table, "text string, lang string, source string").repartition(4)
    expected = plain_audit(table, top=how.get("top_terms", 200))
    assert rows(divergence.audit(df, **how)) == expected
    assert any(r[:4] == ("", "", "pair", "x") for r in expected)


def test_audit_of_awkward_rows(docs, empty):  # noqa: F811
    lang = {"lang_col": "shard"}
    assert rows(divergence.audit(docs, **lang)) == plain_audit([(t, "h", s) for _, t, s in ROWS])
    assert rows(divergence.audit(empty, **lang)) == []


def test_long_division_is_exact():
    for x, y in [(1, 3), (10**13, 10**14 - 1), (8 * 10**15, 9 * 10**15 - 1), (7, 7), (0, 5)]:
        assert divergence.scaled(np.array([x]), y)[0] == 10**9 * x // y


def test_terms_of_texts_in_pieces(monkeypatch):
    text = "Ab1cd é—x " * 500
    whole = [t for part in divergence.term_lists(text) for t in part]
    monkeypatch.setattr(divergence, "PIECE", 50)
    parts = list(divergence.term_lists(text))
    assert len(parts) > 10 and [t for part in parts for t in part] == whole
    assert whole[:3] == [b"ab", b"cd", "é—x".encode()]


# --- collocations ----------------------------------------------------------


def plain_collocations(table, longest=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in table:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(zip(*[w[i:] for i in range(k)]))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= percent * a for b in longer):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def phrases(seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "x;y", "a\tb", "é", "!", "z\n", "the.", "\xa0"]
    return [(" ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", None])) for _ in range(80)]


@pytest.mark.parametrize("how", [{}, {"longest": 2, "min_count": 3}, {"longest": 4, "min_count": 2, "subsumed_percent": 30, "top": 7}])
def test_collocations_against_plain_python(spark, how):
    table = phrases()
    df = spark.createDataFrame(table, "text string, lang string").repartition(3)
    names = {"longest": "longest", "min_count": "least", "subsumed_percent": "percent", "top": "top"}
    expected = plain_collocations(table, **{names[k]: v for k, v in how.items()})
    assert len(expected) > 10
    assert rows(collocations.collocations(df, **how)) == expected


def test_words_whose_hashes_meet_are_counted_apart(spark):
    df = spark.createDataFrame(phrases(), "text string, lang string")
    weak = lambda w, seed: len(w) if seed == 0 else collocations.word_hash(w, seed)
    assert rows(collocations.collocations(df, hash_word=weak)) == plain_collocations(phrases())


def test_collocations_of_awkward_rows(docs, empty):  # noqa: F811
    lang = {"lang_col": "shard", "min_count": 2}
    assert rows(collocations.collocations(docs, **lang)) == plain_collocations([(t, "h") for _, t, _ in ROWS], least=2)
    assert rows(collocations.collocations(empty, **lang)) == []


def test_windows_of_many_words_and_long_texts(monkeypatch):
    text = "a b c. " * 400
    whole = [w for part in collocations.word_runs(text) for w in part]
    monkeypatch.setattr(collocations, "PIECE", 33)
    assert [w for part in collocations.word_runs(text) for w in part] == whole
    block = collocations._Block()
    block.add(whole)
    columns, n = block.windows(3)
    assert sorted(zip(*(c.tolist() for c in columns), n.tolist())) == [(1, 2, 3, 400), (2, 3, 0, 400), (3, 0, 0, 400)]
