"""The Spark-free parts of the corpus operators against brute force."""

import random

import numpy as np
import pytest
import xxhash

from docsift.llm import decontaminate, sharding, simhash, toxicity, warc


def test_differencing_keeps_every_size_and_balances():
    rnd = random.Random(1)
    for k in (1, 2, 3, 24):
        sizes = [rnd.randint(1, 1000) for _ in range(700)]
        parts = sharding.difference(sizes, k)
        sums = [sum(s for s, p in zip(sizes, parts) if p == j) for j in range(k)]
        assert len(parts) == 700 and sum(sums) == sum(sizes)
        assert max(sums) - min(sums) <= 5
    assert sharding.difference([], 24) == []
    parts = sharding.difference([8, 7, 6, 5, 4], 2)  # the textbook case: 8 6 and 7 5 4
    assert parts[0] == parts[2] != parts[1] == parts[3] == parts[4]
    big = sharding.difference([10_000] + [1] * 230, 24)
    assert [p for p in big[1:]].count(big[0]) == 0


def _slow_fingerprint(text, k=4):
    words = [w for w in text.translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", ["", " \n\t", "One", "a b c", "É b c D e\x0bF g A b", "x " * 40 + "y", "the cat SAT on the mat by the door " * 7])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text) == _slow_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 10)
    assert simhash.fingerprint(text) == _slow_fingerprint(text)


def _families(n=40, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.integers(0, 2**63, n, dtype=np.uint64).tolist():
        for _ in range(15):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


def test_bit_sliced_distances():
    fps = _families()
    sliced = simhash.planes(fps)
    for radius in (0, 3, 4, 11, 30):
        for x in fps[::97].tolist():
            assert (simhash.within(sliced, x, len(fps), radius) == (np.bitwise_count(fps ^ np.uint64(x)) <= radius)).all()
    other = fps[::-1].copy()
    assert (simhash.within(sliced, simhash.planes(other), len(fps), 4) == (np.bitwise_count(fps ^ other) <= 4)).all()


def test_groups_are_linked_alike_by_lag_and_by_search(monkeypatch):
    fps = _families()
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    wanted = fps[simhash._smallest(len(fps), i, j)]
    assert (fps[simhash._by_search(fps, 4)] == wanted).all()
    monkeypatch.setattr(simhash, "LAG_GROUP", 10**6)
    a, b = simhash.link_groups(fps, np.zeros(len(fps), dtype=int), 4)
    found = dict(zip(a.tolist(), b.tolist()))
    assert [found.get(x, x) for x in fps.tolist()] == wanted.tolist()


def test_word_hashes_do_not_depend_on_the_neighbours(monkeypatch):
    texts = [b"The cat-sat, on", b"", "É1 the CAT".encode(), b"x" * 50]
    whole = decontaminate.word_hashes(texts)
    assert [len(h) for h in whole] == [4, 0, 3, 1]
    assert whole[0][0] == whole[2][1] and whole[0][1] == whole[2][2]
    for t, h in zip(texts, whole):
        assert (decontaminate.word_hashes([t])[0] == h).all()


def test_benchmark_index_finds_passages_wherever_they_begin():
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    items = [(k, words(n)) for k, n in enumerate([5, 6, 7, 9, 13, 14, 15, 16, 17, 31, 32, 40, 59, 64, 100, 300])]
    index = decontaminate.Index(items, decontaminate.RADIUS, decontaminate.SIMILARITY)
    texts, wanted = [], []
    for k, text in items:
        for before in range(0, 9):
            texts.append(words(before) + " " + text.upper().replace(" ", ", ") + " " + words(rnd.randint(0, 9)))
            wanted.append((k, before))
    found = index.hits(texts)
    assert [[(h["item_id"], h["start"], h["similarity"]) for h in f] for f in found] == [[(k, b, 1.0)] for k, b in wanted]
    assert index.hits([words(500), "", "a b c"]) == [[], [], []]
    long = words(70_000) + " " + items[12][1] + " " + words(10)
    assert [(h["item_id"], h["start"]) for h in index.hits([long])[0]] == [(12, 70_000)]
    cut = " ".join(items[14][1].split()[5:])  # 91 of 96 shingles
    assert index.hits([words(3) + " " + cut + " " + words(50)])[0][0]["similarity"] >= 0.8
    assert index.hits([" ".join(items[14][1].split()[:70]) + " " + words(60)]) == [[]]
    assert decontaminate.Index([(1, "two words")], 7, 0.8).hits(["two words"]) == [[]]


def _edited(words, kind, new, rnd):
    """A copy with a run, an edge or scattered words replaced, or words put in or left out."""
    n, out = len(words), list(words)
    if kind == "run":
        size = rnd.randint(1, max(1, (n - 40) // 9 + 1))
        at = rnd.randrange(n - size + 1)
        out[at : at + size] = [new() for _ in range(size)]
    elif kind == "edge":
        size = rnd.randint(1, max(1, n // 9))
        out[:size] = [new() for _ in range(size)]
        out = out if rnd.random() < 0.5 else [*words[size:], *out[:size]]
    else:
        for _ in range(rnd.randint(1, max(1, n // 36))):
            at = rnd.randrange(len(out))
            out[at : at + (kind != "in")] = [] if kind == "out" else [new()]
    return out


def test_benchmark_index_finds_every_passage_from_the_threshold_on():
    rnd = random.Random(8)
    new = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    found, wanted = 0, 0
    for n in (6, 15, 19, 23, 32, 40, 49, 60, 80, 100, 150, 300):
        words = [new() for _ in range(n)]
        index = decontaminate.Index([(1, " ".join(words))], decontaminate.RADIUS, decontaminate.SIMILARITY)
        texts = [
            [new() for _ in range(rnd.randint(0, 99))] + _edited(words, kind, new, rnd) + [new() for _ in range(rnd.randint(0, 99))]
            for kind in ("run", "edge", "scattered", "in", "out") for _ in range(40)
        ]
        texts += [[new() for _ in range(k)] + words[: n - round((n - 4) * 0.2 * rnd.random())] for k in range(30)]  # the document ends
        texts = [" ".join(t) for t in texts]
        item = index.items[0][2]
        for text, hits in zip(texts, index.hits(texts)):
            own = decontaminate.shingles(decontaminate.word_hashes([text.encode()])[0])
            best = max(decontaminate.weighted_jaccard(own[at : at + len(item)], item) for at in range(len(own)))
            wanted += best >= decontaminate.SIMILARITY
            found += best >= decontaminate.SIMILARITY and len(hits) == 1
            assert best >= decontaminate.SIMILARITY or not hits
    assert wanted > 1000 and found == wanted, (found, wanted)


def test_weighted_jaccard_counts_repeats():
    a, b = np.array([1, 1, 2], dtype=np.uint64), np.array([1, 2, 2, 3], dtype=np.uint64)
    assert decontaminate.weighted_jaccard(a, b) == 2 / 5


def test_features_of_long_texts_in_pieces(monkeypatch):
    text = "Idiots and clowns, all of them. " * 20
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert (toxicity.features(text) == whole).all()
    assert len(toxicity.features("")) == 0 and len(toxicity.features("ab")) == 0


def test_windows_of_texts_in_pieces(monkeypatch):
    rnd = random.Random(2)
    weight = np.array([rnd.choice([0, 0, 1, -1]) for _ in range(1 << toxicity.BITS)], dtype=float)
    monkeypatch.setattr(toxicity, "WINDOW", 20)
    for n in (0, 2, 9, 10, 11, 40, 41, 333):
        text = "".join(rnd.choice("ab cD") for _ in range(n))
        whole = weight[toxicity.features(text)].sum()
        exact = [{int(b[i]) for b in toxicity._buckets(np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)) for i in range(at, min(at + 20, len(b)))} for at in range(0, max(1, n - 10), 10)]
        best = max(weight[sorted(e)].sum() if e else 0.0 for e in exact)
        for piece in (1 << 20, 40):
            monkeypatch.setattr(toxicity, "PIECE", piece)
            assert toxicity.logits(text, weight, 0.5) == (whole + 0.5, best + 0.5)


def test_records_are_split_whatever_the_chunks():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bodies = [b"", b"WARC/1.1\r\n\r\n", b"x" * 50]
    data = b"".join(record % (len(b), b) for b in bodies)
    for size in (1, 7, 1000):
        chunks = (data[i : i + size] for i in range(0, len(data), size))
        assert [r for _, r in warc.split_records(chunks)] == [record % (len(b), b) for b in bodies]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.split_records(iter([data[:-3]])))
