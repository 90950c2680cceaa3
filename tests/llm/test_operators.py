"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, extra columns; and empty tables."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chroma, fingerprints, language_id, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup, url_filter
from pagewright.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, size string, h string, part int"


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def edited(text, seed):
    words = text.split()
    words[random.Random(seed).randrange(len(words))] = "changed"
    return " ".join(words)


def nasty():
    a, b, long_ = prose(1, 120), prose(2, 80), prose(3, 6000)
    passage = prose(9, 90)
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, edited(a, 1), "en", "s2"), (3, edited(a, 1), "en", "s2"), (4, b, "de", None), (5, None, "de", "s2"),
        (6, "", None, "s2"), (None, prose(4, 30), "en", "s1"), (None, None, None, None), (7, long_, "de", "s3"), (8, "word", "en", "s3"), (9, "12 34", "en", "s1"),
        (10, prose(5, 60) + " " + passage + " " + prose(6, 60), "en", "s2"), (11, prose(7, 50) + " " + passage + " " + prose(8, 40), "en", "s2"), (12, "é" * 300 + " ü" * 200, "de", "s1"),
    ]
    return [(i, t, la, s, len(t or ""), "k", "s", "z", "h", 1) for i, t, la, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_suffix_dedup_is_brute_force(docs, nothing):
    got = suffix_dedup.remove_repeats(docs, length=100, window=40).collect()
    data = [(i, (t or "").encode()) for i, t in texts(docs)]
    count = Counter(b[s : s + 100] for _, b in data for s in range(len(b) - 99))
    want = []
    for i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if count[b[s : s + 100]] > 1:
                gone[s : s + 100] = [True] * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall("1+", "".join("01"[g] for g in gone))), hashlib.sha256(kept).hexdigest()))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(want)
    assert {r["key"] for r in got} == {"k"}
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [3, 1000])
def test_suffix_dedup_of_a_hot_core_is_brute_force(spark, hot):
    rng = random.Random(13)
    line = "".join(rng.choice("abcd") for _ in range(75))  # over a core of 61 bytes, under the length of 100
    rows = [(i, "".join(rng.choice("abcd") for _ in range(60)) + line + "".join(rng.choice("abcd") for _ in range(60))) for i in range(40)]
    rows += [(100 + i, "other" + rows[i][1][20 + i : 150 + i] + "end") for i in range(6)] + [(200, rows[7][1]), (201, rows[8][1] + line), (202, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = Counter(t[s : s + 100] for _, t in rows for s in range(len(t) - 99))
    want = {}
    for i, t in rows:
        gone = [False] * len(t)
        for s in range(len(t) - 99):
            if count[t[s : s + 100]] > 1:
                gone[s : s + 100] = [True] * 100
        want[i] = "".join(x for x, g in zip(t, gone, strict=True) if not g)
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(d, length=100, window=40, hot=hot).collect()} == want


def test_suffix_dedup_looks_into_equal_texts_once(spark, monkeypatch):
    made, real = {}, suffix_dedup.materialize

    def written(df, name):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(suffix_dedup, "materialize", written)
    same, part = prose(21, 60), prose(22, 60)
    rows = [(i, same) for i in range(30)] + [(40, "begin " + same[10:200] + " end"), (41, part + " x " + same), (42, part), (43, "alone")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=100, window=40, hot=3).collect()
    assert [(r["_text"], r["_n"]) for r in made["equal-texts"].collect()] == [(same, 30)]
    count = Counter(t[s : s + 100] for _, t in rows for s in range(len(t) - 99))
    for i, t in rows:
        gone = {x for s in range(len(t) - 99) if count[t[s : s + 100]] > 1 for x in range(s, s + 100)}
        assert [bytes(r["kept"]).decode() for r in got if r["doc_id"] == i] == ["".join(c for x, c in enumerate(t) if x not in gone)]


def test_ngram_join_is_brute_force(docs, nothing):
    got = ngram_join.near_duplicates(docs).collect()
    sets = [(i, set(ngram_join.shingles(t).tolist())) for i, t in texts(docs)]
    links = [sum(k != j and len(a & b) >= 0.8 * len(a | b) for j, (_, b) in enumerate(sets)) for k, (_, a) in enumerate(sets)]
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == Counter((i, n) for (i, _), n in zip(sets, links, strict=True))
    by_id = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == 4 and by_id[5] == by_id[6] == 5
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9, 10, 11, 12]
    assert ngram_join.keep_one(nothing).count() == 0


def test_large_group_of_near_copies_loses_no_link(spark):
    base = prose(11, 200)
    rows = [(i, edited(base, i)) for i in range(150)] + [(1000 + i, prose(100 + i, 60)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(d, bucket=16, block=40, depth=2).collect()}
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in rows}
    for i, a in sets.items():
        assert got[i]["n_links"] == sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in sets.items())
    assert {got[i]["class_id"] for i in range(150)} == {0}


def test_substring_dedup_removes_later_passages_only(docs, nothing):
    got = {r["doc_id"]: r for r in substring_dedup.dedup_spans(docs).collect() if r["doc_id"]}
    source = dict(texts(docs))
    assert got[10]["text"] == source[10] and got[1]["text"] == source[1] and got[4]["text"] == source[4]
    assert 60 <= got[11]["words_removed"] <= 95 and got[11]["text"].startswith(source[11][:40])
    assert got[2]["words_removed"] == len(source[2].split()) and got[2]["text"] == ""
    assert got[5]["text"] is None and got[6]["text"] == ""
    out = substring_dedup.dedup_spans(nothing)
    assert out.count() == 0 and set(SCHEMA.replace(",", "").split()[::2]) <= set(out.columns)


def test_substring_dedup_is_brute_force_over_all_runs_of_sentences(spark):
    rng = random.Random(12)
    stock = ["Yes.", "No!", "So it is.", "One more of them.", "This one has seven words in it.", "A longer one, which has all of twelve words in it, is this."]
    rows = [(i, " ".join(rng.choice(stock) if rng.random() < 0.7 else f"Own{i}x{j} words{j}." for j in range(rng.randrange(1, 14)))) for i in range(40)]
    rows += [(100, "Head one. Short a. Short b. Tail one."), (101, "Head two. Short a. Short b. Tail two.")]
    found, want = {}, {}
    for i, t in rows:
        s = re.findall(r"[^.!]+[.!]", t)
        s = [x.strip() for x in s]
        gone = set()
        for a in range(len(s)):
            for b in range(a + 2, len(s) + 1):
                if found.setdefault(tuple(s[a:b]), (i, a)) != (i, a):
                    gone |= set(range(a, b))
        want[i] = (len(gone), " ".join(x for k, x in enumerate(s) if k not in gone))
    got = substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_removed"], " ".join(r["text"].split())) for r in got} == want
    assert want[101] == (2, "Head two. Tail two.")


def test_substring_dedup_covers_a_repeated_run_to_its_end(spark):
    long_ = " ".join(" ".join(f"w{j}{k}" for k in range(13)) + "." for j in range(3))  # each is one piece
    rows = [(1, f"First here. {long_} It ends. Here. Other text follows."), (2, f"Second there! {long_} It ends. Here. Not the same text.")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"].split() == "Second there! Not the same text.".split()


def test_mix_meets_targets(docs, nothing):
    got = mixing.mix_taken(docs, block_words=16, shards=4).collect()
    assert len(got) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t in texts(docs))
    by_source = {}
    for r in got:
        s = by_source.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["size"]
        s[3] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    total = sum(s[2] for s in by_source.values())
    # Shares by weight, limits, excess shared again: plain loop.
    names = sorted(x for x in by_source if x is not None) + [None]
    weight, target, left, open_ = {x: (1, 2, 3)[i % 3] for i, x in enumerate(names)}, {}, float(total), set(names)
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if weight[x] * level > 3 * by_source[x][2]}
        if not full:
            target |= {x: weight[x] * level for x in open_}
            break
        target |= {x: 3.0 * by_source[x][2] for x in full}
        left -= sum(target[x] for x in full)
        open_ -= full
    for x, (s, t, words, taken) in by_source.items():
        assert s == words and abs(t - target[x]) < 1e-6 and abs(taken - t) <= 1
    again = mixing.mix_taken(docs, block_words=16, shards=4).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix_taken(nothing).count() == 0
    assert mixing.mix_documents(nothing).count() == 0


def test_splitting_tree_keeps_quotas_and_balances_shards(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5)], "place int, quota long")
    rows = mixing.split_quotas(quotas, 8, 3).collect()
    by_place, by_shard = Counter(), Counter()
    for r in rows:
        assert r["quota"] >= 0
        by_place[r["place"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert dict(by_place) == {1: 1000, 2: 37, 3: 0, 4: 5}
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 8


def test_hypergeometric_draws_have_the_right_distribution(spark):
    from math import comb

    n, good, drawn, total = 4000, 6, 10, 20
    u = (F.col("id") + 0.5) / n
    got = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), u, F.lit(0.3))).collect())
    for x in range(7):
        assert abs(got[x] / n - comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn)) < 2e-3


def test_blocks_are_disjoint_and_passes_whole(spark):
    units = spark.createDataFrame([(i, "ab"[i > 3], 40 * (i + 1), i) for i in range(9)] + [(99, "c", 0, 99)], "unit long, source string, size long, mix long")
    rows = mixing.mix_units(units, weights=(5, 1, 1), block_words=16, shards=4).collect()
    assert len({(r["unit"], r["block"], r["pass"]) for r in rows}) == len(rows)
    assert all(0 <= r["shard"] < 4 and r["words"] > 0 for r in rows) and 99 not in {r["unit"] for r in rows}


def test_packing_places_every_token(docs, nothing):
    got = packing.pack(docs, buckets=3, batch_tokens=4096).collect()
    assert len(got) == docs.count()
    places = [(r["bucket"], r["batch"], r["slot"]) for r in got if r["n_tokens"]]
    assert len(set(places)) == len(places)
    for r in got:
        if r["n_tokens"]:
            assert r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
            assert (r["slot"] + 1) * r["bucket_length"] <= max(4096, r["bucket_length"])
        else:
            assert r["bucket"] is None and r["batch"] is None and r["slot"] is None and r["padding"] == 0
    assert packing.pack(nothing).count() == 0


def test_fingerprints_against_sets(spark, docs, nothing):
    import xxhash

    def hashes(t):
        w, out = re.findall(r"[^\x20\x09-\x0D]+", t), set()
        for i in range(max(1, len(w) - 4)):
            h = 42
            for x in w[i : i + 5]:
                h = xxhash.xxh64_intdigest(x.encode(), seed=h)
            out.add(h - (1 << 64) if h >> 63 else h)
        low = sorted(h for h in out if h < -(1 << 63) + (1 << 62))
        return low or [min(out)]

    order = sorted(((i, t or "") for i, t in texts(docs)), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).digest()))
    got = fingerprints.fingerprint_documents(docs).collect()
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        show = lambda h: "".join(f"{x % (1 << 64):016x}" for x in h)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), show(hashes(t)), show(hashes(e)), round(like(hashes(t), hashes(e)), 9), round(like(hashes(t), hashes(nxt)), 9)))
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in got) == Counter(want)
    few = fingerprints.with_next(docs, per_part=4)  # several ranges of ids give the same neighbours
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in few.collect()) == Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def test_narrow_and_wide_draws_have_the_right_distribution(spark):
    from math import exp, lgamma

    total, good, drawn, n = 400_000, 150_000, 100_000, 20_000
    u, v = (F.col("id") + 0.5) / n, mixing.uniform(F.lit(3), F.col("id"))
    got = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), u, v)).collect())
    f = lambda x: lgamma(x + 1)
    choose = lambda a, b: f(a) - f(b) - f(a - b)
    chance = lambda x: exp(choose(good, x) + choose(total - good, drawn - x) - choose(total, drawn))
    mean, spread = drawn * good / total, (drawn * good / total * (1 - good / total) * (total - drawn) / (total - 1)) ** 0.5
    assert spread > 64
    edges = [int(mean + spread * k / 4) for k in range(-10, 11)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        p = sum(chance(x) for x in range(lo, hi))
        assert abs(sum(got[x] for x in range(lo, hi)) - n * p) < 5 * (n * p) ** 0.5 + 1
    assert abs(sum(x * c for x, c in got.items()) / n - mean) < 5 * spread / n**0.5
    huge = spark.range(200).select(mixing.hypergeometric(F.lit(10**12), F.lit(4 * 10**11), F.lit(5 * 10**11), F.lit(0.5), mixing.uniform(F.lit(4), F.col("id"))).alias("x")).collect()
    d = np.array([r["x"] for r in huge], np.float64) - 2e11
    assert abs(d.mean()) < 5 * 2.45e5 / 200**0.5 and 0.8 < d.std() / 2.449e5 < 1.2


def test_shards_draw_disjoint_blocks_that_make_up_what_is_taken(spark, docs, tmp_path):
    how = {"block_words": 16, "shards": 4}
    rows = [(i, t, "ab"[i % 3 == 0]) for i, (_, t) in enumerate(texts(docs))]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = d.select(F.col("doc_id").alias("unit"), "source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long").alias("size"), F.xxhash64("doc_id").alias("mix"))
    mix = mixing.mix_units(units, **how).collect()
    assert len({(r["unit"], r["block"], r["pass"]) for r in mix}) == len(mix)
    for name in "ab":
        own = [r for r in mix if rows[r["unit"]][2] == name]
        assert abs(sum(r["words"] for r in own) - own[0]["target"]) <= 1
    n = Counter(r["shard"] for r in mix)
    assert len(n) == 4 and max(n.values()) - min(n.values()) <= 1
    place = {r["place"]: None for r in mix}
    split = {(r["place"], r["shard"]): r["quota"] for r in mixing.split_quotas(spark.createDataFrame([(p, sum(r["place"] == p for r in mix)) for p in place], "place int, quota long"), 4, 17).collect()}
    assert split == {k: sum((r["place"], r["shard"]) == k for r in mix) for k in split}
    drawn = mixing.mix_documents(d, shards=4)
    mixing.write_shards(drawn, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r["doc_id"], r["shard"]) for r in back.collect()) == Counter((r["doc_id"], r["shard"]) for r in drawn.collect())
    for k in range(4):
        keys = [r["shuffle_key"] for f in (tmp_path / "shards" / f"shard={k}").glob("*.parquet") for r in spark.read.parquet(str(f)).collect()]
        assert keys == sorted(keys)


def test_packing_is_brute_force_over_all_bucket_ends(spark):
    import itertools

    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 9, 14, 30])), "x") for i in range(60)] + [(60, None, "x"), (61, "w w", "x"), (61, "w w", "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, Bucket string"), buckets=3, batch_tokens=40, align=1).collect()
    sizes = sorted(len(t.split()) for _, t, _ in rows if t)
    ends = [[*x, max(sizes)] for x in itertools.combinations(sorted(set(sizes))[:-1], 2)]
    assert sum(r["padding"] for r in got) == min(sum(min(e for e in x if e >= n) - n for n in sizes) for x in ends)
    batches = Counter((r["bucket"], r["batch"]) for r in got if r["n_tokens"])
    for bucket, length in {(r["bucket"], r["bucket_length"]) for r in got if r["n_tokens"]}:
        fit, n = max(1, 40 // length), sum(c for (b, _), c in batches.items() if b == bucket)
        assert sorted(c for (b, _), c in batches.items() if b == bucket) == sorted([fit] * (n // fit) + [n % fit] * (n % fit > 0))
    assert len(got) == len(rows)


def test_merged_sketches_are_sketches_of_the_union(spark):
    words = prose(17, 60).split()
    parts = [(" ".join(words[: i % 7 + 4]), " ".join(words[i : i + i % 9 + 5])) for i in range(40)]
    d = spark.createDataFrame([(a, b) for a, b in parts], "a string, b string")
    h = lambda c: fingerprints.shingle_hashes(F.col(c))
    for r in d.select(h("a").alias("x"), h("b").alias("y"), fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m")).collect():
        both = set(r["x"]) | set(r["y"])
        low = sorted(x for x in both if x < fingerprints.threshold(fingerprints.FRACTION))
        assert r["m"] == (low or [min(both)])


def test_place_among_bounds(spark):
    for bounds in ([], [5], [1, 3, 3, 9], list(range(0, 100, 7))):
        got = spark.range(-2, 103).select("id", fingerprints.place_among(bounds, F.col("id")).alias("n")).collect()
        assert all(r["n"] == sum(b <= r["id"] for b in bounds) for r in got)


def test_language_by_nearest_centroid(spark, docs, nothing):
    vowels = [(i, " ".join("aeiouy"[(i * 7 + j * j) % 6] * 2 + "la" for j in range(30)), "xx") for i in range(30)]
    hisses = [(100 + i, " ".join("sztkrx"[(i * 5 + j * j) % 6] * 2 + "sk" for j in range(30)), "yy") for i in range(30)]
    model = language_id.train(spark.createDataFrame([*vowels, *hisses, (1, None, "xx"), (2, "text", None), (3, "12", "xx")], "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(1, vowels[3][1][:90]), (2, "sssk zzsk ttsk"), (3, None), (4, ""), (5, "123 !"), (6, "漢字漢字")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(probe, model).collect()}
    assert got[1]["lang_pred"] == "xx" and got[2]["lang_pred"] == "yy" and not got[1]["rejected"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (3, 4, 5))
    assert got[6]["rejected"] and got[6]["lang_pred"] in ("xx", "yy")
    empty = language_id.train(nothing)
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, empty).collect()} == {"und"}
    assert language_id.identify_languages(nothing, model).count() == 0


def test_languages_are_those_of_the_nearest_centroid_by_brute_force(spark):
    rng = random.Random(18)
    said = lambda vowels, n: " ".join("".join(rng.choice(vowels) + rng.choice("lmnrst") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, said(v, rng.randrange(1, 60)), lang) for i, (v, lang) in enumerate([("ae", "xx"), ("ou", "yy"), ("iy", "zz")] * 40)]
    rows += [(200 + i, rows[0][1], "xx") for i in range(60)]  # copies count once in the sample
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10**6)
    # Document frequencies by a plain count over all rows.
    grams = lambda t: language_id.hashed(language_id.only_letters(t), language_id.SIZES, language_id.BINS)
    df = Counter(b for _, t, _ in rows for b in set(grams(t).tolist()))
    idf = np.array([np.log((1 + len(rows)) / (1 + df[b])) + 1 for b in range(language_id.BINS)])
    assert np.allclose(model.idf, idf) and sorted(set(model.langs)) == ["xx", "yy", "zz"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    # Each centroid is the mean direction of the texts that are nearest to it.
    def dense(t):
        x = np.zeros(language_id.BINS)
        for b, n in Counter(grams(t).tolist()).items():
            x[b] = (1 + np.log(n)) * idf[b]
        return x / np.linalg.norm(x)

    for lang in ("xx", "yy", "zz"):
        own = np.array([dense(t) for t in sorted({t for _, t, la in rows if la == lang})])
        c = model.centroids[[k for k, la in enumerate(model.langs) if la == lang]]
        near = np.argmax(own @ c.T, axis=1)
        for k in range(len(c)):
            mean = own[near == k].mean(axis=0)
            assert (mean / np.linalg.norm(mean)) @ c[k] > 0.98
    probe = [(i, said("aeiouy", 20)) for i in range(30)] + [(30, said("ae", 9000))]
    got = {r["doc_id"]: r for r in language_id.identify_languages(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    for i, t in probe:
        cos = model.centroids @ dense(t)
        assert got[i]["lang_pred"] == model.langs[int(np.argmax(cos))] and abs(got[i]["score"] - cos.max()) < 1e-6
        assert got[i]["rejected"] == (got[i]["score"] < model.reject_below[got[i]["lang_pred"], language_id.length_class(len(t))])


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables")
@pytest.mark.parametrize("left_out", ["es", "fr"])
def test_a_language_that_was_not_learned_is_rejected(spark, left_out):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(d.where(F.col("lang") != left_out))
    r = language_id.identify_languages(d.where(F.length("text") > 200), model).groupBy(F.col("lang") == left_out).agg(F.avg(F.col("rejected").cast("int"))).collect()
    share = dict(map(tuple, r))
    assert share[True] > 0.9 and share[False] < 0.02


def test_quality_scores_are_votes_of_the_nearest_by_brute_force(spark):
    rng = random.Random(19)
    rows = [(i, prose(i, rng.randrange(1, 80)) if i % 3 else " ".join(w.upper() for w in prose(i, 30).split()), int(i % 3 > 0)) for i in range(90)]
    rows += [(5, "a second text of one key", 1), (300, None, 1), (301, "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = d.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    m = quality.train(d.select("doc_id", "text"), labels, neighbours=7)
    assert len(m.labels) == labels.count()
    got = quality.score_quality(d, m).collect()
    for r in got:
        e = m.embed(quality.terms(r["text"])[None, :])[0]
        cos = [(float(np.dot(e, v)), y) for v, y in zip(m.vectors, m.labels, strict=True)]
        near = sorted(cos, key=lambda x: -x[0])[:7]
        w = [max(c, 1e-3) ** m.sharpness for c, _ in near]
        assert abs(r["score"] - sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w)) < 1e-4
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_a_hot_copy_does_not_fill_the_samples(spark):
    rows = [(7, prose(20, 40), "en", 1)] * 300 + [(i, prose(i, 30), "en", i % 2) for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    assert len(quality.train(d.select("doc_id", "text"), d.select("doc_id", "quality")).labels) == 50
    model = language_id.train(d, per_language=10**6)
    assert model.langs and {r["lang_pred"] for r in language_id.identify_languages(d.limit(20), model).collect()} == {"en"}


def test_quality_by_neighbours(spark, docs, nothing):
    rows = [(i, prose(i, 60), 1) for i in range(40)] + [(100 + i, " ".join(w.upper() + "$$$" for w in prose(i, 50).split()), 0) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = d.select("doc_id", "quality").where("doc_id % 2 = 0").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    model = quality.train(d.drop("quality"), labels)
    got = quality.score_quality(d, model).where("doc_id % 2 = 1").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == r["quality"] for r in got)
    assert quality.score_quality(docs, model).count() == docs.count()
    assert {r["score"] for r in quality.score_quality(docs, quality.train(nothing, labels)).collect()} == {0.5}
    assert quality.score_quality(nothing, model).count() == 0


def test_url_rules(spark):
    urls = ["http://example.com/en/x", "http://www.example.com/en/x", "http://m.www.example.com/en/", "http://a.net/es/1", "http://b.a.net/fr/", "http://net/es/", "http://anet/es/", "http://a.com", "http://a.com?x", "HTTP://A.COM/z", None, "", "x"]
    rules = [None if r is None else r for r in ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", "net/es/", None, None, None, "com/", None, None, None]]
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(d).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == rules
    assert [got[i]["verdict"] for i in range(6)] == ["block", "allow", "allow", "block", "block", "block"]
    assert all(got[i]["verdict"] in ("allow", "block") for i in got) and got[9]["host"] == "a.com"
    assert url_filter.judge_urls(d.limit(0)).count() == 0


def test_url_verdicts_are_those_of_plain_logistic_regression(spark):
    import zlib

    labelled = [(f"http://{w}.example.org/{i}", int(w[0] in "bcd")) for i, w in enumerate(["bad", "worse", "cheat", "dodgy", "good", "fine", "nice", "great"] * 3)]
    m = url_filter.train(labelled)
    urls = [f"https://{w}{x}.test/a/{x}" for w in ("bad", "cheat", "good", "fine", "other") for x in ("", "1", "er")] + ["", None, "http://" + "x" * 50_000]
    got = url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules=(), labelled=labelled).collect()
    for r in got:
        u = r["url"] or ""
        host, _, path = u.partition("://")[2].partition("/")
        path = "/" + path if "://" in u and path else ""
        grams = {zlib.crc32((p + t[i : i + n]).encode()) % len(m.weights) for p, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
        z = m.bias + sum(m.weights[g] for g in grams) / max(1, len(grams)) ** 0.5
        assert abs(r["block_score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["verdict"] == ("block" if z >= 0 else "allow") and r["rule"] is None
    # The gradient of the penalised likelihood at the end of training is small.
    x = np.zeros((len(labelled), len(m.weights)))
    for i, (u, _) in enumerate(labelled):
        f = url_filter.features(*url_filter.split_url(u), len(m.weights))
        x[i, f] = 1 / len(f) ** 0.5
    p = 1 / (1 + np.exp(-(x @ m.weights + m.bias)))
    assert np.abs((p - [y for _, y in labelled]) @ x / len(labelled)).max() < 0.02


def test_url_hosts_left_out_of_training_are_told():
    rows = url_filter.labelled_urls()
    random.Random(1).shuffle(rows)
    said = []
    for fold in range(5):
        m = url_filter.train([r for i, r in enumerate(rows) if i % 5 != fold])
        said += [(m.probability(*url_filter.split_url(u)) >= m.threshold, bool(y)) for i, (u, y) in enumerate(rows) if i % 5 == fold]
    assert len({url_filter.split_url(u)[0] for u, _ in rows}) == len(rows) > 180
    assert np.mean([p == y for p, y in said]) > 0.85
    assert np.mean([p for p, y in said if not y]) < 0.1  # ordinary hosts that are blocked


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no test tables")
def test_url_method_leaves_unknown_ordinary_hosts_alone(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    got = url_filter.judge_urls(pages, rules=()).groupBy(F.col("host").contains("-").alias("odd")).agg(F.avg((F.col("verdict") == "block").cast("int")).alias("x")).collect()
    share = {r["odd"]: r["x"] for r in got}
    assert share[False] < 0.02 < share[True]


CLASHES = "doc_id long, text string, source string, lang string, Bucket string, _end string, _rank string, _h string, _row string, _one string, _unit string, TAKEN string, _key string, _text string, N_Removed string, _doc string, _out string, _ruled string, _said string, `a.b` string, row string, Score string, url string, KEY string, `_x` string"


def test_columns_of_clashing_names_stay(spark):
    names = [c.strip().split()[0].strip("`") for c in CLASHES.split(", ")]
    values = [(1, prose(1, 60), "s", "en"), (2, prose(1, 60), "s", "en"), (3, None, None, None)]
    d = spark.createDataFrame([(*v, *[f"{n}{v[0]}" for n in names[4:]]) for v in values], CLASHES)
    model = language_id.train(d.select("text", "lang"))
    rated = quality.train(d.select("doc_id", "text"), d.select("doc_id", F.lit(1).alias("quality")))
    out = {
        "pack": (packing.pack(d), {"bucket", "text"}), "mix": (mixing.mix_taken(d), {"taken", "text"}), "mixed": (mixing.mix_documents(d), set()), "repeats": (suffix_dedup.remove_repeats(d), {"n_removed", "text"}),
        "spans": (substring_dedup.dedup_spans(d), {"n_removed", "text"}), "one": (ngram_join.keep_one(d), set()), "urls": (url_filter.judge_urls(d), set()),
        "lang": (language_id.identify_languages(d, model), {"score"}), "quality": (quality.score_quality(d, rated), {"score"}),
    }
    for what, (df, replaced) in out.items():
        lower = [c.lower() for c in df.columns]
        assert len(set(lower)) == len(lower), what
        rows = df.collect()
        assert rows, what
        for r in rows:
            for n in names[4:]:
                if n.lower() not in replaced:
                    assert r[n] == f"{n}{r['doc_id']}", (what, n)


def test_ids_may_be_strings(spark):
    a, b = prose(21, 80), prose(22, 70)
    d = spark.createDataFrame([("b", a), ("a", edited(a, 2)), ("c", b), (None, a + " Some more. And more."), ("d", b)], "doc_id string, text string")
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(d).collect()}
    assert got["a"] == got["b"] == "a" and got["c"] == got["d"] == "c"
    assert sorted(r["doc_id"] or "" for r in ngram_join.keep_one(d).collect()) in (["a", "c"], ["", "a", "c"])
    cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_spans(d).collect()}
    assert cut["c"] == 0 and cut["d"] > 0 and cut["a"] == 0 and cut[None] > 0


def test_hot_runs_are_dealt_by_salts(spark):
    rows = [(i, f"Own{i} start here. Same one here. Same two here. Own{i} end there.") for i in range(25_000)]
    got = substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("n_removed").count().collect()
    assert {r["n_removed"]: r["count"] for r in got} == {0: 1, 2: 24_999}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables")
def test_ngram_join_is_brute_force_on_the_test_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: set(ngram_join.shingles(r["text"]).tolist()) for r in d.collect()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = Counter((i, j) for own in where.values() for i in own for j in own if i != j)
    links = Counter(i for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n))
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(d).collect()}
    assert got == {i: links[i] for i in sets}


def test_recordings(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.15) for _ in range(64)]) for i in range(12)] + [(None, None), (50, []), (51, [float("nan")] * 3), (3, [0.0] * 64)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in chroma.match_recordings(d, "vec_id", "embedding", every=4).collect()}
    assert len(got) == 15
    for i in (4, 8):
        assert got[i]["query"] == i and got[i]["offset"] == 3 and got[i]["bit_error"] < 0.1
    assert got[None]["n_frames"] == 0 and got[None]["query"] is None and got[50]["n_frames"] == 0
    assert chroma.match_recordings(d.limit(0), "vec_id", "embedding").count() == 0


def test_recordings_keep_every_query_that_aligns_at_the_best_of_all_offsets(spark):
    rng = np.random.default_rng(14)
    song = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    held = np.full(40, 7, np.uint32)
    a = np.concatenate([song, held[:20]])
    b = a ^ (np.arange(80) >= 15).astype(np.uint32)  # five equal integers at the right offset,
    b[:10] = 7  # ten at a wrong one
    noisy = np.where(rng.random(60) < 0.3, song ^ np.uint32(5), song)
    row = lambda i, x: (i, bytearray(x.astype("<u4").tobytes()))
    mine = [*((i, song) for i in range(3)), (8, np.zeros(0, np.uint32)), (9, a), (9, a), (10, held), (11, noisy), (None, song[:20])]
    theirs = [(100, song), (200, song), (300, song[4:]), (400, b), (500, held[:18]), (600, np.zeros(0, np.uint32)), (None, song)]
    schema = "id long, fingerprint binary"
    got = chroma.align_recordings(spark.createDataFrame([row(*x) for x in mine], schema), spark.createDataFrame([row(*x) for x in theirs], schema), "id").collect()
    want = []
    for i, x in mine:
        found = []
        for q, y in theirs:
            best = []
            for o in range(-90, 91) if q is not None else ():
                lo, hi = max(0, o), min(len(x), len(y) + o)
                equal = sum(x[k] == y[k - o] for k in range(lo, hi))
                error = sum(bin(int(x[k] ^ y[k - o])).count("1") for k in range(lo, hi)) / max(1, 32 * (hi - lo))
                if equal and hi - lo >= min(16, len(x), len(y)) and error <= 0.3:
                    best.append((error, -equal, o, hi - lo))
            if best:
                error, _, o, n = min(best)
                found.append((q, o, round(error, 9), n))
        want += [(i, *f, len(found)) for f in found or [(None, None, None, None)]]
    shown = lambda rows: Counter(map(str, rows))
    assert shown((r["id"], r["query"], r["offset"], r["bit_error"] if r["bit_error"] is None else round(r["bit_error"], 9), r["frames"], r["n_aligned"]) for r in got) == shown(want)
    assert {(r["query"], r["offset"]) for r in got if r["id"] == 9} >= {(400, 0)}
    assert sorted((r["id"], r["query"], r["offset"]) for r in got if r["id"] in (0, 1, 2) and r["query"] in (100, 200, 300)) == [(i, q, o) for i in range(3) for q, o in ((100, 0), (200, 0), (300, 4))]


def test_offset_votes_of_runs_are_those_of_frames():
    rng = np.random.default_rng(21)
    for _ in range(40):
        x, y = (np.repeat(rng.integers(0, 3, 12), rng.integers(1, 6, 12)).astype(np.uint32) for _ in range(2))
        want = Counter(i - j for i in range(len(x)) for j in range(len(y)) if x[i] == y[j])
        (a, b) = (next(chroma.runs([pd.DataFrame({"key": [b"k"], "fingerprint": [p.astype("<u4").tobytes()]})])) for p in (x, y))
        m = a.merge(b, on="code")
        votes, first = chroma.offset_votes((m["frame_x"] - m["frame_y"]).to_numpy(), m["length_x"].to_numpy(), m["length_y"].to_numpy(), np.ones(len(m), np.int64))
        assert {i + first: v for i, v in enumerate(votes) if v} == want


def test_hot_codes_are_dealt_to_a_grid(spark):
    """One code (silence) in every recording: the same alignments whatever the bound."""
    rng = np.random.default_rng(22)
    row = lambda i, x: (i, bytearray(x.astype("<u4").tobytes()))
    silence = lambda n: np.full(n, 7, np.uint32)
    songs = [rng.integers(0, 1 << 32, 20, dtype=np.uint32) for _ in range(30)]
    mine = [row(i, np.concatenate([silence(3 + i % 4), x, silence(5)])) for i, x in enumerate(songs)]
    theirs = [row(i, np.concatenate([songs[i], silence(5 + i % 3)])) for i in range(0, 30, 2)]
    d, q = (spark.createDataFrame(x, "id long, fingerprint binary") for x in (mine, theirs))
    shown = lambda df: sorted((bytes(r["class"]), bytes(r["asked"]), r["offset"], round(r["bit_error"], 9), r["frames"]) for r in df.collect())
    plain = shown(chroma.align_classes(d, q))
    assert len(plain) >= 15 and shown(chroma.align_classes(d, q, bound=4)) == plain
    a = d.selectExpr("cast(string(id) as binary) as key", "fingerprint").mapInPandas(chroma.runs, "key binary, code long, frame int, length int")
    a = a.selectExpr("key as class", "code", "frame", "length as la")
    b = a.selectExpr("class as asked", "code", "frame as their", "la as lb")
    pairs = lambda df: sorted((bytes(r["class"]), bytes(r["asked"]), r["code"], r["frame"], r["their"]) for r in df.collect())
    assert pairs(chroma.join_codes(a, b, bound=7)) == pairs(a.join(b, "code"))


def test_copies_of_recordings_are_one_class(spark):
    rng = random.Random(15)
    v = [rng.gauss(0, 0.15) for _ in range(64)]
    rows = [(i, v) for i in range(90, 130)] + [(100, v), (5, [0.1] * 64)]
    got = chroma.match_recordings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()
    copies = [r for r in got if r["vec_id"] != 5]
    assert {r["class_id"] for r in copies} == {90} and {r["n_aligned"] for r in copies} == {2}
    assert Counter(r["vec_id"] for r in got)[100] == 2 and len([r for r in copies if r["query"] == 100]) == 2 and len(got) == len(rows) + 1


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_is_brute_force(spark, tmp_path):
    """Each stage against a plain reckoning on its own input, on a small table with planted cases."""
    import corpus_pipeline

    base, passage = prose(23, 150), prose(24, 60)
    rows = [(i, prose(100 + i, 60 + i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(50, base, "en", "s0"), (51, base, "en", "s1"), (52, edited(base, 3), "en", "s1"), (53, prose(25, 70) + ". " + passage + " " + prose(26, 40), "en", "s2")]
    rows += [(54, prose(27, 50) + ". " + passage + " " + prose(28, 45), "en", "s2"), (55, None, "en", "s0"), (56, "12 34", None, "s0"), (57, "漢字 漢字", None, "s1"), (59, "", "en", "s1")]
    rows = [(i, t, la, s, len(t or "")) for i, t, la, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.out")
        docs = spark.read.parquet(f"{tmp_path}/{k}.out")
        seen.append([r.asDict() for r in docs.collect()])
    known, one, cut, mixed, packed = seen
    by = lambda rows: {r["doc_id"]: r["text"] for r in rows}
    assert set(by(known)) == {i for i, t, *_ in rows if t and any(c.isalpha() and c < "z" for c in t)}
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in by(known).items()}
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert set(by(one)) == {i for i in sets if not any(j < i and near(i, j) for j in sets)} == set(by(known)) - {51, 52}
    # Runs of two whole sentences: the first stays; nothing but the planted passage repeats.
    assert set(by(cut)) == set(by(one)) and all(by(cut)[i] == t for i, t in by(one).items() if i != 54)
    gone = len(by(one)[54].split()) - len(by(cut)[54].split())
    assert 50 <= gone <= 62 and by(cut)[54].startswith(prose(27, 50)[:40])
    size = {i: len(t.split()) for i, t in by(cut).items()}
    total, names = sum(size.values()), sorted({r["source"] for r in cut})
    of = {r["doc_id"]: r["source"] for r in cut}
    own = {s: sum(n for i, n in size.items() if of[i] == s) for s in names}
    target = {s: total * w / 6 for s, w in zip(names, (1, 2, 3), strict=True)}
    assert all(target[s] <= 3 * own[s] for s in names)
    for s in names:
        words = [size[r["doc_id"]] for r in mixed if r["source"] == s]
        assert abs(sum(words) - target[s]) <= max(size.values())
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    assert Counter(r["doc_id"] for r in packed) == Counter(r["doc_id"] for r in mixed)
    padded = lambda n: -(-n // 8) * 8
    assert all(r["n_tokens"] == size[r["doc_id"]] and r["padding"] == r["bucket_length"] - r["n_tokens"] and r["bucket_length"] >= padded(r["n_tokens"]) for r in packed)
    assert len({r["bucket_length"] for r in packed}) <= 16


def test_pipeline_on_small_tables(spark, docs, tmp_path):
    import corpus_pipeline

    clean = docs.select("doc_id", "text", "lang", "source", "n_chars")
    clean.write.parquet(f"{tmp_path}/documents.parquet")
    clean.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for where, some in ((str(tmp_path), True), (f"{tmp_path}/empty", False)):
        out = spark.read.parquet(f"{where}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, out, where).write.parquet(f"{where}/{k}.out")
            out = spark.read.parquet(f"{where}/{k}.out")
            if k < 4:
                assert out.columns == clean.columns
        assert bool(out.count()) == some
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and corpus_pipeline.ORACLE_SQL is None


def test_a_language_of_mostly_copies_is_learned(spark):
    rng = random.Random(31)
    said = lambda vowels, n: " ".join("".join(rng.choice(vowels) + rng.choice("lmnrst") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(said("ae", 40), "xx") for _ in range(300)] + [(said("ou", 40), "yy") for _ in range(20)]
    rows += [rows[-1]] * 20_000
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.langs) == {"xx", "yy"}
    probe = spark.createDataFrame([(said("ou", 30),) for _ in range(50)], "text string")
    assert {r["lang_pred"] for r in language_id.identify_languages(probe, model).collect()} == {"yy"}


@pytest.mark.parametrize("kind", ["string", "long", "decimal(10,0)", "date"])
def test_fingerprints_over_several_ranges_of_any_ids(spark, kind):
    ids = [None, *range(0, 600, 2), 10, 10, 300] * 2
    rows = [(i, f"text number {n} of some, with words {n % 7} {n % 11}") for n, i in enumerate(ids)]
    d = spark.createDataFrame(rows, "i int, text string")
    value = {"string": "lpad(CAST(i AS string), 5, '0')", "date": "date_add(DATE'2000-01-01', i)"}.get(kind, f"CAST(i AS {kind})")
    d = d.selectExpr(f"{value} AS doc_id", "text", "i")
    names = {i: r["doc_id"] for r in d.collect() for i in [r["i"]]}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    want = Counter((names[i], t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(d, per_part=8).collect()) == want
    assert fingerprints.with_next(d, per_part=8).count() == len(rows)


def test_substring_dedup_is_brute_force_for_long_sentences(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    stock = [" ".join(word() for _ in range(rng.randrange(17, 60))) + "." for _ in range(8)]
    shared = " ".join(word() for _ in range(281))
    rows = [(i, " ".join(rng.choice(stock) if rng.random() < 0.6 else " ".join(word() for _ in range(30)) + "!" for _ in range(rng.randrange(1, 9)))) for i in range(30)]
    rows += [(50, f"{word()} {shared} {word()} end."), (51, f"{word()} {shared} {word()} stop.")]  # one sentence each, not the same
    seen, want = {}, {}
    for i, t in rows:
        parts = [x.strip() for x in re.findall(r"[^.!]+[.!]", t)]
        gone = set()
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                if seen.setdefault(tuple(parts[a:b]), (i, a)) != (i, a):
                    gone |= set(range(a, b))
        want[i] = (len(gone), " ".join(x for k, x in enumerate(parts) if k not in gone))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], " ".join(r["text"].split())) for r in substring_dedup.dedup_spans(d).collect()}
    assert got == want and got[51][0] == 0 and any(n for n, _ in got.values())
    assert {r["doc_id"]: r["words_removed"] for r in substring_dedup.dedup_spans(d, long=16).collect()}[51] > 200  # the option
