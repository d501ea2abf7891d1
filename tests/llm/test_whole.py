"""What a shorter job would miss: results on cases at the bounds, against brute force."""

import math
import random
import zlib

import numpy as np
import pytest

from varilume.llm import alike, decontam, licenses, mixing, pii, secrets, simhash, substrings, toxicity


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_at_the_bound(spark, monkeypatch):
    r = random.Random(4)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, texts, kinds = prose(30), [], []
    for _ in range(120):
        w = prose(r.randint(60, 250))
        other = list(w)
        for at in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0.005, 0.04)))):
            other[at] = "edited"
        texts += [" ".join(w), " ".join(other)]
    texts += [" ".join(prose(100) + passage) for _ in range(60)]
    base = prose(200)
    for _ in range(60):
        w = list(base)
        w[r.randrange(200)] = w[r.randrange(200)] = "changed"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    texts = dict(zip(ids, texts, strict=True))
    comp = {i: i for i in texts}
    root = lambda x: x if comp[x] == x else root(comp[x])
    for a in texts:
        for b in range(a):
            if (j := jaccard(texts[a], texts[b])) >= 0.8:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
            if j >= 0.5:
                kinds.append(int(20 * j))
    assert {14, 15, 16, 17} <= set(kinds)  # on both sides of 0.8
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)
    want = {i: root(i) for i in texts}
    assert {x.doc_id: x.component_id for x in alike.near_duplicates(df).collect()} == want
    assert {x.doc_id for x in simhash.drop_near_duplicates(df).collect()} == set(want.values())


def test_parity_masks_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 200, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.1, 0.9):
            b = np.unique(np.concatenate((a[rng.random(len(a)) >= share], rng.integers(0, 1 << 63, int(share * n)).astype(np.uint64))))
            differ = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in alike.parities(a) ^ alike.parities(b))
            assert differ <= len(np.setxor1d(a, b)) and (len(np.setxor1d(a, b)) - differ) % 2 == 0
            assert differ >= 0.8 * len(np.setxor1d(a, b)) or len(np.setxor1d(a, b)) > 200


def test_wide_masks_bound_the_difference_at_any_size():
    rng = np.random.default_rng(5)
    bits = lambda x: sum(bin(int(w) & (1 << 64) - 1).count("1") for w in x)
    assert not len(alike.wide(np.arange(1000, dtype=np.uint64)))
    for n, m in ((3000, 3000), (5800, 5900), (20_000, 24_000)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.02, 0.1, 1.0):
            b = np.unique(np.concatenate((a[rng.random(len(a)) >= share], rng.integers(0, 1 << 63, m - int((1 - share) * n)).astype(np.uint64))))
            x, y = sorted((alike.wide(a), alike.wide(b)), key=len)
            y = np.bitwise_xor.reduce(y.reshape(-1, len(x)))
            differ = len(np.setxor1d(a, b))
            assert len(x) > alike.MASK and bits(x ^ y) <= differ
            # sets with nothing in common are told apart
            assert share < 1 or 9 * bits(x ^ y) > len(a) + len(b)


def test_large_sets_under_frequent_keys(spark):
    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    passage, texts = prose(300), []
    # sizes on both sides of where a wide mask doubles, all with one passage
    for size in (1300, 1460, 2700, 2950, 3600):
        for _ in range(6):
            w = prose(size - 300) + passage
            texts.append(" ".join(w))
            for share in (0.015, 0.022, 0.03):
                other = list(w)
                for at in r.sample(range(size), round(size * share)):
                    other[at] = "edited"
                texts.append(" ".join(other + prose(r.randrange(60))))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    comp = list(range(len(texts)))
    root = lambda x: x if comp[x] == x else root(comp[x])
    near = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            near += 0.75 < both / (len(sets[a]) + len(sets[b]) - both) < 0.85
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    assert near > 20 and len({root(i) for i in range(len(texts))}) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in alike.near_duplicates(df).collect()} == {i: root(i) for i in range(len(texts))}


def test_simhash_takes_part_in_near_dedup(spark, monkeypatch):
    r = random.Random(12)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(150)) for _ in range(40)]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # without the join by prefixes, SimHash and the exact check still find most pairs with one word changed, and no other
    none = spark.createDataFrame([], "kind long, key long, a long, b long, n long, pos long")
    monkeypatch.setattr(alike, "_candidates", lambda dealt: none)
    kept = {x.doc_id for x in simhash.drop_near_duplicates(df).collect()}
    assert set(range(40)) <= kept and len(kept) <= 52


def test_candidates_by_multi_index_hashing(spark):
    r = random.Random(13)
    points = [(i, r.getrandbits(63)) for i in range(30)]
    # one bit of the low half differs, and none, 3 or 20 of the high half
    points += [(100 * k + i, f ^ 1 << i % 10 ^ sum(1 << 32 + b for b in r.sample(range(31), n))) for k, n in ((1, 0), (2, 3), (3, 20)) for i, f in points[10 * k - 10 : 10 * k]]
    got = {(x.a, x.b) for x in simhash.candidates(spark.createDataFrame(points, "rep long, f0 long"), 1, 32, 16).collect()}
    assert got >= {(i, 100 + i) for i in range(10)} | {(i, 200 + i) for i in range(10, 20)} and not {(i, 300 + i) for i in range(20, 30)} & got


def test_sort_sees_shared_windows_alone(monkeypatch):
    """Of runs that share a hash, what stands in one document only is left out before the suffix sort; the rest comes out as by brute force."""
    r = random.Random(6)
    passage = bytes(r.choice(b"abcdef ") for _ in range(70))
    strings = [bytes(r.choice(b"uvwxyz ") for _ in range(900)) + passage[r.randrange(3) :] + bytes(r.choice(b"uvwxyz ") for _ in range(900)) for _ in range(30)]
    asks = np.zeros(30, substrings.ASK)
    asks["key"], asks["doc_id"], asks["n"] = np.arange(30), np.arange(30)[::-1] // 2, [len(s) - 49 for s in strings]
    least = {}
    for i, s in zip(asks["doc_id"].tolist(), strings, strict=True):
        for k in range(len(s) - 49):
            least[s[k : k + 50]] = min(i, least.get(s[k : k + 50], i))
    want = {(k, at) for k, (i, s) in enumerate(zip(asks["doc_id"].tolist(), strings, strict=True)) for at in range(len(s) - 49) if i > least[s[at : at + 50]]}
    seen, sort = [], substrings.induced.repeats
    monkeypatch.setattr(substrings.induced, "repeats", lambda x, n: seen.append(sum(map(len, x))) or sort(x, n))
    for size in (1 << 20, 500):
        monkeypatch.setattr(substrings, "SORT_BYTES", size)
        got = {(int(x["key"]), int(x["start"]) + j) for x in substrings._gone(asks, strings) for j in range(int(x["n"]))}
        assert got == want and len(want) > 500
    assert max(seen) < sum(map(len, strings)) / 10


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    from varilume.llm.components import components

    r = random.Random(14)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    once = {x.node: x.component for x in components(df, "a", "b").collect()}
    monkeypatch.setattr("varilume.llm.components.SMALL", 0)
    assert once == {x.node: x.component for x in components(df, "a", "b").collect()} and once[1040] == 1000


def test_wrapped_templates():
    index = licenses.Index(licenses.TEMPLATES, {})
    bsd = b"Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
    mit = b"Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    other = b"some prose that says nothing of it\n" * 40
    assert index.labelled(other + bsd + b"\n" + other) == ({"bsd"}, 1.0) and index.labelled(other + mit)[0] == {"mit"}


def test_runs_travel_with_their_whole_hash(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefghijklmnop") for _ in range(300)) for _ in range(12)]
    want = sorted(int(x) for x in substrings.runs([t.encode() for t in texts])[4])
    got = []
    for row in substrings._deal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id AS key", "doc_id", "text"), 4).collect():
        m, at = len(row.runs) // substrings.RUN.itemsize, 0
        for c in substrings.RUN.names:
            if c == "whole":
                got += [int(x) for x in np.frombuffer(row.runs, substrings.RUN[c], m, at)]
            at += m * substrings.RUN[c].itemsize
    assert sorted(got) == want


def test_keys_joined_to_a_name():
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(200)]
    for name in ("KEY=", "sig_", "x/"):
        assert sum(bool(secrets.entropy_spans(name + h)) for h in hexes) >= 198
    key = "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA9x8Kq"
    for text in ("abcdefghijklmnop=" + key, key + "_0123456789abcdef", "123e4567-e89b-12d3-a456-426614174000/" + key):
        (a, b, _), = secrets.entropy_spans(text)
        assert set(key) >= set(text[a:b].strip("=_/")) and b - a >= 20
    assert not secrets.entropy_spans("n=20240101123456789012345 id=123e4567-e89b-12d3-a456-426614174000 abcdefghijklmnopqrstuvwxyz0123456789")


def test_blocks_of_test_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h and i j k l m n o p"), (1, "a b c d e f g h and i j k l m n o p"), (2, "nothing of it"), (None, "i j k l m n o p")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (2, "i j k l m n o p"), (3, "i j k l m n o p"), (3, "i j k l m q q q q q"), (4, "x y z x y z x y")], "item_id long, text string")
    want = sorted(map(str, decontam.overlaps(docs, bench).collect()))
    assert len(want) == 4 and sum("items=[1, 2, 3]" in x for x in want) == 2
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 12)
    assert len(list(decontam._blocks(bench))) > 1
    assert sorted(map(str, decontam.overlaps(docs, bench).collect())) == want
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [2]
    items = decontam.Items([(3, b"i j k l m n o p"), (3, b"i j k l m q q q q q")])
    assert items.coverage(b"i j k l m n o p") == {3: 1.0}


def test_repeated_empty_rows_have_places(spark):
    rows = [(1, "", "a"), (1, "", "a"), (2, None, "a"), (2, None, "a"), (None, "", "a"), (None, "", "a"), (3, "one two", "a")]
    assert mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == len(rows)


def test_counts_of_any_size_follow_the_hypergeometric_law(monkeypatch):
    """The ratio of uniforms against the law itself, and the halving above numpy's bound."""
    rng = np.random.default_rng(5)
    for good, bad, m in ((30, 50, 20), (400, 30, 100), (5, 1000, 300), (7, 3, 9)):
        got = np.bincount([mixing.ratio_of_uniforms(rng, good, bad, m) for _ in range(20_000)], minlength=m + 1) / 20_000
        law = np.array([math.comb(good, k) * math.comb(bad, m - k) / math.comb(good + bad, m) for k in range(m + 1)])
        assert np.abs(got - law).max() < 5 * math.sqrt(0.25 / 20_000)
    big = [mixing.ratio_of_uniforms(rng, 3 * 10**11, 10**11, 2 * 10**11) for _ in range(400)]
    sd = math.sqrt(2e11 * 0.75 * 0.25 * 0.5)
    assert abs(np.mean(big) - 1.5e11) < 5 * sd / 20 and 0.85 < np.std(big) / sd < 1.15
    monkeypatch.setattr(mixing, "NUMPY_BELOW", 10)
    counts = np.array([50, 0, 170, 4])
    parts = list(mixing.shard_counts(counts, 0, 23, 10))
    assert sum(c for _, c, _ in parts).tolist() == counts.tolist() and all(c.sum() == 10 for _, c, _ in parts[:-1])
    assert [c.tolist() for _, c, _ in mixing.shard_counts(counts, 7, 9, 10)] == [c.tolist() for _, c, _ in parts[7:9]]


def test_near_copies_are_linked_without_pairs(spark):
    """A group whose fingerprints all lie within three bits of each other or of a middle one: components equal to all pairs."""
    r = random.Random(8)
    base, far = r.getrandbits(64), r.getrandbits(64)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    points = list({base, far, *(flip(base, r.choice((1, 2))) for _ in range(300)), *(flip(far, 3) for _ in range(60)), *(r.getrandbits(64) for _ in range(100))})
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(signed)], "rep long, f0 long, label long").repartition(4)
    comp = list(range(len(points)))
    root = lambda x: x if comp[x] == x else root(comp[x])
    near = [(i, j) for i in range(len(points)) for j in range(i) if bin(points[i] ^ points[j]).count("1") <= 3]
    for i, j in near:
        a, b = sorted((root(i), root(j)))
        comp[b] = a
    star = {tuple(sorted(x)) for x in simhash.stars(df, 1, 32, 3).collect()}
    assert star <= {(j, i) for i, j in near} and len(star) <= 4 * len(points) < len(near)
    from varilume.llm.components import components

    got = {i: i for i in range(len(points))} | {x.node: x.component for x in components(simhash.links(df, 1, 32, 3), "a", "b").collect()}
    assert got == {i: root(i) for i in range(len(points))}
    early = components(simhash.stars(df, 1, 32, 3), "a", "b")
    labelled = df.drop("label").join(early, df["rep"] == early["node"], "left").selectExpr("rep", "f0", "coalesce(component, rep) AS label")
    rest = simhash.links(labelled, 1, 32, 3).collect()
    label = {x.rep: x.label for x in labelled.collect()}
    assert all(root(a) == root(b) and a != b for a, b in rest) and len(rest) < len(points)
    joined = {root(a) for a in label.values()}
    assert joined == {root(i) for i in range(len(points))}


def test_decoding_in_steps_equals_the_whole_lattice(monkeypatch):
    w = np.array(pii.weights())
    monkeypatch.setattr(pii, "STEP", 3)
    for text, _ in pii._examples(120, 5):
        assert pii.decode(text, 0, len(text), w) == pii.Lattice(text).best(w)
    monkeypatch.undo()
    long_ = "a1b2c3-" * 3000 + " jo@mail.example.org"
    assert (len(long_) - 19, len(long_), "email") in pii.all_spans(long_, w)[1]


def test_repeated_tokens_need_no_pairs():
    item, text = b"la " * 400 + b"end", b"la " * 40_000
    items = decontam.Items([(1, item)])
    assert items.coverage(text) == {1: 400 / 401}
    ids = np.array([1] * 40_000, np.uint64)
    at = np.arange(len(ids) - 4)
    lo = np.searchsorted(items.hashes, np.full(len(at), items.hashes[0]))
    assert len(items._matches(ids, at, lo, np.full(len(at), 396))["at"]) <= 40_400


def test_decontamination_query_equals_brute_force(spark, tmp_path):
    from tests.llm.test_brute_force import tiles

    r = random.Random(12)
    word = lambda: f"w{r.randrange(200)}"
    items = [[word() for _ in range(r.randint(6, 20))] for _ in range(12)]
    docs = [[word() for _ in range(r.randint(0, 30))] + (x := list(r.choice(items)))[: r.randint(0, len(x))] + [word() for _ in range(5)] for _ in range(40)]
    spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in decontam.op4_decontamination(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        share = [tiles(x, d, 5) / len(x) for x in items]
        assert got[i].coverage == pytest.approx(max(share)) and got[i]["items"] == [k for k, v in enumerate(share) if v >= 0.8] and got[i].n_items == len(got[i]["items"])


def test_toxicity_query(spark, tmp_path):
    """held_out by checksum, predicted by the score, and held-out accuracy on words that say it."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("bcdfgklmn") + r.choice("aeiou") for _ in range(2))
    rows = [(i, " ".join([word() for _ in range(40)] + (["vile", "nasty", "vile"] if i % 4 == 0 else []))) for i in range(800)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == list(range(800))
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out]
    assert sum((x.doc_id % 4 == 0) == bool(x.predicted) for x in held) >= 0.95 * len(held)
