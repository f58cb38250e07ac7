"""MinHash signatures and the multi-index Hamming join against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

DOC = "doc_id long, text string, sid int, n string"     # extra columns with names used inside


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def components(texts, percent=85):
    sets = []
    for text in texts:
        w = words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [(k, len(s), find(k), find(k) == k) for k, s in enumerate(sets)]


def families(count, length, seed=4):
    """Families of copies with a few to many edits, cuts at both ends, repeated texts, short and empty ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = [None, "", " \n ", "One two", "one TWO", "a b c d e", "A b c d  e", "x" * 5000]
    for _ in range(count):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + ("\n" if edits else ""))
        texts += [" ".join(base[6:]), " ".join(base[:-7])]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOC)


@pytest.mark.parametrize("part", [4096, 3])
def test_matches_brute_force(spark, monkeypatch, part):
    """Also with keys and leaders cut into many parts."""
    from tabwise.llm import minhash_hamming

    monkeypatch.setattr(minhash_hamming, "PART", part)
    texts = families(8, 90)
    got = minhash_hamming.near_duplicates(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == components(texts)


def test_rows_without_ids_and_empty_table(spark):
    from tabwise.llm.minhash_hamming import near_duplicates

    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text), (None, text + " x"), (5, text), (5, text), (7, "other words"), (None, "alone")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(
        [(None, 5, False), (None, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (None, None, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_pairs_within_the_distance_share_a_key(spark):
    """The pigeonhole guarantee: any 23 of 64 slots may differ."""
    from tabwise.llm import minhash_hamming as M

    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        one = rng.integers(0, 256, 64, dtype=np.uint8)
        other = one.copy()
        at = rng.choice(64, 23, replace=False)
        other[at] += rng.integers(1, 256, 23, dtype=np.uint8)
        rows += [(2 * k, *one.view(np.int64).tolist()), (2 * k + 1, *other.view(np.int64).tolist())]
    sets = spark.createDataFrame(rows, "sid long, " + ", ".join(f"s{k} long" for k in range(8)))
    keys = {}
    for r in M.chunk_keys(sets, 64, 8, 12, 1).collect():
        keys.setdefault(r["sid"], set()).add(r["key"])
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(300))


def test_signatures_estimate_similarity():
    from tabwise.llm import minhash_hamming as M

    rng, hashers, apart = np.random.default_rng(0), M._hashers(64), []
    for _ in range(500):
        tokens = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        one, other = np.concatenate([tokens[:340], tokens[340:370]]), np.concatenate([tokens[:340], tokens[370:]])
        apart.append((M.signature(one, *hashers, 8).view(np.uint8) != M.signature(other, *hashers, 8).view(np.uint8)).sum())
    assert abs(np.mean(apart) - 64 * 0.15 * 255 / 256) < 0.5 and max(apart) <= 23


def test_large_group_of_near_copies_is_not_paired_as_a_whole(spark, monkeypatch):
    """Sets that their leader does not link meet their closest partners first; the components are those of all pairs."""
    from tabwise.llm import minhash_hamming
    walk = [f"w{k}" for k in range(540)]
    texts = [" ".join(walk[k:k + 300]) for k in range(240)]        # each is near some 24 on either side
    compared, count = [], minhash_hamming.exact_overlaps
    monkeypatch.setattr(minhash_hamming, "exact_overlaps", lambda pairs, *a: compared.append(pairs.count()) or count(pairs, *a))
    got = minhash_hamming.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == components(texts)
    assert max(compared) < 3 * len(texts), compared
