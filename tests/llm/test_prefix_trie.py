"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURN = "conv_id long, turn int, role string, text string, p1 int, depth string"     # extra columns with names used inside


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p],
                   hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def trie(spark, rows, **options):
    from tabwise.llm.prefix_trie import conversation_trie

    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURN)
    return sorted(tuple(r) for r in conversation_trie(frame, **options).select(*COLUMNS).collect())


def rows(longest):
    """Shared heads, short and turnless conversations, equal turns, nulls, repeated rows, a null id, an absent head."""
    rng = random.Random(longest)
    out = []
    for conv in [*range(0, 60), 205, 305, 1000]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, longest])):
            text = rng.choice(["a", "b", None, "", "longer é" * 50]) if turn > 3 or rng.random() < .2 else f"t{turn}"
            out.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", None]), text))
    return out + out[:3] + [(None, 1, "user", "x")]


@pytest.mark.parametrize("band, longest", [(8, 12), (3, 40)])
def test_trie_matches_brute_force(spark, band, longest):
    given = rows(longest)
    assert trie(spark, given, band=band) == brute(given)


def test_long_conversations_cross_segments(spark, monkeypatch):
    """Running names cross segments of turns; the conversation's rows come from many sorted partitions."""
    from tabwise.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "SEGMENT", 5)
    given = [(c, t, "user", f"{t % 7}" if t < 30 else f"{c}-{t}") for c in (0, 1, 2) for t in range(70)]
    assert trie(spark, given, band=4) == brute(given)


def test_empty_table_and_equal_conversations(spark):
    assert trie(spark, []) == []
    given = [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]
    assert trie(spark, given) == brute(given)


def test_node_texts(spark):
    from tabwise.llm.prefix_trie import conversation_trie, node_texts

    given = spark.createDataFrame([(100, 0, "user", "a"), (100, 1, "assistant", "b"), (101, 0, "user", "c")], "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in node_texts(conversation_trie(given), given).collect()}
    assert got[100, 0] == (None, None) and got[100, 1] == ("user", "a") and got[100, 2] == ("assistant", "b")
