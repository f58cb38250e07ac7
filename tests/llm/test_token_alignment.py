"""Cross-tokenizer alignment against whole texts and decoded bytes."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest

DOC = "doc_id long, text string, block int, n string"     # extra columns with names used inside
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "Hello, world", "Hello,  world \n\n x\ty\n", "héllo 日本語 🎉x naïve ｆｕｌｌ", "<|endoftext|> <s> </s> <unk>",
         "a▁b keeps no tokens", "ends in space ", "tab\tand\r\nreturn", "no break   space", "é combining", "x" * 3000,
         "aaaa " * 50, "\u0000 nul", "日本" * 200, "🎉🎉🎉", "1234567 3.14 don't we'll", "same words here", "same words here", "👩‍👩‍👧 family"]


def paths():
    from tabwise.llm.queries import aligned_tokenizer_paths

    return aligned_tokenizer_paths()


class Brute:
    """Whole texts, cut where the decoded bytes of both tokenizers end together."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = paths()
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        order = [*range(33, 127), *range(161, 173), *range(174, 256)]
        order += [x for x in range(256) if x not in order]
        shown = {chr(x) if k < 188 else chr(256 + k - 188): x for k, x in enumerate(order)}
        self.entry = {i: bytes(shown[c] for c in t) for t, i in json.load(open(a))["model"]["vocab"].items()}

    def groups(self, text):
        if not text:
            return []
        raw = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        one = [self.entry[i] for i in a]
        other = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        if b"".join(one) != raw or b"".join(other) != raw:
            return []

        def ends(parts):
            out = [0]
            for p in parts:
                out.append(out[-1] + len(p))
            return out[1:]

        x, y = ends(one), ends(other)
        out, start = [], 0
        for cut in sorted(set(x) & set(y)):
            out.append((start, cut, [t for t, e in zip(a, x) if start < e <= cut], [t for t, e in zip(b, y) if start < e <= cut]))
            start = cut
        return out

    def counts(self, texts):
        groups = [self.groups(t) for t in texts]
        links = [Counter((x, y) for _, _, a, b in g for x in a for y in b) for g in groups]
        held = Counter(p for c in links for p in c)
        most = defaultdict(int)
        for (a, _), n in held.items():
            most[a] = max(most[a], n)
        rows = []
        for k, (g, c) in enumerate(zip(groups, links)):
            written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in g)
            rows.append((k, sum(len(a) for _, _, a, _ in g), sum(len(b) for _, _, _, b in g), len(g), sum(c.values()),
                         sum(m for p, m in c.items() if held[p] == most[p[0]]), sum(m * held[p] for p, m in c.items()),
                         hashlib.sha256(written.encode()).hexdigest() if g else ""))
        return rows


def count(spark, texts):
    from tabwise.llm.token_alignment import count_links

    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOC)
    return sorted(tuple(r) for r in count_links(frame, paths()).collect())


def test_counts_match_brute_force(spark):
    assert count(spark, TEXTS) == Brute().counts(TEXTS)


def test_counts_on_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert count(spark, texts) == Brute().counts(texts)


def test_segments_blocks_and_a_full_cache(spark, monkeypatch):
    """Workers read the limits from the module they import: run the task's parts here."""
    from tabwise.llm import token_alignment as M

    aligner, brute = M.Aligner(*paths()), Brute()
    monkeypatch.setattr(M, "SEGMENT", 10)
    text = "Some words,  in\nsegments of ten or more bytes, naïve 日本語 ones as well "
    parts = [s for s, whole in aligner.document(text)]
    assert "".join(parts) == " " + text and len(parts) > 4
    known = M._Chunks(aligner)
    numbers = known.numbers(text)
    assert ";".join(known.written[k] for k in numbers) == ";".join(
        ",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in brute.groups(text))
    for k in range(40):
        known.numbers(f"word{k} segments")
    known.shrink(20)
    assert len(known) == 10 and " segments" in known
    again = known.numbers(text)
    assert ";".join(known.written[k] for k in again) == ";".join(
        ",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in brute.groups(text))


def test_links_of_a_large_group(monkeypatch):
    from tabwise.llm import token_alignment as M

    groups = M.Groups(np.array([1, 1, 2, 3]), np.array([5, 6, 5, 7]), np.array([4, 5]), np.array([0, 0, 0, 1]), np.array([0, 0, 0, 1]))
    one = sum((Counter({(g, p): t}) for g, p, t in zip(*map(np.ndarray.tolist, groups.links(10)))), Counter())
    monkeypatch.setattr(M, "LARGE", 3)
    other = sum((Counter({(g, p): t}) for g, p, t in zip(*map(np.ndarray.tolist, groups.links(10)))), Counter())
    assert one == other and sum(one.values()) == 10


def test_groups_and_null_ids(spark):
    from tabwise.llm.token_alignment import count_links, token_groups

    brute = Brute()
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: [(g["start"], g["end"], g["a"], g["b"]) for g in r["groups"]] for r in token_groups(frame, paths()).collect()}
    assert got == {k: brute.groups(t) for k, t in enumerate(TEXTS)}
    rows = count_links(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string"), paths()).collect()
    assert [r["n_links"] for r in rows] == [2, 2, 2] and [r["count_sum"] for r in rows] == [6, 6, 6]
    assert count(spark, []) == []


@pytest.mark.parametrize("text", ["plain words", "日本 🎉 ｆ", "\u0000é"])
def test_spans_and_bytes_agree(text):
    """Ends from character spans are those of the decoded bytes."""
    from tabwise.llm.token_alignment import Aligner, byte_ends

    aligner = Aligner(*paths())
    one = aligner.a.encode(" " + text, add_special_tokens=False)
    sizes = aligner.a_sizes[np.array(one.ids)]
    raw = np.frombuffer((" " + text).encode(), np.uint8)
    assert byte_ends(raw, np.array(one.offsets), sizes).tolist() == np.cumsum(sizes).tolist()
