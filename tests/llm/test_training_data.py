"""The ten training-data operators against brute-force versions, closed forms and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, _slot int, digest string"     # extra columns with names used inside


def docs_frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, 1, "x") for k, t in enumerate(texts)], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = [None, "", " \n ", "One two", "one TWO", "a b c d e", "A b c d  e", "x" * 5000]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 6):
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + ("\n" if edits else ""))
        texts.append(" ".join(base[: len(base) - 4]))
    return texts


def components(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


def test_ngram_join_matches_brute_force(spark):
    from tabwise.llm.ngram_join import similar_components

    texts = corpus()
    got = similar_components(docs_frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == components(texts)


def test_ngram_join_keeps_links_behind_a_hub(spark):
    """Pairs at or just above the threshold, both near a hub that has all of their difference."""
    from tabwise.llm.ngram_join import similar_components

    sets = []
    for family in range(1000):
        rng = random.Random(family)
        core = rng.randint(30, 50)
        word = [f"f{family}w{k}" for k in range(2 * core)]
        a, b = word[:core + core // 4], word[:core]
        hub = rng.sample(b, core - rng.randint(3, core // 4)) + word[core:core + core // 4 + rng.randint(0, 8)]
        sets += [hub, a, b]
    got = {r["doc_id"]: r["component_id"] for r in similar_components(docs_frame(spark, [" ".join(s) for s in sets]), size=1).collect()}
    expected = {}
    for k in range(0, len(sets), 3):
        link = lambda x, y: 100 * len(set(sets[x]) & set(sets[y])) >= 80 * len(set(sets[x]) | set(sets[y]))
        assert link(k + 1, k + 2)
        first = k if link(k, k + 1) or link(k, k + 2) else k + 1
        expected |= {k: k, k + 1: first, k + 2: first}
    assert {k for k in expected if got[k] != expected[k]} == set()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    from tabwise.llm.packing import best_fit_packing, fill_sequences
    from tabwise.llm.queries import tokenizer_path

    texts = [None, "", "a<|endoftext|> B ÀÉ ﬁ Ω it's don't 12,3", "́abc \x1c q\x85z", "word " * 300, "tail " * 63] + ["mid size text"] * 40
    packed = best_fit_packing(docs_frame(spark, texts), tokenizer_path(), capacity=64, keep_ids=True)
    rows = packed.collect()
    tokenizer, pieces, used = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == 64 * r["piece"]
        pieces[r["doc_id"]].append((r["piece"], bytes(r["ids"])))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert b"".join(p for _, p in sorted(pieces[k])) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert all(len(p) == 256 for _, p in sorted(pieces[k])[:-1])
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert sum(len(r["ids"]) for r in fill_sequences(packed).collect()) == 4 * sum(r["length"] for r in rows)


def test_plan_fits_like_sequential_best_fit():
    from tabwise.llm.packing import plan_best_fit

    rng = random.Random(2)
    lengths = [rng.randint(1, 40) for _ in range(500)]
    room = []
    for length in sorted(lengths, reverse=True):
        best = min((r, k) for k, r in enumerate(room + [40]) if r >= length)[1]
        if best == len(room):
            room.append(40)
        room[best] -= length
    slots = plan_best_fit(dict(Counter(lengths)), 40)
    assert max(s[3] + -(-(s[2] - s[1]) // s[4]) for s in slots) == len(room)


def test_url_filter_classes(spark):
    from tabwise.llm.queries import URL_RULES
    from tabwise.llm.url_filter import filter_urls

    pages = [(1, "http://a.org/x", '<link rel="canonical" href="https://bad.net/es/1">'),
             (2, "https://b.org/y?q=1#t", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'),
             (3, "http://www.example.com/en/5", "<link href=http://c.org/z rel=canonical>"), (4, "http://c.org/z", None),
             (5, None, "<link rel=canonical href=http://bad.net/es/1>"), (6, "http://EXAMPLE.com/en/1", ""), (7, "nourl", ""),
             (8, "http://m.org/", "<link rel=canonical href=http://bad.net/es/2><link rel=canonical href=http://www.example.com/en/7>"),
             (9, "http://notexample.com", ""), (9, "http://notexample.com", "")]
    frame = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["via"]) for r in filter_urls(frame, URL_RULES).collect()}
    assert got == {1: (None, "block", "class"), 2: (None, "block", "class"), 3: ("www.example.com/en/", "allow", "rule"),
                   4: (None, "allow", "class"), 5: (None, "allow", "default"), 6: ("example.com/en/", "block", "rule"),
                   7: (None, "allow", "default"), 8: (None, "allow", "class"), 9: (None, "allow", "default")}


def test_html_extraction(spark):
    from tabwise.llm.html_crf import LAYOUTS, extract_main_text, layout_pages, train_tagger

    body = "Long running text of the story, with commas and full stops. It goes on and on here. "
    page = ("<html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
            f"<!-- ad --><div class=ad>Buy now.</div><article><h1>Head&amp;line</h1><p><b>{body}<br><p>Two\n\t  &lt;spaces&gt; {body}</p></article>"
            "<div class=comments><p>First!</p></div><footer>&copy; x</footer>")
    model = train_tagger(layout_pages())
    frame = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract_main_text(frame, model).collect()}
    assert got[1]["text"] == " ".join(f"Head&line {body} Two <spaces> {body}".split()) and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["url"] is None
    hits = [main == b.main for blocks in layout_pages(2) for (b, _), main in zip(blocks, model.decode([b for b, _ in blocks]))]
    assert len(LAYOUTS) >= 5 and sum(hits) / len(hits) > 0.97


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    from tabwise.llm.exact_dedup import exact_dedup, sha256

    texts = [(1, "a b"), (2, "ab"), (3, " a b "), (4, None), (5, ""), (6, "AB"), (7, "c d"), (7, "c d"), (None, "ab"), (8, "cd")]
    frame = spark.createDataFrame([(*t, 1, "x") for t in texts], DOC)
    rows = exact_dedup(frame, (lambda c: F.substring(sha256(c), 1, 0)) if weak else sha256).collect()   # every digest clashes
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows))
    expected = [(False, 1, 3, 4, False), (False, 2, 3, 4, False), (False, 3, 3, 4, True), (False, 4, 4, 2, True), (False, 5, 4, 2, False),
                (False, 6, 6, 1, True), (False, 7, 7, 2, False), (False, 7, 7, 2, True), (False, 8, 8, 1, True), (True, 0, 3, 4, False)]
    assert got == expected


def test_license_scan(spark):
    from tabwise.llm.license_scan import KNOWN_LICENSES, license_scan

    mit = dict(KNOWN_LICENSES[1:2])["MIT"]
    texts = ["Copyright (c) 2020 Me\n" + mit.replace("merge", "MERGE").replace(", ", " ,\n "), mit + " extra", None, "",
             "Some text.\nReleased under the MIT Licence!\nlicensed under CC BY-NC 4.0\nmore"]
    got = {r["doc_id"]: r for r in license_scan(docs_frame(spark, texts)).collect()}
    assert got[0]["license"] == "MIT" and got[1]["license"] is None and got[2]["canonical_sha256"] is None and got[2]["notices"] == []
    assert got[3]["canonical_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["notices"] == ["CC-BY-NC-4.0", "MIT"]


def test_license_scan_whole_texts_and_own_table(spark):
    from pathlib import Path

    from tabwise.llm import license_scan as scan

    folder = Path(scan.__file__).parent / "licenses"
    files = {f.stem: f.read_text() for f in folder.glob("*.txt")}
    body = {name: text for name, text in scan.KNOWN_LICENSES[::-1] if len(text) > 500}
    bsd3 = body["BSD-2-Clause"].replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                                        "or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS", 1)
    mit = scan.KNOWN_LICENSES[1][1]
    expected = [*files.items(), ("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n{mit}"), ("ISC", f"ISC License\n\n(c) X\n\n{body['ISC']}"),
                ("MIT", f"Copyright 2001 X\nAll rights reserved.\n{mit}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) Y\nAll rights reserved.\n\n{bsd3}"),
                (None, f"The MIT License (MIT)\n{mit} or not")]
    got = {r["doc_id"]: r["license"] for r in scan.license_scan(docs_frame(spark, [t for _, t in expected])).collect()}
    assert [got[k] for k in range(len(expected))] == [name for name, _ in expected] and len(files) >= 8
    own = spark.createDataFrame([("House-1", "Ours, under licence."), ("Gone", None)], "license string, text string")
    got = scan.license_scan(docs_frame(spark, ["ours under LICENSE", "x\nOurs, under licence!\ny", mit]), own).collect()
    assert [(r["license"], r["notices"]) for r in sorted(got)] == [("House-1", ["House-1"]), (None, ["House-1"]), (None, [])]
    assert {r["license"] for r in scan.license_scan(docs_frame(spark, [mit]), own.limit(0)).collect()} == {None}


def test_language_id_held_out(spark):
    from tabwise.llm.language_id import evaluate

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = evaluate(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.97 and 0 <= got[1] <= got[2] <= 1
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "12 !", None), (None, "", "fr")], "doc_id long, text string, lang string"))
    odd = [r["lang_pred"] for r in evaluate(more).where("doc_id < 0 or doc_id is null").collect()]
    assert odd == ["und"] * 3


def test_kneser_ney_matches_brute_force(spark):
    from tabwise.llm.kneser_ney import discounts, score_texts, train_kneser_ney
    from tabwise.llm.scratch import Scratch

    train = [t for t in corpus()[1:40]]
    scored = train[:10] + [None, "", "unseen words abc", corpus()[-1]]
    sequences = [words(t) + ["</s>"] for t in train]
    c = Counter(w for s in sequences for w in s)
    pairs = Counter(p for s in sequences for p in zip(["<s>"] + s, s))
    follows = Counter(w for _, w in pairs)
    by = defaultdict(list)
    for (h, _), n in pairs.items():
        by[h].append(n)
    of = lambda counts: discounts([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)])
    d2, d1, total = of(pairs), of(follows), len(pairs)
    cut = lambda n, d: n - (0, *d)[min(n, 3)]
    mass = lambda counts, d: sum((0, *d)[min(n, 3)] for n in counts)

    def p1(w):
        return cut(follows[w], d1) / total + mass(follows.values(), d1) / total / (len(c) + 1)

    def p2(h, w):
        return (cut(pairs[h, w], d2) + mass(by[h], d2) * p1(w)) / sum(by[h]) if h in by else p1(w)

    assert math.isclose(sum(p2("<s>", w) for w in c) + p2("<s>", "?"), 1.0, rel_tol=1e-9)
    model = train_kneser_ney(docs_frame(spark, train).repartition(3), Scratch(spark, "kn-test"))
    rows = {r["doc_id"]: r for r in score_texts(docs_frame(spark, scored), model).collect()}
    for k, t in enumerate(scored):
        s = words(t) + ["</s>"]
        assert rows[k]["n_tokens"] == len(s) and rows[k]["n_known"] == sum(c[w] > 0 for w in s) and rows[k]["train_tokens"] == sum(c.values())
        assert math.isclose(rows[k]["base_score"], sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in s), rel_tol=1e-9)
        assert math.isclose(rows[k]["score"], sum(math.log10(p2(h, w)) for h, w in zip(["<s>"] + s, s)), rel_tol=1e-9)


def test_decontamination_matches_brute_force(spark):
    from tabwise.llm.decontaminate import find_contamination, remove_contaminated

    texts = corpus()
    items = [(10, texts[9]), (9, " ".join(words(texts[20])[3:17])), (3, "One, two"), (4, None), (5, "!"), (None, texts[30]), (9, texts[40])]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k:k + 13])].add("" if item is None else str(item))
    got = {r["doc_id"]: r for r in find_contamination(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    clean = set()
    for k, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in windows:
                    hit |= set(range(a, a + size))
                    found |= windows[tuple(w[a:a + size])]
        bad = bool(hit) and 20 * len(hit) >= len(w)
        clean |= set() if bad else {k}
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["items"], got[k]["contaminated"]) == (len(w), len(hit), sorted(found), bad)
        assert got[k]["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert sum(s["words"] for s in got[k]["hit_spans"]) == len(hit)
    left = remove_contaminated(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == clean and left.columns == ["doc_id", "text", "_slot", "digest"]


def test_toxicity_held_out(spark):
    from tabwise.llm.toxicity import evaluate

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = evaluate(docs, labels).join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.expr("CASE WHEN toxic = 1 THEN predicted END"))).first()
    assert got[0] > 0.93 and got[1] > 0.6
    none = evaluate(docs_frame(spark, [None, ""]), labels.limit(0)).collect()
    assert [(r["score"], r["predicted"]) for r in none] == [(0.0, 0)] * 2


def test_empty_tables(spark):
    from tabwise.llm import decontaminate, exact_dedup, html_crf, kneser_ney, language_id, license_scan, ngram_join, packing, queries, toxicity, url_filter

    docs = docs_frame(spark, [""]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for frame in (ngram_join.similar_components(docs), packing.best_fit_packing(docs, queries.tokenizer_path()), url_filter.filter_urls(pages, queries.URL_RULES),
                  html_crf.extract_main_text(pages), exact_dedup.exact_dedup(docs), license_scan.license_scan(docs),
                  language_id.evaluate(docs.withColumn("lang", F.lit(None).cast("string"))), kneser_ney.evaluate(docs, F.lit(False)),
                  decontaminate.find_contamination(docs, benchmark), toxicity.evaluate(docs, labels)):
        assert frame.count() == 0
    assert decontaminate.find_contamination(docs_frame(spark, ["a b"]), benchmark).first()["n_hit"] == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    near = components([texts[k] for k in ids])
    assert sizes == sorted(sizes, reverse=True)
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert all(near[ids.index(k)][2] == ids.index(k) for k in left if texts[k] and near[ids.index(k)][1])
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


@pytest.mark.parametrize("stored", [False, True])
def test_dedup_stages_decide_by_row(spark, tmp_dir, stored):
    """Null ids, repeated rows and one id with two texts, from memory and from files."""
    import corpus_pipeline

    long, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(None, "a b c"), (None, "a b c"), (1, "a  b c"), (None, "only null"), (None, "only null"), (2, "twice"), (2, "twice"),
            (3, "a b c"), (3, "third"), (4, None), (4, ""), (None, long), (None, long + " end"), (5, other), (5, other + " end"),
            (6, other + " tail"), (7, "")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC).repartition(3)
    if stored:
        frame.write.parquet(f"{tmp_dir}/docs")
        frame = spark.read.parquet(f"{tmp_dir}/docs")
    got = corpus_pipeline.exact(spark, frame, SF)
    assert got.columns == frame.columns
    exact = sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect()))
    assert exact == sorted([(1, "a  b c"), (0, "only null"), (2, "twice"), (3, "third"), (4, ""), (0, long), (0, long + " end"),
                            (5, other), (5, other + " end"), (6, other + " tail")])
    got = corpus_pipeline.near(spark, frame, SF).collect()
    near = Counter((r["doc_id"] or 0, "w0" if "w0" in (r["text"] or "") else "v0" if "v0" in (r["text"] or "") else " ".join((r["text"] or "").split())) for r in got)
    assert near == Counter([(1, "a b c"), (0, "only null"), (2, "twice"), (3, "third"), (4, ""), (4, ""), (7, ""), (0, "w0"), (5, "v0")])
