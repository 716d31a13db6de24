"""Text preparation operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from spikelens.llm import decontam, fingerprints, licenses, near_dedup, packing, repeats, ring, substring_dedup, suffix_dedup, toxicity, url_rules
from spikelens.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def texts():
    """A passage in many documents, near copies, periodic texts, copies, nulls, and empty and short texts."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = some(60), some(150).split()
    out = [f"{some(30)} {passage} {some(30)}" for _ in range(40)]
    for i in range(30):
        copy = list(base)
        copy[rnd.randrange(150)] = f"x{i}"
        out.append(" ".join(copy))
    return [*out, *["Is onhe. " * rnd.randrange(20, 120) for _ in range(10)], "", None, "a", "é x", out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), SCHEMA)


@pytest.mark.parametrize("keep,bucket", [("none", 400), ("none", 4), ("first", 4)])
@pytest.mark.parametrize("module,window", [(suffix_dedup, 200), (substring_dedup, 35)])
def test_repeats(docs, module, window, keep, bucket):
    got = {r["doc_id"]: r for r in module.dedup(docs, keep=keep, bucket=bucket, with_text=True).collect()}
    units = [(t or "").encode() if window == 200 else tuple((t or "").encode().split()) for t in texts()]
    places = collections.defaultdict(list)
    for d, u in enumerate(units):
        for i in range(len(u) - window + 1):
            places[u[i : i + window]].append((d, i))
    for d, u in enumerate(units):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            own = places[u[i : i + window]]
            if len(own) > 1 if keep == "none" else min(own) < (d, i):
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, x in zip(u, gone) if not x) if window == 200 else b" ".join(b for b, x in zip(u, gone) if not x)
        assert (got[d].n_units, got[d].n_removed, got[d].kept_sha256) == (len(u), sum(gone), hashlib.sha256(kept).hexdigest()), d
        if window == 35:
            assert got[d].kept_text.split() == kept.decode().split()


def test_repeats_take_few_files(spark, docs, monkeypatch):
    """Each file is a task and some processes that an executor starts, whatever the number of shuffle partitions."""
    files, kept = [], repeats.stored

    def counted(df, *how):
        out = kept(df, *how)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("30", "false"), strict=True):
            spark.conf.set(k, v)
        stage = corpus_pipeline.passages_out(spark, docs.repartition(4), SF)
        assert stage.rdd.getNumPartitions() <= 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(files) >= 6 and max(files) <= 5, files


def test_longest_factors():
    rnd = random.Random(1)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(120)), np.uint8)
    at = np.arange(100)
    before, after = suffix_dedup.factors(data, at, at, 20)
    lcp = lambda i, j: next((k for k in range(20) if max(i, j) + k >= 120 or data[i + k] != data[j + k]), 20)
    assert before.tolist() == [max((lcp(i, j) for j in range(i)), default=0) for i in range(100)]
    assert after.tolist() == [max((lcp(i, j) for j in range(i + 1, 100)), default=0) for i in range(100)]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    more = [(500, "Hello, World. " * 3000), (501, None), (502, "It's <|endoftext|> e\u0301, I\u0307.")]
    rows = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = packing.pack(rows, tokenizer_path()).collect()
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), {}
    for d, t in [*enumerate(texts()), *more]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for i in range(0, len(ids), 4096):
            want[d, i // 4096] = (i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(rows.limit(0), tokenizer_path()).count() == 0


def test_licenses(spark):
    cases = ["Released UNDER the MIT-License, under the mit license.", "apache license version 20", "Apache License, Version 2.0",
             "CC BY-NC 4.0 and more", None, "", "under the mit licenses", "This work is licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(cases)), SCHEMA)).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) for i in range(8)] == [
        (2, 1, 5, "mit", "mit"), (0, None, None, "", ""), (1, 0, 0, "apache-2", "apache-2"), (1, 0, 0, "cc-by-nc", "cc-by-nc"),
        (0, None, None, "", ""), (0, None, None, "", ""), (0, None, None, "", ""), (0, None, None, "", "gpl-3")]
    assert got[0].n_words == 9 and all(0 <= r.score <= 1 for r in got.values()) and got[7].score == 1


def test_template_regions():
    m = licenses.compile_template("a <<optional>>b c<</optional>> d <<any:2>> e", "x")
    run = lambda s: m.run([w.encode() for w in s.split()], 0)
    assert [run(s) for s in ("a d e", "a b c d x e", "a b d e", "a d x y z e", "a d x y e")] == [3, 6, -1, -1, 5]


def test_urls(spark):
    urls = ["http://A.example.ORG/es/1?x=1", "https://example.org/en/1#t", "https://b.com/de/2", "x://b.com/fr/", "nothing", None,
            "http://q.net/en/9", "http://borg/fr/2", "http://b.com?y#z"] * 20
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(url_rules.judge(rows).collect(), key=lambda r: r.page_id)
    assert len(got) == len(urls)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got[:6]] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/1", "example.org/en/1", "block"),
        ("b.com", "/de/2", "com/de/", "block"), ("b.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
    assert got[7].rule is None and (got[8].host, got[8].path) == ("b.com", "")
    assert url_rules.judge(rows.limit(0)).count() == 0


def test_all_rules_are_mined(spark):
    """Thousands of sure but redundant rules leave room for a short one that is less sure."""
    rows = [*[([f"{g}{i}" for i in range(14)], "block") for g in "ab" for _ in range(50)], *[(["x"], "block")] * 8, (["x"], "allow"),
            *[(["x", "z"], "block")] * 5, *[(["z"], "allow")] * 5, *[(["a1", "b1"], "allow")] * 3]
    held, total = collections.Counter(), collections.Counter()
    for items, verdict in rows:
        for k in range(1, 5):
            for part in itertools.combinations(sorted(items), k):
                held[part, verdict] += 1
                total[part] += 1
    sure = {r: n / total[r[0]] for r, n in held.items() if n >= 0.01 * len(rows) and n / total[r[0]] >= 0.8}
    weaker = lambda items, verdict, c: any(
        sure.get((p, verdict), 0) >= c for k in range(1, len(items)) for p in itertools.combinations(items, k))
    want = {r: c for r, c in sure.items() if not weaker(*r, c)}
    assert len(sure) > 2000 and (("x",), "block") in want and (("x", "z"), "block") in want
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string")).collect()
    assert len(got) == len(want) and {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in got} == pytest.approx(want)


def test_a_rule_of_five_tokens_flips_a_verdict(spark):
    """Any four of five tokens mean allow more often than not; only all five together mean block."""
    five = ["a", "b", "c", "d", "e"]
    rows = [(five, "block")] * 20 + [([t for t in five if t != left], "allow") for left in five for _ in range(100)]
    rules = {(tuple(r["items"]), r.verdict): r.confidence for r in url_rules.mine(
        spark.createDataFrame(rows, "items array<string>, verdict string"), 0.01, 0.8).collect()}
    assert rules[tuple(five), "block"] == 1 and max(c for (_, v), c in rules.items() if v == "allow") < 1
    path = lambda parts: "http://x.com/de/" + "/".join(parts)
    urls = [path(five)] * 20 + [path(t for t in five if t != left).replace("/de/", "/fr/") for left in five for _ in range(100)]
    pages = spark.createDataFrame(list(enumerate([*urls, "http://y.net/" + "/".join(five), "http://y.net/a/b/c/d"])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages).collect()}
    assert (got[520], got[521]) == ("block", "allow") and all(got[i] == ("block" if i < 20 else "allow") for i in range(520))


def test_tokens_that_always_stand_together_are_one(spark):
    """Forty tokens in the same rows are one item, not 2**40 sets; each of them alone stands for the rule."""
    many = [f"m{i:02d}" for i in range(40)]
    rows = [([*many, "z"], "block")] * 30 + [(["z"], "allow")] * 30 + [(["q"], "allow")] * 40
    got = {(tuple(r["items"]), r.verdict) for r in url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string")).collect()}
    assert got == {((m,), "block") for m in many} | {(("q",), "allow")}


def test_rules_are_mined_from_all_rows(spark):
    """One token set holds a third of many rows, the others a few per cent each: shares are those of the whole table."""
    few = spark.range(40_000).selectExpr("array(concat('t', id % 20), concat('n', id)) as items", "if(id % 20 < 10, 'block', 'allow') as verdict")
    hot = spark.range(20_000).selectExpr("array('hot') as items", "'allow' as verdict")
    got = {tuple(r["items"]): (r.verdict, r.confidence, r.support) for r in url_rules.mine(few.unionByName(hot)).collect()}
    assert got == {("hot",): ("allow", 1, pytest.approx(1 / 3)),
                   **{(f"t{i}",): ("block" if i < 10 else "allow", 1, pytest.approx(1 / 30)) for i in range(20)}}


def test_ring(spark, docs):
    rows = docs.unionByName(spark.createDataFrame([(None, "x"), (None, "x"), (None, None)], SCHEMA))
    got = ring.shard_rows(rows).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == rows.count() and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    text = dict(enumerate(texts()))
    assert all((r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, zlib.crc32((text[r.doc_id] or "").encode()))
               for r in got if r.doc_id is not None)
    assert ring.shard_rows(rows.limit(0)).count() == 0


def test_fingerprints(spark, docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        docs.selectExpr("doc_id + 100000 as doc_id", "text"))
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    got = {r.doc_id: r for r in fingerprints.edited(rows).collect()}
    order, errors = sorted(text, reverse=True), []
    grams = lambda t: {tuple(w[i : i + 3]) for w in [t.lower().split()] for i in range(len(w) - 2)}
    for i, d in enumerate(order):
        a, b = text[d], text[order[(i + 1) % len(order)]]
        cut = len(a) // 3
        edit = a[: len(a) - cut] + b[:cut]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(a), hashlib.sha256(edit.encode()).hexdigest())
        if grams(a) and grams(edit):
            errors.append(got[d].near_edited - len(grams(a) & grams(edit)) / len(grams(a) | grams(edit)))
    assert len(got) == len(text) and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert len({got[d].fingerprint for d in (100000, 100084, 100085)}) == 1


def test_near_duplicates(spark, docs):
    text = dict(enumerate(texts()))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    sets = {d: frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []) for d, w in (
        (d, (t or "").lower().split()) for d, t in text.items())}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {
        d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
    kept = near_dedup.survivors(docs.unionByName(docs), shingle=2)
    assert sorted(r.doc_id for r in kept.collect() if r.text) == [d for d in sets if sets[d] and find(d) == d]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_find_links_that_leaders_miss(spark, docs, monkeypatch):
    whole = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "TURNS", 1)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=2).collect()} == whole


def test_marginals():
    rnd = np.random.default_rng(3)
    score, trans, start = rnd.normal(size=9), rnd.normal(size=(2, 2)), rnd.normal(size=2)
    first = np.zeros(9, bool)
    first[[0, 4]] = True
    got, pairs = toxicity.marginals(score, first, trans, start)
    total, each, joint = 0.0, np.zeros(9), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=9):
        p = np.exp(sum(score[t] * y[t] + (start[y[t]] if first[t] else trans[y[t - 1], y[t]]) for t in range(9)))
        total += p
        each += p * np.array(y)
        for t in range(1, 9):
            if not first[t]:
                joint[y[t - 1], y[t]] += p
    assert np.allclose(got, each / total) and np.allclose(pairs, joint / total)


def test_toxicity(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = []
    for d in range(600):
        w = [rnd.choice(words) for _ in range(40)]
        if d % 4 == 0:
            w[rnd.randrange(40)] = rnd.choice(["idiot", "vequa" + rnd.choice("xyz")])
        rows.append((d, " ".join(w), int(d % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (601, "")], SCHEMA).selectExpr("*", "1 as toxic_score")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.sample(docs, labels))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.toxic_score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert len(got) == 602 and all(r.toxic_score < 0.5 for r in got if not r.text)
    hit = next(r for r in got if r.toxic_spans)
    assert re.search("idiot|vequ", hit.text[hit.toxic_spans[0].start : hit.toxic_spans[0].end])
    none = toxicity.fit(*toxicity.sample(docs.limit(0), labels))
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_decontamination(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    item = [rnd.choice(words) for _ in range(30)]
    edit = list(item)
    edit[7] = "new"
    del edit[20]
    clean = [rnd.choice(words) for _ in range(200)]
    cases = [clean, clean[:90] + item + clean[90:], edit + clean, item[:6] + clean]
    docs = spark.createDataFrame([*[(i, " ".join(c)) for i, c in enumerate(cases)], (8, None), (9, "")], SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "w1")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1].score == 1 and (got[1, 1].first_word, got[1, 1].end_word) == (90, 120)
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [0, 3, 8, 9]
    assert decontam.clean(docs, bench.limit(0)).count() == 6 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_edited_copies(spark):
    """Copies with many edits, whose unmatched n-grams are rarer than the ones that survive, and one with a long insertion."""
    rnd = random.Random(17)
    items, cases = [], []
    for size, edits in [(80, 0.2), (150, 0.1), (200, 0.15)] * 8:
        items.append([f"w{rnd.randrange(10**6)}" for _ in range(size)])
        copy = [f"x{rnd.randrange(10**6)}" if rnd.random() < edits else w for w in items[-1]]
        cases.append([f"y{i}" for i in range(50)] + copy + [f"z{i}" for i in range(50)])
    items.append([f"v{i}" for i in range(40)])
    cases.append([*items[-1][:20], *[f"x{i}" for i in range(30)], *items[-1][20:]])
    number = {w: k for k, w in enumerate({w for x in [*items, *cases] for w in x})}
    code = lambda words: np.array([number[w] for w in words])
    want = {}
    for d, i in itertools.product(range(len(cases)), range(len(items))):
        score, first, end = decontam.align(code(items[i]), code(cases[d]))
        if score >= len(items[i]):
            want[d, i] = (score / (2 * len(items[i])), first, end)
    assert len(want) >= 20 and want[24, 24] == (50 / 80, 0, 70)
    rows = lambda x, name: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(x)], f"{name} long, text string")
    found = decontam.leaks(rows(cases, "doc_id"), rows(items, "item_id"))
    assert {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in found.collect()} == want


def test_no_edited_copy_is_lost(spark):
    """Items of 1 to 60 words among common words, copied with up to 40 per cent of edits, against aligning all pairs."""
    rnd = random.Random(23)
    common = [f"c{i}" for i in range(12)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in [*range(1, 13), 15, 15, 20, 30, 40, 59, 60] for _ in range(2)]
    cases = []
    for item in items:
        for rate in (0, 0.1, 0.25, 0.35, 0.4):
            copy = [x for w in item for x in rnd.choice([[word()], [], [w, word()]] if rnd.random() < rate else [[w]])]
            cases.append([word() for _ in range(20)] + copy + [word() for _ in range(20)])
        cases.append([x for i, w in enumerate(item) for x in ([word()] if i % 4 == 3 else [w])])
        cases.append([x for w in item for x in (w, word())])
    number = {w: k for k, w in enumerate(sorted({w for x in [*items, *cases] for w in x}))}
    code = lambda words: np.array([number[w] for w in words], np.int64)
    want = {}
    for d, i in itertools.product(range(len(cases)), range(len(items))):
        n = len(items[i])
        score = decontam.align(code(items[i]), code(cases[d]))[0] if n >= 3 else 0
        if n >= 3 and score >= max(n, 2 * min(n, 4)):
            want[d, i] = score / (2 * n)
    rows = lambda x, name: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(x)], f"{name} long, text string")
    found = decontam.leaks(rows(cases, "doc_id").repartition(3), rows(items, "item_id"))
    assert len(want) > 120 and {(r.doc_id, r.item_id): r.score for r in found.collect()} == want


def test_alignment():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        a, b = rnd.integers(0, 4, 8), rnd.integers(0, 4, 12)
        h = np.zeros((9, 13), int)
        for i, j in itertools.product(range(1, 9), range(1, 13)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b)[0] == h.max()


def test_pipeline(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    odd = start.limit(1).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    docs, seen = start.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        seen.append((name, docs.columns, docs.count()))
        if name == "near_dedup":
            assert near_dedup.near_duplicates(docs).where("not kept").count() == 0
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontam.leaks(docs, bench).count() == 0
            assert docs.where("doc_id is null").count() == 1
    assert all(c == start.columns for _, c, _ in seen[:4])
    assert start.count() + 1 >= seen[0][2] >= seen[1][2] == seen[2][2] >= seen[3][2] > 0.5 * start.count()
    assert docs.select("doc_id").distinct().count() == seen[3][2]


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
