"""Connected components against a plain union-find, and what they cost."""

import random

from spikelens.llm import common, graph, near_dedup


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


def found(spark, edges, **how):
    rows = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = graph.components(rows, **how).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.component for r in got}


def test_components(spark):
    r = random.Random(5)
    names = r.sample(range(-(10**15), 10**15), 400)
    path = [(x, x + 1) for x in range(300)]
    r.shuffle(path)
    zigzag = [(i if i % 2 else 1000 - i, (i + 1) if (i + 1) % 2 else 999 - i) for i in range(200)]
    hub = [(7, x) for x in range(8, 500)] + [(499, 1000), (1000, 2)]
    chance = [(r.choice(names), r.choice(names)) for _ in range(350)]
    for edges in (path, zigzag, hub, chance, [(3, 3)], [(4, 2), (2, 4)]):
        assert found(spark, edges) == plain(edges)
        assert found(spark, edges, files=3) == plain(edges)


def test_narrow_tables_are_few_files(spark, monkeypatch):
    """Each file is a task and a process that an executor starts; 30 shuffle partitions once made 800 of them here."""
    r = random.Random(8)
    base = [f"w{r.randrange(90)}" for _ in range(60)]
    rows = []
    for i in range(90):  # a chain of near copies: each differs from the one before in one word
        base[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files, kept = [], common.stored

    def counted(df, *how):
        out = kept(df, *how)
        files.append(len(out.inputFiles()))
        return out

    for module in (near_dedup, graph):
        monkeypatch.setattr(module, "stored", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("30", "false"), strict=True):
            spark.conf.set(k, v)
        near_dedup.near_duplicates(docs, shingle=2).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(files) <= 300, files


def guessed(df):
    """Broadcast sides in the plan of ``df`` that have no shuffle of their own, by whose rows Spark would know their size."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            inside, skip = [], None
            for y, d in zip(lines[i + 1 :], depth[i + 1 :], strict=True):
                if d <= depth[i]:
                    break
                if skip is not None and d > skip:
                    continue
                skip = d if "BroadcastExchange" in y else None
                inside.append(y)
            if not any("- Exchange " in y for y in inside):
                out.append("\n".join([x, *inside]))
    return out


def test_no_side_of_guessed_size_is_broadcast(spark, monkeypatch):
    """Such sides once grew to several times the driver's memory, above all the blocks' classes with an explode above them."""
    r = random.Random(8)
    base = [f"w{r.randrange(90)}" for _ in range(60)]
    rows = [(i, " ".join([*base[:-1], f"x{i % 3}"])) for i in range(9)]
    for i in range(9, 50):  # too far from each other for a link, but they share buckets
        far = list(base)
        for k in r.sample(range(60), 5):
            far[k] = f"y{i}"
        rows.append((i, " ".join(far)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bad, kept, joins = [], common.stored, []

    def watched(df, *how):
        bad.extend(guessed(df))
        joins.append(df._jdf.queryExecution().executedPlan().toString().count("Join "))
        return kept(df, *how)

    for module in (near_dedup, graph):
        monkeypatch.setattr(module, "stored", watched)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "TURNS", 1)  # so that blocks are left to compare
    calls, compared = [], near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda *x: calls.append(1) or compared(*x))
    out = near_dedup.near_duplicates(docs, shingle=2)
    assert not bad + guessed(out), "\n\n".join(bad + guessed(out))
    assert calls and sum(joins) >= 12, joins
    sides = docs.select("doc_id").join(docs.select("doc_id").hint("broadcast"), "doc_id")
    assert guessed(sides.withColumn("x", sides.doc_id)) == [] and guessed(spark.range(9).join(spark.range(5).hint("broadcast"), "id"))
