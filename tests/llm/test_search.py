"""Joins, searches and rules against brute force on small fixtures and on the smallest tables."""

import hashlib
import math
import pathlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindeck.llm import chosen_path, fm_toxicity, katz, license_minhash, mixing, queries, risk_rules, secret_markov, wu_manber
from graindeck.llm.common import Run, shared_dir

DOCS = "doc_id long, text string, lang string, source string"


def clash(df):
    return df.withColumns({"id": F.lit("q"), "path": F.lit(1), "n": F.lit(2), "bucket": F.lit(3), "label": F.lit(4), "words": F.lit("w"), "budget": F.lit(9)})


# n-gram Jaccard join


def brute_join(rows):
    """doc_id -> (class, copies, links) by comparing all sets."""
    sets = {}
    for i, t in rows:
        w = wu_manber.words_of(t)
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else None
    by = defaultdict(list)
    for i, s in sets.items():
        if s:
            by[s].append(i)
    kinds = list(by)
    up = {s: s for s in kinds}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    links = defaultdict(int)
    for a in range(len(kinds)):
        for b in range(a):
            x, y = kinds[a], kinds[b]
            both = len(x & y)
            if both * 5 >= 4 * (len(x) + len(y) - both):
                links[x] += 1
                links[y] += 1
                up[root(x)] = root(y)
    least = {}
    for s in kinds:
        r = root(s)
        least[r] = min(least.get(r, 1 << 60), min(by[s]))
    return {i: (i, 1, 0) if not s else (least[root(s)], len(by[s]), links[s]) for i, s in sets.items()}


def near_copies(seed=4, groups=25, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(30, 120))]
        if g % 3 == 0:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.randint(1, 2 * n // groups)):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t) + rng.choice(("", ".", "!")))
    return list(enumerate(rows))


def joined(spark, rows):
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in chosen_path.join(df).collect()}


def test_join_equals_brute_force(spark):
    rows = near_copies()
    assert joined(spark, rows) == brute_join(rows)


@pytest.mark.parametrize(
    "small,pivots,block,shingles,sets",
    [
        (3, 1024, 1024, 4_000_000, 4096), (3, 2, 1024, 4_000_000, 4096), (4, 3, 2, 4_000_000, 4096), (256, 1024, 1024, 600, 4096),
        (256, 1024, 1024, 4_000_000, 3)
    ]
)
def test_join_splits_and_blocks(spark, monkeypatch, small, pivots, block, shingles, sets):
    """Salted parts, recursion, blocks of pivots and of sets, at sizes that make small data use them."""
    for name, value in (("SMALL", small), ("PIVOTS", pivots), ("BLOCK", block), ("BLOCK_SHINGLES", shingles), ("BLOCK_SETS", sets)):
        monkeypatch.setattr(chosen_path, name, value)
    rows = near_copies(9, 8, 150)
    assert joined(spark, rows) == brute_join(rows)


def test_links_within_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = np.arange(1, 80, dtype=np.uint64) * np.uint64(977)
    sets = []
    for _ in range(90):  # near copies, half copies and others
        own = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.5, 1.0])]
        sets.append(np.unique(np.r_[own, rng.integers(0, 2**40, rng.integers(1, 9), dtype=np.uint64)]))
    sides = rng.integers(0, 2, len(sets))
    alike = lambda x, y: len(np.intersect1d(x, y)) * 5 >= 4 * len(np.union1d(x, y))
    for side in (None, sides):
        want = [sum(i != j and (side is None or side[i] != side[j]) and alike(x, y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
        counts, forest = chosen_path.links_within(sets, side)
        assert counts.tolist() == want and sum(want) > 100
        for i, x in enumerate(sets):
            assert all(forest.root(i) == forest.root(j) for j, y in enumerate(sets) if i != j and (side is None or side[i] != side[j]) and alike(x, y))
    assert chosen_path.links_within([base], None)[0].tolist() == [0]


def test_a_large_bucket_of_near_copies(spark):
    """Thousands of near copies of one text: a part of the bucket is a few rows, and all links are counted."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        t = list(base)
        for _ in range(i % 4):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert joined(spark, rows) == brute_join(rows)
    ids = [bytes([i]) for i in range(200)]
    same = np.tile(rng.randbytes(chosen_path.SKETCH), 200)
    of, chosen, far = chosen_path.pivots(np.frombuffer(bytes(same), np.uint8).reshape(200, -1))
    assert set(of) == {0} and len(chosen) == 1 and far.tolist() == [0] and len(ids) == 200


def test_one_of_each_judges_rows_that_share_an_id(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (3, words), (5, words + " more"), (5, "a text of its own, not like the others"), (5, "a text of its own, not like the others"), (5, None), (5, None),
        (8, words.upper()), (None, words), (None, "only here"), (9, "only here")
    ]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    kept = chosen_path.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, words), (5, ""), (5, ""), (5, rows[2][1]), (9, "only here")]


def test_runs_leave_only_their_results(spark):
    """What an operator stores on the way is deleted, also after an error."""
    home = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    docs = spark.createDataFrame([(i, f"text {i % 4} of a small table with some words in it", "en", f"s{i % 2}") for i in range(12)], DOCS)
    tables = lambda: sorted(str(p) for p in (home / "tables").glob("*"))
    before = tables()
    chosen_path.join(docs)
    chosen_path.one_of_each(docs)
    katz.score(docs)
    mixing.mix(docs, F.col("source"), {}, F.col("total_tokens") * 0.5)
    risk_rules.judge(docs, docs.selectExpr("doc_id", "1 as quality"))
    bad = docs.withColumn("text", F.when(F.col("doc_id") < 99, F.raise_error(F.lit("no"))).cast("string"))
    with pytest.raises(Exception):
        katz.score(bad)
    assert tables() == before


def test_join_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_join([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in queries.op3_chosen_path_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == want
    kept = chosen_path.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (c, _, _) in want.items() if c == i}


def test_join_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "one"), (5, "ONE."), (6, "x " * 30_000), (7, "x " * 20_000), (9, "a b c d e f"), (9, "a b c d e f")]
    got = joined(spark, rows)
    assert got == {1: (1, 1, 0), 2: (2, 1, 0), 3: (3, 1, 0), 4: (4, 2, 0), 5: (4, 2, 0), 6: (6, 2, 0), 7: (6, 2, 0), 9: (9, 2, 0)}
    df = spark.createDataFrame(rows + [(None, "one")], "doc_id long, text string")
    assert sorted(r.doc_id for r in chosen_path.one_of_each(df).where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 9]
    assert chosen_path.join(df.limit(0)).count() == 0
    assert chosen_path.recall(0.8) > 0.999 and chosen_path.recall(0.8, depth=1) > 0.99999


def test_join_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    # 1 and 2 are linked only through the set whose rows all have a null id
    chain = [(1, " ".join(words[:48])), (None, " ".join(words[:54])), (None, " ".join(words[:54])), (2, " ".join(words))]
    rows = [*chain, (None, "p q r"), (None, "P q, r"), (None, None), (None, ""), (7, "far off from all of it")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in chosen_path.join(df).select("doc_id", "class_id", "n_copies", "n_links").collect()]
    want = [
        (1, 1, 1, 1), (None, 1, 2, 2), (None, 1, 2, 2), (2, 1, 1, 1), (None, None, 2, 0), (None, None, 2, 0), (None, None, 1, 0), (None, None, 1, 0),
        (7, 7, 1, 0)
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = chosen_path.one_of_each(df)
    found = kept.collect()
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in found) == ["1", "7", "None", "None", "None"]
    assert sum((r.text or "").lower().startswith("p") for r in found) == 1


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1"), (b"\xf0", b"\xf0")]
    with Run(spark) as run:
        got = {bytes(r.id): bytes(r.label) for r in chosen_path.components(run, spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(41)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


# Benchmark decontamination


def brute_windows(docs, items):
    out = {}
    pats = defaultdict(set)
    for k, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            pats[tuple(w[i : i + n])].add(str(k))
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hit, found = set(), set()
        for p, own in pats.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit.update(range(j, j + len(p)))
                    found |= own
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def scanned(spark, docs, items, **more):
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    return {r.doc_id: tuple(r)[1:] for r in wu_manber.scan(d, b, **more).collect()}


@pytest.mark.parametrize("table_bytes", [1 << 20, 60])
def test_windows_equal_brute_force(spark, table_bytes):
    rng = random.Random(1)
    item = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(1, item(20)), (2, item(13)), (30, item(5)), (4, "Zebra"), (5, None), (6, "?!"), (7, item(15)), (7, item(15)), (8, "Ünder the x")]
    docs = [(i, " ".join(rng.choice("abab") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [
        (100, None), (101, ""), (102, "a zebra; ünder THE x"), (103, items[0][1] + " c " * 400), (105, "a b " * 12_000),
        (104, items[0][1].upper().replace(" ", "--"))
    ]
    assert scanned(spark, docs, items, table_bytes=table_bytes) == brute_windows(docs, items)


def test_windows_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t,
        k in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    assert {r.doc_id: tuple(r)[1:] for r in queries.op8_wu_manber(spark, sf).collect()} == brute_windows(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert wu_manber.clean(d, b).count() == sum(not v[4] for v in brute_windows(docs, items).values())
    assert wu_manber.scan(d.limit(0), b).count() == 0 and {r.n_hit for r in wu_manber.scan(d, b.limit(0)).collect()} == {0}


@pytest.mark.parametrize("table_bytes", [1 << 20, 60])
def test_clean_judges_rows_in_place(spark, table_bytes):
    items = [(i, " ".join(f"k{i}n{j}" for j in range(14))) for i in range(3)]
    docs = [
        (None, items[0][1]), (None, "fine"), (5, items[2][1]), (5, "fine too"), (6, items[1][1] + " c" * 300),
        (7, " ".join(items[i][1] + " c" * 150 for i in range(3)))
    ]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    out = wu_manber.clean(d, spark.createDataFrame(items, "item_id long, text string"), table_bytes=table_bytes)
    assert out.columns == d.columns and sorted(r.text for r in out.collect()) == sorted(["fine", "fine too", docs[4][1]])


def test_shared_windows_and_small_tables(spark):
    """A window that many items share is one pattern; a table whose slots all collide only shifts less."""
    shared = " ".join(f"s{i}" for i in range(13))
    items = [(i, f"{shared} own{i}") for i in range(300)]
    docs = [(1, f"x {shared} y"), (2, " ".join(f"s{i}" for i in range(1, 13))), (3, f"a b c {shared} own7")]
    assert scanned(spark, docs, items) == brute_windows(docs, items)
    table = wu_manber.WuManber.build(13, [(i, wu_manber.words_of(t)) for i, t in items], slots=0)
    assert len(table.shift) == 256 and len(table.begin) == 301
    for _, t in docs:
        w = wu_manber.words_of(t)
        assert [s for s, _ in table.search(w)] == [
            i for i in range(len(w) - 12) if w[i : i + 13] in [x[j : j + 13] for x in map(wu_manber.words_of, [t for _, t in items]) for j in (0, 1)]
        ]


# Quality rules


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [
        None, "", "  \n ", "a", "x " * 7, "x " * 8, "x " * 9, "é 😀 # \x0b b|c", "l\nl\n \nl", "a\x0db\n" * 3
    ] + [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(60)] + ["y z " * 20_000]
    df = clash(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in risk_rules.with_counts(df, ["doc_id"]).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_judgement(spark):
    """False rejections among documents whose labels set no cutoff."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = risk_rules.judge(docs, labels)
    tested = out.where(risk_rules.held_out()).join(labels, "doc_id").where("not base_failed")
    r = {(x.quality, x.kept): x["count"] for x in tested.groupBy("quality", "kept").count().collect()}
    assert r[1, True] > 500 and r.get((1, False), 0) <= 0.05 * r[1, True] and r[0, False] > 0
    assert out.where("kept and base_failed").count() == 0
    assert risk_rules.judge(docs.limit(0), labels).count() == 0
    few = risk_rules.judge(docs.limit(50), labels.limit(0))
    assert few.where("kept = base_failed").count() == 0  # without labels no rule is on


def planted_rules(spark, strata, good=400):
    """By stratum ``good`` texts labelled good, without symbols, and 100 labelled bad, of symbols."""
    rows = []
    for s, sign in strata:
        for i in range(good + 100):
            words = [f"{s}word{i}x{j}" for j in range(30)]
            rows.append((len(rows), " ".join(words + ["#" * (sign if i >= good else 0)] * 5), s, "src", int(i < good)))
    df = spark.createDataFrame(rows, DOCS + ", quality int")
    return clash(df.drop("quality")), df.select("doc_id", "quality")


def test_rules_hold_in_every_stratum(spark):
    """More strata than any cap, one named like a pool, one without labels, one too small to certify a cutoff."""
    many = [(f"l{i}", 40) for i in range(70)]
    docs, labels = planted_rules(spark, [("*", 40), ("en", 40), *many], 460)
    small, some = planted_rules(spark, [("small", 40)], 20)
    small, some = (x.withColumn("doc_id", F.col("doc_id") + 10**6) for x in (small, some))
    other = docs.where("lang = 'en'").withColumns({"doc_id": F.col("doc_id") + 10**7, "lang": F.lit("unseen")})
    out = risk_rules.judge(docs.union(small).union(other), labels.union(some), risk=0.2).join(docs.union(small).union(other).select("doc_id", "lang"), "doc_id")
    gone = {r.lang: r.n for r in out.where("not kept and not base_failed").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert gone == {s: 100 for s in ["*", "en", *[x for x, _ in many]]}


def test_copies_are_one_trial(spark):
    docs, labels = planted_rules(spark, [("en", 40)], 30)
    again = docs.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") * 1000 + F.col("copy")).drop("copy")
    marks = labels.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).select((F.col("doc_id") * 1000 + F.col("copy")).alias("doc_id"), "quality")
    assert risk_rules.judge(again, marks).where("not kept").count() == 0  # 1,200 good rows, yet 30 texts


def test_binomial_bound(spark):
    cases = [(k, n, p) for n, p in ((20, 0.1), (300, 0.02), (50, 0.5), (4000, 0.0125)) for k in range(0, int(n * p), max(1, n // 60))]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for p in {c[2] for c in cases}:
        for r in df.where(F.col("p") == p).select("k", "n", risk_rules.binomial_cdf(F.col("k"), F.col("n"), p).alias("got")).collect():
            assert r.got == pytest.approx(sum(math.comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.k + 1)), rel=1e-8)
    x = spark.createDataFrame([(0, 300), (0, 298), (10**6, 10**9)], "k long, n long").select(
        risk_rules.admissible(F.col("k"), F.col("n"), 0.01, F.lit(0.05))
    ).collect()
    assert [r[0] for r in x] == [True, False, True]


# License scans


def test_licenses(spark):
    apache = license_minhash.NOTICES[1][1]
    docs = [
        (1, None), (2, ""), (3, "words " * 300 + apache + " more words" * 300),
        (4, "Released under the MIT License. And: " + "filler text " * 50 + "Licensed under CC BY-NC 4.0."), (5, "the license of this work"),
        (6, apache.upper().replace(" ", "\n * ")), (7, "x " * 60_000), (7, "released  UNDER the mit license")
    ]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r.doc_id, r.licenses) for r in license_minhash.scan(df).collect())
    assert got == [(1, ""), (2, ""), (3, "Apache-2.0"), (4, "CC-BY-NC-4.0,MIT"), (5, ""), (6, "Apache-2.0"), (7, ""), (7, "MIT")]
    assert {r.n_licenses for r in license_minhash.scan(df, []).collect()} == {0} and license_minhash.scan(df.limit(0)).count() == 0


def brute_licenses(scanner, text):
    """Every template at every window, by exact containment alone, without bands or the count of known shingles."""
    hashes, best = scanner.hashes.of(wu_manber.words_of(text)), {}
    for part in scanner.parts:
        s = license_minhash.shingles(hashes, part.size)
        for t, (name, _, n) in enumerate(part.templates):
            length = 1 << max(1, math.ceil(math.log2(n)))
            for start in range(0, max(1, len(s) - length + length // 4) if len(s) else 0, max(1, length // 4)):
                share = part.contained(s, start, length, t)
                if share >= part.containment and (share, -start) > best.get(name, (0.0, 1)):
                    best[name] = (share, -start)
    return sorted((name, share) for name, (share, _) in best.items())


def test_licenses_equal_brute_force(spark):
    """On the table and on whole license texts, as they are, edited, cut, reflowed and between other words."""
    rng, texts = random.Random(2), license_minhash.templates()
    scanner = license_minhash.LicenseScanner(texts)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    whole = [(n, t) for n, t in texts if len(wu_manber.words_of(t)) >= license_minhash.LONG]
    assert len({n for n, _ in whole}) >= 15
    for name, t in whole:
        w = t.split()
        edited = [x if rng.random() > 0.01 else "other" for x in w]
        docs += [t, "before " * 40 + " ".join(edited) + " after" * 90, " ".join(w[: len(w) // 2]).upper(), "# " + "\n# ".join(w)]
    found = [[(n, s) for n, _, s in scanner.find(t)] for t in docs]
    assert found == [brute_licenses(scanner, t) for t in docs]
    for i, (name, _) in enumerate(whole):
        full, edited, _, marked = found[len(found) - 4 * len(whole) + 4 * i :][:4]
        assert name in dict(full) and name in dict(edited) and name in dict(marked)
    assert license_minhash.recall(0.5) > 0.98


def test_license_lines_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = {
        "Apache-2.0": "licensed under the apache license, version 2.0.", "MIT": "released under the mit license.",
        "CC-BY-NC-4.0": "licensed under cc by-nc 4.0.", "GPL-3.0": "this work is licensed under the gnu general public license, version 3."
    }
    found = {r.doc_id: r.licenses.split(",") for r in license_minhash.scan(docs).where("n_licenses > 0").collect()}
    for name, line in lines.items():
        ids = {r.doc_id for r in docs.where(F.lower("text").contains(line)).select("doc_id").collect()}
        assert ids and ids <= {i for i, n in found.items() if name in n}


# Mixing


def brute_mix(rows, weights, share, epochs, seed):
    """Budgets by filling level by level, prefixes by one sort of each leaf."""
    leaves = defaultdict(list)
    for i, dom, lang, src, n in rows:
        if n:
            leaves[dom, lang, src].append((i, n))
    caps = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}

    def deal(budget, children):
        got, open_, left = {}, dict(children), budget
        while open_:
            total = sum(w for w, _ in open_.values())
            if total <= 0:
                got |= dict.fromkeys(open_, 0.0)
                break
            full = {k: c for k, (w, c) in open_.items() if w > 0 and left * w / total >= c}
            if not full:
                return got | {k: left * w / total for k, (w, _) in open_.items()}
            for k, c in full.items():
                got[k] = float(c)
                left -= c
                del open_[k]
        return got

    def walk(above, budget, depth):
        if depth == 3:
            return {above: budget}
        names = {k[depth] for k in caps if k[:depth] == above}
        level = mixing.LEVELS[depth]
        kids = {n: (weights.get(level, {}).get(n, 1.0), sum(c for k, c in caps.items() if k[: depth + 1] == (*above, n))) for n in names}
        out = {}
        for n, b in deal(budget, kids).items():
            out |= walk((*above, n), b, depth + 1)
        return out

    total = sum(sum(n for _, n in v) for v in leaves.values())
    shares, out = walk((), float(round(total * share)), 0), {}
    for k, docs in leaves.items():
        leaf = sum(n for _, n in docs)
        whole = math.floor(shares[k] / leaf)
        rest, at = shares[k] - whole * leaf, 0
        for _, i, n in sorted((hashlib.sha256(f"{seed}|{whole + 1}|{i}".encode()).hexdigest()[:16], i, n) for i, n in docs):
            if whole + (at < rest):
                out[i] = whole + (at < rest)
            at += n
    return out


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 2), (1.7, 2), (5.0, 2)])
def test_mix_equals_brute_force(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(6)
    rows = [(i, rng.choice("xyyy"), rng.choice(("en", "en", "de")), f"s{rng.choice((0, 0, 0, 1, 2))}", rng.randint(0, 30)) for i in range(300)]
    weights = {"domain": {"x": 5.0}, "lang": {"en": 2.0, "de": 1.0}, "source": {"s1": 0.0, "s2": 3.0}}
    df = clash(spark.createDataFrame([(i, "w " * n, d, la, s) for i, d, la, s, n in rows], "doc_id long, text string, d string, lang string, source string"))
    got = {r.doc_id: r.copies for r in mixing.mix(df, F.col("d"), weights, F.col("total_tokens") * share, epochs, 3).collect()}
    assert got == brute_mix(rows, weights, share, epochs, 3)


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "a b", None, None), (1, "a b", None, None), (2, None, "en", "s"), (3, "", "en", "s"), (None, "c", "en", "s")], DOCS)
    df = df.union(spark.createDataFrame([(6, "long text " * 40_000, "en", "s")], DOCS))
    r = mixing.mix(clash(df), queries.domain(), {}, F.col("total_tokens") * 3, 2, 0).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.copies) for x in r) == [("1", 2, 2), ("1", 2, 2), ("6", 80_000, 2), ("None", 1, 2)]
    assert mixing.mix(df.limit(0), queries.domain(), {}, F.col("total_tokens") * 0.5).count() == 0


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, before = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    now = {r.doc_id: r.text for r in kept.collect()}
    assert 600 < len(now) < len(before)
    assert all(t == before[i] or "[REDACTED]" in t for i, t in now.items())
    home = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    there = {str(p) for p in [*home.glob("*"), *home.glob("results/*"), *home.glob("tables/*")]}
    out = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, sf).collect()}
    left = {str(p) for p in [*home.glob("*"), *home.glob("results/*"), *home.glob("tables/*")]} - there
    assert len(left) == 1 and [p.name for p in pathlib.Path(left.pop()).iterdir()] == ["mixture"]  # only the result
    assert out and set(out) <= set(now)
    joined_classes = {c for i, (c, _, _) in brute_join(list(before.items())).items()}
    assert len(set(now) - joined_classes) <= len(before) - len(joined_classes)
    assert np.isfinite(sum(out.values()))


def odd_documents(spark):
    rows = [
        (1, None, "en", "src0"), (2, "", None, None), (3, " \n\t", "en", "src1"), (4, "x " * 60_000, "en", "src0"), (
            5, "plain words in a short text", "en", "src2"
        ), (5, "plain words in a short text", "en", "src2"),
        (None, "plain words in a short text", "en", "src2"), (None, "nobody has this one", "de", "src3"), (
            7, "the key is token=abcdef123456 here", "de", "src3"
        ), (8, "the key is token=abcdef123456 here", "de", "src3"),
        (9, "tail " * 30 + "é😀 ½", "fr", "src9999999999"), (9, "another text with the same id", "fr", ""),
    ]
    return clash(spark.createDataFrame(rows, DOCS)).withColumn("score", F.lit("x")).withColumn("_set", F.lit(1))


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, clashing names, empty tables: what the docstrings say."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        docs = odd_documents(spark)
        out = stage(spark, docs, sf)
        rows = sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str) if name != "mixture" else None
        if name != "mixture":
            assert out.columns == docs.columns, name
        every = sorted(((str(r.doc_id), r.text) for r in docs.collect()), key=str)
        if name in ("toxicity", "decontamination"):
            assert rows == every
        elif name == "secrets":
            assert [i for i, _ in rows] == [i for i, _ in every] and sum(t is None for _, t in rows) == 1 and not any(
                "abcdef123456" in (t or "") for _, t in rows
            )
        elif name == "near_duplicates":
            assert [i for i, _ in rows] == ["1", "2", "3", "4", "5", "7", "9", "9", "None"]
        else:
            taken = [r.doc_id for r in out.collect()]
            assert taken and not {1, 2, 3} & set(taken) and taken.count(5) in (0, 2)
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_pipeline_equals_its_operators(spark):
    """All five stages against plain versions of their rules, on the whole smallest table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    score = {r.doc_id: r.score for r in fm_toxicity.score(docs, fm_toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    kept = {i: r.text for i, r in rows.items() if score[i] < 0.7}
    classes = brute_join(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i][0] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    windows = brute_windows(list(kept.items()), items)
    kept = {i: t for i, t in kept.items() if not windows[i][4]}
    left = docs.where(F.col("doc_id").isin(list(kept)))
    model = secret_markov.fit(left)
    texts = {i: secret_markov.redacted(t, model.spans(t)[1]) for i, t in kept.items()}
    weights = queries.MIX_WEIGHTS
    number = lambda s: int((re.search(r"[0-9]{1,9}$", s or "") or ["999999999"])[0]) % 4
    leaves = [
        (i, f"d{number(rows[i].source)}", rows[i].lang or "", rows[i].source or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in texts.items()
    ]
    want = brute_mix(leaves, weights, queries.MIX_SHARE, queries.MIX_EPOCHS, queries.MIX_SEED)
    assert {r.doc_id: r.copies for r in corpus_pipeline.run(spark, sf).collect()} == want and len(want) > 20
