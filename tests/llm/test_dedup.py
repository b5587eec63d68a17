"""Exact, near and line dedup against brute force, with copies, nulls, blanks and repeated rows."""

import hashlib
import random
import re

import pytest

from stemwork.llm import exact_dedup, line_dedup, near_dedup, simhash

SCHEMA = "doc_id long, text string, h long, n string"


def docs(spark, rows):
    """(doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def words(rnd, n):
    return [rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randint(0, 60)) for _ in range(n)]


@pytest.fixture(scope="module")
def crowd():
    """A dense group whose members link with some of the others, groups of copies, short and empty texts."""
    rnd = random.Random(4)
    base = words(rnd, 150)
    rows = [(5000, " ".join(base))]
    for k in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 3000)}"
        rows.append((5001 + k, " ".join(w[: rnd.choice([150, 150, 150, 118, 112])])))
    for k in range(60):
        rows.append((k, " ".join(words(rnd, rnd.randint(1, 60)))))
    rows += [(100 + k, rows[170 + k % 7][1].upper() if k % 2 else f" {rows[170 + k % 7][1]}\n") for k in range(20)]
    return rows + [(300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "One"), (305, "a b c d"), (306, "a b c"), (303, "one")]


def brute(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets)}


def test_near_components_lose_no_link(spark, crowd):
    got = near_dedup.near_duplicates(docs(spark, crowd)).collect()
    want = brute(crowd)
    assert len(got) == len(crowd)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_of_null_ids_and_one_id_with_two_texts(spark):
    a, b = " ".join(map(str, range(20))), " ".join(map(str, range(50, 70)))
    got = near_dedup.near_duplicates(docs(spark, [(1, a), (2, b), (3, a), (3, b), (None, a), (None, "only one of its kind here")])).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 1}
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, True), (1, False)]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_exact_groups(spark, crowd):
    rows = [*crowd, (None, "one"), (None, "alone")]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    norm = lambda t: re.sub("[\x20\t-\r]+", " ", t or "").encode()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i or -1, min((x for x in groups[norm(t)] if x is not None), default=-1), len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or -1, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == [(i, k, n, s) for i, k, n, s in want]
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_frequent_texts_are_merged_twice(spark, crowd, monkeypatch):
    plain = sorted(map(str, exact_dedup.exact_groups(docs(spark, crowd * 3)).collect()))
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 2)
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", 2000)
    assert sorted(map(str, exact_dedup.exact_groups(docs(spark, crowd * 3)).collect())) == plain


def test_grace_spills_and_compares_content(tmp_path):
    rnd = random.Random(1)
    rows = [(f"text {rnd.randint(0, 500)}".encode() * 5, 1) for _ in range(4000)]
    got = dict(exact_dedup.grace(iter(rows), lambda a, b: a + b, table_bytes=4000, fan=3))
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 0) + v
    assert got == want
    table = exact_dedup.Table(lambda a, b: a + b)
    for k in range(3000):
        table.add(7, str(k % 1500).encode(), 1)  # all under one hash
    assert len(table.keys) == 1500 and set(table.values) == {2}


def test_later_runs_of_lines_go(spark):
    rnd = random.Random(2)
    line = lambda n: " ".join(words(rnd, n))
    long, short, run = line(60), line(6), [line(9) for _ in range(5)]
    rows = [
        (1, "\n".join([line(8), long, line(12)])), (2, "\n".join([short, long.replace(" ", "  "), line(7), ""])), (3, "\n".join([*run, line(30)])), (4, "\n".join([line(3), *run[:2], "", *run[2:], line(5)])),
        (5, "\n".join([short, line(4)])), (6, long), (7, None), (8, ""), (9, "\n".join([long] * 3)), (2, rows_text := "\n".join([run[0], line(40)])), (2, rows_text), (None, long),
    ]
    got = line_dedup.drop_repeated_lines(docs(spark, rows))
    assert set(got.columns) >= {"h", "n"} and got.count() == len(rows)
    text = {(r.doc_id, r.lines): r.text for r in got.collect()}
    keep = lambda k: rows[k][1].split("\n")
    assert text[1, 3] == rows[0][1] and text[3, 6] == rows[2][1] and text[5, 2] == rows[4][1]
    assert text[2, 4] == "\n".join([short, *keep(1)[2:]])
    assert text[4, 8] == "\n".join([keep(3)[0], keep(3)[-1]])  # the blank line inside the run went with it
    assert (text[6, 1], text[7, 1], text[8, 1], text[9, 3], text[None, 1], text[2, 2]) == ("", None, "", "", "", rows_text)
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


def test_runs_of_random_lines_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(words(rnd, rnd.choice([2, 4, 8, 30]))) for _ in range(60)]
    rows = []
    for k in range(60):
        own = [" ".join(words(rnd, rnd.randint(3, 20))) for _ in range(4)]
        at = rnd.randrange(len(pool) - 8)
        rows.append((k, "\n".join(own[:2] + pool[at : at + rnd.randint(1, 8)] + own[2:])))
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    first = {}
    for k, t in rows:
        for line in t.split("\n"):
            first.setdefault(line, k)
            if first[line] == k:
                assert line in got[k], "a first place was deleted"
            elif len(line.split()) >= line_dedup.MIN_WORDS:
                assert line not in got[k], "a long line that came before stayed"


def every_run(rows, least):
    """Lines left by doc_id if all runs of lines with `least` words or more go where they aren't the first."""
    first, left = {}, {}
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(len(x.split()) for x in lines[s : e + 1]) >= least and first.setdefault(tuple(lines[s : e + 1]), (i, s)) != (i, s):
                    gone.update(range(s, e + 1))
        left[i] = [x for k, x in enumerate(lines) if k not in gone]
    return left


def test_runs_whose_parts_have_earlier_owners(spark):
    rnd = random.Random(6)
    line = lambda n: " ".join(words(rnd, n))
    j, k, l, m, n = (line(x) for x in (10, 11, 12, 11, 10))
    long, short = line(30), line(2)
    rows = [(1, [line(7), k, l, line(6)]), (2, [line(5), l, m, line(8)]), *((i, [line(9), j, k, l, m, n, line(4)]) for i in (3, 4, 5))]
    rows += [(6, [line(3), long, line(3)]), *((i, [line(4), long, short, line(5)]) for i in (7, 8)), *((i, [line(4), short, long, line(5)]) for i in (9, 10))]
    pool = [line(rnd.choice([2, 5, 9, 12, 27])) for _ in range(12)]
    for i in range(11, 120):
        body = [rnd.choice(pool) if rnd.random() < 0.85 else line(6) for _ in range(rnd.randint(1, 9))]
        rows.append((i, body + [x for _ in range(rnd.randint(0, 2)) for at in [rnd.randrange(9)] for x in pool[at : at + 4]]))
    rows = [(i, "\n".join(x)) for i, x in rows]
    want = every_run(rows, line_dedup.MIN_WORDS)
    assert [len(want[i]) for i in (3, 4, 5, 7, 8, 9, 10)] == [7, 2, 2, 3, 2, 3, 2]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {i: ("\n".join(want[i]), len(t.split("\n")) - len(want[i])) for i, t in rows}


def test_a_document_that_repeats_one_line_takes_linear_work(spark):
    rnd = random.Random(8)
    line, other = (" ".join(words(rnd, 25)) for _ in range(2))
    rows = [(1, "\n".join([line] * 20_000)), (2, "\n".join([other, *[line, ""] * 3_000, other]))]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {1: (line, 19_999), 2: (other, 6_001)}


@pytest.mark.parametrize("limit", [5, 40, 10_000])
def test_components_by_tasks(spark, monkeypatch, limit):
    monkeypatch.setattr(near_dedup, "EDGES_A_TASK", limit)
    rnd = random.Random(limit)
    pairs = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(140, 160)]
    least = {k: k for p in pairs for k in p}
    for _ in range(200):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    loose = {k for a, b in pairs if a == b for k in (a,)}
    assert {k: v for k, v in least.items() if k in got} == got and all(least[k] == k for k in set(least) - set(got)) and set(least) - set(got) <= loose


def brute_fingerprint(spark, text):
    return simhash.fingerprints(spark.createDataFrame([(1, text)], "k int, x string").select("k", simhash.terms(simhash.F.col("x")).alias("t")), ["k"], "t").first()


def test_fingerprints_and_radius(spark, crowd):
    rows = [(k, t) for k, (_, t) in enumerate(crowd)]
    got = simhash.edit_resistance(docs(spark, rows)).toPandas().set_index("doc_id")
    order = sorted(rows, reverse=True)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        assert got.edited_sha256[i] == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest() and got.n_chars[i] == len(t)
    prints = {i: int(got.fingerprint[i], 16) for i in got.index}
    for i in (0, 100, 200):
        assert got.n_within[i] == sum((prints[i] ^ p).bit_count() <= simhash.RADIUS for p in prints.values())
    assert got.n_within.notna().sum() == sum(i % 100 == 0 for i in got.index)
    for (i, _), (j, _) in zip(order, order[1:] + order[:1]):
        assert abs(got.near_next[i] - (1 - (prints[i] ^ prints[j]).bit_count() / 128)) < 1e-12
    long = got[got.n_chars > 150]
    assert long.near_edited.mean() > 0.65
    assert simhash.edit_resistance(docs(spark, [])).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(128) for _ in range(20)]
    near = [b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randint(0, 9))) for b in base for _ in range(20)]
    split = lambda v: tuple(x - (1 << 64) if x >> 63 else x for x in (v >> 64, v & (1 << 64) - 1))
    q, idx = spark.createDataFrame([split(v) for v in base], "hi long, lo long"), spark.createDataFrame([split(v) for v in near], "hi long, lo long")
    got = {(r.q_hi, r.q_lo, r.hi, r.lo) for r in simhash.within_radius(q, idx).collect()}
    assert got == {(*split(a), *split(b)) for a in base for b in near if (a ^ b).bit_count() <= simhash.RADIUS}


def shuffled(spark):
    """Bytes that all stages of the session have written to the shuffle."""
    sc, spark_jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark_jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_keys_that_are_not_asked_for_are_not_shuffled(spark):
    rnd = random.Random(6)
    n, word = 20_000, lambda: rnd.getrandbits(64) - (1 << 63)
    idx = spark.createDataFrame([(word(), word()) for _ in range(n)], "hi long, lo long").cache()
    few = idx.limit(100).cache()
    assert idx.count() == n and few.count() == 100
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        got = simhash.within_radius(few, idx).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.distance == 0 for r in got) == 100
    assert shuffled(spark) - before < 100 * n  # 28 keys of each would be several times as much


def test_forest_finds_neighbours_across_ranges(spark):
    """All pairs next to each other in an order come out, wherever its ranges end."""
    rnd = random.Random(9)
    base = words(rnd, 80)
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(80)] = f"e{rnd.randint(0, 400)}"
        rows.append((k, " ".join(w)))
    sketches = near_dedup.sketched(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = sketches.select(near_dedup.F.col("doc_id").alias("uid"), near_dedup.F.col("doc_id").alias("c"), "n", "hi", "lo")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in near_dedup.forest(sets, 2).collect()}
    want, seen = set(), sets.collect()
    for t in range(near_dedup.TREES):
        order = sorted((r.hi[t], r.lo[t], r.uid) for r in seen)
        for step in (1, 2):
            want |= {(min(x[2], y[2]), max(x[2], y[2])) for x, y in zip(order, order[step:]) if x[0] == y[0]}
    assert got == want and len(want) > 500


def test_rare_shingles_find_what_the_forest_cannot(spark):
    rnd = random.Random(10)
    base, rows = words(rnd, 60), []
    for k in range(150):
        w = base[:20] + words(rnd, 20) if k % 2 else list(base)
        if not k % 2:
            w[rnd.randrange(60)] = f"e{k}"
        rows.append((k, " ".join(w)))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = near_dedup.sketched(docs_)
    F = near_dedup.F
    nodes = sketches.select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("c"), "n", F.array(F.lit(1).cast("long")).alias("hi"), F.array(F.lit(0).cast("long")).alias("lo"))
    sets = near_dedup.shingle_sets(docs_, nodes.select("uid"))
    got = near_dedup.confirmed(near_dedup.unseen(nodes, sets), sets).collect()
    parts_ = [set(near_dedup.shingles(t)) for _, t in rows]
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * len(parts_[a] & parts_[b]) >= 75 * len(parts_[a] | parts_[b])}
    assert {(r.a, r.b) for r in got} == want and want


def test_near_query_contract(spark, crowd, tmp_path):
    from stemwork.llm import queries

    spark.createDataFrame(crowd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_lsh_forest_near_dedup(spark, str(tmp_path)).toPandas()
    assert {"doc_id", "n_shingles", "component_id", "kept"} <= set(got.columns)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute(crowd)
    exact = queries.op9_grace_exact_dedup(spark, str(tmp_path)).toPandas()
    assert (exact.kept == (exact.doc_id == exact.keep_id)).all() and len(exact) == len(crowd)


def test_simhash_buckets_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    rnd = random.Random(11)
    rows = [(i, " ".join(words(rnd, 12))) for i in [*range(60), *[7] * 80, *[None] * 60]]
    d = docs(spark, rows)
    placed = simhash._with_next(d).where("not extra").select("b", "doc_id", "h").collect()
    assert len(placed) == len(rows) and len({r.b for r in placed if r.doc_id == 7}) > 4 and len({r.b for r in placed if r.doc_id is None}) > 4
    got = simhash.edit_resistance(d).toPandas()
    lowest = -(1 << 63)
    hashes = {(r.doc_id, r.text): r.h for r in d.select("doc_id", "text", simhash.F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (lowest if r[0] is None else r[0], hashes[r]), reverse=True)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for (_, t), (_, u) in zip(order, order[1:] + order[:1]))
    assert sorted(got.edited_sha256) == want
