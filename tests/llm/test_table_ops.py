"""Operators over whole tables against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import components, linededup, mixing, setjoin
from tidemark.llm.common import shared_dir

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


# -- mixing


def brute_mix(rows):
    sizes = [len(SPACED.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = {n: sum(k for k, r in zip(sizes, rows, strict=True) if r[2] == n) for n in names}
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, capped = sum(sizes), set()
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(3 * size[n] for n in capped)
        target = {n: 3 * size[n] if n in capped else left * weight[n] / sum(weight[x] for x in free) for n in names}
        over = {n for n in free if target[n] > 3 * size[n]}
        if not over:
            return sizes, size, target
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30]))), rng.choice(["a", "b", "c", "é", None, *["hot"] * 6])) for i in range(400)]
    rows += [(1000, None, "empty"), (1001, "one", "tiny"), (5, rows[5][1], rows[5][2]), (None, "x y", "a")]
    docs = docs_of(spark, rows).withColumns({"size": F.lit("clash"), "slot": F.lit(1), "weight": F.lit(2)})
    sizes, by_source, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["__source_size"] == by_source[r["source"]] and r["__target"] == pytest.approx(target[r["source"]])
        assert r["size"] == "clash" and 0 <= r["__epochs"] <= 3
        taken[r["source"]] += r["__size"] * r["__epochs"]
    for source, want in target.items():
        assert abs(taken[source] - want) <= 60, source
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["__epochs"] for r in got)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mix_takes_ties_row_by_row(spark):
    rows = [(7, "w " * 8, "b")] * 400 + [(None, f"n{i % 9} " * (1 + i % 3), "c") for i in range(300)] + [(i, "a " * 40, "a") for i in range(100)]
    docs = docs_of(spark, rows).withColumns({c: F.lit("mine") for c in ("__size", "__copy", "__row", "__rank", "__text")})
    sizes, by_source, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["__size"] * r["__epochs"]
    assert len(got) == len(rows) and {s: abs(taken[s] - target[s]) <= 20 for s in target} == dict.fromkeys(target, True)
    key = lambda r: str((r["source"], r["text"], r["__epochs"]))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["__epochs"] for r in got) and {r["__size"] for r in out.collect()} == {"mine"}


# -- line dedup


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    last = (1 << 63) - 1
    held = defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(last if i is None else i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("shard", [7, linededup.SHARD])
def test_line_dedup_equals_brute_force(spark, shard):
    rng = random.Random(shard)
    pool = ["a line of %d words" % i for i in range(30)] + ["short", "", "  A LINE OF 3 WORDS\t", "ééééééééé", "éééééééééé", "x" * 5000]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8))), "s") for i in range(60)] + [(100 + i, "the hot line of all\nown line %d here" % i, "s") for i in range(80)]
    rows += [(None, "a line of 3 words", "s"), (7, "a line of 3 words\nrepeated id", "s"), (900, None, "s"), (901, "", "s"), (902, "own own own own", "s"), (902, "own own own own", "s")]
    docs = docs_of(spark, rows).withColumns({"h1": F.lit(1), "shard": F.lit(2), "id": F.lit(3), "n_chars": F.lit(0)})
    got = sorted(((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"] or "") for r in linededup.dedup_lines(docs, shard).collect()), key=repr)
    assert got == sorted(brute_lines(rows), key=repr)
    kept = linededup.without_shared_lines(docs, shard)
    assert kept.columns == docs.columns and all(r["n_chars"] in (0, len(r["text"] or "")) for r in kept.collect())
    assert linededup.dedup_lines(docs.where("false"), shard).count() == 0


def test_line_dedup_with_clashing_names_and_many_null_ids(spark):
    names = ("__drops", "__drop_id", "__drop_row", "__n_lines", "__n_dropped", "row")
    rows = [(i, f"the line of all of them\nown {i} line of one", "s") for i in range(20)]
    docs = docs_of(spark, rows).withColumns({c: F.lit("mine") for c in names})
    out = linededup.without_shared_lines(docs)
    assert out.columns == docs.columns and all(r[c] == "mine" for r in out.collect() for c in names)
    twice = linededup.dedup_lines(linededup.dedup_lines(docs))
    assert len(twice.columns) == len(set(twice.columns)) and sum(r["__n_dropped"] for r in twice.collect()) == 0
    many = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('a line that all of them hold\n', 'their own line ', id % 50000, '\nits own line number ', id) AS text", "'s' AS source")
    found = linededup.dropped_lines(many.unionByName(docs_of(spark, [(1, "a line that all of them hold", "s")])))
    assert found.count() == 100_000 and found.agg(F.max(F.size("drops"))).first()[0] == 1


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1)), max_size=300))
def test_perfect_hash_is_minimal_and_perfect(keys):
    a, b = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    index = linededup.PerfectHash.build(a, b)
    again = linededup.PerfectHash.unpack(*index.pack())
    for x in (index, again):
        assert sorted(x.find(a, b).tolist()) == list(range(len(keys)))
    assert (again.find(a ^ np.uint64(1), b) < max(1, len(keys))).all()


# -- similarity join


def brute_classes(rows, rule):
    sets = []
    for _, text, _ in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = SPACED.findall(w)
        sets.append(frozenset(zip(*[w[k:] for k in range(rule.width)], strict=False)) if len(w) >= rule.width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least.get(root(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True)) if d is not None)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 9, 12, 14, 18, 24, 30, 60, 200]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            out.append(" ".join(w))
    hub = [word() for _ in range(150)]
    for _ in range(60):
        w = list(hub)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = word()
        out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rule", [setjoin.Rule(3, 90, 100), setjoin.Rule(5, 80, 100), setjoin.Rule(1, 80, 100)])
def test_classes_equal_brute_force(spark, rule, monkeypatch):
    texts = near_copies(rule.width) + ["", None, " \t", "one", "ONE", "one two", "same same same same", "x " * 30_000]
    rows = [(i * 3, t, "s") for i, t in enumerate(texts)]
    docs = docs_of(spark, rows).withColumns({"n": F.lit(1), "node": F.lit(2), "component_id": F.lit(3), "s1": F.lit("x")})
    want = brute_classes(rows, rule)
    for small in (None, 0, 14):  # the boundary by cost, no small sets, many small sets
        if small is not None:
            monkeypatch.setattr(setjoin, "boundary", lambda *_, s=small: s)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.with_classes(docs, rule).collect())
        assert got == want
        monkeypatch.undo()
    kept = setjoin.keep_representatives(docs, rule)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in want if d == c)
    assert len({c for *_, c in want}) < len(want)


@pytest.mark.parametrize("rule", [setjoin.Rule(3, 90, 100), setjoin.Rule(5, 80, 100)])
def test_dealt_lists_lose_no_link(spark, rule):
    template = " ".join(f"t{i}" for i in range(30))
    rows = [(i, t, "s") for i, t in enumerate(near_copies(9) + [f"{template} a{i} b{i % 5} c{i % 3} d{i % 2}" for i in range(40)] + [f"page {i} of the one big site here and now" for i in range(30)])]
    docs = docs_of(spark, rows)
    want = {(d, c) for d, _, c in brute_classes(rows, rule)}
    marks = setjoin.set_marks(docs, rule)
    for parts, long in ((5, 2), (3, 20)):
        found = setjoin.classes(docs, rule, parts, long)
        assert {(r["doc_id"], r["component_id"]) for r in marks.join(found, ["s1", "s2"]).collect()} == want


def test_subsets_are_enumerated_where_they_cost_less(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for rule in (setjoin.Rule(3, 90, 100), setjoin.Rule(5, 80, 100)):
        sets = setjoin.distinct_sets(docs, rule)
        sketch = spark.sparkContext.broadcast(setjoin.token_sketch(sets, rule))
        costs = setjoin.sizes_and_costs(sets, rule, sketch)
        small = setjoin.boundary(costs, rule)
        assert sum(n for size, (n, _) in costs.items() if size <= small) > 0
        posted = setjoin.postings(sets, rule, sketch, small, sets.count())
        assert posted.where("pos < 0").count() > 0 and posted.where("pos >= 0").count() > 0
    assert setjoin.boundary({n: (10, 10) for n in range(20)}, setjoin.Rule(5, 80, 100)) == 3  # sets of four would pay for their lists too
    assert setjoin.boundary({n: (10, 10_000) for n in range(20)}, setjoin.Rule(5, 80, 100)) > 9


def test_representatives_row_by_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "x"), (None, text, "x"), (9, text, "x"), (4, text + " more", "x"), (4, "another text of id four that has no copy at all", "x"), (None, "no id has this text at all", "x"), (None, "no id has this text at all", "y"), (None, None, "x"), (5, "", "x")]
    names = ("__gone", "__n", "__s1", "__keeper", "component_id", "s1")
    docs = docs_of(spark, rows).withColumns({c: F.lit("mine") for c in names})
    out = setjoin.keep_representatives(docs)
    got = out.collect()
    assert out.columns == docs.columns and all(r[c] == "mine" for r in got for c in names)
    kept = sorted(str((r["doc_id"], (r["text"] or "")[:9])) for r in got)
    assert kept == sorted(map(str, [(4, "w0 w1 w2 "), (4, "another t"), (None, "no id has"), (None, ""), (5, "")]))
    assert setjoin.keep_representatives(docs.where("false")).count() == 0


def test_classes_with_null_and_repeated_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "s"), (9, text, "s"), (9, text, "s"), (4, text + " more", "s"), (None, "alone alone alone", "s")]
    got = setjoin.with_classes(docs_of(spark, rows), setjoin.Rule(3, 90, 100)).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, [(None, 4), (9, 4), (9, 4), (4, 4), (None, None)]))
    assert setjoin.with_classes(docs_of(spark, rows).where("false")).count() == 0


def test_word_hashes_follow_words_across_chunks(monkeypatch):
    text = " ".join(near_copies(1)).encode() + b"\x0b" + "é日本".encode() * 50
    whole = setjoin.word_hashes(text)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(setjoin, "CHUNK", 64)
    assert (setjoin.word_hashes(text) == whole).all() and len(setjoin.word_hashes(b" \n")) == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(i, 100) for i in range(90, 99)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 90 for i in [*range(90, 99), *range(100, 160)]}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    odd = spark.createDataFrame([(None, 1, "x"), (2, None, "x"), (4, 4, "x"), (3, 5, "x"), (5, 3, "x"), (3, 5, "x")], "a bigint, b bigint, node string")
    assert sorted(map(tuple, components.components(odd).collect())) == [(3, 3), (5, 3)]


# -- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from tidemark.llm import bpe, quality

    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 40, n))
    rows = [(i, "\n".join(prose(30) for _ in range(4)), f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[3][1], "s0"), (101, rows[4][1].replace("w1 ", "w2 ", 1), "s1"), (102, "short", "s2"), (103, None, "s2"), (104, " ".join(f"Z{i}!!" for i in rng.integers(0, 999, 90)), "s1")]
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "tokenize"] and corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    weights = quality.fit_weights(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = {r["doc_id"] for r in quality.quality_report(docs, weights).collect() if r["kept"]}
    assert {102, 103, 104}.isdisjoint(good) and len(good) >= 60
    now = [r for r in rows if r[0] in good]
    now = [(i, t, s) for (i, *_, t), (_, _, s) in zip(brute_lines(now), now, strict=True)]
    classes = {d: c for d, _, c in brute_classes(now, setjoin.Rule(5, 80, 100))}
    now = [r for r in now if classes[r[0]] == r[0]]
    epochs = {r["doc_id"]: r["__epochs"] for r in mixing.mix(docs_of(spark, now)).collect()}
    library = Tokenizer.from_file(bpe.default_path())
    want = [(i, np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) for i, t, _ in now for _ in range(epochs[i])]
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == sorted(want)
    assert all(r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_pipeline_with_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 60, n))
    long = [prose(120) for _ in range(12)]
    rows = [(i, t, "s") for i, t in enumerate(long)] + [(None, long[0], "s"), (None, prose(90), None), (None, None, None), (3, long[3], "s"), (5, prose(80), None), (20, "", "s"), (21, " \n ", "s")]
    names = ("__n", "__drops", "__size", "__copy", "__row", "__keeper", "size", "s1")
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars").withColumns({c: F.lit("mine") for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.where("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now, corpus_pipeline.stored(stage(spark, now, str(tmp_path)), f"test-{name}")
            assert now.columns == docs.columns and all(r[c] == "mine" for r in now.collect() for c in names), name
            assert now.select("doc_id", "source").exceptAll(before.unionAll(before).unionAll(before).select("doc_id", "source")).isEmpty(), name
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert out.count() == now.count()
        assert table is not docs or {20, 21}.isdisjoint({r["doc_id"] for r in out.collect()})


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
