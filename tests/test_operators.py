"""Operators on hand-written edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from columnloom import queries
from columnloom.functions.text import declared_type, json_object, safe_name
from columnloom.operators import candidates, catalog, cluster, evaluate, graph, parse, providers, text, vectors
from columnloom.plans import alignment


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_samples(spark):
    df = spark.createDataFrame([(i, None if i < 7 else i * 1e6, None, "x" if i % 2 else None) for i in range(12)], "k int, a double, b string, `c.d (e)/f` string")
    got = {r.column_name: r.samples for r in catalog.profile_samples(df, "s", "t", ["k"]).collect()}
    assert got == {"k": ["0", "1", "2"], "a": ["7000000.0", "8000000.0", "9000000.0"], "b": [], "c.d (e)/f": ["x", "x", "x"]}
    head = {r.column_name: r.samples for r in catalog.profile_samples(df, "s", "t", ["k"], head=5).collect()}
    assert head["a"] == [] and head["c.d (e)/f"] == ["x", "x"]


def test_large_doubles(spark):
    df = spark.createDataFrame([(1, 1e7), (2, 0.25), (3, float("nan")), (4, 12345678.5)], "k int, a double")
    assert catalog.profile_samples(df, "s", "t", ["k"]).where("column_name = 'a'").first().samples == ["10000000.0", "0.25", "12345678.5"]


def test_declared_types():
    assert [declared_type(x) for x in ("integer", "bigint unsigned", "varchar(20)", "numeric(9)", "numeric(9,2)", "real", "text", "smallint")] == ["int", "decimal(20,0)", "string", "decimal(9,0)", "decimal(9,2)", "float", "string", "smallint"]


def test_descriptions(spark):
    df = spark.createDataFrame([(1, "123456789"), (2, "1234567890"), (3, None), (4, "uncertain"), (5, "Uncertain due to missing samples")], "id int, description string")
    assert [r.needs_description for r in catalog.needs_description(df).orderBy("id").collect()] == [True, False, True, True, False]
    assert [r.escalate for r in catalog.uncertain_split(df).orderBy("id").collect()] == [False, False, False, True, False]


def test_json_object(spark):
    df = spark.createDataFrame([("x {\"a\": 1} y",), ('{"a": 1} {"a": 2}',), ("none",), ("[1]",)], "t string")
    assert [r[0] and r[0].a for r in df.select(json_object(F.col("t"), "a int")).collect()][:2] == [1, None]
    assert df.select(safe_name(F.lit("a/b c"))).first()[0] == "a_b_c"


def test_parser(spark):
    answers = spark.createDataFrame([("d", 1, "- s1.a <-> s2.b \n s2.b <-> s1.a\n* s1.a <-> s2.b\ns1.a <-> s1.c\ns1.a <-> s2.x\ns1.a <-> s2.b <-> s2.b\n　--s1.c--<->　s2.b　")], "domain_id string, response_id int, response string")
    known = spark.createDataFrame([(1, x) for x in ("s1.a", "s1.c", "s2.b")], "response_id int, column_id string")
    assert rows(parse.parse_matches(answers, known).select("col_a", "col_b")) == [("s1.a", "s2.b"), ("s1.c", "s2.b")]
    assert rows(parse.invented_ids(answers, known).select("column_id")) == [("* s1.a",), ("s2.x",)]


def test_mentions_keep_prefix_hits(spark):
    columns = spark.createDataFrame([("d", "s1.t.age", "s1"), ("d", "s2.t.age", "s2"), ("d", "s2.t.age_group", "s2")], "domain_id string, column_id string, source_id string")
    answers = columns.limit(1).withColumn("response", F.lit("see s2.t.age_group"))
    assert len(rows(parse.mention_pairs(answers, columns))) == 2


def test_all_counts_pairs_across_labels(spark):
    truth = spark.createDataFrame([("one", "s1.a", "s2.a"), ("two", "s3.a", "s4.a")], "label string, col_a string, col_b string")
    predicted = spark.createDataFrame([("s1.a", "s2.a"), ("s1.a", "s3.a")], "col_a string, col_b string")
    got = {r.label: (r.tp, r.n_predicted, r.n_truth, r.fp, r.fn, round(r.f1, 4)) for r in evaluate.eval_all(truth, predicted).collect()}
    assert got == {"one": (1, 1, 1, 0, 0, 1.0), "two": (0, 0, 1, 0, 1, 0.0), "ALL": (1, 2, 2, 1, 1, 0.5)}
    nothing = predicted.limit(0)
    assert evaluate.eval_metrics(truth, nothing).first().precision == 0.0
    assert evaluate.eval_metrics(truth.limit(0), predicted).count() == 0


@pytest.mark.parametrize(
    ("tp", "predicted", "truth", "p", "r", "f1"),
    [(5, 6, 16, 0.8333, 0.3125, 0.4545), (27, 28, 35, 0.9643, 0.7714, 0.8571), (13, 14, 15, 0.9286, 0.8667, 0.8966), (6, 7, 6, 0.8571, 1.0, 0.9231), (199, 274, 356, 0.7263, 0.5590, 0.6317), (250, 342, 428, 0.7310, 0.5841, 0.6494), (266, 373, 428, 0.7131, 0.6215, 0.6642)],
)
def test_published_metrics(spark, tp, predicted, truth, p, r, f1):
    """Counts that give published precision, recall and F1."""
    t = spark.range(truth).selectExpr("'x' AS label", "concat('s1.', id) AS col_a", "concat('s2.', id) AS col_b")
    q = spark.range(truth - tp, truth - tp + predicted).selectExpr("concat('s1.', id) AS col_a", "concat('s2.', id) AS col_b")
    got = evaluate.eval_metrics(t, q).first()
    assert (got.tp, got.n_predicted, got.n_truth) == (tp, predicted, truth)
    assert tuple(round(x, 4) for x in (got.precision, got.recall, got.f1)) == (p, r, f1)


def test_groups(spark):
    anchors = spark.createDataFrame([("g", 1, "s1.a", "s1"), ("g", 1, "s2.a", "s2"), ("g", 1, "s1.b", "s1"), ("g", 2, "s2.a", "s2"), ("g", 2, "s1.a", "s1")], "label string, anchor_id int, column_id string, source_id string")
    assert rows(evaluate.gt_pairs_group(anchors).select("col_a", "col_b")) == [("s1.a", "s2.a"), ("s1.b", "s2.a")]


def columns(spark, data):
    return spark.createDataFrame([("d", f"{s}.c{i}", i, s, v) for i, (s, v) in enumerate(data)], "domain_id string, column_id string, ordinal int, source_id string, vector array<float>")


def test_similarity_join(spark, monkeypatch):
    data = [("s1", [1.0, 0.0]), ("s2", [1.0, 0.0]), ("s2", [0.0, 0.0]), ("s3", [1.0, 1.0]), ("s1", [0.0, 2.0])]
    found = {(r.id_a, r.id_b): round(r.score, 6) for r in vectors.similarity_join(columns(spark, data), 0.70710678).collect()}
    assert found == {("s1.c0", "s2.c1"): 1.0, ("s1.c0", "s3.c3"): 0.707107, ("s2.c1", "s3.c3"): 0.707107, ("s3.c3", "s1.c4"): 0.707107}
    assert vectors.similarity_join(columns(spark, data).limit(0)).count() == 0


def test_blocks_find_every_pair_once(spark, monkeypatch):
    draw = np.random.default_rng(1)
    data = [(f"s{i % 3}", draw.normal(size=4).tolist()) for i in range(60)]
    whole = rows(vectors.scored_pairs(columns(spark, data)).select("id_a", "id_b"))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert rows(vectors.scored_pairs(columns(spark, data)).select("id_a", "id_b")) == whole and len(whole) == 60 * 40 // 2
    top = rows(vectors.topk_similar(columns(spark, data), 2).select("column_id", "other_id", "rank"))
    monkeypatch.undo()
    assert rows(vectors.topk_similar(columns(spark, data), 2).select("column_id", "other_id", "rank")) == top


def test_pairs_of_unknown_sources(spark, monkeypatch):
    """A column whose source is unknown is not known to be of another one; only what is asked for leaves a block."""
    data = [("s1", [1.0, 0.0]), (None, [1.0, 0.0]), ("s2", [1.0, 2.0])]
    pairs = vectors.scored_pairs(columns(spark, data), digits=3, only=("id_a", "id_b", "score"))
    assert pairs.columns == ["id_a", "id_b", "score"] and rows(pairs) == [("s1.c0", "s2.c2", 0.447)]
    assert vectors.scored_pairs(columns(spark, data), cross_source=False).count() == 3


def test_pairs_by_score_take_less_room(spark, monkeypatch, tmp_path):
    """F1 of round 3: the same pairs in smaller files, whole where a vector is zero or not a number."""
    draw = np.random.default_rng(3)
    data = [(f"s{i % 3}", v) for i, v in enumerate([[0.0] * 4, [float("nan")] * 4, *draw.normal(size=(58, 4)).tolist()])]
    found = [[(r.id_a, r.id_b, str(r.score)) for r in vectors.scored_pairs(columns(spark, data), digits=2).collect()]]
    for most in (1 << 22, 200):
        monkeypatch.setattr(vectors, "ORDERED", most)
        found.append([(r.id_a, r.id_b, str(r.score)) for r in vectors.scored_pairs(columns(spark, data), digits=2, ordered=True).collect()])
    assert sorted(found[0]) == sorted(found[1]) == sorted(found[2]) and len(found[0]) == 60 * 40 // 2
    known = [[float(s) for _, _, s in x if s != "nan"] for x in found]
    assert known[1] == sorted(known[1]) and known[2] != sorted(known[2])
    monkeypatch.undo()

    monkeypatch.setattr(vectors, "BLOCK", 4096)
    table = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(draw.normal(size=(2000, 64)).tolist())], "vec_id long, label int, embedding array<float>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = vectors.scored_pairs(queries._columns(spark, str(tmp_path)), digits=6, only=("id_a", "id_b", "score"))
    sizes, sums = [], []
    for name, pairs in (("plain", plain), ("query", queries.cosine_pairs(spark, str(tmp_path)))):
        pairs.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        sizes.append(sum(x.stat().st_size for x in (tmp_path / name).glob("*.parquet")))
        sums.append(spark.read.parquet(f"{tmp_path}/{name}").agg(F.count("*"), F.sum(F.xxhash64("id_a", "id_b", "score").cast("decimal(38,0)"))).first())
    assert sums[0] == sums[1] and sizes[1] < 0.8 * sizes[0], sizes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagged_pairs(spark, monkeypatch):
    """Flags of distinct pairs as those of all scored pairs, where ids repeat, a source is unknown and parts are many."""
    draw = np.random.default_rng(2)
    data = [(f"s{i % 3}" if i % 20 else None, draw.normal(size=4).tolist()) for i in range(60)]
    once = columns(spark, data)
    again = once.where("ordinal % 2 = 0").withColumn("vector", F.transform("vector", lambda x: -x * x)).unionByName(once.where("ordinal % 6 = 0"))
    flags = {"in_truth": lambda s: (s >= 0.1) & (s < 0.5), "in_predicted": lambda s: s >= 0.3}
    for table in (once, once.unionByName(again)):
        known = [r for r in table.collect() if r.source_id]
        truth, predicted = set(), set()
        for i, a in enumerate(known):
            for b in known[:i]:
                score = np.dot(a.vector, b.vector) / np.linalg.norm(a.vector) / np.linalg.norm(b.vector)
                if a.source_id != b.source_id:
                    ids = tuple(sorted([a.column_id, b.column_id]))
                    truth |= {ids} if 0.1 <= score < 0.5 else set()
                    predicted |= {ids} if score >= 0.3 else set()
        for block, strip in ((1024, 1 << 18), (7, 30)):
            monkeypatch.setattr(vectors, "BLOCK", block)
            monkeypatch.setattr(vectors, "STRIP", strip)
            pairs = vectors.flagged_pairs(table, flags)
            assert rows(pairs.drop("domain_id")) == sorted((*x, x in truth, x in predicted) for x in truth | predicted)
            assert rows(evaluate.flagged(pairs, in_truth=False, in_predicted=True)) == sorted(predicted - truth)
            assert rows(evaluate.flagged(pairs, in_truth=True, in_predicted=False)) == sorted(truth - predicted)
            assert rows(evaluate.flagged(pairs, in_truth=True, in_predicted=True)) == sorted(truth & predicted)


def test_rows_are_copied_to_few_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    table = columns(spark, [("s1", [1.0, 0.0])] * 100)
    assert vectors._blocks(table, "domain_id", vectors._few_parts).count() == 100 * vectors.PARTS
    monkeypatch.setattr(vectors, "MOST", 4)
    assert vectors._blocks(table, "domain_id", vectors._few_parts).count() == 100 * 25


def test_flagged_metrics(spark):
    """As the scores of truth and predictions in two tables, for labels that share pairs and sources, or have no hits."""
    truth = [("one", "s1.a", "s2.a"), ("one", "s1.b", "s2.a"), ("two", "s1.a", "s2.a"), ("two", "s2.a", "s3.a"), ("three", "s4.a", "s5.a")]
    predicted = [("s1.a", "s2.a"), ("s1.a", "s2.b"), ("s1.a", "s3.a"), ("s2.b", "s3.b"), ("s1.a", "s4.a"), ("s6.a", "s7.a")]
    of = {p: [x for x, *q in truth if tuple(q) == p] for p in {tuple(x[1:]) for x in truth} | set(predicted)}
    schema = "col_a string, col_b string, labels array<string>, in_predicted boolean"
    table = lambda more: spark.createDataFrame([(*p, x + more * bool(x), p in predicted) for p, x in of.items()], schema)
    two = spark.createDataFrame(truth, "label string, col_a string, col_b string"), spark.createDataFrame(predicted, "col_a string, col_b string")
    assert rows(evaluate.flagged_metrics(table([]))) == rows(evaluate.eval_metrics(*two))
    assert rows(evaluate.flagged_metrics(table([evaluate.ALL]))) == rows(evaluate.eval_all(*two))
    assert evaluate.flagged_metrics(table([]).where("size(labels) = 0")).count() == 0
    assert evaluate.flagged_metrics(table([]).withColumn("in_predicted", F.lit(False))).agg(F.sum("n_predicted"), F.sum("f1")).first()[:] == (0, 0.0)


@pytest.mark.parametrize("name", ["eval_all", "eval_metrics"])
def test_only_counts_move(spark, name):
    """Pairs are made once, and counted before anything else."""
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = plan_of(found)
    plan = plan[: plan.find("== Initial Plan ==")]
    assert plan.count("FlatMapGroupsInArrow") == 1 and "ReusedExchange" in plan and "SortMergeJoin" not in plan


#: Queries over pairs that are flagged where they are scored: no exchange of pairs, so no more than those of vectors and sizes.
@pytest.mark.parametrize("name", ["pairs_fp", "fn_examples", "pairs_fn", "pairs_tp"])
def test_pairs_do_not_move(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]


def linkage_by_definition(d, threshold):
    """Clusters by repeatedly joining the pair with the least mean distance below the threshold."""
    clusters = [[i] for i in range(len(d))]
    while len(clusters) > 1:
        far, i, j = min((np.mean([d[a, b] for a in x for b in y]), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        if far >= threshold:
            break
        clusters[i] += clusters.pop(j)
    return sorted(sorted(c) for c in clusters)


def test_average_linkage():
    x = np.random.default_rng(7).normal(size=(14, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(1 - u @ u.T, 0, 2)
    np.fill_diagonal(d, 0)
    merges = cluster.average_linkage(d)
    for t in (0.1, 0.3, 0.6, 0.9, 1.2):
        labels = cluster.cut(14, merges, t)
        assert sorted(sorted(np.flatnonzero(labels == k).tolist()) for k in set(labels)) == linkage_by_definition(d, t)


def test_domains(spark):
    data = [("a", [1.0, 0.01]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.01, 1.0])]
    df = spark.createDataFrame([("all", s, v) for s, v in data], "universe string, source_id string, vector array<double>")
    assert rows(cluster.domains(df).select("domain_id", "source_id")) == [("domain_0", "a"), ("domain_0", "b"), ("domain_1", "c"), ("domain_1", "d")]
    assert cluster.domains(df.limit(3)).count() == 0  # no admissible cut
    assert len(cluster.threshold_sweep()) == 15 and cluster.threshold_sweep()[-1] == 0.75


def test_silhouette_matches_pairs(spark):
    draw = np.random.default_rng(3)
    x, labels = draw.normal(size=(40, 5)), [i % 4 if i else 9 for i in range(40)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(1 - u @ u.T, 0, 2)
    np.fill_diagonal(d, 0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(labels, x)], "label int, v array<double>")
    assert abs(cluster.silhouette(df, "label", "v").first().silhouette - cluster.silhouette_of(d, np.array(labels))) < 1e-9


def small_catalog(spark):
    data = [("s1", "t", "customer_name", 1), ("s1", "t", "city", 2), ("s2", "u", "customer_name", 3), ("s2", "u", "total", 4), ("s3", "w", "zip", 5)]
    df = spark.createDataFrame(data, "source_id string, table_name string, column_name string, ordinal int")
    df = catalog.with_ids(df).withColumns({"data_type": F.lit("str"), "samples": F.array(F.lit("x")), "table_desc": F.lit("About things")})
    return df.withColumn("description", F.when(F.col("ordinal") == 2, F.lit("The city of the customer")))


def test_graph_counts(spark):
    df = small_catalog(spark).withColumn("description", F.lit("d"))
    assert graph.skeleton_nodes(df).count() == 3 + 3 + 5 and graph.skeleton_edges(df).count() == 3 + 5
    near = graph.neighborhood(graph.skeleton_edges(df), spark.createDataFrame([("s1",)], "node_id string"))
    assert {(r.node_id, r.hop) for r in near.collect()} == {("s1", 0), ("s1.t", 1), ("s1.t.customer_name", 2), ("s1.t.city", 2)}


def test_batches(spark):
    docs = spark.range(0, 23).selectExpr("id", "concat('d', id) AS text").repartition(5)
    got = {r.batch_no: (r.n_docs, r.text.split("\n\n===\n\n")[0]) for r in text.batches(docs, "id", "text").collect()}
    assert got == {0: (10, "d0"), 1: (10, "d10"), 2: (3, "d20")}


def test_numbering_over_many_parts(spark):
    df = spark.range(0, 6000).selectExpr("IF(id < 5, NULL, (id * 7919) % 6007) AS k", "id").repartition(7)
    got = [(r.n, r.k) for r in text.numbered(df, "k", "n").orderBy("n").collect()]
    assert [n for n, _ in got] == list(range(6000))
    keys = [-1 if k is None else k for _, k in got]
    assert keys == sorted(keys) and keys.count(-1) == 5


def test_resume(spark):
    pairs = spark.createDataFrame([("d", f"a{i:02}", "b") for i in range(25)], "domain_id string, source_a string, source_b string")
    left = candidates.resume_pending(pairs, pairs.where("source_a < 'a03'"))
    assert rows(left.select("position", "checkpoint"))[-1] == (21, 2) and left.count() == 22


class Failing:
    def complete(self, prompts):
        raise RuntimeError("no service")


class Pairs:
    """Answers with the columns of equal names."""

    def complete(self, prompts):
        out = []
        for p in prompts:
            first, second = p.split("\n", 1)[1].split("\n---\n")
            out.append("\n".join(f"- {a} <-> {b}" for a in first.split("\n") for b in second.split("\n") if a.split(".")[-1] == b.split(".")[-1]))
        return out


def test_alignment(spark):
    done = alignment.enrich(small_catalog(spark), providers.TemplateCompletion(), providers.TemplateCompletion(certain=True))
    assert done.where("description IS NULL").count() == 0 and done.where("ordinal = 2").first().description == "The city of the customer"
    placed = alignment.with_domains(done, providers.HashingEmbedding(64)).withColumn("domain_id", F.lit("domain_0"))
    nodes, edges, pairs = alignment.knowledge_graph(placed, providers.HashingEmbedding(64), 0.95, augmented=False)
    assert {tuple(sorted((r.id_a, r.id_b))) for r in pairs.collect()} == {("s1.t.customer_name", "s2.u.customer_name")}
    assert edges.count() == 8 + 1 and nodes.count() == 11
    found = alignment.matches(placed, alignment.ask(placed, None, Pairs()))
    truth = spark.createDataFrame([("t", "s1.t.customer_name", "s2.u.customer_name")], "label string, col_a string, col_b string")
    assert {r.label: r.f1 for r in alignment.scored(found, truth).collect()} == {"t": 1.0, "ALL": 1.0}


def test_failures_are_no_descriptions(spark):
    done = alignment.enrich(small_catalog(spark), Failing(), Failing())
    assert done.where("description IS NOT NULL").count() == 1
    assert done.where("status LIKE 'RuntimeError%'").count() == 4


def test_uncertain_answers_escalate(spark):
    df = spark.createDataFrame([("a\tstr\t[]",), ("b\tstr\t[\"1\"]",)], "prompt string")
    tiers = {r.prompt[0]: r.tier for r in providers.two_tier(df, "prompt", providers.TemplateCompletion(), providers.TemplateCompletion(True)).collect()}
    assert tiers == {"a": "large", "b": "small"}


def test_answers_with_noise(spark):
    """Bullets, both orientations, unknown ids, one source, two arrows, white space."""
    answers = [
        ("domain_0", 1, "Here are the matches:\n- s1.t.a <-> s2.t.a\ns2.t.a <-> s1.t.a\n--s1.t.b<->s2.t.b.c  \n* s1.t.c <-> s2.t.c\ns1.t.a <-> s1.t.b"),
        ("domain_0", 2, "s1.t.a <-> s3.t.x\ns1.t.a <-> s3.t.x <-> s1.t.b\ns1.t.zz <-> s3.t.x\n s3.t.y <-> s1.t.b\nnone"),
        ("domain_1", 3, ""),
        ("domain_1", 4, "   s8.t.q <-> s9.t.q \nS8.t.q <-> s9.t.q\n-s8.t.r- <-> -s9.t.q"),
    ]
    known = [(1, c) for c in ("s1.t.a", "s1.t.b", "s1.t.c", "s2.t.a", "s2.t.b.c")] + [(2, c) for c in ("s1.t.a", "s1.t.b", "s3.t.x", "s3.t.y")] + [(4, c) for c in ("s8.t.q", "s8.t.r", "s9.t.q")]
    frames = spark.createDataFrame(answers, "domain_id string, response_id int, response string"), spark.createDataFrame(known, "response_id int, column_id string")
    assert {tuple(r) for r in parse.parse_matches(*frames).collect()} == {("domain_0", 1, "s1.t.a", "s2.t.a"), ("domain_0", 1, "s1.t.b", "s2.t.b.c"), ("domain_0", 2, "s1.t.a", "s3.t.x"), ("domain_0", 2, "s3.t.y", "s1.t.b"), ("domain_1", 4, "s8.t.q", "s9.t.q")}
    assert ("s1.t.zz") in {r.column_id for r in parse.invented_ids(*frames).collect()}


def test_mentions_in_parts(spark, monkeypatch):
    """Every part of a domain's answers meets every id; ids inside ids, of the own source and of other domains."""
    monkeypatch.setattr(parse, "SCAN_ROWS", 3)
    columns = [("d", f"s{k % 3}.t.c{k}", f"s{k % 3}") for k in range(20)] + [("e", "s7.t.c1", "s7")]
    said = [("d", c, s, f"maybe s0.t.c12, s1.t.c1 or s7.t.c1 {c}") for d, c, s in columns if d == "d"] + [("d", "s0.t.c0", "s0", None)]
    got = {tuple(r) for r in parse.mention_pairs(spark.createDataFrame(said, "domain_id string, column_id string, source_id string, response string"), spark.createDataFrame(columns, "domain_id string, column_id string, source_id string")).collect()}
    want = set()
    for d, c, s, text in said[:-1]:
        want |= {(d, min(c, o), max(c, o)) for e, o, t in columns if e == d and t != s and o in text}
    assert got == want and len(got) > 10


def test_numbering_in_levels(spark, monkeypatch):
    """Many parts, found in two steps; nulls, ties and equal rows."""
    monkeypatch.setattr(text, "WIDTH", 8)
    rows = [(None, 0)] * 3 + [((k * 7919) % 500, k) for k in range(3000)] + [(77, 1)] * 200
    df = spark.createDataFrame(rows, "k long, v long")
    got = text.numbered(df, "k", "n", part_rows=60).collect()
    assert sorted(r.n for r in got) == list(range(len(rows)))
    keys = [r.k for r in sorted(got, key=lambda r: r.n)]
    assert keys == [None] * 3 + sorted(k for k, _ in rows if k is not None)
    assert [r.n for r in text.numbered(df.where("k = 9"), "k", "n").orderBy("n").collect()] == list(range(6))
    assert text.numbered(df.limit(0), "k", "n").count() == 0


def test_samples_beyond_the_first_rows(spark):
    rows = [(k, str(k) if k in (40, 45, 46, 60) else None, float(k), None) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, rare string, x double, never string")
    got = {r.column_name: r.samples for r in catalog.profile_samples(df, "s", "t", ["k"], first=20).collect()}
    assert got == {"k": ["0", "1", "2"], "rare": ["40", "45", "46"], "x": ["0.0", "1.0", "2.0"], "never": []}


def test_types_of_first_rows(spark):
    rows = [(k, "7" if k < 5 else "word", "1.5" if k != 2 else None, None, "3" if k != 1 else None, k % 2 == 0, "1e3", f"v{k}") for k in range(9)]
    df = spark.createDataFrame(rows, "k long, late string, part string, none string, gap string, flag boolean, e string, s string")
    got = {r.column_name: r.data_type for r in catalog.profile_head_types(df, "s", "t", ["k"]).collect()}
    assert got == {"k": "int64", "late": "int64", "part": "float64", "none": "float64", "gap": "float64", "flag": "bool", "e": "float64", "s": "str"}


class Answers:
    def __init__(self, *answers):
        self.answers = answers

    def complete(self, prompts):
        return [next((a for k, a in self.answers if k in p), "no idea") for p in prompts]


class Late:
    def complete(self, prompts):
        raise TimeoutError("late")


def test_extraction(spark):
    docs = spark.createDataFrame([("s1", "about cranes"), ("s2", "about fish"), ("s2", "about nothing")], "source_id string, text string")
    provider = Answers(
        ("cranes", 'Found: {"entities": [{"name": "crane", "type": "THING", "description": "lifts"}, {"name": "quay", "type": "PLACE"}], "relations": [{"src": "crane", "tgt": "quay", "description": "stands on"}, {"src": "crane", "tgt": "moon"}]}'),
        ("fish", '{"entities": [{"name": "fish"}, {"type": "x"}]}'),
    )
    nodes, edges = providers.extract(docs, "text", provider)
    assert {(r.node_id, r.node_type, r.source_id) for r in nodes.collect()} == {("crane", "THING", "s1"), ("quay", "PLACE", "s1"), ("fish", None, "s2")}
    assert [(r.src_id, r.tgt_id, r.weight, r.description) for r in edges.collect()] == [("crane", "quay", 1.0, "stands on")]
    assert [t.count() for t in providers.extract(docs, "text")] == [0, 0] == [t.count() for t in providers.extract(docs, "text", Late())]


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "X"), ("b", "X")], "node_id string, node_type string")
    edges = spark.createDataFrame([("a", "b")], "src_id string, tgt_id string")
    store = graph.GraphStore(spark, str(tmp_path), "domain_1")
    assert not store.exists()
    store.write(nodes, edges)
    graph.GraphStore(spark, str(tmp_path), "domain_2").write(nodes.limit(1), edges.limit(0))
    assert store.read()[0].count() == 2 and graph.indexed_domains(spark, str(tmp_path), ["domain_1", "domain_3"]) == ["domain_1"]
    assert {(r.node_id, r.hop) for r in store.around(nodes.where("node_id = 'a'").select("node_id")).collect()} == {("a", 0), ("b", 1)}


def test_enriched_sources_and_tables(spark):
    rows = [("s1", "A usable description", None, [("t", ["a"])]), ("s2", "short", "{}", [("t", ["a"]), ("u", ["b"])]), ("s3", None, None, [])]
    sources = spark.createDataFrame(rows, "source_id string, description string, metadata string, inventory array<struct<table_name:string,columns:array<string>>>")
    got = {r.source_id: (r.description, r.status) for r in alignment.enrich_sources(sources, providers.InventoryCompletion()).collect()}
    assert got == {"s1": ("A usable description", "given"), "s2": ("Holds the tables t, u.", "ok"), "s3": ("Uncertain", "ok")}
    got = {r.source_id: (r.description, r.status) for r in alignment.enrich_sources(sources, Late()).collect()}
    assert got["s1"][1] == "given" and got["s2"] == (None, "TimeoutError: late")
    columns = spark.createDataFrame([("s1", "t", "a", 0, "int64", ["1"]), ("s1", "t", "b", 1, "str", [])], "source_id string, table_name string, column_name string, ordinal int, data_type string, samples array<string>")
    assert [tuple(r) for r in alignment.enrich_tables(columns, providers.InventoryCompletion()).collect()] == [("s1", "t", "Holds the columns a, b.", "ok")]
    assert alignment.enrich_tables(columns, Late()).first().description is None


def test_questions_over_the_graph(spark):
    nodes = spark.createDataFrame([("s1.t.a", "weight", [1.0, 0.0]), ("s2.t.a", "mass", [0.9, 0.1]), ("s3.t.z", "name", [0.0, 1.0]), ("s1.t", "table", None)], "node_id string, description string, vector array<double>")
    edges = spark.createDataFrame([("s1.t.a", "s1.t")], "src_id string, tgt_id string")
    asked = spark.createDataFrame([("q", "What is heavy?", [1.0, 0.0])], "question_id string, text string, vector array<double>")
    got = {(r.node_id, r.hop, r.score) for r in alignment.retrieved(asked, nodes, edges, k=2).collect()}
    assert got == {("s1.t.a", 0, 1.0), ("s2.t.a", 0, 0.993884), ("s1.t", 1, 1.0)}
    provider = Answers(("s1.t.a: weight\ns2.t.a: mass\ns1.t: table\n\nWhat is heavy?", "both"))
    assert [(r.answer, r.status) for r in alignment.answered(asked, nodes, edges, provider, k=2).collect()] == [("both", "ok")]
    assert alignment.answered(asked, nodes, edges, Late(), k=2).first().answer is None
    assert alignment.retrieved(asked.limit(0), nodes, edges, k=2).count() == 0


def test_asking_for_domains_and_columns(spark):
    texts = spark.createDataFrame([("s1", "cranes"), ("s2", "ships"), ("s3", "fish")], "source_id string, text string")
    provider = Answers(("s1: cranes\ns2: ships\ns3: fish", 'So: {"domains": [{"name": "port", "sources": ["s1", "s2", "s9"]}, {"name": "food", "sources": ["s3", "s1"]}]} ok?'))
    assert {tuple(r) for r in alignment.propose_domains(texts, provider).collect()} == {("port", "s2"), ("food", "s1"), ("food", "s3")}
    assert alignment.propose_domains(texts, Late()).count() == 0 == alignment.propose_domains(texts, Answers()).count()
    rows = [("d", f"s{k}.t.c", f"s{k}", "a weight", "float64", ["1.5"]) for k in range(3)]
    columns = spark.createDataFrame(rows, "domain_id string, column_id string, source_id string, description string, data_type string, samples array<string>")
    assert {tuple(r) for r in alignment.ask_columns(columns, Answers(("same as s0.t.c?", "s1.t.c, clearly"))).collect()} == {("d", "s0.t.c", "s1.t.c")}
