"""Inputs on which an operator once did less than the whole job."""

import collections
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from columnloom.llm import chat, common, exact_dedup, html_extract, language_id, near_embeddings, ngram_join, packing, token_counts, toxicity


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def at_cosine(draw, base, cosine):
    """A unit vector at the given cosine to ``base``."""
    other = draw.normal(size=base.shape)
    other = unit(other - (other @ base) * base)
    return cosine * base + np.sqrt(1 - cosine**2) * other


def group(draw, centre, n):
    """n different vectors with cosines of about 0.999 to one another."""
    return unit(centre + draw.normal(size=(n, len(centre))) * 0.032 / np.sqrt(len(centre)))


def missing(spark, vectors, threshold=near_embeddings.THRESHOLD):
    """(links not found, links, wrong components) of one label, against brute force."""
    x = np.asarray(vectors, np.float64)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_embeddings.near_embeddings(df, threshold).collect()}
    near = unit(x) @ unit(x).T >= threshold
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    while True:
        least = np.minimum(component, np.where(near, component[None, :], len(x)).min(1))
        if (least == component).all():
            break
        component = least
    n_links = np.array([got[i].n_links for i in range(len(x))])
    assert (n_links <= near.sum(1)).all()
    return int(near.sum() - n_links.sum()), int(near.sum()), sum(got[i].component_id != c or got[i].kept != (i == c) for i, c in enumerate(component.tolist()))


def test_links_between_full_lists(spark):
    """Two tight groups, each larger than any list, 0.95 apart: every list is full of its own group."""
    draw = np.random.default_rng(11)
    a = unit(draw.normal(size=64))
    twins = np.concatenate([group(draw, a, 80), group(draw, at_cosine(draw, a, 0.95), 80)])
    lost, links, wrong = missing(spark, np.concatenate([twins, draw.normal(size=(300, 64))]))
    assert links == 160 * 159 and (lost, wrong) == (0, 0), (lost, links, wrong)


def test_small_groups_beside_a_hot_one(spark, monkeypatch):
    """The links of a hot group must not outvote isolated pairs that a sparse graph misses."""
    monkeypatch.setattr(near_embeddings, "TABLES", 1)
    monkeypatch.setattr(near_embeddings, "ROUNDS", 0)
    draw = np.random.default_rng(12)
    alone = unit(draw.normal(size=(500, 64)))
    pairs = np.stack([at_cosine(draw, x, 0.94) for x in alone[:60]])
    hot = unit(draw.normal(size=64)) + draw.normal(size=(150, 64)) * 1e-6
    lost, links, wrong = missing(spark, np.concatenate([hot, alone, pairs]))
    assert links == 150 * 149 + 2 * 60 and (lost, wrong) == (0, 0), (lost, links, wrong)


def test_audit_counts_each_class(spark):
    """Three of 30 pairs missing beside a group of 150 with all its links."""
    draw = np.random.default_rng(14)
    alone = unit(draw.normal(size=(30, 64)))
    x = np.concatenate([group(draw, unit(draw.normal(size=64)), 150), alone, np.stack([at_cosine(draw, v, 0.94) for v in alone])])
    classes = spark.createDataFrame([(i, 1, bytearray(v.tobytes()), 1, i) for i, v in enumerate(x)], "rep long, space long, unit binary, copies long, least long")
    near = unit(x) @ unit(x).T >= 0.93
    n = near.sum(1) - 1
    n[[150, 180, 151, 181, 152, 182]] = 0
    found = lambda n: spark.createDataFrame([(i, int(k)) for i, k in enumerate(n) if k], "rep long, links long")
    assert near_embeddings.audit(classes, found(n), 0.93) == 0.9
    assert near_embeddings.audit(classes, found(near.sum(1) - 1), 0.93) == 1


def test_links_without_a_graph(spark, monkeypatch):
    """A neighbour graph that finds nothing, however often it is built, loses no link."""
    build = near_embeddings.neighbour_graph
    monkeypatch.setattr(near_embeddings, "ROUNDS", 0)
    monkeypatch.setattr(near_embeddings, "neighbour_graph", lambda *args: build(*args).limit(0))
    draw = np.random.default_rng(13)
    alone = unit(draw.normal(size=(50, 64)))
    lost, links, wrong = missing(spark, np.concatenate([alone, np.stack([at_cosine(draw, x, 0.94) for x in alone[:20]])]))
    assert links == 40 and (lost, wrong) == (0, 0), (lost, links, wrong)


def test_failed_audit_raises(spark, monkeypatch):
    """Links that stay missing are an error, not a result."""
    across, build = near_embeddings._across, near_embeddings.neighbour_graph
    monkeypatch.setattr(near_embeddings, "ROUNDS", 0)
    monkeypatch.setattr(near_embeddings, "neighbour_graph", lambda *args: build(*args).limit(0))
    monkeypatch.setattr(near_embeddings, "_across", lambda *args: across(*args).limit(0))
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="0.0000"):
        near_embeddings.near_embeddings(df)


def test_lists_hold_different_neighbours(spark):
    """One pair with two values in the last bits takes one place of a list."""
    edges = spark.createDataFrame([(1, 2, 0.99), (1, 2, 0.9900001), (1, 3, 0.98), (1, 4, 0.97)], "a long, b long, sim double")
    row = near_embeddings._lists(edges, None, 2, "test-lists").first()
    assert [(e.b, e.sim) for e in row.near] == [(2, 0.9900001), (3, 0.98)]


@pytest.mark.parametrize("start", ["<body><article><p>", "<article><p>", "<head><p>", "<span>", "<br>", "", "<!-- c --> <script>x</script><p>"])
def test_head_without_end_tag(start):
    """A head whose end tag is left out ends where the body starts, by an element or by text."""
    page = "<html><head><title>t</title><meta charset=utf-8> <style>b</style>\n" + start
    assert [b.text for b in html_extract.blocks(page + "Hi")] == ["Hi"]
    assert [b.text for b in html_extract.blocks(page + "Hi</head><p>there")] == ["Hi", "there"]


def test_page_without_head_end(spark):
    page = "<html><head><title>t</title><body><article><p>A longer sentence stands in this article.</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_extract.extract(df, html_extract.fit()).first().text == "A longer sentence stands in this article."


MARKUP = [
    ("<p title=it's>First</p><p>2", ["First", "2"]),
    ('<p title="it>First</p><p class="b">2', ["First", "2"]),
    ('<p title="a>b">F', ["F"]),
    ("<p a='x\"y' b=\"q'z\">A<p onclick=\"if(a>b){}\">B", ["A", "B"]),
    ("<object data=x><p>A", ["A"]),
    ("<object data=x><p>A</object><p>B", ["B"]),
    ("<canvas><p>A</p><svg><path d=1><p>B", ["A", "B"]),
    ("<svg/><p>A<svg><title>t</title><text>x</text></svg>", ["A"]),
    ("<script src=/js/>alert(1)</script>B", ["B"]),
    ("<iframe src=x><p>A", ["A"]),
    ("<!--><p>A<!-- x --!>B", ["AB"]),
    ("a < b <3 </> c", ["a < b <3 c"]),
    ("<script>x<p>B", []),
    ("<table><tr><td>A<td>B<tr><td>C</table><dl><dt>D<dd>E</dl>", ["A", "B", "C", "D", "E"]),
]


@pytest.mark.parametrize(("page", "want"), MARKUP)
def test_markup(page, want):
    """Odd quotes, hidden elements without end, omitted end tags."""
    assert [b.text for b in html_extract.blocks(page)] == want


@pytest.mark.parametrize("piece", ['<p a="', "<object><p>x", "<div><iframe>", "<p a=   ", "<div>x", "<ul><li>x", "<!--", "<svg>", "&amp;<b"])
def test_very_long_pages(piece):
    """Parsing takes time in proportion to the page, and every text is there."""
    start = time.perf_counter()
    found = html_extract.blocks(piece * 20_000 + "<p>end")
    assert time.perf_counter() - start < 5
    assert sum(b.text == "x" for b in found) == (20_000 if piece.endswith("x") else 0)
    assert len(html_extract.vectors(found)) == len(found)


def test_many_languages(spark):
    """210 languages, each with letters of its own; the last ten have fewer documents."""
    draw = np.random.default_rng(15)
    ids = iter([i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2])  # none of them held out
    rows = [(next(ids), "".join(map(chr, 0x4E00 + 20 * k + draw.integers(0, 20, 60))), f"x{k:03}") for k in range(210) for _ in range(2 if k < 200 else 1)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: lang for i, _, lang in rows}


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, ngram_join.drop_near_copies])
def test_row_keys_survive_other_splits(spark, tmp_path, monkeypatch, drop):
    """The same rows stay when the files are split in another way in every scan."""
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(12)]
    rows = [(i, texts[i % 12], 900 + i) for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, path int").repartition(3).write.option("parquet.block.size", 2048).parquet(path)
    docs = spark.read.parquet(path).where("doc_id <> 5")
    want = sorted(tuple(r) for r in drop(docs).collect())
    assert len(want) == 12
    parts, write = iter([1, 9, 4, 17, 2, 13, 6, 3, 11, 5, 8, 7] * 9), common.staged

    def shifting(df, name):
        out = write(df, name)
        spark.conf.set("spark.sql.files.minPartitionNum", next(parts))
        spark.conf.set("spark.sql.files.maxPartitionBytes", 512 * next(parts))
        return out

    monkeypatch.setattr(common, "staged", shifting)
    for module in (exact_dedup, ngram_join):
        monkeypatch.setattr(module, "staged", shifting)
    try:
        assert sorted(tuple(r) for r in drop(docs).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_keys_of_other_frames(spark):
    """Rows that don't come straight from a scan are staged with their keys."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a b c d e ', id % 4) AS text")
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs.union(docs.limit(3))).collect()) == [36, 37, 38, 39]
    key = common.keyed(docs, "k")
    assert [r.k for r in key.orderBy("doc_id").collect()] == [r.k for r in key.orderBy("doc_id").collect()]


def test_index_deals_itself_into_more_shards(spark, monkeypatch):
    """An index that grows keeps its shards small, and finds old digests in them."""
    monkeypatch.setattr(exact_dedup, "MIN_SHARDS", 1)
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 50)
    docs = spark.range(300).selectExpr("id AS doc_id", "cast(id % 200 AS string) AS text")
    rows = common.staged(exact_dedup.digests(docs), "test-digests")
    index = exact_dedup.DedupIndex.build(rows.where("doc_id < 40"), 40).insert(rows.where("doc_id >= 40"))
    assert index.n_shards >= 4 and index.content.count() == 200
    assert index.content.where("n = 2").count() == 100


def test_discarded_tables(spark):
    import os

    table = common.staged(spark.range(3), "test-discard")
    assert os.path.isdir(table.staged_path)
    common.discard(table, spark.range(2), None)
    assert not os.path.isdir(table.staged_path)


def plain_kneser_ney(texts, order=4):
    """Interpolated Kneser-Ney in dictionaries of strings; returns the probability of a string's last character."""
    stream = " " * (order - 1) + "".join(texts) + " "
    grams = {k: [stream[i - k + 1 : i + 1] for i in range(order, len(stream))] for k in range(1, order + 1)}
    counts = {order: collections.Counter(grams[order])}
    for k in range(1, order):
        counts[k] = collections.Counter(dict.fromkeys(grams[k], 0))
        for g in set(grams[k + 1]):
            counts[k][g[1:]] += 1
        counts[k] = collections.Counter({g: max(n, 1) for g, n in counts[k].items()})
    discount, total, kinds = {}, {}, {}
    for k, own in counts.items():
        n1, n2 = (sum(n == x for n in own.values()) for x in (1, 2))
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[k], kinds[k] = collections.Counter(), collections.Counter()
        for g, n in own.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / language_id.ALPHABET
        if not total[k][g[:-1]]:
            return p(g[1:])
        d = discount[k]
        return (max(counts[k][g] - d, 0) + d * kinds[k][g[:-1]] * p(g[1:])) / total[k][g[:-1]]

    return p


def test_plain_kneser_ney():
    """Cross-entropies of several languages, one of which lacks most n-grams, against the definition."""
    draw = np.random.default_rng(21)
    text = lambda letters, n: "".join(draw.choice(list(letters), n))
    train = {"a": [text("abc ", 300), text("abde ", 200)], "b": [text("bcxyz ", 400)], "c": [text("öüß ", 30)]}
    models = language_id.LanguageModels({k: language_id.KneserNey([language_id.codepoints(t) for t in v]) for k, v in train.items()})
    as_read = lambda t: "".join(map(chr, language_id.codepoints(t).tolist()))
    plain = {k: plain_kneser_ney([as_read(t) for t in v]) for k, v in train.items()}
    for sample in ["abc abd", text("abcxyzö ", 200), "q", "日本 語", text("öüß", 40)]:
        seen = " " * 3 + as_read(sample)
        want = [-sum(math.log(plain[k](seen[i - 3 : i + 1])) for i in range(4, len(seen))) / (len(seen) - 4) for k in models.languages]
        assert np.allclose(models.cross_entropy(language_id.codepoints(sample)), want, rtol=1e-5), sample


def test_table_of_met_ngrams(monkeypatch):
    """What comes from the table is what a new model computes, also where the table is too small and starts anew."""
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcdefgh éü", k=draw.randint(1, 3000))) for _ in range(60)]
    kept, new = (language_id.LanguageModels({k: language_id.KneserNey([language_id.codepoints(t) for t in texts[n : n + 5]]) for n, k in enumerate("xyz")}) for _ in range(2))
    for size in (32_000_000, 200_000):
        monkeypatch.setattr(language_id, "MET_BYTES", size)
        for t in texts * 2:
            cp = language_id.codepoints(t)
            if len(cp) > 1:
                new._forget()
                assert np.array_equal(kept.cross_entropy(cp), new.cross_entropy(cp))
    assert len(kept.met) > 1000


def test_language_of_long_documents(spark):
    """A language that has only long documents is learned from its shortest; letters of any plane count."""
    texts = {"xx": "lorem ipsum dolor sit amet " * 2000, "yy": "alpha beta gamma delta epsilon " * 3, "zz": "\U00030001\U00030005 \U00030010 " * 5}
    ids = iter([i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2])
    rows = [(next(ids), t, lang) for lang, t in texts.items() for _ in range(3)]
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {(i, lang) for i, _, lang in rows}


def test_scored_branches(spark):
    """Random forests, trees with several roots and null trees, against a plain walk."""
    draw = np.random.default_rng(8)
    rows = []
    for n in range(400):
        tree = int(draw.integers(0, 12))
        tree = None if tree > 8 else tree
        same = [m for m in rows if m[0] == tree]
        parent = None if not same or draw.random() < 0.08 else same[int(draw.integers(max(0, len(same) - 6), len(same)))][1]
        rows.append((tree, n, parent, "assistant" if n % 2 else "user", f"t{n}", float(draw.integers(-3, 4))))
    by = {r[1]: r for r in rows}

    def path(n):
        return ([] if by[n][2] is None else path(by[n][2])) + [n]

    leaves: dict = {}
    for n in set(by) - {r[2] for r in rows}:
        way = path(n)
        leaves.setdefault((by[n][0], way[0] if by[n][0] is None else None), []).append((-sum(by[k][5] for k in way), -len(way), n, way))
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    for branches in (1, 3):
        want = {(by[n][0], n, -score, tuple(f"t{k}" for k in way)) for own in leaves.values() for score, _, n, way in sorted(own)[:branches]}
        got = {(r.tree, r.leaf, r.path_score, tuple(t for _, t in chat.read_turns(r.formatted))) for r in chat.format_reply_trees(df, branches).collect()}
        assert got == want


def test_byte_ids_of_odd_texts():
    """Ids of texts with any white space, signs and added tokens, against the library on whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = packing.ByteBpe(path), Tokenizer.from_file(path)
    draw = random.Random(4)
    units = [" ", " ", " ", "\n", "  ", "\t", "\r\n", "\u00a0", "\x1c", "\u2028", "\u3000", "a", "it's", "'ll", "Word", "12", "3456", "...", "!?", "é", "日本", "👍🏽", "\u0301", "<|endoftext|>", "<|end", "x" * 90, "_", "\x85", "\x00"]
    for _ in range(20_000):
        text = "".join(draw.choices(units, k=draw.randint(0, 14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_large_group_of_near_copies(spark):
    """A group beyond every block, with pairs that the pivot tells and pairs that it doesn't, a chain and a tight part."""
    draw = random.Random(6)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for n in range(1600):
        words = list(base)
        for k in draw.sample(range(90), draw.choice([0, 1, 1, 1, 2, 2, 3, 5])):
            words[k] = f"x{draw.randint(0, 3)}"
        texts.append(" ".join(words[draw.choice([0, 0, 0, 3]) :]))
    texts += [" ".join(f"c{k}" for k in range(s, s + 70)) for s in range(0, 120, 3)]
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    kinds = list(dict.fromkeys(sets))
    copies = collections.Counter(sets)
    index = {s: k for k, s in enumerate({w for s in kinds for w in s})}
    x = np.zeros((len(kinds), len(index)), np.float32)
    for k, s in enumerate(kinds):
        x[k, [index[w] for w in s]] = 1
    both, size = x @ x.T, x.sum(1)
    linked = 9 * both >= 4 * (size[:, None] + size[None, :])
    many = np.array([copies[s] for s in kinds])
    want = dict(zip(kinds, (linked @ many - 1).tolist(), strict=True))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.ngram_join(df).collect()}
    assert len(kinds) > 2 * ngram_join.BUCKET_ROWS
    assert [got[k].n_links for k in range(len(texts))] == [want[s] for s in sets]
    least = np.array([sets.index(s) for s in kinds])
    while (lower := np.where(linked, least[None, :], len(texts)).min(1)).tolist() != least.tolist():
        least = lower
    class_of = dict(zip(kinds, least.tolist(), strict=True))
    assert [got[k].class_id for k in range(len(texts))] == [class_of[s] for s in sets]


def spread(draw, centre, n, angle):
    """n vectors at angles up to about ``angle`` from the centre."""
    return np.stack([at_cosine(draw, centre, np.cos(a)) for a in draw.uniform(0, angle, n)])


def test_dense_groups(spark, monkeypatch):
    """Spread groups with fuller neighbourhoods than lists hold, bridges between them, outsiders at their edges."""
    for name, value in (("MAX_NEIGHBOURS", 4), ("NEIGHBOURS", 2), ("BLOCK", 16), ("CELL", 64), ("BUCKET", 32), ("PART", 16), ("SLICE", 24), ("RECALL", 0.0)):
        monkeypatch.setattr(near_embeddings, name, value)
    monkeypatch.setattr(near_embeddings, "_across", None)  # nothing but the method itself may find the links
    draw = np.random.default_rng(31)
    a = unit(draw.normal(size=32))
    b = at_cosine(draw, a, np.cos(0.55))
    groups = [spread(draw, a, 150, 0.25), spread(draw, b, 120, 0.3), spread(draw, unit(draw.normal(size=32)), 90, 0.9), group(draw, unit(draw.normal(size=32)), 200)]
    alone = unit(draw.normal(size=(200, 32)))
    edge = spread(draw, groups[0][3], 10, 0.4)
    pairs = np.stack([at_cosine(draw, v, 0.94) for v in alone[:40]])
    lost, links, wrong = missing(spark, np.concatenate([*groups, alone, edge, pairs]))
    assert links > 20_000 and (lost, wrong) == (0, 0), (lost, links, wrong)


def test_outside_of_dense_components(spark, monkeypatch):
    """A graph that lacks every edge between two components with dense classes loses no link between them or to others."""
    monkeypatch.setattr(near_embeddings, "_across", None)
    monkeypatch.setattr(near_embeddings, "CELL", 32)
    draw = np.random.default_rng(32)
    a = unit(draw.normal(size=32))
    x = np.concatenate([spread(draw, a, 80, 0.12), spread(draw, at_cosine(draw, a, 0.95), 80, 0.12), spread(draw, at_cosine(draw, a, 0.95), 20, 0.1), unit(draw.normal(size=(60, 32)))])
    part = [0] * 80 + [80] * 80 + list(range(160, len(x)))

    def graph(classes, *rest):
        rows = classes.join(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "i long, raw binary"), F.col("vector") == F.col("raw")).select("rep", "i").collect()
        rep = {r.i: r.rep for r in rows}
        edges = [(rep[i], rep[part[i]], True) for i in range(160) if part[i] != i]
        return spark.createDataFrame(edges + [(b, a, True) for a, b, _ in edges], "a long, b long, dense boolean")

    monkeypatch.setattr(near_embeddings, "neighbour_graph", graph)
    monkeypatch.setattr(near_embeddings, "RECALL", 0.0)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_embeddings.near_embeddings(df).collect()}
    near = unit(x) @ unit(x).T >= near_embeddings.THRESHOLD
    want = near.sum(1) - 1
    want[160:] -= near[160:, 160:].sum(1) - 1  # links among classes outside of both components are the graph's business
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_very_long_words():
    """They leave nothing behind, and count as they would alone."""
    trie = token_counts.model(public_tokenizers.path("piece_bpe_32k.model"))
    n = trie.count("hello")
    held = len(trie.best), len(trie.pieces), len(trie.child), len(trie.counts)
    long = "hello" * 60_000
    assert trie.count(long) == trie.count(long) > 30_000 and trie.count("hello") == n
    assert (len(trie.best), len(trie.pieces), len(trie.child), len(trie.counts)) == held


def test_broadcasts_have_a_bound(spark):
    keys, names = spark.range(1).toDF("k"), spark.range(1).selectExpr("id AS k", "'x' AS name")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small_side(keys, 1_000_000)) and not hinted(common.small_side(keys, 3_000_000))
    assert hinted(common.small_side(names, 100_000)) and not hinted(common.small_side(names, 1_000_000))


def test_toxicity_at_scale(spark):
    """Held-out documents of a larger table: most toxic ones are caught, clean ones left alone."""
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    found = toxicity.toxicity(spark.read.parquet(f"{path}/documents.parquet"), labels)
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))
