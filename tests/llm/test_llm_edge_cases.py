"""What every operator must bear: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from columnloom.llm import bpe, chat, exact_dedup, html_extract, language_id, near_embeddings, ngram_join, packing, token_counts, toxicity

WORD, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    (1, "the cat sat on the mat and the dog lay by the door", "en"), (2, "THE CAT sat on the mat and the dog lay by the door", "en"), (3, None, "en"), (4, "", None), (5, "  \n\t ", "fr"),
    (6, "le chat est sur le tapis et le chien dort près de la porte", "fr"), (6, "le chat est sur le tapis et le chien dort près de la porte", "fr"), (None, "no id here at all my friend", "en"),
    (8, "word " * 60_000, "en"), (9, "x" * 100_000, None), (10, "12345 !!! ###", "en"), (11, "été 日本語 👍🏽 \x1c <|endoftext|> It's", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    extra = {c: F.lit(7) for c in ("row_key", "digest", "n", "score", "shard", "rep", "signature", "batch", "label", "source", "held_out")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


MAPS = {
    "op1": lambda d, lab: ngram_join.ngram_join(d), "op2": toxicity.toxicity, "op4": lambda d, lab: language_id.identify(d), "op7": lambda d, lab: bpe.encode_documents(d, WORD, digests=True),
    "op8": lambda d, lab: exact_dedup.exact_dedup(d), "op10": lambda d, lab: token_counts.token_counts(d, PIECES),
}


@pytest.mark.parametrize("name", MAPS)
def test_one_row_per_row(docs, labels, name):
    got = MAPS[name](docs, labels)
    assert sorted(r.doc_id or 0 for r in got.collect()) == sorted(t[0] or 0 for t in TEXTS)


@pytest.mark.parametrize("name", MAPS)
def test_empty_tables(docs, labels, name):
    assert MAPS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_exact_dedup(docs):
    got = {(r.doc_id, r.row_key): r for r in exact_dedup.exact_dedup(docs).collect()}
    by_id = {}
    for (i, _), r in got.items():
        by_id.setdefault(i, []).append(r)
    assert by_id[1][0].keep_id == 2 and by_id[2][0].kept and by_id[1][0].group_size == 2
    assert by_id[3][0].keep_id == 4 and by_id[4][0].kept  # null is empty; white space is not
    assert by_id[5][0].group_size == 1
    assert sorted(r.kept for r in by_id[6]) == [False, True]  # a repeated row
    assert by_id[4][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 3


def test_near_copies(docs):
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_links == got[2].n_links == 1
    assert got[3].n_links == got[4].n_links == got[5].n_links == 0
    assert got[6].n_links == 1 and got[8].n_shingles == 1
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2


def test_filters_keep_columns(docs, labels):
    assert language_id.keep_identified(docs).columns == docs.columns
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    ids = {r.doc_id for r in language_id.keep_identified(docs).collect()}
    assert not ids & {3, 4, 5, 10} and {1, 2, 6} <= ids


def test_language_without_letters(docs):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 10)) and got[1].lang_pred == "en"


def test_packing(docs):
    rows = packing.pack_documents(docs, BYTES, with_ids=True).collect()
    assert packing.pack_documents(docs.limit(0), BYTES).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r.offset)
        ends = [r.offset + r.length for r in parts]
        assert [r.offset for r in parts] == [0, *ends[:-1]]
        assert ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    for i, text, _ in TEXTS:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        if i != 6:
            assert [x for r in own for x in r.ids] == [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_bpe(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, WORD).collect()}
    for i, text, _ in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_token_counts(docs):
    got = {r.doc_id: r for r in token_counts.token_counts(docs, PIECES).collect()}
    assert got[3].n_tokens == got[4].n_tokens == got[5].n_tokens == 0 and got[8].n_pretokens == 60_000 and got[9].n_tokens > 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, node long, tree string"
    rows = [(1, 0, "user", "a", 5, "x"), (1, 1, "assistant", None, 5, "x"), (1, 1, "assistant", None, 5, "x"), (1, None, None, "z", 5, "x"), (None, 0, "tool\nrole", "</s>\\[INST]", 5, "x"), (2, 0, "assistant", "w " * 50_000, 5, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat.read_back(chat.format_reply_trees(chat.chains(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, None: 1, 2: 1}
    assert got[2].loss_chars == 100_000
    assert got[None].turns_sha256 == hashlib.sha256(b"tool\nrole\n</s>\\[INST]\n").hexdigest()
    assert chat.read_back(chat.format_reply_trees(chat.chains(df.limit(0)))).count() == 0


def test_pages(spark):
    model = html_extract.fit()
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "<article><p>A &amp; b&nbsp;c</p><p>cut <b>off here, a longer sentence follows.</p><p"), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<!-- never closed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    got = {r.page_id: r for r in html_extract.extract(df, model).collect()}
    assert got[1].text == got[2].text == got[5].text == "" and got[3].text == "A & b c cut off here, a longer sentence follows."
    assert got[3].n_chars == len(got[3].text)
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.1, 0.0], 1), (2, [2.0, 0.0], 1), (12, [1.0, 0.1], 1), (13, [1e-30, 1e-31], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "space": F.lit(1), "v": F.lit(1)})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_embeddings.near_embeddings(df).collect())
    linked = {1: 4, 2: 4, 12: 4, 13: 4}
    assert got == sorted((i, linked.get(i, 0), 1 if i in linked else i, i not in linked or i == 1) for i, _, _ in rows)
    assert near_embeddings.near_embeddings(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in pieces}
    assert 2 in kept and 6 in kept and not kept & {1, 3, 4, 5, 10}
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
