"""Empty tables, repeated ids, very long texts and clashing columns through every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestra.llm import decontamination, fingerprints, language_id, line_dedup, near_dedup, quality_net, revisits, sentencepieces, stages, substring_dedup, token_counts
from tests.llm.fixtures import documents, texts

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_words", "n_dropped", "fingerprint", "class_id", "lang_pred", "score", "n_tokens", "pieces", "__id", "__text", "u", "hub", "p", "t1", "__h1", "edge", "at", "item_id", "distance"]


def odd(spark, rows=None):
    """The fixture with columns named like those inside the operators."""
    return documents(spark, rows).withColumns({n: F.lit("mine") for n in NAMES})


def items(spark, kind="long"):
    return spark.createDataFrame([("1", "one two three four five six"), ("2", None)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind)).withColumn("doc_id", F.lit("x"))


def model(spark):
    return language_id.fit(spark.createDataFrame([(1, "the house of the king", "en"), (2, "la maison du roi", "fr")], "doc_id long, text string, lang string"))


OPERATORS = {
    "op1": lambda s, d: fingerprints.edited_fingerprints(d),
    "op3": lambda s, d: substring_dedup.substring_dedup(d),
    "op5": lambda s, d: line_dedup.line_dedup(d),
    "op6": lambda s, d: near_dedup.near_classes(d),
    "op7": lambda s, d: language_id.identify(d, model(s)),
    "op8": lambda s, d: quality_net.score(d, quality_net.QualityNet.fresh()),
    "op9": lambda s, d: sentencepieces.round_trip(d, PIECE_BPE, keep_pieces=True),
    "op10": lambda s, d: token_counts.token_counts(d, WORD_BPE),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_repeated_long_and_clashing(spark, name):
    run = OPERATORS[name]
    assert run(spark, odd(spark, []).where("false")).count() == 0
    rows = texts() + [(3, texts()[1][1]), (3, texts()[1][1]), (None, None), (9_000, "word " * 60_000 + "é" * 2_000)]
    a, b = (sorted(map(str, run(spark, d).collect())) for d in (odd(spark, rows), documents(spark, rows).select("doc_id", "text")))
    assert a == b and len(a) == len(rows)


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string"])
def test_items_of_any_type(spark, kind):
    docs = odd(spark, [(1, "x one TWO three four  five six y"), (2, "clean"), (1, "one two three four five six"), (None, None), (3, "word " * 60_000)])
    found = decontamination.leaks(docs, items(spark, kind))
    assert dict(found.dtypes)["item_id"] == kind and sorted((r.doc_id, str(r.item_id), r.distance) for r in found.collect()) == [(1, "1", 0), (1, "1", 0)]
    assert decontamination.clean(docs, items(spark, kind)).count() == 3
    assert decontamination.leaks(docs.where("false"), items(spark, kind)).count() == decontamination.leaks(docs, items(spark, kind).where("false")).count() == 0


def test_models_of_empty_tables(spark):
    none = documents(spark, []).where("false")
    assert language_id.fit(none.select("doc_id", "text", "lang")).names == []
    assert {r.lang_pred for r in language_id.identify(documents(spark), language_id.fit(none.select("doc_id", "text", "lang"))).collect()} == {"und"}
    records = spark.createDataFrame([], "record_id long, url string, ts long, revisit boolean, etag string, last_modified long, digest string, headers array<struct<name:string,value:string>>, slice string, full string")
    assert revisits.resolve(records).count() == 0


def test_stages_keep_columns_and_rows(spark, small):
    """Every stage on awkward rows: all columns stay, whatever their names, and only what the stage is for goes."""
    rows = [(i, t) for i, t in texts()] + [(3, "quite different words under an id that was there before"), (5_000, None)]
    docs = odd(spark, rows)
    for name, stage in stages.STAGES:
        out = stage(spark, docs, small)
        assert out.columns[: len(docs.columns)] == docs.columns and (len(out.columns) == len(docs.columns)) == (name != stages.STAGES[-1][0])
        assert dict(out.dtypes).items() >= dict(docs.dtypes).items()
        assert stage(spark, docs.where("false"), small).count() == 0
        kept = out.select("doc_id", "text").collect()
        if name == "MinHash near-dedup":
            assert sum(r.doc_id == 3 for r in kept) == 2  # one id, two texts: both unique
        if name == "line dedup":
            assert len(kept) == len(rows)
        if name.startswith("SentencePiece"):
            assert sorted(map(str, kept)) == sorted(map(str, docs.select("doc_id", "text").collect()))
