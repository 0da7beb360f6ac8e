"""Hard rows for operators and pipeline stages, and registered queries on a whole table against plain versions."""

import pytest
from brute import near, repeats, sha, shared
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skylattice.llm import bpe, decontaminate, language_id, queries, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
VOCABULARY = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
#: Names that operators give to columns of their own.
CLASHES = (
    "n", "h", "f1", "f2", "rep", "word", "words", "host", "path", "rule", "token", "tokens", "place", "best", "score", "predicted", "held_out", "lang_pred", "toxic", "item_id", "hash", "seed", "hits", "n_hits", "norm", "size", "text_sha256", "component_id", "kept", "keep_id", "_gone", "ids",
)
TEXT = " ".join(f"stone{i % 37} river{i % 11} bank{i}" for i in range(30))
LONG = " ".join(f"word{i % 5000} hill" for i in range(20_000))


def with_clashes(spark, rows, schema="doc_id long, text string, lang string"):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in df.columns]).repartition(3)


@pytest.fixture(scope="module")
def toxic_model(spark):
    large = "/root/testdata/sf0.1"  # the small tables hold too few labelled texts to learn from
    return toxicity.fit_toxicity(queries.table(spark, large, "documents"), queries.table(spark, large, "labels"))


@pytest.fixture(scope="module")
def languages(spark):
    return language_id.fit_languages(queries.table(spark, DATA, "documents"))


def test_rows_that_repeat_an_id_or_have_none(spark, toxic_model, languages):
    docs = with_clashes(spark, [(1, TEXT, "x"), (1, TEXT, "y"), (None, TEXT, None), (2, None, "x"), (3, "", "x"), (4, LONG, "x"), (1, "You idiot", "x")])
    for run in (lambda d: bpe.bpe_digest(d, VOCABULARY), lambda d: language_id.identify_language(d, languages), lambda d: toxicity.score_toxicity(d, toxic_model)):
        got = [tuple(r) for r in run(docs).collect()]
        assert sorted(str(r[0]) for r in got) == ["1", "1", "1", "2", "3", "4", "None"]
        same = [r for r in got if r[0] == 1]
        assert len(set(same)) == 2  # the text decides, not the id
        assert {r[-2:] for r in got if r[0] is None} <= {r[-2:] for r in same}
        assert {r[-2:] for r in got if r[0] == 2} == {r[-2:] for r in got if r[0] == 3}


def test_urls_that_repeat_and_clash(spark):
    long = "http://a.org/" + "x/" * 50_000
    rows = [(1, "http://example.org/es/1", "x"), (1, "http://example.org/es/1", "y"), (None, "http://example.org/es/1", "z"), (2, None, "x"), (3, long, "x"), (4, "", "x")]
    got = [(r["page_id"], r["rule"], r["verdict"], len(r["path"])) for r in url_filter.filter_urls(with_clashes(spark, rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "example.org/es/", "block", 5)] * 2 + [(None, "example.org/es/", "block", 5), (2, None, "allow", 0), (3, "org/", "allow", 100_001), (4, None, "allow", 0)], key=str)


def test_equal_longest_rules(spark):
    rules = (url_filter.host_rule("a.org", "/x", "allow"), url_filter.host_rule("a.org", "/x", "block"))
    pages = spark.createDataFrame([(1, "http://a.org/x1")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()] == ["block"]


def test_benchmark_rows_that_repeat(spark):
    item = " ".join(f"question{i}" for i in range(25))
    docs = with_clashes(spark, [(1, f"{TEXT} {item} {TEXT}", "x"), (1, f"{TEXT} {item} {TEXT}", "x"), (None, item, "x"), (2, None, "x"), (3, f"{LONG} {item}", "x"), (4, LONG, "x")])
    bench = with_clashes(spark, [(8, item, "x"), (8, item, "x"), (9, item.upper(), "x"), (None, None, "x")], "item_id long, text string, lang string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 8), (1, 9), (3, 8), (3, 9)]


def stages(spark, toxic_model, bench):
    from skylattice.llm.exact_dedup import drop_exact_copies
    from skylattice.llm.near_dedup import drop_near_copies

    return {
        "toxicity": lambda d: toxicity.drop_toxic(d, toxic_model), "exact": drop_exact_copies, "near": drop_near_copies, "benchmark": lambda d: decontaminate.drop_contaminated(d, bench), "encode": lambda d: corpus_pipeline.encode(spark, d, DATA),
    }


@pytest.mark.parametrize("stage,gone", [("toxicity", {6}), ("exact", {3, 9}), ("near", {7, 9}), ("benchmark", {5}), ("encode", set())])
def test_stages_on_hard_rows(spark, toxic_model, stage, gone):
    item = " ".join(f"question{i}" for i in range(25))
    changed = TEXT.replace("bank15", "other")
    rows = [(1, TEXT, "x"), (1, TEXT, None), (2, None, "x"), (3, "", None), (None, "a row that has no id at all", "x"), (4, LONG, "x"), (5, f"so {item} then", "x"), (6, "You idiot", "x"), (7, changed, "x"), (9, TEXT + "\n", "x")]
    if stage == "exact":
        rows = [(i, t + " " if t and i == 1 else t, x) for i, t, x in rows]  # both as long as the copy: the smaller id stays
    docs, bench = with_clashes(spark, rows), spark.createDataFrame([(8, item), (None, None)], "item_id long, text string")
    out = stages(spark, toxic_model, bench)[stage](docs)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in rows if r[0] not in gone)
    if stage != "encode":
        assert out.schema == docs.schema
    empty = docs.where("doc_id < 0")
    assert stages(spark, toxic_model, bench)[stage](empty).collect() == []


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_near_dedup", "op4_bpe", "op7_substring_dedup"])
def test_registered_queries_on_a_whole_table(spark, name):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, DATA, "documents").collect()}
    library = Tokenizer.from_file(VOCABULARY)

    def encoded(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    plain = {"op1_suffix_dedup": lambda: repeats(texts, 400), "op2_near_dedup": lambda: near(texts, 2), "op4_bpe": lambda: {i: encoded(t) for i, t in texts.items()}, "op7_substring_dedup": lambda: shared(texts, 13)}[name]()
    got = {r[0]: tuple(r)[1:] for r in queries.queries()[name](spark, DATA).drop("n_seeds").collect()}
    assert got == plain
