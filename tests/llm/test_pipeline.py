import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_whole(spark):
    import corpus_pipeline as pipeline
    from eventloom.llm import decontaminate, forced_bpe, markov_secrets, minhash_join, weak_toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, steps[-1], SF)
        assert got.columns == docs.columns
        rows = got.collect()
        steps.append(spark.createDataFrame(rows, docs.schema))
    text = [{r.doc_id: r.text for r in s.collect()} for s in steps]
    model = weak_toxicity.fit(docs, labels)
    assert set(text[1]) == {i for i, t in text[0].items() if model.linear.score(t) < 0.5}
    sets = {i: minhash_join.shingle_set(t, 2) for i, t in text[1].items()}
    group = {i: i for i in sets}
    for i in sorted(sets):  # plain components: the least id over all links
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert set(text[2]) == {i for i, g in group.items() if g == i}
    wins = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decontaminate.windows_of(r.text)}
    for i, t in text[2].items():
        words = decontaminate.words_of(t)
        hit = {k + d for k in range(len(words)) for d in range(13) if b" ".join(words[k : k + 13]) in wins and k + 13 <= len(words)}
        assert (i in text[3]) == (not hit or 20 * len(hit) < len(words))
    assert set(text[4]) == set(text[3])
    assert all(not markov_secrets.base_spans(t) for t in text[4].values())
    last = {r.doc_id: r for r in pipeline.encoding(spark, steps[4], SF).collect()}
    bpe = forced_bpe.ForcedBpe(forced_bpe.tokenizer_path("word_bpe_49k.json"))
    assert {i: list(r.ids) for i, r in last.items()} == {i: bpe.encode(t) for i, t in text[4].items()}


def test_registered_queries(spark):
    names = driver.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(driver.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name, key", [("op1_compression_bands", "doc_id"), ("op4_token_records", "doc_id"), ("op5_warc_salvage", "page_id"), ("op8_block_rules", "page_id")])
def test_queries_return_a_row_for_each_row(spark, name, key):
    table = "pages" if key == "page_id" else "documents"
    assert driver.queries()[name](spark, SF).select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_stored_tables_go_at_the_end_of_a_stage(spark):
    import os

    from eventloom.llm.common import discarding, stored

    def folder(df):
        return os.path.dirname(df.inputFiles()[0].replace("file://", ""))

    before = folder(stored(spark.range(3), "outside"))
    with discarding(spark):
        outer = folder(stored(spark.range(3), "outer"))
        with discarding(spark):
            inner = folder(stored(spark.range(3), "inner"))
        assert not os.path.exists(inner) and os.path.exists(outer)
    after = folder(stored(spark.range(3), "outside"))
    assert not os.path.exists(outer) and os.path.exists(before) and os.path.exists(after)
