from wirelens.llm import jaccard_join


def test_part_hashes_are_made_and_dealt_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    rows_of = jaccard_join.signature_rows

    def counted(*args):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch
        return rows_of(*args).mapInArrow(run, "signature long, doc long")

    words = [f"w{i}" for i in range(60)]
    # ten near copies (one word of the last ones differs), an exact copy and ten texts of their own
    texts = [" ".join(words[:59] + [f"end{i}"]) for i in range(10)] + [" ".join(words[:59] + ["end0"])]
    texts += [" ".join(f"own{i}x{k}" for k in range(40)) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = jaccard_join.Settings(width=3, num=90, den=100)
    one_reading = rows_of(jaccard_join._id_text(docs, "doc_id", "text"), settings, 58).count()
    monkeypatch.setattr(jaccard_join, "signature_rows", counted)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, settings).collect()}
    assert found == {i: 0 if i < 11 else i for i in range(21)}
    assert made.value == one_reading
