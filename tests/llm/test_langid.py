from pyspark.sql import functions as F

from tracewell.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] > 0.97 and right[1] == 0


def test_foreign_scripts_are_rejected(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.learnable(docs, langid.held_out()))
    assert model.classify("Это предложение написано на совсем другом языке, и букв таких модель не видела никогда.")[2]
    assert model.classify("123 456 !!!") == ("und", 0.0, True)


def test_edge_cases(edge, empty):
    model = langid.fit(langid.learnable(edge, langid.held_out()))
    out = langid.predict(edge, model).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if not (r["text"] or "").strip()} == {"und"}
    nothing = langid.fit(langid.learnable(empty, langid.held_out()))
    assert nothing.classify("any text") == ("und", 0.0, True)
    assert langid.predict(empty, nothing).count() == 0


def test_fold_of_null_id(spark):
    row = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id").select(langid.held_out()).first()
    assert row[0] is False


def test_sample_is_bounded_however_often_a_text_is_repeated(spark):
    copies = spark.range(20_000).selectExpr("'der eine satz' AS text", "'de' AS lang")
    others = spark.range(3_000).selectExpr("concat('satz nummer ', id) AS text", "if(id % 3 = 0, 'de', 'en') AS lang")
    keyed = copies.unionByName(others).withColumn("_key", F.xxhash64("text", "lang"))
    got = langid.drawn(keyed, {"de": 1001, "en": 2000}, 150).collect()
    assert sorted((k, sum(r.lang == k for r in got)) for k in ("de", "en")) == [("de", 150), ("en", 150)]
    assert len({(r.text, r.lang) for r in got}) == 300
    assert sorted(langid.drawn(keyed, {"de": 1001, "en": 2000}, 150).collect()) == sorted(got)
    assert langid.drawn(keyed, {"de": 1001, "en": 2000}, 5000).count() == 3001


def test_ties_take_the_first_language(spark):
    rows = spark.createDataFrame([("same words here", lang) for lang in ("fr", "de", "en")] * 2, "text string, lang string")
    model = langid.fit(rows)
    assert model.classify("same words here")[0] == "de"


def test_equals_brute_force_cosines(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(langid.learnable(docs, langid.held_out()))
    for r in langid.predict(docs.select("doc_id", "text"), model).collect():
        if not r.text or not langid.has_letter(r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        grams = {}
        clean = "".join(c if (("a" <= c <= "z") if ord(c) < 128 else ord(c) >= 0xAA) else " " for c in r.text.lower())
        while "  " in clean:
            clean = clean.replace("  ", " ")
        clean = f" {clean} "
        for n in (1, 2, 3):
            for i in range(len(clean) - n + 1):
                if n > 1 or clean[i] != " ":
                    grams[clean[i : i + n]] = grams.get(clean[i : i + n], 0) + 1
        at, n = langid.gram_counts(r.text)
        assert sum(n) == sum(grams.values())
        v = np.zeros(langid.DIM)
        v[at] = (1 + np.log(n)) * model.idf[at]
        cos = [float(c @ v / np.linalg.norm(v)) for c in model.centre]
        assert r.lang_pred == model.lang[int(np.round(cos, 6).argmax())] and abs(r.score - max(cos)) < 1e-4


def test_driver_gives_memory_back(spark, monkeypatch):
    """The fit's sample does not stay with the driver's Python for the stages that follow."""
    done, plain = [], langid.settle
    monkeypatch.setattr(langid, "settle", lambda: done.append(1) or plain())
    rows = spark.createDataFrame([(f"the house and the garden {i}", "en") for i in range(20)], "text string, lang string")
    assert langid.fit(rows).lang[0] == "en"
    assert done == [1]
