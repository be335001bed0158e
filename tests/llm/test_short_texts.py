"""Language of texts of a few words."""

import random

from marketloom.llm import language_id

FOLDER = "/root/testdata/sf0.01"


def test_short_pieces_keep_their_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.Classifier(language_id.learn(spark, docs))
    rows = docs.where("lang is not null and text is not null").where(language_id.held_out()).orderBy("doc_id").collect()
    rng = random.Random(5)
    for words, least in ((3, 0.9), (5, 0.95)):
        right = total = 0
        for r in rows:
            parts = [w for w in r["text"].split() if w.isalpha()]
            if len(parts) < words:
                continue
            at = rng.randrange(len(parts) - words + 1)
            found, _, lead = model.predict(" ".join(parts[at : at + words]))
            total += 1
            right += found == r["lang"] and lead >= language_id.MARGIN
        assert total > 100 and right / total >= least, (words, right, total)


def test_short_texts_with_tiny_dictionaries():
    model = language_id.Classifier({"aa": b"one\n", "bb": b"two words of text\n"})
    assert model.predict("xy")[0] in ("aa", "bb") and model.predict("")[0] == "und"
