"""Cases that the contracts name: special strings, long matches, repeated queries, late batches, long secrets."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import ann, byte_bpe, minhash_dedup, packing, pii, token_rollup
from marketloom.llm.common import Scratch
from marketloom.llm.tokenizing import ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(PATH), special_tokens={})


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_whole_table_and_long_matches(spark):
    rng = random.Random(3)
    blob = base64.b64encode(rng.randbytes(37_500)).decode()
    own = [(-1, "x" * 50_000), (-2, blob + " tail"), (-3, "é" * 300 + " 1" * 3), (-4, " " * 5000 + "a"), (-5, "日本" * 400), (-6, None)]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = table.union(spark.createDataFrame(own, table.schema))
    rows = {r[0]: r[1] or "" for r in df.collect()}
    for r in byte_bpe.encode_decode(spark, df).collect():
        ids = encoding().encode_ordinary(rows[r[0]])
        want = (len(ids), digest(",".join(map(str, ids)).encode()), digest(rows[r[0]].encode()))
        assert tuple(r)[1:] == want, r[0]


def test_bpe_heap():
    table, e, rng = ranks(PATH), encoding(), random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("aabcdeéthing日-=/") for _ in range(rng.randrange(1, 60))).encode()
        assert byte_bpe._whole_or_merged(word, table) == e._core_bpe.encode_single_piece(word)


def test_bpe_dictionary_bound(spark, monkeypatch):
    """Words that stand more often than any step of the histogram do not enter beyond the bound."""
    monkeypatch.setattr(byte_bpe, "DICTIONARY", 1)
    words = spark.createDataFrame([(w,) for w in ["a", "b", "c"] * 300 + ["d"] * 40_000], "word string")
    row = byte_bpe._frequent(Scratch(spark, "bound"), words, byte_bpe.Coder(PATH)).first()[0]
    assert [k for m in row for k in m] == ["d"]


def test_special_strings(spark):
    texts = ["see <|endoftext|> here", "<|endoftext|>", " <|endoftext|><|endoftext|>x", "<|endof text|>"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    n = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert [n[i] for i in range(4)] == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_repeated_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows.append((20, rng.normal(size=8).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by_query = {}
    for r in ann.neighbours(spark, df, every=20).collect():
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(k for k, _ in by_query[20]) == sorted([*range(1, 11)] * 2)
    assert len(by_query[0]) == len(by_query[40]) == 10


def test_late_batch(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "late"))

    def batch(n):
        return spark.createDataFrame(
            [("insert", "a", "en", "v", None, n)], "op string, source string, lang string, tokenizer string, n_before long, n_after long"
        )

    assert rollup.commit("0001", batch(1)) and rollup.commit("0003", batch(10))
    rollup.compact()
    assert rollup.commit("0002", batch(100)) and not rollup.commit("0002", batch(100))
    assert rollup.totals().first()["n_tokens"] == 111
    rollup.compact()
    assert rollup.totals().first()["n_tokens"] == 111 and rollup.committed() == ["0001", "0002", "0003"]


def test_keep_one_loses_no_text(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, "quite another text of more than five words"), (1, text), (2, text), (None, "x"), (None, "x")]
    got = minhash_dedup.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)


def test_shared_folder_needed():
    def bare(master):
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        return type("S", (), {"conf": conf, "sparkContext": type("X", (), {"master": master})})

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            Scratch(bare(master), "x")
    assert Scratch(bare("local[8]"), "x").root.rsplit("/", 1)[0] == Scratch(bare("local"), "y").root.rsplit("/", 1)[0]


@pytest.mark.parametrize("n", [65, 5000])
def test_long_secrets(spark, n):
    rng = random.Random(n)
    sign = lambda k: "".join(rng.choice("abcdefghjkmnpqrstuvwxyz23456789") for _ in range(k))
    secrets = [f"sk-{sign(n)}", "".join(rng.choice("0123456789abcdef") for _ in range(n)), sign(n)]
    texts = [f"api key {secrets[0]} end", f"the token {secrets[1]} end", f"password = {secrets[2]} end", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts * 8)), "doc_id long, text string")
    out = [r["text"] for r in pii.mask(spark, docs).collect()]
    assert not any(s[-20:] in t for s in secrets for t in out) and "nothing here" in out


def test_many_candidates_are_linear():
    text = " ".join(f"{i % 900 + 100}-45-{i % 9000 + 1000}" for i in range(60_000))
    assert len(pii.candidates(text, pii.base_spans(text))) == 60_000


SPACES = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2003\u2009\u2028\u2029\u202f\u205f\u3000"


def test_bpe_long_runs_of_mixed_white_space(spark):
    own = []
    for s in SPACES:
        for other in " \n":
            own += ["x" + (s + other) * n + "y" for n in (40, 90, 128, 150)]
            own += ["x" + (s + " ") * 70 + other]
    rng = random.Random(8)
    signs = SPACES + "aé日😀1.-'_" + chr(0x200B)
    own += ["".join(rng.choices(signs, k=rng.randint(200, 400))) for _ in range(60)]
    own += ["".join(rng.choices(SPACES, k=rng.randint(80, 300))) for _ in range(60)]
    rows = dict(enumerate(own))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in byte_bpe.encode_decode(spark, df).collect():
        ids = encoding().encode_ordinary(rows[r[0]])
        want = (len(ids), digest(",".join(map(str, ids)).encode()), digest(rows[r[0]].encode()))
        assert tuple(r)[1:] == want, (r[0], rows[r[0]][:20])


def test_language_of_long_documents_is_learnt(spark):
    from marketloom.llm import language_id

    french = "Le chat noir dort sur la vieille chaise près de la fenêtre ouverte du salon. "
    english = "The black cat sleeps on the old chair near the open window of the room. "
    rows = [(i, french * 3500, "fr") for i in range(6)] + [(i, english * 3, "en") for i in range(6, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language_id.learn(spark, docs)
    assert sorted(learnt) == ["en", "fr"] and all(len(v) <= language_id.DICTIONARY_BYTES for v in learnt.values())


def test_rollup_batch_between_list_and_sum(spark, monkeypatch):
    scratch = Scratch(spark, "race")
    rollup = token_rollup.Rollup(spark, scratch.path("t"))

    def change(n):
        return spark.createDataFrame([("insert", "s", "en", "v", None, n)], "op string, source string, lang string, tokenizer string, n_before long, n_after long")

    rollup.commit("0001", change(10))
    listing = rollup._list
    state = {"calls": 0}

    def slow(kind):
        names = listing(kind)
        if kind == "batch" and not state["calls"]:
            state["calls"] = 1
            rollup.commit("0002", change(100))
        return names

    monkeypatch.setattr(rollup, "_list", slow)
    rollup.compact()
    assert [r.n_tokens for r in rollup.totals().collect()] == [110]
    rollup.compact()
    assert [r.n_tokens for r in rollup.totals().collect()] == [110]


def test_minhash_doc_id_with_several_texts(spark):
    words = [f"word{i}" for i in range(60)]
    a, b, c = " ".join(words[:30]), " ".join(words[30:]), " ".join(words[10:50])
    near = a + " tail"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, None), (9, c), (9, c), (9, ""), (11, near), (None, a), (13, None), (13, None), (15, c.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(spark, df).collect())
    assert got == sorted([
        (3, 26, 3, True), (5, 26, 3, False), (5, 26, 3, False), (7, 26, 3, False), (7, 0, 3, False), (9, 36, 9, True), (9, 36, 9, True), (9, 0, 9, True), (11, 27, 3, False),
        (-1, 26, None, False), (13, 0, 13, True), (13, 0, 13, True), (15, 36, 9, False),
    ])
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in minhash_dedup.keep_one(spark, df).collect())
    assert kept == sorted([(3, a), (5, b), (7, ""), (9, c), (9, ""), (-1, a), (13, "")])


def test_pipeline_on_empty_tables_and_nulls(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    columns = {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, 0)])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(out.columns) == columns and out.count() <= len(rows)


def test_bpe_dictionary_rows(spark, monkeypatch):
    """The dictionary is rows, no map in one row; it holds the frequent words with their ids and no others."""
    monkeypatch.setattr(byte_bpe, "DICTIONARY", 2)
    words = spark.createDataFrame([(w,) for w in ["x"] * 2 + [" thing"] * 300 + ["日本"] * 40], "word string")
    rows = byte_bpe._frequent(Scratch(spark, "rows"), words, byte_bpe.Coder(PATH)).collect()
    assert sorted(map(tuple, rows)) == sorted((w, ",".join(map(str, encoding().encode_ordinary(w)))) for w in [" thing", "日本"])


def test_bpe_folds_only_unknown_matches(spark):
    """Known matches are taken from the dictionary wherever they stand; the others come out in their order."""
    known = ["a", " a", " b", "b", " ", "  ", "\n", ",", "'s", " 12"]
    ids = lambda w: ",".join(map(str, encoding().encode_ordinary(w)))
    dictionary = spark.createDataFrame([(w, ids(w)) for w in known], "word string, ids string").coalesce(1)
    long = " " + "x" * 300
    texts = ["", " ", "a b", " a b", "zz", " zz a", "a zz,b  b\n b's 12", "  zz  a\n", f"a{long} b", f"{long}zz1", "a yy zz b yy", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, runs, unknown, between in byte_bpe._split(docs, dictionary, PATH).collect():
        text = texts[i] or ""
        matches = byte_bpe._MATCH.findall(text)
        assert unknown == [m for m in matches if m not in known and len(m) <= byte_bpe.LONG]
        assert len(runs) == len(between) == len(unknown) + 1
        assert "".join(b + u for b, u in zip(between, [*unknown, ""])) == text
        both = [x for r, u in zip(runs, [*map(ids, unknown), None]) for x in (r, u) if x]
        assert ",".join(both) == ids(text)


def test_bpe_bytes_that_are_no_text(spark):
    """Malformed bytes are read as replacement signs, as the pattern's own functions read them."""
    rows = spark.sql("select 1L doc_id, cast(unhex('61FF2062') as string) text union all select 2L, 'a b'")
    got = {r[0]: tuple(r)[1:] for r in byte_bpe.encode_decode(spark, rows).collect()}
    for i, text in ((1, "a\ufffd b"), (2, "a b")):
        ids = encoding().encode_ordinary(text)
        assert got[i] == (len(ids), digest(",".join(map(str, ids)).encode()), digest(text.encode()))


def test_bpe_fold_of_bytes(spark):
    """The fold of every two bytes and of random matches, and how often a step looks ranks up and copies its state."""
    coder, table, rng = byte_bpe.Coder(PATH), ranks(PATH), random.Random(6)
    words = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([a]) for a in range(256)]
    words += ["".join(rng.choice("aabcdeéthing日-=/") for _ in range(rng.randrange(1, 30))).encode() for _ in range(2000)]
    df = spark.createDataFrame([(w,) for w in words], "word binary")
    folded = df.select("word", coder.bind(lambda code: code._fold(F.col("word"))).alias("ids"))
    assert all(r.ids == byte_bpe.merged(bytes(r.word), table) for r in folded.collect())
    plan = folded._jdf.queryExecution().analyzed().toString()
    assert plan.count("slice(") == plan.count("concat(") == 0 and plan.count("array_remove(") == 1


def test_bpe_letters_and_signs_need_no_pattern():
    """Parts of letters and then signs are told apart as the pattern does it."""
    for c in map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)):
        assert not c.isalpha() or byte_bpe._MATCH.findall(c + "a" + c) == [c + "a" + c], c
    rng = random.Random(8)
    for before in ("", " "):
        for _ in range(20_000):
            part = "".join(rng.choice("abZé日'',.*s\n\t1٣-_\U0001f600́") for _ in range(rng.randrange(1, 9)))
            assert byte_bpe.matches(part, before) == byte_bpe._MATCH.findall(before + part)


def test_bpe_dictionary_is_folded_once(spark, monkeypatch):
    """No plan of the dictionary holds the fold twice, as a filter over it would."""
    plans, write = [], Scratch.write

    def kept(self, name, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, name, df)

    monkeypatch.setattr(Scratch, "write", kept)
    words = spark.createDataFrame([(w,) for w in ["x"] * 2 + [" thing"] * 3], "word string")
    rows = byte_bpe._frequent(Scratch(spark, "once"), words, byte_bpe.Coder(PATH)).collect()
    assert sorted(map(tuple, rows)) == sorted((w, ",".join(map(str, encoding().encode_ordinary(w)))) for w in ["x", " thing"])
    assert max(p.count("aggregate(lambda") + p.count("aggregate(sequence") for p in plans) == 1
