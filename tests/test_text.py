import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import code, text
from sparkloom.operators import bpe
from sparkloom.plans import queries
from sparkloom.sources import tables

TEXTS = ["The cat sat on the mat, the cat's hat.", "a  b", "", "über straße 123 — ①", "x\n\n  y\tz "]


def test_html():
    assert text.strip_tags("tail &amp") == ""
    assert text.strip_tags("x<script>var a=1<2;</script>y") == "xvar a=1<2;y"
    assert text.strip_tags("a<!-- c -->b") == "ab"
    assert text.strip_tags(None) is None


def test_normalize(spark):
    df = spark.createDataFrame([("①",), ("a   b",), ("AÉ",), (None,), ("a\x01b\u200bc",)], "t string")
    assert [r[0] for r in df.select(text.normalize(F.col("t"))).collect()][:4] == ["1", "a b", "AÉ", None]
    assert df.select(text.normalize(F.col("t"), lower=True)).collect()[2][0] == "aé"
    assert df.select(text.normalize(F.col("t"), nmt=True)).collect()[4][0] == "ab c"
    with pytest.raises(ValueError):
        text.unicode_form("nfx")


def test_clean_comment(spark):
    df = spark.createDataFrame([("#    ======== hi",), ("# !",)], "t string")
    assert [r[0] for r in df.select(text.clean_comment(F.col("t"))).collect()] == ["# ===== hi", ""]
    assert code.encode_string("#    ======== hi", True) == "# ▁ ===== ▁ hi <endcom>"


def tok(source, **how):
    return code.PythonTokenizer().tokenize(source, **how)


def test_lexer():
    assert tok("x = 1\n") == "x = 1 <newline>"
    assert tok('def f():\n    """doc"""\n    return 1\n') == "def f ( ) : <newline> <indent> return 1 <newline> <dedent>"
    assert "doc" in tok('def f():\n    """doc text"""\n    return 1\n', keep_comments=True)
    assert tok('class A:\n    """doc"""\n') == "class A : <newline>"
    assert tok("x = 'a\n") == "" and tok("if x:\n    a\n  b\n") == ""
    assert tok("x = 1 # note here\n") == "x = 1 <newline>"
    assert tok("x = 1 # note here\n", keep_comments=True) == "x = 1 # ▁ note ▁ here <endcom> <newline>"
    assert tok("x = 'a b'\n") == "x = 'a ▁ b' <newline>"
    assert tok("x = f'a {y} b'\n") == "x = f'a ▁ {y} ▁ b' <newline>"
    assert tok("x = 1\n", spaced=False) == "x = 1<newline>"


def test_lexer_and_back():
    source = "import os\ndef f(a):\n    if a:\n        return os.x\n    return 'a b'\n"
    back = code.PythonTokenizer().detokenize(tok(source))
    assert tok(back) == tok(source)
    assert code.PythonTokenizer().detokenize(tok(source, spaced=False), spaced=False) == back
    assert code.PythonTokenizer().detokenize(None) == ""
    assert code.PythonTokenizer().detokenize("a > > b < < c") == "a >> b << c"


def test_diffs():
    with pytest.raises(ValueError):
        code.TextDiff().generate("a", "b")
    with pytest.raises(ValueError):
        code.TextDiff().generate("a", "b", "x", "y")
    assert code.TextDiff().generate("a\nb", "a\nc", target_name="f") == "--- f\n+++ f\n@@ -1,2 +1,2 @@\n a\n-b\n+c"
    assert code.TextDiff().generate("a", "a", "f") == ""
    assert code.CodeDiff().generate("x = 1\n", "x = 2\n", "f") == "--- f +++ f <newline> - x = 1 <newline> + x = 2 <newline>  "
    assert code.CodeDiff.line("-x") == "- x" and code.CodeDiff.line("--- f") == "--- f" and code.CodeDiff.line("@@ -1 +1 @@ g") == "<newline> g"


def test_bleu_words():
    assert code.bleu_international("a,b 1,000 x$y.") == "a , b 1,000 x $ y ."


def test_bpe_ties_and_tokens():
    model = bpe.train_from_counts({"ab": 3, "cd": 3}, 262)
    assert model.merges[0] == ("a", "b")
    assert [model.vocabulary[t] for t in ("<pad>", "</s>", "<unk>")] == [0, 1, 2]


def test_bpe_against_the_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers.models import BPE
    from tokenizers.trainers import BpeTrainer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    model = bpe.train(docs, size=800, normal=False)
    words = [r.text for r in docs.collect()]
    other = tokenizers.Tokenizer(BPE())
    other.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = BpeTrainer(vocab_size=800, min_frequency=2, special_tokens=list(bpe.SPECIAL_TOKENS), initial_alphabet=tokenizers.pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
    other.train_from_iterator(words, trainer)
    assert json.loads(other.to_str())["model"]["vocab"] == model.vocabulary
    ids = [r[0] for r in docs.select(bpe.encode(F.col("text"), model, normal=False)).collect()]
    assert [i[:-1] for i in ids] == [e.ids for e in other.encode_batch(words)] and all(i[-1] == 1 for i in ids)
    folder = tables.save_tokenizer(model, str(tmp_path / "t"), spark)
    assert tables.load_tokenizer(folder).merges == model.merges
    saved = tokenizers.Tokenizer.from_file(f"{folder}/tokenizer.json")
    assert saved.encode(words[0]).ids == ids[0]
    grown = tables.save_fast_tokenizer(model, str(tmp_path / "g"), max_length=512, extra=("<x>",), extra_ids=3)
    assert grown.vocabulary["<extra_id_0>"] == 800 and grown.vocabulary["<x>"] == 803 and grown.max_input(None) == 512 and grown.max_input(9) == 9


@pytest.mark.parametrize("how", [
    {"lower": True}, {"nmt": True, "form": None}, {"form": "nfc", "collapse": False}, {"continuing_prefix": "##"}, {"end_of_word": "</w>"}, {"continuing_prefix": "@", "end_of_word": "$", "prefix_space": True},
])
def test_tokenizer_settings_against_the_library(spark, tmp_path, how):
    """Each setting changes training and encoding as the library's does, and outlives saving."""
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["The  Cat\u0007 sat \u2460 ﬁne", "the cat the cat THE HAT", "caf\u00e9 cafe\u0301 naïve", "banana bananas ban", ""] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = bpe.train(docs, size=330, min_frequency=2, **how)
    folder = tables.save_tokenizer(tables.save_fast_tokenizer(model, str(tmp_path / "g"), max_length=77, extra_ids=2), str(tmp_path / "t"))
    loaded = tables.load_tokenizer(folder)
    assert loaded.max_length == 77 and loaded.merges == model.merges
    for k in ("form", "nmt", "collapse", "lower", "prefix_space", "trim_offsets"):
        assert getattr(loaded, k) == getattr(model, k), k
    assert (loaded.continuing_prefix, loaded.end_of_word) == (how.get("continuing_prefix"), how.get("end_of_word"))
    ids = [r[0] for r in docs.select(bpe.encode(F.col("text"), loaded)).collect()]
    saved = tokenizers.Tokenizer.from_file(f"{folder}/tokenizer.json")
    assert ids == [saved.encode(t).ids for t in texts]
    assert bpe.train(docs, size=330, max_words=0, **how).vocabulary == model.vocabulary


def test_words_of_many_letters_and_dropout(spark):
    model = bpe.train_from_counts({"abababab": 9, "aab": 5}, 275, min_frequency=1)
    letters = "ab" * 20000
    began = time.perf_counter()
    assert model.vocabulary["abababab"] in model.word(letters) and time.perf_counter() - began < 5
    df = spark.createDataFrame([("abababab abababab abababab abababab",)], "t string")
    half = [df.select(bpe.encode(F.col("t"), model, dropout=0.5, seed=s, normal=False)).first()[0] for s in range(4)]
    assert len({tuple(x) for x in half}) > 1 and all(bpe.Model.decode(model, list(x)) == "abababab abababab abababab abababab" for x in half)
    words = [r[0] for r in spark.createDataFrame([("abababab" * 1 + " " + "abababab",)], "t string").select(bpe.encode(F.col("t"), model, dropout=1.0, normal=False)).collect()]
    assert len(words[0]) == 8 + 9 + 1


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    model = bpe.train_from_counts({"the": 5, " cat": 4}, 270)
    out = df.select("t", bpe.encode(F.col("t"), model, normal=False).alias("i"))
    rows = out.select("t", "i", bpe.decode(F.col("i"), model).alias("d")).collect()
    assert all(r.d == r.t for r in rows)
    assert [r.i for r in rows if r.t == ""] == [[1]]
    dropped = df.select(bpe.encode(F.col("t"), model, normal=False, dropout=1.0).alias("i")).first().i
    assert len(dropped) == len(TEXTS[0].encode()) + 1


def test_train_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("aa aa aa\n" * 3)
    model = bpe.train_from_files(spark, str(tmp_path / "a.txt"), 262)
    assert model.merges[0] == ("a", "a")
    assert tables.training_texts(spark, files=[str(tmp_path / "a.txt")]).first().text == "aa aa aa\n"


def test_word_vocabulary(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 5), ("d", 1)], "word string, n long")
    want = {"c": 3, "a": 4, "b": 5, "d": 6}
    assert {r.word: r.id for r in bpe.word_vocabulary(counts).collect()} == want
    assert {r.word: r.id for r in bpe.word_vocabulary(counts, 5).collect()} == {"c": 3, "a": 4}
    pairs = bpe.pair_counts(spark.createDataFrame([("aé", 2), ("x", 9)], "word string, n long")).collect()
    assert {(r.left, r.right): r.n for r in pairs} == {("61", "C3"): 2, ("C3", "A9"): 2}


def test_bpe_counts_all_words(spark):
    """Rare words decide here: (x, y) stands in 40 words of one occurrence, (a, b) 30 times in one word."""
    rows = [("ab " * 30,)] + [(f"xy{chr(0x4E00 + i)}",) for i in range(40)]
    model = bpe.train(spark.createDataFrame(rows, "text string"), size=260, normal=False, max_words=2)
    assert model.merges[0] == ("x", "y")


def test_bpe_on_cluster(spark):
    texts = [*TEXTS, "aaaa aaa aaaaa abab ababab banana", "the then there thesis hethe", "abc ab bc abcabc bcabc"] * 3
    docs = spark.createDataFrame([(f"{t} {t[i % 5:]}{i % 7}",) for i, t in enumerate(texts)], "text string")
    for size, least in ((300, 2), (420, 1), (5000, 1)):
        here, there = (bpe.train(docs, size=size, min_frequency=least, user=("a", "<x>"), max_words=m) for m in (10_000, 0))
        assert there.merges == here.merges and there.vocabulary == here.vocabulary


def test_pre_tokens(spark):
    df = spark.createDataFrame([("it's  a-b",), ("",)], "t string")
    assert [r[0] for r in df.select(text.pre_tokens(F.col("t"))).collect()] == [["it", "'s", " ", " a", "-", "b"], []]
    assert df.select(text.pre_tokens(F.col("t"), prefix_space=True)).first()[0][0] == " it"


def test_markers(spark):
    df = spark.createDataFrame([(["a", "<newline>", "b"],)], "t array<string>")
    assert df.select(text.stringify(F.col("t"), spaced=False)).first()[0] == "a<newline>b"
    assert df.select(text.destringify(F.lit("a<newline>b"), spaced=False)).first()[0] == "a <newline> b"


def test_word_encode_keeps_texts_without_words(spark, tmp_path):
    rows = [(1, "a b a"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.ids for r in queries.word_encode(spark, str(tmp_path)).collect()}
    assert found == {1: hashlib.md5(b"5 4 3 1").hexdigest(), 2: hashlib.md5(b"1").hexdigest(), 3: None}


def test_clean_comment_query_cuts_what_its_sql_names(spark, tmp_path):
    """Runs of letters stay in the query, not by default; a combining mark is no word character, as in Python."""
    texts = ["ciónrrrrrr ======= %%%%%% ab", "e\u0301", "a\r\r\r\r\r\r\rb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.digest for r in queries.clean_comment(spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(["ciónrrrrrr ===== %%%%% ab", "", texts[2]])}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.clean_comment(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["ciónrrrrr ===== %%%%% ab", "", "a\r\r\r\r\rb"]
