"""Evaluation through the serving path: the detected language picks the cut, the data set's names the slice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.operators import metrics
from tonewise.plans.serving import Classifier

MIN_ROWS = 20
PASS_ACCURACY = 0.8

#: Rows of our own for a quick look: a toxic and a clean one in each of 15 languages, and four that hide their words.
SMOKE_ROWS = [
    ("You are a worthless moron and everyone hates you", 1, "en"), ("What a lovely morning for a walk with the dog", 0, "en"),
    ("Eres un idiota y das mucho asco", 1, "es"), ("Muchas gracias por la ayuda con todo esto", 0, "es"),
    ("Tu es un crétin et une ordure", 1, "fr"), ("Merci pour cette belle journée avec vous", 0, "fr"),
    ("Du bist ein Idiot und einfach nur Abschaum", 1, "de"), ("Das Wetter ist heute schön und ich freue mich", 0, "de"),
    ("Sei un cretino e fai schifo a tutti", 1, "it"), ("Grazie per questo bel regalo, sono molto felice", 0, "it"),
    ("Você é um idiota e um lixo", 1, "pt"), ("Obrigado pelo jantar, estava muito bom", 0, "pt"),
    ("Je bent een waardeloze sukkel", 1, "nl"), ("Het was een fijne dag met de kinderen", 0, "nl"),
    ("Jesteś żałosnym idiotą", 1, "pl"), ("Dziękuję za wspaniałe życzenia", 0, "pl"),
    ("Sen aşağılık bir aptalsın", 1, "tr"), ("Bugün hava çok güzel, teşekkürler", 0, "tr"),
    ("Какой же он мерзкий подонок и лгун", 1, "ru"), ("Спасибо за помощь, хорошего дня", 0, "ru"),
    ("Ти дурний покидьок, їдь звідси", 1, "uk"), ("Дякую за гарний вечір і їжу", 0, "uk"),
    ("كم هو إنسان تافه وكذاب قذر", 1, "ar"), ("شكرا لك على المساعدة", 0, "ar"),
    ("तुम बेवकूफ और नीच हो", 1, "hi"), ("आपकी मदद के लिए धन्यवाद", 0, "hi"),
    ("你是个白痴废物", 1, "zh"), ("今天的天气真好", 0, "zh"),
    ("お前は馬鹿でクズだ", 1, "ja"), ("手伝ってくれてありがとう", 0, "ja"),
    ("you 1d1ot, st*pid tr4sh", 1, "en"), ("he is a real l o w l i f e", 1, "en"), ("what an іdіоt", 1, "en"), ("soooo happyyyy for youuuu", 0, "en"),
]


def run_holdout(classifier: Classifier, rows: DataFrame, min_rows: int = MIN_ROWS, limit: int | None = None) -> DataFrame:
    """(lang or null, counts, accuracy, toxic_f1, macro_f1, roc_auc) of rows with text, is_toxic and lang: the whole, then languages by size.

    ``roc_auc`` is that of the whole, by the reported scores; null for languages.
    """
    rows = rows.where(F.col("text").isNotNull())
    rows = rows.limit(limit) if limit else rows
    judged = classifier.analyze(rows.withColumnRenamed("is_toxic", "label"))
    judged = judged.select("lang", F.col("label").alias("is_toxic"), F.col("is_toxic").alias("predicted"), (F.col("score") / 100).alias("prob"))
    each = metrics.confusion(judged, ("lang",)).where(F.col("n") >= min_rows).withColumn("roc_auc", F.lit(None).cast("double"))
    whole = metrics.confusion(judged).join(metrics.roc_auc(judged)).withColumn("lang", F.lit(None).cast("string"))  # a row each
    return metrics.by_size(metrics.scores(whole.unionByName(each)))


def run_smoke(classifier: Classifier, rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows with their verdicts and detected language, exit code: 0 from an accuracy of 0.8 on, else 2)."""
    judged = classifier.analyze(rows.withColumnRenamed("is_toxic", "expected"))
    right = judged.agg(F.avg((F.col("is_toxic").cast("int") == F.col("expected")).cast("int"))).first()[0]
    return judged.withColumnRenamed("language", "detected"), 0 if right is not None and right >= PASS_ACCURACY else 2
