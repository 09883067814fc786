"""The classifier in a Pipeline, saved and loaded; the hashed vocabulary against a plain one."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer

from tonewise.operators import features
from tonewise.plans.stages import ToxicityClassifier


@pytest.mark.filterwarnings("ignore")
def test_pipeline_saved_and_loaded(spark, tmp_path):
    bad, good = ["you awful idiot", "stupid trash person"], ["what a lovely day", "nice walk today"]
    rows = [(i, f"{(bad if i % 2 else good)[i // 2 % 2]} number{i % 9}", float(i % 2), "kept") for i in range(120)] + [(500, None, 1.0, "x"), (501, "no label", None, "x")]
    df = spark.createDataFrame(rows, "n long, words string, y double, normalized string")
    stages = [SQLTransformer(statement="SELECT *, upper(words) AS loud FROM __THIS__"), ToxicityClassifier().with_params(idCol="n", textCol="loud", labelCol="y", probabilityCol="p", wordFeatures=200, charFeatures=300, epochs=4)]
    Pipeline(stages=stages).save(f"{tmp_path}/pipeline")
    again = Pipeline.load(f"{tmp_path}/pipeline")
    assert again.getStages()[1].of("textCol") == "loud" and again.getStages()[1].of("wordFeatures") == 200
    model = again.fit(df)
    model.save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    want, got = ({r["n"]: r["p"] for r in m.transform(df).collect()} for m in (model, loaded))
    assert want == got and len(got) == 122
    assert min(got[i] for i in range(1, 120, 2)) > 0.5 > max(got[i] for i in range(0, 120, 2))
    out = loaded.transform(df)
    assert out.columns == [*df.columns, "loud", "p"] and {r["normalized"] for r in out.collect()} == {"kept", "x"}


def test_hashed_vocabulary_as_a_plain_one():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices("abé \U0001f600z", k=rng.randrange(1, 6))) for _ in range(500)})
    rng.shuffle(terms)
    idf = np.array([rng.uniform(1, 3) for _ in terms])
    index, plain = features.TermIndex.of("char", terms, idf), {t: i for i, t in enumerate(terms)}
    for _ in range(200):
        text = "".join(rng.choices("abé \U0001f600zq", k=rng.randrange(0, 40)))
        counts = Counter(plain[t] for t in features.terms_of(text, "char") if t in plain)
        w = {i: (1 + np.log(n)) * idf[i] for i, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in w.values())) or 1
        at, values = features.vector_of(text, [index])
        assert at.tolist() == sorted(w) and np.allclose(values, [w[i] / norm for i in sorted(w)], rtol=1e-12)
    assert features.vector_of("", [index])[0].tolist() == [] and not len(features.TermIndex.of("word", [], np.zeros(0)).find(["a"]))
    with pytest.raises(ValueError, match="one hash"):
        features.TermIndex.of("word", ["a", "a"], np.zeros(2))
