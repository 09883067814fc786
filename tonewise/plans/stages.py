"""The classifier as stages of an ML ``Pipeline``: texts in, probabilities out, saved and loaded with the pipeline."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.functions.normalize import normalize_text
from tonewise.operators.features import Vectorizer
from tonewise.plans.models import Ensemble
from tonewise.plans.training import Options


class _Columns(Params):
    """Columns and sizes; ``idCol`` deals rows to folds and need not be unique."""

    idCol = Param(Params._dummy(), "idCol", "column that deals rows to folds", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "column of raw texts", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column of labels, 0 or 1", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column that is added", TypeConverters.toString)
    wordFeatures = Param(Params._dummy(), "wordFeatures", "word terms at most", TypeConverters.toInt)
    charFeatures = Param(Params._dummy(), "charFeatures", "character terms at most", TypeConverters.toInt)
    epochs = Param(Params._dummy(), "epochs", "passes of the modified Huber member", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        o = Options()
        self._setDefault(idCol="row_id", textCol="text", labelCol="is_toxic", probabilityCol="prob", wordFeatures=o.word_features, charFeatures=o.char_features, epochs=o.epochs)

    def of(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def with_params(self, **values) -> "_Columns":
        self._set(**values)
        return self


class ToxicityClassifier(_Columns, Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """Fits vectorizer and ensemble to the normalised texts; rows without a text or a label teach nothing."""

    def _fit(self, dataset: DataFrame) -> "ToxicityModel":
        rows = dataset.select(F.col(self.of("idCol")).alias("row_id"), F.col(self.of("labelCol")).cast("int").alias("is_toxic"), F.col(self.of("textCol")).alias("text"))
        rows = rows.where(F.col("text").isNotNull() & F.col("is_toxic").isin(0, 1)).select("row_id", "is_toxic", normalize_text(F.col("text")).alias("normalized"))
        fitted = Ensemble.fit(rows, Vectorizer(self.of("wordFeatures"), self.of("charFeatures")), epochs=self.of("epochs"))
        return self._copyValues(ToxicityModel(fitted))


class ToxicityModel(_Columns, Model, MLWritable, MLReadable):
    def __init__(self, ensemble: Ensemble | None = None):
        super().__init__()
        self.ensemble = ensemble

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = {f"c{i}": c for i, c in enumerate(dataset.columns)}  # so that no column clashes with those in between
        text = F.col(f"c{dataset.columns.index(self.of('textCol'))}")
        rows = self.ensemble.predict(dataset.toDF(*names).withColumn("normalized", normalize_text(text)), "prob")
        return rows.select(*[F.col(k).alias(c) for k, c in names.items() if c != self.of("probabilityCol")], F.col("prob").alias(self.of("probabilityCol")))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.ensemble.save(f"{path}/ensemble")


class _Reader(MLReader):
    def load(self, path: str) -> ToxicityModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ToxicityModel(Ensemble.load(f"{path}/ensemble"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
