"""pyspark.ml wrappers: the toggled text preprocessor (T10) as a
Transformer and TF-IDF (F8) as an Estimator/Model pair, so they compose in
``Pipeline`` objects and ``CrossValidator`` like any MLlib stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, drop_stopwords
from ..session import staged
from .lemma import fit_lemmas, lemmatise_text, may_change
from .tfidf import TfidfModel, fit_tfidf


class TextPreprocessor(Transformer, HasInputCol, HasOutputCol):
    """clean -> stop words -> lemmas, each step switchable; drops rows that
    end up empty.  Without a ``lemmaTable`` (token, lemma) the lemmas are
    fitted on the transformed rows (tokens that two documents hold).  Pass
    ``observation`` (a ``pyspark.sql.Observation``) to get
    ``rows`` / ``empty_removed`` from the job that consumes the output."""

    doClean = Param(Params._dummy(), "doClean", "apply cleaning", TypeConverters.toBoolean)
    doRemoveStopwords = Param(Params._dummy(), "doRemoveStopwords", "remove stop words", TypeConverters.toBoolean)
    doLemmatize = Param(Params._dummy(), "doLemmatize", "lemmatise", TypeConverters.toBoolean)
    dropEmpty = Param(Params._dummy(), "dropEmpty", "drop empty results", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol: str = "text", outputCol: str = "clean_text", doClean: bool = True,
                 doRemoveStopwords: bool = True, doLemmatize: bool = True, dropEmpty: bool = True,
                 lemmaTable: DataFrame | None = None, idCol: str = "doc_id", observation=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="clean_text", doClean=True, doRemoveStopwords=True,
                         doLemmatize=True, dropEmpty=True)
        kw = dict(self._input_kwargs)
        self.lemma_table = kw.pop("lemmaTable", None)
        self.fitted_lemmas = None  # the table of the last transform without a lemmaTable
        self.id_col = kw.pop("idCol", "doc_id")
        self.observation = kw.pop("observation", None)
        self._set(**kw)

    def _transform(self, df: DataFrame) -> DataFrame:
        inp, out = self.getInputCol(), self.getOutputCol()
        c = F.coalesce(F.col(inp), F.lit(""))
        if self.getOrDefault(self.doClean):
            c = clean_text(inp)
        if self.getOrDefault(self.doRemoveStopwords):
            c = drop_stopwords(c)
        # generator form: the drop-empty filter cannot inline the regex chain twice
        res = df.select(*[x for x in df.columns if x != out], F.explode(F.array(c)).alias(out))
        if self.getOrDefault(self.doLemmatize):
            table = self.lemma_table
            if table is None:
                res = staged(res)  # read for the tokens, then for the answers
                table = self.fitted_lemmas = fit_lemmas(res, out)
            # the rules say which tokens of a fitted table can change, a given table may hold any
            candidate = may_change if self.lemma_table is None else None
            res = lemmatise_text(res, table, out, self.id_col, out, candidate)
        if self.observation is not None:
            res = res.observe(self.observation, F.count(F.lit(1)).alias("rows"),
                              F.count_if(F.length(F.col(out)) == 0).alias("empty_removed"))
        if self.getOrDefault(self.dropEmpty):
            res = res.where(F.length(F.col(out)) > 0)
        return res


class TfidfEstimator(Estimator):
    def __init__(self, textCol: str = "clean_text", idCol: str = "doc_id", maxFeatures: int = 10000,
                 nMax: int = 2, minDf: int = 2, maxDf: float = 0.95):
        super().__init__()
        self.textCol, self.idCol, self.maxFeatures = textCol, idCol, maxFeatures
        self.nMax, self.minDf, self.maxDf = nMax, minDf, maxDf

    def _fit(self, df: DataFrame) -> "TfidfVectorModel":
        m = fit_tfidf(df, self.textCol, self.idCol, self.maxFeatures, self.nMax, self.minDf, self.maxDf)
        return TfidfVectorModel(m, self.idCol)


class TfidfVectorModel(Model):
    def __init__(self, tfidf: TfidfModel, idCol: str = "doc_id"):
        super().__init__()
        self.tfidf, self.idCol = tfidf, idCol

    @property
    def vocabulary(self) -> DataFrame:
        return self.tfidf.vocab

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != self.idCol]
        return self.tfidf.transform_vectors(df, self.idCol, keep=keep)
