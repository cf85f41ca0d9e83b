"""Models that work on tables: Python models that score texts in batches, and models that are fitted on labels."""

from __future__ import annotations

import threading
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from commentscan.functions import text as T


class TableModel(ABC):
    @abstractmethod
    def answers(self, comments: DataFrame) -> DataFrame:
        """comments (text, ...) with _score (float) and _error (string), either of them null."""


Score = Callable[[list[str]], Sequence[float | None]]
#: What this Python process has loaded, by model.
_LOADED: dict[str, Score] = {}


def _within(seconds: float | None, work: Callable):
    """work(), or TimeoutError. Python cannot stop a thread, so one that hangs is left behind."""
    if seconds is None:
        return work()
    out: list = []

    def run() -> None:
        try:
            out.append((work(), None))
        except Exception as e:  # raised again where it is waited for
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no answer in {seconds:g} s")
    if out[0][1] is not None:
        raise out[0][1]
    return out[0][0]


class Batched(TableModel):
    """A Python model: load() gives a function from texts to as many scores, null for none.

    It is loaded once a worker process and called with at most `size` texts, none of them null, at a time. A batch that raises,
    answers short, or takes more than `seconds`, is asked again text by text; a text that fails once more has a message in _error, and
    costs no other its score. If loading fails, every text says so.
    """

    def __init__(self, load: Callable[[], Score], size: int = 64, seconds: float | None = None):
        self.load, self.size, self.seconds, self.key = load, size, seconds, uuid.uuid4().hex

    def _one(self, score: Score, texts: list[str]) -> list[float | None]:
        said = list(_within(self.seconds, lambda: score(texts)))
        if len(said) != len(texts):
            raise ValueError(f"{len(said)} scores for {len(texts)} texts")
        return [None if s is None else float(s) for s in said]

    def scored(self, texts: list[str]) -> list[tuple[float | None, str | None]]:
        """(score, error) of each text."""
        try:
            if self.key not in _LOADED:
                _LOADED[self.key] = self.load()
            score = _LOADED[self.key]
        except Exception as e:
            return [(None, _message(e))] * len(texts)
        try:
            return [(s, None) for s in self._one(score, texts)]
        except Exception as e:
            if len(texts) == 1:
                return [(None, _message(e))]
        out: list[tuple[float | None, str | None]] = []
        for text in texts:
            try:
                out.append((self._one(score, [text])[0], None))
            except Exception as e:
                out.append((None, _message(e)))
        return out

    def answers(self, comments: DataFrame) -> DataFrame:
        schema = comments.withColumns({"_score": F.lit(None).cast("float"), "_error": F.lit(None).cast("string")}).schema

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                asked = [k for k, t in enumerate(texts) if t is not None]
                score, error = [None] * len(texts), [None] * len(texts)
                for first in range(0, len(asked), self.size):
                    some = asked[first : first + self.size]
                    for k, (s, e) in zip(some, self.scored([texts[k] for k in some]), strict=True):
                        score[k], error[k] = s, e
                columns = [*batch.columns, pa.array(score, pa.float32()), pa.array(error, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=to_arrow_schema(schema).names)

        return comments.mapInArrow(run, schema)


def _message(e: Exception) -> str:
    return str(e) or type(e).__name__


class Learned(TableModel):
    """A logistic regression over hashed words, fitted on labelled texts; it scores in the JVM and can be saved and loaded."""

    def __init__(self, pipeline: PipelineModel):
        self.pipeline = pipeline

    @classmethod
    def fit(cls, labels: DataFrame, n_features: int = 1 << 14, penalty: float = 0.01, rounds: int = 100) -> Learned:
        """labels (text, label: hate or safe), as build_lexicon reads them; null texts and other labels are left out.

        The fit is a sum over all rows, which Spark gathers by a tree of tasks: the driver holds n_features numbers.
        """
        rows = labels.filter(F.col("label").isin("hate", "safe") & F.col("text").isNotNull()).select("text", (F.col("label") == "hate").cast("double").alias("_hate"))
        words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[\x20\x09-\x0D]+", toLowercase=True)
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=n_features, binary=True)
        model = LogisticRegression(featuresCol="_counts", labelCol="_hate", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", regParam=penalty, maxIter=rounds, tol=1e-9)
        return cls(Pipeline(stages=[words, counts, model]).fit(rows))

    def answers(self, comments: DataFrame) -> DataFrame:
        packed = comments.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
        scored = self.pipeline.transform(packed)
        own = T.trim_all(F.col("text")) != ""  # a text without words has no score
        score = F.when(own, F.get(vector_to_array("_probability"), 1)).cast("float")
        return scored.select("_row.*", score.alias("_score"), F.lit(None).cast("string").alias("_error"))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Learned:
        return cls(PipelineModel.load(path))
