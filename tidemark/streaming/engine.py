"""A live engine: a model that the first micro-batch trains, or an earlier run has saved, scores every batch of a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import learning
from .feed import run_for

#: Columns of a signal.
SIGNAL = ("symbol", "ts", "action", "p", "price")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _rename(spark: SparkSession, src: str, dst: str) -> None:
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (src, dst))
    old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new)


@dataclass
class LiveEngine:
    """Signals of a stream of rows with ``symbol``, ``ts``, ``price`` and features.

    ``estimator`` is fitted on the labelled rows (``label`` 0 or 1) of the first batch that has ``least_rows`` of them, and saved under ``path``; until then nothing is scored. A later start, of the same
    stream or another, loads what is there and does not train again. A batch that is repeated after a failure writes the same folder again. ``on_signal`` gets the signals of
    a batch and its number, ``on_update`` a summary of it.
    """

    estimator: Estimator
    path: str
    threshold: float = 0.75
    least_rows: int = 50
    on_signal: Callable[[DataFrame, int], None] | None = None
    on_update: Callable[[dict], None] | None = None
    trained: int = field(default=0, init=False)
    _model: PipelineModel | None = field(default=None, init=False, repr=False)

    @property
    def signals_path(self) -> str:
        return f"{self.path}/signals"

    def model(self, batch: DataFrame) -> PipelineModel | None:
        """The loaded model, the saved one, or one trained on ``batch``."""
        spark, saved = batch.sparkSession, f"{self.path}/model"
        if self._model is None and _exists(spark, saved):
            self._model = PipelineModel.load(saved)
        if self._model is None:
            rows = batch.where("label is not null")
            if rows.limit(self.least_rows).count() < self.least_rows:
                return None
            fitted = learning.fit(self.estimator, rows)
            fitted.write().overwrite().save(f"{saved}.unfinished")
            _rename(spark, f"{saved}.unfinished", saved)  # whole or not at all
            self.trained += 1
            self._model = PipelineModel.load(saved)
        return self._model

    def decide(self, batch: DataFrame, model: PipelineModel) -> DataFrame:
        """BUY where the probability of 1 reaches the threshold, SELL where that of 0 does, PASS else."""
        out, p = learning.scored(model, batch), F.col("p")
        return out.withColumn("action", F.when(p >= self.threshold, "BUY").when(p <= 1 - self.threshold, "SELL").otherwise("PASS")).select(*SIGNAL)

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch, for ``foreachBatch``."""
        model = self.model(batch)
        if model is None:
            return
        spark, path = batch.sparkSession, f"{self.signals_path}/batch={number}"
        self.decide(batch, model).write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
        if self.on_signal:
            self.on_signal(found, number)
        if self.on_update:
            counts = found.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("BUY", "SELL", "PASS")], F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price")).first()
            self.on_update({"batch": number, **counts.asDict()})

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """Run over a stream: what is there, and then an end; or a batch ``every`` so often until stopped."""
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def run(self, stream: DataFrame, minutes: float, every: str = "1 minute") -> DataFrame:
        """Run for so many minutes and return the summary of all signals so far."""
        run_for(self.start(stream, every), 60 * minutes)
        return self.summary(stream.sparkSession)

    def signals(self, spark: SparkSession) -> DataFrame:
        kinds = "symbol string, ts timestamp, action string, p double, price double, batch long"
        return spark.read.schema(kinds).parquet(self.signals_path) if _exists(spark, self.signals_path) else spark.createDataFrame([], kinds)

    def summary(self, spark: SparkSession) -> DataFrame:
        """``total``, ``buys``, ``sells``, ``passes``, ``avg_confidence``, and action and price of the latest signal, in one row."""
        at = F.struct("ts", "symbol")
        return self.signals(spark).agg(
            F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("BUY", "buys"), ("SELL", "sells"), ("PASS", "passes"))],
            F.avg("p").alias("avg_confidence"), F.max_by("action", at).alias("latest_action"), F.max_by("price", at).alias("latest_price"),
        )
