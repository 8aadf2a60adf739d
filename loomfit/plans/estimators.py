"""The two estimators: skip-gram with negative sampling, and logistic matrix factorization."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfit.operators import pairs as pair_ops
from loomfit.operators import vocab
from loomfit.params import SAMPLING_MODES, TrainParams
from loomfit.plans.trainer import Metrics, train
from loomfit.session import store
from loomfit.sources import tables


class _Estimator:
    """Fluent setters; every setter checks its value and returns the estimator."""

    def __init__(self) -> None:
        self.params = TrainParams()
        self.metrics = Metrics()
        self.checkpoint: list = [None, 0]

    def _with(self, **values):
        self.params = replace(self.params, **values)
        return self

    def setVectorSize(self, n: int):
        return self._with(vector_size=n)

    def setNegative(self, n: int):
        return self._with(negative=n)

    def setNumIterations(self, n: int):
        return self._with(num_iterations=n)

    def setLearningRate(self, x: float):
        return self._with(learning_rate=x)

    def setNumPartitions(self, n: int):
        return self._with(num_partitions=n)

    def setPow(self, x: float):
        return self._with(pow=x)

    def setLambdaL(self, x: float):
        """L2 weight of the left vectors."""
        return self._with(lambda_l=x)

    def setLambdaR(self, x: float):
        """L2 weight of the right vectors."""
        return self._with(lambda_r=x)

    def setUseBias(self, on: bool):
        return self._with(use_bias=on)

    def setSeed(self, seed: int):
        return self._with(seed=seed)

    def setBatchSize(self, n: int):
        return self._with(batch_size=n)

    def setGamma(self, x: float):
        """Weight of a negative relative to its positive."""
        return self._with(gamma=x)

    def setCheckpoint(self, path: str, interval: int):
        """Write the vectors every ``interval`` rotations under ``path``, and take up what is found there."""
        return self.setCheckpointPath(path).setCheckpointInterval(interval)

    def setCheckpointPath(self, path: str):
        """Goes together with :meth:`setCheckpointInterval`; the order does not matter."""
        self.checkpoint[0] = path
        return self

    def setCheckpointInterval(self, interval: int):
        """In rotations."""
        self.checkpoint[1] = self._at_least("checkpoint_interval", interval)
        return self

    def setNumThread(self, n: int):
        """Accepted without effect: every partition is trained by one thread, and there are as many tasks as partitions."""
        self._at_least("num_thread", n)
        return self

    def setIntermediateRDDStorageLevel(self, level: object):
        """Accepted without effect: intermediate tables are written to the shared folder, where executors cannot lose them."""
        if str(level).upper() == "NONE":
            raise ValueError("the storage level must not be NONE")
        return self

    def _ready(self) -> TrainParams:
        """The parameters, with path and interval of checkpoints checked."""
        path, interval = self.checkpoint
        return replace(self.params, checkpoint_path=path, checkpoint_interval=interval)

    @staticmethod
    def _spread(df: DataFrame) -> DataFrame:
        """The input dealt evenly over the cluster: few or large files would leave pairing to few tasks."""
        return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    @staticmethod
    def _at_least(name: str, n: int) -> int:
        if n < 0:
            raise ValueError(f"{name} must not be negative")
        return n


class SkipGram(_Estimator):
    """Skip-gram embeddings of the ids of ``sequence``, with left and right vectors for each."""

    def __init__(self) -> None:
        super().__init__()
        self.min_count, self.window, self.mode = 1, 1, None

    def setMinCount(self, n: int):
        self.min_count = self._at_least("min_count", n)
        return self

    def setWindowSize(self, n: int):
        if n < 1:
            raise ValueError("window size must be positive")
        self.window = n
        return self

    def setSamplingMode(self, mode: str):
        if mode not in SAMPLING_MODES:
            raise ValueError(f"sampling mode must be one of {', '.join(SAMPLING_MODES)}")
        self.mode = mode
        return self

    def initial(self, seqs: DataFrame) -> DataFrame:
        rows = vocab.both_roles(vocab.word_counts(seqs, self.min_count))
        rows = vocab.signed_roles(rows) if self.mode == "ITEM2VEC_POS2NEG" else rows
        return vocab.first_vectors(rows, self.params.vector_size, self.params.use_bias, self.params.seed)

    def pairs(self, seqs: DataFrame, epoch: int) -> DataFrame:
        seed = self.params.seed * 1_000_003 + epoch
        if self.mode == "WINDOW":
            got = pair_ops.window_pairs(seqs, self.window)
        elif self.mode == "ITEM2VEC":
            got = pair_ops.item2vec_pairs(seqs, self.window, seed)
        else:
            got = pair_ops.pos2neg_pairs(seqs, self.window, seed)
        none = F.lit(None).cast("float")
        return got.withColumns({"label": none, "weight": none})

    def fit(self, df: DataFrame) -> DataFrame:
        """``type, id, cn, f`` after training. Null ids are left out; rare words keep their positions while pairing.

        An empty input gives no rows.
        """
        if self.mode is None:
            raise ValueError("set a sampling mode first")
        p = self._ready()
        seqs = store(self._spread(tables.sequences(df)), "sequences")
        out, self.metrics = train(self.initial(seqs.df), lambda e: self.pairs(seqs.df, e), p, same_domain=True)
        seqs.drop()
        return out


class LogisticMF(_Estimator):
    """Logistic factorization of ``user, item, rating``: users have left vectors, items right ones."""

    def __init__(self) -> None:
        super().__init__()
        self.min_user, self.min_item, self.gamma, self.max_weight = 1, 1, None, 100.0

    def setMinUserCount(self, n: int):
        self.min_user = self._at_least("min_user_count", n)
        return self

    def setMinItemCount(self, n: int):
        self.min_item = self._at_least("min_item_count", n)
        return self

    def setMaxWeight(self, x: float):
        """Largest weight of an implicit rating; larger ones count as this."""
        if not x > 0:
            raise ValueError("max_weight must be positive")
        self.max_weight = float(x)
        return self

    def setImplicitPref(self, on: bool):
        return self._with(implicit=on)

    def setGamma(self, x: float):
        self.gamma = x
        return super().setGamma(x)

    def initial(self, rows: DataFrame) -> DataFrame:
        return vocab.first_vectors(vocab.role_counts(rows, self.min_user, self.min_item), self.params.vector_size, self.params.use_bias, self.params.seed)

    def fit(self, df: DataFrame) -> DataFrame:
        """``type, id, cn, f`` after training.

        Rows with a null id, or a null or NaN rating, are left out. Explicit ratings must be 0 or 1. All negatives of a
        pair weigh as much as the pair, unless gamma is set. An implicit rating is a weight: a negative one weighs nothing and
        an absurd one, infinity included, as much as ``setMaxWeight`` (100) allows; their rows count and their ids have vectors.
        """
        p = self._ready()
        p = p if self.gamma is not None else replace(p, gamma=1 / p.negative)
        known = tables.ratings(df).where("user IS NOT NULL AND item IS NOT NULL AND rating IS NOT NULL AND NOT isnan(rating)")
        rows = store(self._spread(known), "ratings")
        if not p.implicit and (bad := rows.df.where("rating NOT IN (0, 1)").first()):
            raise ValueError(f"explicit ratings must be 0 or 1, not {bad['rating']}")
        pairs = pair_ops.rating_pairs(rows.df, p.implicit)
        if p.implicit:
            pairs = pairs.withColumn("weight", F.least(F.greatest("weight", F.lit(0.0)), F.lit(self.max_weight)).cast("float"))
        out, self.metrics = train(self.initial(rows.df), lambda e: pairs, p, same_domain=False)
        rows.drop()
        return out
