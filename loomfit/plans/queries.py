"""Queries for every operator, over the tables of a folder, and the SQL each is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfit.functions import scalars
from loomfit.functions.hashing import RIGHT_SALT, hashed, owners, partitions, units
from loomfit.operators import pairs, vocab
from loomfit.params import TrainParams
from loomfit.plans.estimators import LogisticMF, SkipGram
from loomfit.plans.trainer import epoch_pairs, train
from loomfit.session import shared_dir, store
from loomfit.sources import checkpoint, tables
from loomfit.sources.tables import table

WINDOW, N, DIM, LR = 3, 4, 64, 0.05


def _line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    return tables.baskets(_line(spark, d))


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return tables.signed_baskets(_line(spark, d))


def _ratings(spark: SparkSession, d: str, explicit: bool = False) -> DataFrame:
    return tables.basket_ratings(_line(spark, d), table(spark, d, "orders"), explicit)


def sequence_scan(spark, d):
    return tables.sequences(table(spark, d, "item_seqs"))


def rating_scan(spark, d):
    """All ratings; NaN, which is unequal to itself, as a column of its own."""
    nan = F.coalesce(F.isnan("rating"), F.lit(False))
    return tables.ratings(table(spark, d, "ratings")).select("user", "item", F.when(~nan, F.col("rating")).alias("rating"), nan.alias("nan"))


def vocab_count(spark, d):
    return vocab.word_counts(_baskets(spark, d))


def vocab_min_count(spark, d):
    return vocab.word_counts(_baskets(spark, d), 30)


def lmf_roles_count(spark, d):
    return vocab.role_counts(table(spark, d, "ratings"))


def lmf_roles_min_count(spark, d):
    return vocab.role_counts(table(spark, d, "ratings"), 20, 5)


def pos2neg_roles(spark, d):
    return vocab.signed_roles(vocab.both_roles(vocab.word_counts(_signed(spark, d))))


def skipgram_init_rows(spark, d):
    return vocab.both_roles(vocab.word_counts(_baskets(spark, d), 2))


def window_pairs(spark, d):
    return pairs.window_pairs(_baskets(spark, d), WINDOW)


def pairs_by_part(spark, d):
    """Pairs of each partition in each rotation of the first epoch, as training reads them."""
    made = epoch_pairs(window_pairs(spark, d).withColumns({"label": F.lit(None).cast("float"), "weight": F.lit(None).cast("float")}), 0, N)
    return made.df.groupBy("rotation", "part").agg(F.sum("n").alias("pairs"))


def oov_pairs(spark, d):
    """Pairs both of whose words occur at least 30 times; rare words kept their positions."""
    known = vocab.word_counts(_baskets(spark, d), 30)
    return pairs.window_pairs(_baskets(spark, d), WINDOW).transform(vocab.in_vocab, known, known)


def item2vec_draws(spark, d):
    s = _baskets(spark, d)
    return s.select("l_orderkey", (F.size("sequence") * pairs.item2vec_budget(F.size("sequence"), WINDOW)).cast("bigint").alias("draws"))


def pos2neg_draws(spark, d):
    left, right = pairs.sequence_parts(F.col("sequence"))
    return _signed(spark, d).select("l_orderkey", (F.size(left) * pairs.item2vec_budget(F.size(right), 1)).cast("bigint").alias("draws"))


def item2vec_pairs(spark, d):
    return pairs.item2vec_pairs(_baskets(spark, d), WINDOW, 1)


def pos2neg_pairs(spark, d):
    return pairs.pos2neg_pairs(_signed(spark, d), 1, 1)


def _drawn(pairs: DataFrame, allowed: DataFrame, again: DataFrame) -> DataFrame:
    """Per left id the drawn pairs, those that no basket allows, and whether drawing again gives the same pairs."""
    both = pairs.withColumn("n", F.lit(1)).unionByName(again.withColumn("n", F.lit(-1)))
    each = both.groupBy("left", "right").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("pairs"), F.sum("n").alias("off"))
    known = each.join(allowed.distinct().withColumn("known", F.lit(True)), ["left", "right"], "left")
    return known.groupBy("left").agg(F.sum("pairs").alias("pairs"), F.count_if(F.col("known").isNull()).alias("strange"), F.bool_and(F.col("off") == 0).alias("same"))


def item2vec_drawn(spark, d):
    """Drawn pairs of the baskets without repeated parts, by left id: their number is the budget, both ids are of one basket."""
    s = _baskets(spark, d).where(F.size(F.array_distinct("sequence")) == F.size("sequence"))
    return _drawn(pairs.item2vec_pairs(s, WINDOW, 1), pairs.window_pairs(s, 1_000), pairs.item2vec_pairs(s, WINDOW, 1))


def pos2neg_drawn(spark, d):
    """The same of two-role baskets: parts with suppliers."""
    s = _signed(spark, d)
    left, right = pairs.sequence_parts(F.col("sequence"))
    allowed = s.select(F.explode(left).alias("left"), right.alias("r")).select("left", F.explode("r").alias("right"))
    return _drawn(pairs.pos2neg_pairs(s, 1, 1), allowed, pairs.pos2neg_pairs(s, 1, 1))


def lmf_pairs_implicit(spark, d):
    return pairs.rating_pairs(_ratings(spark, d), True)


def lmf_pairs_explicit(spark, d):
    return pairs.rating_pairs(_ratings(spark, d, True), False)


def lmf_pairs_by_part(spark, d):
    """Rating pairs by the partition of their user in the first epoch."""
    rows = store(pairs.rating_pairs(_ratings(spark, d), True).select("left"), "pairs").df
    return hashed(rows, {"part": (F.col("left"), 0, N)}).groupBy("part").agg(F.count(F.lit(1)).alias("pairs"))


def partition_hash(spark, d):
    ids = table(spark, d, "item_data").select("id").distinct().where("id IS NOT NULL")
    return hashed(ids, {"p0": (F.col("id"), 0, 4), "p3": (F.col("id"), 3, 4), "wide": (F.col("id"), 0, 2_500_000)})


def rotation_exactly_once(spark, d):
    """For each pair of a user and an item that occurs, the number of rotations that own it: one."""
    every = store(_ratings(spark, d).select("user", "item").distinct(), "pairs").df
    turned = every.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    both = partitions(turned, 1, F.col("rotation"), N, "user", "item").withColumn("task_", F.spark_partition_id())
    return both.groupBy("user", "item").agg(F.count_if(F.expr("left_part = right_part AND task_ >= 0")).alias("owners"))


def unigram_prob(spark, d):
    return vocab.unigram(vocab_count(spark, d), 0.75).select("id", "cn", F.round("prob", 12).alias("prob"))


def unigram_cdf(spark, d):
    return vocab.unigram_cdf(vocab_count(spark, d), 0.75).select("id", F.round("cdf", 9).alias("cdf"))


def _scores(spark, d):
    """Score of each vector of ``embeddings`` with that of the next id, tenfold."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("other"))
    f = scalars.dot(F.col("embedding"), F.col("b"), DIM) * 10
    return e.join(other, "vec_id").select("vec_id", "embedding", "b", f.alias("f"), (F.col("label") == F.col("other")).cast("double").alias("y"))


def dot_score(spark, d):
    return _scores(spark, d).select("vec_id", F.round("f", 9).alias("f"))


def sigmoid(spark, d):
    return _scores(spark, d).select("vec_id", F.round(scalars.sigmoid(F.col("f")), 9).alias("s"))


def sigmoid_table(spark, d):
    f = F.round("f", 6)
    return _scores(spark, d).select("vec_id", F.round(scalars.sigmoid_table(f), 9).alias("s"))


def logloss(spark, d):
    return _scores(spark, d).select("vec_id", F.round(scalars.logloss(F.col("f"), F.col("y")), 9).alias("loss"))


def gradient_step(spark, d):
    """First values of each vector after one explicit step on its pair."""
    s = _scores(spark, d).withColumn("g", (F.col("y") - scalars.sigmoid(F.col("f"))) * LR)
    moved = scalars.axpy(F.col("g"), F.col("b"), F.col("embedding"))
    return s.select("vec_id", F.round(F.get(moved, F.lit(0)), 9).alias("x0"), F.round(F.get(moved, F.lit(DIM - 1)), 9).alias("x63"))


NAMES = (("9_3", True), ("10_1", True), ("run_params", True), ("10_2", False), ("x_1", True), ("_temporary", False))


def latest_checkpoint(spark, d):
    return checkpoint.latest(spark.createDataFrame(list(NAMES), "name string, committed boolean"))


def init_vectors(spark, d):
    return vocab.first_vectors(skipgram_init_rows(spark, d), 16, True, 1)


def checkpoint_roundtrip(spark, d):
    """First vectors through the sink, which replaces what an earlier run left, and back from the latest state found."""
    root = f"{shared_dir(spark).rstrip('/')}/loomfit/roundtrip-{uuid.uuid4().hex}"
    rows = init_vectors(spark, d)
    checkpoint.write(rows.limit(1), f"{root}/0_1")
    checkpoint.write(rows, f"{root}/0_1")
    epoch, done = checkpoint.latest_committed(spark, root)
    return checkpoint.read(spark, f"{root}/{epoch}_{done}")


def init_vectors_check(spark, d):
    """Per side the first vectors: those of the right length, within the bounds, with bias 0, and the distinct ones."""
    x = F.slice("f", 1, 16)
    ok = {"sound": F.size("f") == 17, "bounded": F.forall(x, lambda v: F.abs(v) <= 0.5 / 16), "unbiased": F.get("f", F.lit(16)) == 0}
    return init_vectors(spark, d).groupBy("type").agg(*[F.count_if(c).alias(name) for name, c in ok.items()], F.count_distinct("f").alias("distinct"))


def checkpoint_check(spark, d):
    """Every row of the first vectors, and whether it came back from the sink unchanged."""
    back = checkpoint_roundtrip(spark, d).withColumnsRenamed({"cn": "cn_", "f": "f_"})
    return init_vectors(spark, d).join(back, ["type", "id"], "full").select("type", "id", "cn", F.coalesce((F.col("cn") == F.col("cn_")) & (F.col("f") == F.col("f_")), F.lit(False)).alias("same"))


def _skipgram(mode: str) -> SkipGram:
    return SkipGram().setVectorSize(32).setSamplingMode(mode).setLearningRate(LR).setNumPartitions(5).setSeed(1)


def train_skipgram_window(spark, d):
    return _skipgram("WINDOW").setWindowSize(WINDOW).fit(_baskets(spark, d))


def train_skipgram_item2vec(spark, d):
    return _skipgram("ITEM2VEC").setPow(0.75).fit(_baskets(spark, d))


def train_skipgram_pos2neg(spark, d):
    return _skipgram("ITEM2VEC_POS2NEG").setUseBias(True).fit(_signed(spark, d))


def _factors() -> LogisticMF:
    return LogisticMF().setVectorSize(32).setLearningRate(LR).setNumPartitions(5).setUseBias(True).setLambdaL(0.001).setLambdaR(0.001).setSeed(1)


def train_lmf_implicit(spark, d):
    return _factors().setMinItemCount(5).fit(table(spark, d, "ratings"))


def train_lmf_explicit(spark, d):
    return _factors().setImplicitPref(False).fit(_ratings(spark, d, True))


def _checked(model, df: DataFrame) -> DataFrame:
    """One row: the vectors, how many of them are finite, and whether the last rotation's loss per pair is below the first's."""
    out = model.setNumIterations(2).fit(df)
    mean = [r["loss"] / r["pairs"] for r in model.metrics.rotations if r["pairs"]]
    sound = F.forall("f", lambda v: ~F.isnan(v) & (F.abs(v) < 1_000))
    return out.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(sound).alias("finite"), F.lit(mean[-1] < mean[0]).alias("learned"))


def train_check_window(spark, d):
    return _checked(_skipgram("WINDOW").setWindowSize(WINDOW), _baskets(spark, d))


def train_check_item2vec(spark, d):
    return _checked(_skipgram("ITEM2VEC").setPow(0.75), _baskets(spark, d))


def train_check_pos2neg(spark, d):
    return _checked(_skipgram("ITEM2VEC_POS2NEG").setUseBias(True), _signed(spark, d))


def train_check_implicit(spark, d):
    return _checked(_factors().setMinItemCount(5), table(spark, d, "ratings"))


def train_check_explicit(spark, d):
    return _checked(_factors().setImplicitPref(False), _ratings(spark, d, True))


#: Learning rate and L2 weights of the queries that check the trainer's values.
STEP, LEFT_L2, RIGHT_L2 = 0.5, 0.03, 0.02


def explicit_step(spark, d):
    """Trained values of vectors each of which is in one pair: every vector of ``embeddings`` with that of the next id."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).cast("bigint").alias("cn"), F.col("embedding").alias("f"))
    start = e.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("type"), "id", "cn", "f")
    made = _scores(spark, d).select(F.col("vec_id").alias("left"), (F.col("vec_id") + 1).alias("right"), F.col("y").cast("float").alias("label"), F.lit(None).cast("float").alias("weight"))
    p = TrainParams(vector_size=DIM, implicit=False, num_partitions=3, learning_rate=STEP, lambda_l=LEFT_L2, lambda_r=RIGHT_L2)
    out, _ = train(start, lambda e: made, p, same_domain=False)
    return out.select("type", "id", F.round(F.get("f", F.lit(0)).cast("double"), 4).alias("x0"), F.round(F.get("f", F.lit(DIM - 1)).cast("double"), 4).alias("x63"))


def negative_step(spark, d):
    """Trained values of one pair and five negatives, which of two right vectors can only be the one that is not the left id's."""
    e = table(spark, d, "embeddings").where("vec_id < 2").select(F.col("vec_id").alias("id"), F.lit(1).cast("bigint").alias("cn"), F.col("embedding").alias("f"))
    start = e.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("type"), "id", "cn", "f").where("type OR id = 0")
    made = spark.createDataFrame([(0, 1, None, 2.0)], "left bigint, right bigint, label float, weight float")
    out, _ = train(start, lambda e: made, TrainParams(vector_size=DIM, learning_rate=STEP, gamma=0.5, batch_size=1), same_domain=True)
    return out.select("type", "id", F.round(F.get("f", F.lit(0)).cast("double"), 5).alias("x0"), F.round(F.get("f", F.lit(DIM - 1)).cast("double"), 5).alias("x63"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f"q_{f.__name__}": f
    for f in (
        sequence_scan, rating_scan, vocab_count, vocab_min_count, lmf_roles_count, lmf_roles_min_count, pos2neg_roles, skipgram_init_rows, window_pairs, pairs_by_part, oov_pairs,
        item2vec_draws, pos2neg_draws, item2vec_pairs, pos2neg_pairs, lmf_pairs_implicit, lmf_pairs_explicit, lmf_pairs_by_part, partition_hash, rotation_exactly_once, unigram_prob,
        unigram_cdf, dot_score, sigmoid, sigmoid_table, logloss, gradient_step, latest_checkpoint, init_vectors, checkpoint_roundtrip, train_skipgram_window, train_skipgram_item2vec,
        train_skipgram_pos2neg, train_lmf_implicit, train_lmf_explicit, item2vec_drawn, pos2neg_drawn, init_vectors_check, checkpoint_check, train_check_window, train_check_item2vec,
        train_check_pos2neg, train_check_implicit, train_check_explicit, explicit_step, negative_step,
    )
}

BASKETS = "b AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS sequence FROM lineitem GROUP BY l_orderkey), w AS (SELECT unnest(sequence) AS id FROM b)"
POSITIONS = BASKETS + ", e AS (SELECT l_orderkey, i, sequence[i] AS id FROM (SELECT *, unnest(range(1, len(sequence) + 1)) AS i FROM b))"
PAIRS = POSITIONS + f", p AS (SELECT a.id AS \"left\", c.id AS \"right\" FROM e a JOIN e c ON a.l_orderkey = c.l_orderkey AND abs(a.i - c.i) <= {WINDOW} AND a.id <> c.id)"
RATED = "r AS (SELECT o_custkey AS \"user\", l_partkey AS item, CAST({} AS FLOAT) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
QUANTITY, RETURNED = RATED.format("l_quantity"), RATED.format("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")
SIDES = "s AS (SELECT false AS type, \"user\" AS id FROM ratings UNION ALL SELECT true, item FROM ratings), k AS (SELECT type, id, count(*) AS cn FROM s WHERE id IS NOT NULL GROUP BY ALL)"
SCORES = f"""e AS (SELECT a.vec_id, a.embedding AS a, b.embedding AS b, CAST(a.label = b.label AS INTEGER) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 f AS (SELECT *, 10 * list_sum(list_transform(range(1, {DIM + 1}), lambda k: CAST(a[k] AS DOUBLE) * CAST(b[k] AS DOUBLE))) AS f FROM e)"""
WRAP = 1 << 64


def _hash_steps(source: str, x: str, salts: dict[str, tuple[int, int]]) -> str:
    """A chain of common table expressions ``h0 .. h6`` over ``source`` that ends with a column per salt."""
    unsigned = f"(CASE WHEN {x} < 0 THEN CAST({x} AS HUGEINT) + {WRAP} ELSE CAST({x} AS HUGEINT) END)"
    out = [f"h0 AS (SELECT *, xor(CAST({unsigned} % 4294967296 AS UBIGINT), CAST({unsigned} // 4294967296 AS UBIGINT)) AS low FROM {source})"]
    out.append("h1 AS (SELECT *, " + ", ".join(f"CAST(low AS UBIGINT) * 4294967296::UBIGINT + {salt}::UBIGINT AS {name}" for name, (salt, _) in salts.items()) + " FROM h0)")
    fold = lambda c: f"xor({c}, {c} >> 33) AS {c}"
    k = 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, None):
        out.append(f"h{k + 1} AS (SELECT * REPLACE (" + ", ".join(fold(c) for c in salts) + f") FROM h{k})")
        k += 1
        if factor:
            out.append(f"h{k + 1} AS (SELECT * REPLACE (" + ", ".join(f"CAST(CAST({c} AS UHUGEINT) * {factor}::UHUGEINT % {WRAP}::UHUGEINT AS UBIGINT) AS {c}" for c in salts) + f") FROM h{k})")
            k += 1
    top = 1 << 63
    last = ", ".join(f"CAST(CASE WHEN {c} = {top} THEN 0 WHEN {c} > {top} THEN ({WRAP}::UHUGEINT - {c}) % {n} ELSE {c} % {n} END AS INTEGER) AS {c}" for c, (_, n) in salts.items())
    return ", ".join(out) + f", hashed AS (SELECT * REPLACE ({last}) FROM h{k})"


_SQL = {
    "sequence_scan": "SELECT sequence FROM item_seqs",
    "rating_scan": 'SELECT "user", item, CASE WHEN NOT isnan(rating) THEN rating END AS rating, coalesce(isnan(rating), false) AS nan FROM ratings',
    "vocab_count": f"WITH {BASKETS} SELECT id, count(*) AS cn FROM w GROUP BY id",
    "vocab_min_count": f"WITH {BASKETS} SELECT id, count(*) AS cn FROM w GROUP BY id HAVING count(*) >= 30",
    "lmf_roles_count": f"WITH {SIDES} SELECT * FROM k",
    "lmf_roles_min_count": f"WITH {SIDES} SELECT * FROM k WHERE cn >= CASE WHEN type THEN 5 ELSE 20 END",
    "pos2neg_roles": "SELECT false AS type, l_partkey + 1 AS id, count(*) AS cn FROM lineitem GROUP BY ALL UNION ALL SELECT true, -(l_suppkey + 1), count(*) FROM lineitem GROUP BY ALL",
    "skipgram_init_rows": f"WITH {BASKETS}, k AS (SELECT id, count(*) AS cn FROM w GROUP BY id HAVING count(*) >= 2) SELECT unnest([false, true]) AS type, id, cn FROM k",
    "window_pairs": f"WITH {PAIRS} SELECT * FROM p",
    "pairs_by_part": f"WITH {PAIRS}, ids AS (SELECT DISTINCT id FROM w), {_hash_steps('ids', 'id', {'l': (0, N), 'step': (RIGHT_SALT, len(units(N))), 'shift': (RIGHT_SALT + 1, N)})},"
    f" q AS (SELECT a.l, ({units(N)}[b.step + 1] * k + b.shift) % {N} AS r, k AS rotation FROM p JOIN hashed a ON a.id = p.\"left\" JOIN hashed b ON b.id = p.\"right\" CROSS JOIN range({N}) t(k))"
    " SELECT CAST(rotation AS INTEGER) AS rotation, l AS part, count(*) AS pairs FROM q WHERE l = r GROUP BY ALL",
    "oov_pairs": f"WITH {PAIRS}, k AS (SELECT id FROM w GROUP BY id HAVING count(*) >= 30) SELECT * FROM p WHERE \"left\" IN (FROM k) AND \"right\" IN (FROM k)",
    "item2vec_draws": f"WITH {BASKETS} SELECT l_orderkey, len(sequence) * least({2 * WINDOW}, len(sequence) - 1) AS draws FROM b",
    "pos2neg_draws": "SELECT l_orderkey, count(*) * least(2, count(*) - 1) AS draws FROM lineitem GROUP BY l_orderkey",
    "lmf_pairs_implicit": f'WITH {QUANTITY} SELECT "user" AS "left", item AS "right", CAST(NULL AS FLOAT) AS label, rating AS weight FROM r',
    "lmf_pairs_explicit": f'WITH {RETURNED} SELECT "user" AS "left", item AS "right", rating AS label, CAST(NULL AS FLOAT) AS weight FROM r',
    "lmf_pairs_by_part": f'WITH {QUANTITY}, {_hash_steps("r", chr(34) + "user" + chr(34), {"part": (0, N)})} SELECT part, count(*) AS pairs FROM hashed GROUP BY part',
    "partition_hash": f"WITH i AS (SELECT DISTINCT id FROM item_data WHERE id IS NOT NULL), {_hash_steps('i', 'id', {'p0': (0, 4), 'p3': (3, 4), 'wide': (0, 2_500_000)})} SELECT id, p0, p3, wide FROM hashed",
    "rotation_exactly_once": f'WITH {QUANTITY} SELECT DISTINCT "user", item, CAST(1 AS BIGINT) AS owners FROM r',
    "unigram_prob": f"WITH {BASKETS}, k AS (SELECT id, count(*) AS cn FROM w GROUP BY id) SELECT id, cn, round(pow(cn, 0.75) / sum(pow(cn, 0.75)) OVER (), 12) AS prob FROM k",
    "unigram_cdf": f"WITH {BASKETS}, k AS (SELECT id, count(*) AS cn FROM w GROUP BY id) SELECT id, round(sum(pow(cn, 0.75)) OVER (ORDER BY id) / sum(pow(cn, 0.75)) OVER (), 9) AS cdf FROM k",
    "dot_score": f"WITH {SCORES} SELECT vec_id, round(f, 9) AS f FROM f",
    "sigmoid": f"WITH {SCORES} SELECT vec_id, round(CASE WHEN f > 6 THEN 1 WHEN f < -6 THEN 0 ELSE 1 / (1 + exp(-f)) END, 9) AS s FROM f",
    "sigmoid_table": f"WITH {SCORES}, g AS (SELECT vec_id, round(f, 6) AS f FROM f) SELECT vec_id, round(CASE WHEN f > 6 THEN 1 WHEN f < -6 THEN 0 ELSE 1 / (1 + exp(-6 * (2 * least(floor((f + 6) * 83.0), 999) / 1000.0 - 1))) END, 9) AS s FROM g",
    "logloss": f"WITH {SCORES}, z AS (SELECT vec_id, CASE WHEN y = 1 THEN f ELSE -f END AS z FROM f) SELECT vec_id, round(CASE WHEN z > 6 THEN 0 WHEN z < -6 THEN {scalars.MISS} ELSE ln(1 + exp(-z)) END, 9) AS loss FROM z",
    "gradient_step": f"WITH {SCORES}, g AS (SELECT *, (y - CASE WHEN f > 6 THEN 1 WHEN f < -6 THEN 0 ELSE 1 / (1 + exp(-f)) END) * {LR} AS g FROM f)"
    f" SELECT vec_id, round(a[1] + g * b[1]::DOUBLE, 9) AS x0, round(a[{DIM}] + g * b[{DIM}]::DOUBLE, 9) AS x63 FROM g",
    "latest_checkpoint": "WITH n(name, committed) AS (VALUES " + ", ".join(f"('{a}', {str(c).lower()})" for a, c in NAMES) + "), m AS (SELECT CAST(split_part(name, '_', 1) AS INTEGER) AS epoch, CAST(split_part(name, '_', 2) AS INTEGER) AS iter"
    " FROM n WHERE committed AND regexp_full_match(name, '[0-9]+_[0-9]+')) SELECT epoch, iter FROM m ORDER BY epoch DESC, iter DESC LIMIT 1",
}
_SQL |= {
    "item2vec_drawn": f"WITH {BASKETS}, x AS (SELECT unnest(sequence) AS id, least({2 * WINDOW}, len(sequence) - 1) AS n FROM b WHERE len(list_distinct(sequence)) = len(sequence) AND len(sequence) > 1)"
    " SELECT id AS \"left\", sum(n)::BIGINT AS pairs, 0::BIGINT AS strange, true AS same FROM x GROUP BY ALL",
    "pos2neg_drawn": "WITH b AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_partkey + 1 AS \"left\", sum(least(2, n - 1))::BIGINT AS pairs, 0::BIGINT AS strange, true AS same"
    " FROM lineitem JOIN b USING (l_orderkey) WHERE n > 1 GROUP BY ALL",
    "init_vectors_check": f"WITH {BASKETS}, k AS (SELECT id FROM w GROUP BY id HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM k)"
    ' SELECT unnest([false, true]) AS type, n AS sound, n AS bounded, n AS unbiased, n AS "distinct" FROM n',
    "checkpoint_check": f"WITH {BASKETS}, k AS (SELECT id, count(*) AS cn FROM w GROUP BY id HAVING count(*) >= 2) SELECT unnest([false, true]) AS type, id, cn, true AS same FROM k",
    "train_check_window": "SELECT 2 * count(DISTINCT l_partkey) AS vectors, 2 * count(DISTINCT l_partkey) AS finite, true AS learned FROM lineitem",
    "train_check_item2vec": "SELECT 2 * count(DISTINCT l_partkey) AS vectors, 2 * count(DISTINCT l_partkey) AS finite, true AS learned FROM lineitem",
    "train_check_pos2neg": "WITH n AS (SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS n FROM lineitem) SELECT n AS vectors, n AS finite, true AS learned FROM n",
    "train_check_implicit": 'WITH r AS (SELECT "user", item FROM ratings WHERE "user" IS NOT NULL AND item IS NOT NULL AND rating IS NOT NULL AND NOT isnan(rating)),'
    ' i AS (SELECT item FROM r GROUP BY item HAVING count(*) >= 5), n AS (SELECT (SELECT count(DISTINCT "user") FROM r) + (SELECT count(*) FROM i) AS n) SELECT n AS vectors, n AS finite, true AS learned FROM n',
    "train_check_explicit": f'WITH {RETURNED}, n AS (SELECT count(DISTINCT "user") + count(DISTINCT item) AS n FROM r) SELECT n AS vectors, n AS finite, true AS learned FROM n',
    "explicit_step": f"WITH {SCORES.replace('10 * list_sum', 'list_sum')}, s AS (SELECT vec_id, a, b, {STEP} * (y - 1 / (1 + exp(-f))) AS g FROM f),"
    f" l AS (SELECT vec_id AS id, a[1] + g * b[1] - {STEP * LEFT_L2} * a[1] AS p, a[{DIM}] + g * b[{DIM}] - {STEP * LEFT_L2} * a[{DIM}] AS q FROM s),"
    f" r AS (SELECT vec_id + 1 AS id, b[1] + g * a[1] - {STEP * RIGHT_L2} * b[1] AS p, b[{DIM}] + g * a[{DIM}] - {STEP * RIGHT_L2} * b[{DIM}] AS q FROM s),"
    f" z AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS p, embedding[{DIM}]::DOUBLE AS q FROM embeddings)"
    " SELECT false AS type, z.id, round(coalesce(l.p, z.p), 4) AS x0, round(coalesce(l.q, z.q), 4) AS x63 FROM z LEFT JOIN l USING (id)"
    " UNION ALL SELECT true, z.id, round(coalesce(r.p, z.p), 4), round(coalesce(r.q, z.q), 4) FROM z LEFT JOIN r USING (id)",
    "negative_step": f"WITH RECURSIVE v AS (SELECT a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1),"
    f" t AS (SELECT 0 AS k, a, b, [0.0::DOUBLE for x in a] AS up FROM v UNION ALL SELECT k + 1, a, [x[1] + g * x[2] for x in list_zip(b, a)], [x[1] + g * x[2] for x in list_zip(up, b)]"
    f" FROM (SELECT *, {STEP} * CASE WHEN k = 0 THEN 2 ELSE 1 END * (CASE WHEN k = 0 THEN 1 ELSE 0 END - 1 / (1 + exp(-list_dot_product(a, b)))) AS g FROM t WHERE k < 6)),"
    f" z AS (SELECT * FROM t WHERE k = 6) SELECT false AS type, 0::BIGINT AS id, round(a[1] + up[1], 5) AS x0, round(a[{DIM}] + up[{DIM}], 5) AS x63 FROM z UNION ALL SELECT true, 1, round(b[1], 5), round(b[{DIM}], 5) FROM z"
    f" UNION ALL SELECT true, 0, round(embedding[1]::DOUBLE, 5), round(embedding[{DIM}]::DOUBLE, 5) FROM embeddings WHERE vec_id = 0",
}
SQL: dict[str, str] = {f"q_{name}": text for name, text in _SQL.items()}
