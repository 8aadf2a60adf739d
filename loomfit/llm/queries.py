"""Queries of this subpackage over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfit.llm import clusters, heavy, neighbours, packing, runs, terms, together, tokens, topics
from loomfit.llm.shared import counting_copies
from loomfit.session import store


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Share of all ids, or of all ratings, from which an id counts as frequent in p1_found.
FREQUENT = 0.005


def p1_top(spark: SparkSession, d: str, share: float = FREQUENT) -> DataFrame:
    """The most frequent ids with their counts. At most ``1 / share`` ids can have that share, which is the k."""
    k = int(1 / share + 1e-9)
    seqs = counting_copies(table(spark, d, "item_seqs"), "sequence").select("sequence")
    items = heavy.distinct_ratings(table(spark, d, "ratings")).select("item")
    a = heavy.top_items(heavy.node_counts(seqs, skip_zero_and_null=True), k, share)
    b = heavy.top_items(heavy.node_counts(items), k, share)
    named = [x.select(F.lit(f).alias("field"), F.col("item").alias("id"), "n", "total") for f, x in (("sequence", a), ("item", b))]
    return named[0].unionByName(named[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_top(spark, d).select("field", "id")


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run with its positions, number of events and duration in seconds."""
    copies = counting_copies(table(spark, d, "item_seqs"), "sequence", "secs")
    found = runs.repeated_links(copies, table(spark, d, "item_alias"))
    return runs.collapse(found).drop("dup")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_runs(spark, d).select("seq_id", "first_pos", "last_pos")


#: An id in fewer sequences is rare; one in at least this share of the sequences is common.
RARE, COMMON = 3, 0.02


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of right ids in the same cluster of three or more mutually similar vectors."""
    return clusters.pairs(clusters.tight_clusters(right(table(spark, d, "item_data"))))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size and most typical ids, loose groups split around medoids."""
    return clusters.described(right(table(spark, d, "item_data")))


def right(item_data: DataFrame) -> DataFrame:
    return item_data.where("type")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and sequences of every id, with its marks."""
    counts, filled = terms.term_frequencies(counting_copies(table(spark, d, "item_seqs"), "sequence").select("sequence"))
    rare, common = F.col("records") < RARE, F.col("records") >= F.lit(COMMON * filled - 1e-9)
    return counts.select(F.col("term").alias("id"), "occurrences", F.col("records").alias("sequences"), rare.alias("rare"), common.alias("common"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    seen = p5_terms(spark, d)
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    marked = seen.select("id", F.explode(marks).alias("mark"))
    told = table(spark, d, "item_data").where("id <> 0 AND cn IS NOT NULL").select("id", "cn")
    wrong = told.join(seen, "id", "left").where("NOT coalesce(common, false) AND cn <> coalesce(occurrences, 0)")
    return marked.unionByName(wrong.select("id", F.lit("miscounted").alias("mark")).distinct())


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The up to five most similar vectors of every vector, from 0.9 on."""
    near = neighbours.most_similar(table(spark, d, "item_data"))
    return near.select(F.when(F.col("type"), "right").otherwise("left").alias("side"), "id", "other", "similarity", "place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_neighbours(spark, d).select("side", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids that share sequences far more often than chance, with their counts and association."""
    pairs = together.appear_together(counting_copies(table(spark, d, "item_seqs"), "sequence").select("sequence"))
    return pairs.withColumns({c: F.round(c, 9) for c in ("jaccard", "lift", "pmi")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pairs(spark, d).select("id_a", "id_b")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again; null became the empty text."""
    return tokens.decode_ids(p8_ids(spark, d))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document's pieces."""
    return packing.pack_documents(table(spark, d, "documents"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """For every document: all its tokens are placed, in pieces one after another, cut only where it is larger than a
    container, and no container it is in holds too much."""
    placed = store(p9_containers(spark, d), "placed").df
    size = p8_ids(spark, d).select("doc_id", F.size("ids").alias("tokens"))
    used = placed.groupBy("container").agg((F.sum("size") <= packing.CAPACITY).alias("fits"))
    each = placed.join(used, "container").groupBy("doc_id").agg(F.sum("size").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.bool_and(F.col("start") == F.col("piece") * packing.CAPACITY).alias("whole"), F.bool_and("fits").alias("fits"))
    least = F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1))
    right = F.col("fits") & F.col("whole") & (F.col("placed") == F.col("tokens")) & (F.col("pieces") == least) & (F.col("last") == F.col("pieces") - 1)
    return size.join(each, "doc_id", "left").select("doc_id", F.coalesce(right, F.lit(False)).alias("right"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers and documents, tokens, and the share of the space in use."""
    placed = p9_containers(spark, d)
    each = placed.groupBy("container").agg(F.sum("size").alias("tokens"), F.count_if(F.col("piece") == 0).alias("documents"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("used"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return topics.subjects_of(docs, table(spark, d, "subjects"), table(spark, d, "subject_labels"))


COPIES = """c AS (SELECT * FROM item_seqs QUALIFY row_number() OVER (PARTITION BY seq_id
  ORDER BY loaded_at DESC NULLS LAST, len(sequence) DESC NULLS LAST) = 1)"""

P1 = f"""WITH {COPIES}, ids AS (SELECT unnest(sequence) AS id FROM c),
 s AS (SELECT 'sequence' AS field, id, count(*) AS n FROM ids WHERE id IS NOT NULL AND id <> 0 GROUP BY id),
 r AS (SELECT rating_id, any_value(item) AS id FROM ratings WHERE rating_id IS NOT NULL GROUP BY rating_id),
 i AS (SELECT 'item' AS field, id, count(*) AS n FROM r GROUP BY id),
 u AS (SELECT *, sum(n) OVER () AS total FROM s UNION ALL SELECT *, sum(n) OVER () AS total FROM i)
SELECT field, id{{more}} FROM u WHERE id IS NOT NULL AND n >= {FREQUENT} * total"""

P2 = f"""WITH RECURSIVE {COPIES},
 al AS (SELECT alias, item FROM item_alias WHERE alias IS NOT NULL QUALIFY row_number() OVER (PARTITION BY alias ORDER BY since DESC NULLS LAST, item NULLS LAST) = 1),
 hop AS (SELECT alias, item, 1 AS k FROM al WHERE item IS NOT NULL AND item <> alias
  UNION ALL SELECT h.alias, al.item, k + 1 FROM hop h JOIN al ON h.item = al.alias WHERE al.item IS NOT NULL AND al.item <> al.alias),
 root AS (SELECT alias, arg_max(item, k) AS root FROM hop GROUP BY alias),
 e AS (SELECT seq_id, CAST(i - 1 AS INTEGER) AS pos, sequence[i] AS id, secs[i] AS t FROM (SELECT *, unnest(range(1, len(sequence) + 1)) AS i FROM c)),
 x AS (SELECT seq_id, pos, t, coalesce(root, id) AS item FROM e LEFT JOIN root ON id = alias WHERE id IS NOT NULL AND id <> 0),
 l AS (SELECT *, lag(item) OVER w AS b, lag(t) OVER w AS bt FROM x WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
 g AS (SELECT *, sum(CASE WHEN b = item AND coalesce(t - bt <= 600, true) THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM l)
SELECT seq_id, min(pos) AS first_pos, max(pos) AS last_pos{{more}} FROM g GROUP BY seq_id, run HAVING count(*) > 1"""

TERMS = f"""WITH {COPIES}, e AS (SELECT seq_id, unnest(sequence) AS id FROM c),
 f AS (SELECT id, count(*) AS occurrences, count(DISTINCT seq_id) AS sequences FROM e WHERE id IS NOT NULL AND id <> 0 GROUP BY id),
 m AS (SELECT *, sequences < {RARE} AS rare, sequences >= {COMMON} * (SELECT count(*) FROM c WHERE len(sequence) > 0) AS common FROM f)"""

P7 = f"""WITH {COPIES}, e AS (SELECT DISTINCT seq_id, id FROM (SELECT seq_id, unnest(sequence) AS id FROM c) WHERE id IS NOT NULL AND id <> 0),
 f AS (SELECT id, count(*) AS k FROM e GROUP BY id), n AS (SELECT count(*) AS n FROM c WHERE len(sequence) > 0),
 p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n_ab FROM e a JOIN e b ON a.seq_id = b.seq_id AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b{{more}} FROM p JOIN f a ON a.id = id_a JOIN f b ON b.id = id_b CROSS JOIN n
 WHERE n_ab >= 6 AND n_ab / (a.k + b.k - n_ab) >= 0.2 AND n_ab * n / (a.k * b.k) >= 5"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_top": p1_top,
    "p2_found": p2_found,
    "p2_runs": p2_runs,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_ids": p8_ids,
    "p8_text": p8_text,
    "p9_containers": p9_containers,
    "p9_documents": p9_documents,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
}

USABLE = """u AS (SELECT DISTINCT type, id, f[1:48]::DOUBLE[48] AS f FROM item_data WHERE type IS NOT NULL AND id IS NOT NULL AND len(f) = 49
 AND list_bool_and(list_transform(f, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(f[1:48], lambda x: x <> 0)))"""

P3 = f"""WITH {USABLE}, r AS (SELECT id, f FROM u WHERE type), e AS (SELECT a.id AS a, b.id AS b FROM r a, r b WHERE a.id = b.id OR array_cosine_similarity(a.f, b.f) >= 0.9),
 n AS (SELECT a, list(b ORDER BY b) AS near FROM e GROUP BY a), c AS (SELECT near FROM n GROUP BY near HAVING count(*) = len(near) AND len(near) >= 3),
 m AS (SELECT near, unnest(near) AS id FROM c)
SELECT x.id AS id_a, y.id AS id_b FROM m x JOIN m y ON x.near = y.near AND x.id < y.id"""

P6 = f"""WITH {USABLE}, e AS (SELECT a.type, a.id, b.id AS other, array_cosine_similarity(a.f, b.f) AS s FROM u a JOIN u b ON a.type = b.type AND a.id <> b.id AND array_cosine_similarity(a.f, b.f) >= 0.9),
 k AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY round(s, 12) DESC, other) AS r FROM e)
SELECT DISTINCT CASE WHEN type THEN 'right' ELSE 'left' END AS side, least(id, other) AS id_a, greatest(id, other) AS id_b FROM k WHERE r <= 5"""

SQL: dict[str, str] = {
    "p3_found": P3,
    "p6_found": P6,
    "p1_found": P1.format(more=""),
    "p1_top": P1.format(more=", n, CAST(total AS BIGINT) AS total"),
    "p2_found": P2.format(more=""),
    "p2_runs": P2.format(more=", count(*) AS n, arg_max_null(t, pos) - arg_min_null(t, pos) AS duration"),
    "p5_found": TERMS + """ SELECT id, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT id, 'common' FROM m WHERE common
 UNION ALL SELECT DISTINCT d.id, 'miscounted' FROM item_data d LEFT JOIN m USING (id) WHERE d.id <> 0 AND cn IS NOT NULL AND NOT coalesce(common, false) AND cn <> coalesce(occurrences, 0)""",
    "p5_terms": TERMS + " SELECT * FROM m",
    "p7_found": P7.format(more=""),
    "p7_pairs": P7.format(more=", n_ab, a.k AS n_a, b.k AS n_b, n, round(n_ab / (a.k + b.k - n_ab), 9) AS jaccard, round(n_ab * n / (a.k * b.k), 9) AS lift, round(log2(n_ab * n / (a.k * b.k)), 9) AS pmi"),
    "p9_documents": 'SELECT doc_id, true AS "right" FROM documents',
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
