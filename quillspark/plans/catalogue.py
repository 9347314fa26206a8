"""Queries over the driver tables, one for each operator, and DuckDB SQL written independently for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BANNED_TOPIC_WORDS, CONTROL_TYPES, FIRST_PERSON, IMAGE_STOPWORDS, LEAK_STOPWORDS, MODELS, SECOND_PERSON, TOPIC_STOPWORDS
from ..functions import text as tx
from ..functions import vector as vx
from ..operators import assessment, candidates, controls, embed, features, hard_negatives, leakage, metrics, model, parse, residual, split, topics
from ..sources import readers
from . import experiments, mining, pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Texts that one file holds (small tables) in as many parts as there are cores; larger tables have enough as read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def r6(c) -> F.Column:
    return F.round(c, 6)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- relations ------------------------------------------------------------------------------------------------------


def works(spark, sf) -> DataFrame:
    """documents as works: four sources are the target set, the language is the control type."""
    target = F.col("source").isin("src0", "src1", "src2", "src3")
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.when(target, "target").otherwise("background").alias("set"), "lang", "source")


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("work_id"), F.col("turn").alias("index"), F.col("role").alias("type"), F.coalesce("text", F.lit("")).alias("text"))


def doc_atoms(spark, sf) -> DataFrame:
    return works(spark, sf).select(F.col("id").alias("work_id"), F.posexplode(tx.lines(F.col("text"))).alias("index", "text"))


def vectors(spark, sf) -> DataFrame:
    """embeddings as works with raw vectors: label 0 is the target set, 1 and 2 are the hard control types."""
    control = F.when(F.col("label") == 1, CONTROL_TYPES[0]).when(F.col("label") == 2, CONTROL_TYPES[1]).otherwise("generic")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.when(F.col("label") == 0, "target").otherwise("background").alias("set"), control.alias("control_type"), F.col("embedding").cast("array<double>").alias("vector"))
    return split.assign_splits(rows, ["set"])


def with_residuals(spark, sf) -> DataFrame:
    """vectors with residuals: the content basis of a work is the two vectors that follow it."""
    rows = vectors(spark, sf)
    n = rows.count()
    topic = rows.select("id", F.col("vector").alias("_v"))
    one = topic.select(F.pmod(F.col("id") - 1, F.lit(n)).alias("id"), F.col("_v").alias("_a"))
    two = topic.select(F.pmod(F.col("id") - 2, F.lit(n)).alias("id"), F.col("_v").alias("_b"))
    rows = rows.join(one, "id").join(two, "id")
    basis = residual.basis_vectors(F.array("_a", "_b"), F.lit(None).cast("array<double>"))
    return rows.withColumn("residual", vx.residualize(F.col("vector"), basis)).drop("_a", "_b")


def both_kinds(spark, sf) -> DataFrame:
    rows = with_residuals(spark, sf)
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("vector").alias("vector")), F.struct(F.lit("residual").alias("kind"), F.col("residual").alias("vector")))
    return rows.select("id", "label", "set", "control_type", "split", F.inline(kinds))


def similarities(spark, sf) -> DataFrame:
    return model.centroid_similarities(both_kinds(spark, sf))


def scores(spark, sf) -> DataFrame:
    return model.model_scores(similarities(spark, sf))


def kept_scores(spark, sf) -> DataFrame:
    """scores, kept for the searches that read them several times, until the caller clears the cache."""
    return scores(spark, sf).persist()


EMB = """emb AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v,
  CASE WHEN label = 0 THEN 'target' ELSE 'background' END AS st,
  CASE label WHEN 1 THEN 'same_topic_generic_ai_near_miss' WHEN 2 THEN 'attempted_lookalike' ELSE 'generic' END AS ctrl FROM embeddings),
 es AS (SELECT *, CASE WHEN n >= 3 THEN CASE WHEN i < n - 2 * greatest(1, n // 5) THEN 'train' WHEN i < n - greatest(1, n // 5) THEN 'validation' ELSE 'test' END
   WHEN n = 2 AND i = 1 THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY sha256('137' || chr(31) || id::VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY st) AS n FROM emb))"""
RES = (
    EMB
    + """, b1 AS (SELECT e.*, list_transform(p.v, lambda x: x / sqrt(list_dot_product(p.v, p.v))) AS q1, list_transform(q.v, lambda x: x / sqrt(list_dot_product(q.v, q.v))) AS w2
  FROM es e JOIN es p ON p.id = (e.id + 1) % (SELECT count(*) FROM emb) JOIN es q ON q.id = (e.id + 2) % (SELECT count(*) FROM emb)),
 b2 AS (SELECT *, list_transform(w2, lambda x, i: x - list_dot_product(w2, q1) * q1[i]) AS r2 FROM b1),
 b3 AS (SELECT *, list_transform(r2, lambda x: x / sqrt(list_dot_product(r2, r2))) AS q2 FROM b2),
 b4 AS (SELECT *, list_transform(v, lambda x, i: x - list_dot_product(v, q1) * q1[i] - list_dot_product(v, q2) * q2[i]) AS u FROM b3),
 res AS (SELECT *, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS rv FROM b4)"""
)
SIM = (
    RES
    + """, vecs AS (SELECT id, label, st, ctrl, split, 'raw' AS kind, v AS vec FROM res UNION ALL SELECT id, label, st, ctrl, split, 'residual', rv FROM res),
 roles AS (SELECT kind, st AS role, vec FROM vecs WHERE split = 'train' UNION ALL SELECT kind, 'near_miss', vec FROM vecs WHERE split = 'train' AND st = 'background' AND ctrl <> 'generic'),
 cells AS (SELECT kind, role, pos, avg(x) AS x FROM (SELECT kind, role, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM roles) GROUP BY ALL),
 cents AS (SELECT kind, role, list(x ORDER BY pos) AS c FROM cells GROUP BY ALL),
 sims AS (SELECT v.*, list_cosine_similarity(vec, t.c) AS t, list_cosine_similarity(vec, b.c) AS b, list_cosine_similarity(vec, m.c) AS nm FROM vecs v
  JOIN cents t ON t.kind = v.kind AND t.role = 'target' JOIN cents b ON b.kind = v.kind AND b.role = 'background' LEFT JOIN cents m ON m.kind = v.kind AND m.role = 'near_miss')"""
)
SC = (
    SIM
    + f""", ms AS (SELECT unnest([{quoted(MODELS)}]) AS model),
 sc AS (SELECT model, id, st, ctrl, split, kind, t, CASE WHEN model LIKE '%target_similarity' THEN t WHEN model LIKE '%contrast%' THEN t - greatest(b, coalesce(nm, b)) ELSE t - b END AS score,
  st = 'target' AS act FROM sims JOIN ms ON kind = split_part(model, '_', 1))"""
)
AUC = """auc AS (SELECT p.model, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auc FROM val p JOIN val n ON p.model = n.model AND p.act AND NOT n.act GROUP BY p.model)"""
MET = """tp / greatest(1, p) AS recall, fp / greatest(1, n) AS fpr, (tp / greatest(1, p) + (n - fp) / greatest(1, n)) / 2 AS ba"""
CANDS = (
    SC
    + f""", val AS (SELECT * FROM sc WHERE split = 'validation'), {AUC},
 dv AS (SELECT DISTINCT model, score AS x FROM val), dt AS (SELECT DISTINCT model, t AS x FROM val),
 cm AS (SELECT model, coalesce((x + lead(x) OVER (PARTITION BY model ORDER BY x)) / 2, x + 1e-6) AS th FROM dv UNION ALL SELECT model, min(x) - 1e-6 FROM dv GROUP BY model),
 ct AS (SELECT model, coalesce((x + lead(x) OVER (PARTITION BY model ORDER BY x)) / 2, x + 1e-6) AS sth FROM dt UNION ALL SELECT model, min(x) - 1e-6 FROM dt GROUP BY model),
 cnt AS (SELECT c.model, c.th, count(*) FILTER (act AND score >= th)::DOUBLE AS tp, count(*) FILTER (NOT act AND score >= th)::DOUBLE AS fp, count(*) FILTER (act)::DOUBLE AS p, count(*) FILTER (NOT act)::DOUBLE AS n FROM cm c JOIN val USING (model) GROUP BY c.model, c.th),
 met AS (SELECT model, th, auc, {MET} FROM cnt JOIN auc USING (model)),
 grid AS (SELECT c.model, c.th, s.sth, count(*) FILTER (act AND score >= th AND t >= sth)::DOUBLE AS tp, count(*) FILTER (NOT act AND score >= th AND t >= sth)::DOUBLE AS fp, count(*) FILTER (act)::DOUBLE AS p, count(*) FILTER (NOT act)::DOUBLE AS n
  FROM cm c JOIN ct s USING (model) JOIN val USING (model) WHERE model IN ('residual_margin_dual_gate', 'residual_margin_strict_dual_gate') GROUP BY c.model, c.th, s.sth),
 gmet AS (SELECT model, th, sth, auc, {MET} FROM grid JOIN auc USING (model)),
 plain AS (SELECT model, th FROM met QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(ba, 12) DESC, round(auc, 12) DESC, round(fpr, 12), round(recall, 12) DESC, th) = 1),
 okay AS (SELECT *, auc >= 0.9 AND ba >= 0.85 AND recall >= 0.85 AND fpr <= 0.15 AS ok FROM met),
 flo AS (SELECT model, count(*) FILTER (act AND score >= 0.05)::DOUBLE AS tp, count(*) FILTER (NOT act AND score >= 0.05)::DOUBLE AS fp, count(*) FILTER (act)::DOUBLE AS p, count(*) FILTER (NOT act)::DOUBLE AS n FROM val GROUP BY model),
 flok AS (SELECT model FROM (SELECT model, auc, {MET} FROM flo JOIN auc USING (model)) WHERE auc >= 0.9 AND ba >= 0.85 AND recall >= 0.85 AND fpr <= 0.15),
 strict AS (SELECT p.model, coalesce(CASE WHEN f.model IS NOT NULL THEN 0.05::DOUBLE END, l.th, p.th) AS th FROM plain p LEFT JOIN flok f USING (model) LEFT JOIN (SELECT model, max(th) AS th FROM okay WHERE ok GROUP BY model) l USING (model)),
 dual AS (SELECT model, th, sth FROM gmet WHERE model = 'residual_margin_dual_gate' QUALIFY row_number() OVER (ORDER BY round(ba, 12) DESC, round(auc, 12) DESC, round(fpr, 12), round(recall, 12) DESC, sth DESC, th DESC) = 1),
 tight AS (SELECT model, th, sth FROM gmet WHERE model = 'residual_margin_strict_dual_gate' AND auc >= 0.9 AND ba >= 0.85 AND recall >= 0.85 AND fpr <= 0.15 QUALIFY row_number() OVER (ORDER BY sth DESC, round(ba, 12) DESC, round(auc, 12) DESC, round(fpr, 12), round(recall, 12) DESC, th DESC) = 1),
 tight0 AS (SELECT m.model, coalesce(t.th, 0.0) AS th, coalesce(t.sth, 0.0) AS sth FROM (SELECT 'residual_margin_strict_dual_gate' AS model) m LEFT JOIN tight t USING (model)),
 chosen AS (SELECT model, th, NULL::DOUBLE AS sth FROM plain WHERE model NOT LIKE '%gate%' AND model NOT LIKE '%contrast_strict%' UNION ALL SELECT model, th, NULL FROM strict WHERE model = 'residual_near_miss_contrast_strict' UNION ALL SELECT * FROM dual UNION ALL SELECT * FROM tight0),
 fin AS (SELECT model, th, sth, count(*) FILTER (act AND score >= th AND coalesce(t >= sth, TRUE))::DOUBLE AS tp, count(*) FILTER (NOT act AND score >= th AND coalesce(t >= sth, TRUE))::DOUBLE AS fp, count(*) FILTER (act)::DOUBLE AS p, count(*) FILTER (NOT act)::DOUBLE AS n FROM chosen JOIN val USING (model) GROUP BY ALL),
 cmp AS (SELECT model, th, sth, auc, {MET}, (tp + n - fp) / greatest(1, p + n) AS acc FROM fin JOIN auc USING (model))"""
)
ATOMS = """atoms AS (SELECT doc_id AS work_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, t AS text FROM
  (SELECT doc_id, generate_subscripts(ls, 1) AS pos, trim(unnest(ls), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE t <> '')"""
PRON = lambda col, ws: f"len(regexp_extract_all(lower({col}), '\\b(?:{'|'.join(w.replace(chr(39), chr(39) * 2) for w in ws)})\\b'))"
WORDS = lambda col: f"len(regexp_extract_all({col}, '\\b[\\w'']+\\b'))"


# --- parsing and features -------------------------------------------------------------------------------------------


@query(f"WITH {ATOMS} SELECT work_id, idx::BIGINT AS index, text FROM atoms")
def parse_atoms(spark, sf):
    return doc_atoms(spark, sf).select("work_id", F.col("index").cast("long"), "text")


@query("""SELECT conv_id AS work_id, role AS type, count(*) AS blocks, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL""")
def parse_conversations(spark, sf):
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda x: x.text), "\n")
    return turns(spark, sf).groupBy("work_id", "type").agg(F.count(F.lit(1)).alias("blocks"), joined.alias("text"))


@query("""SELECT doc_id AS id, 'work_' || substr(sha256(doc_id::VARCHAR || chr(31) || coalesce(text, 'null')), 1, 16) AS work_id, sha256(coalesce(text, 'null')) AS text_hash FROM documents""")
def content_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), tx.create_id("work", F.col("doc_id"), F.col("text")).alias("work_id"), tx.content_hash(F.col("text")).alias("text_hash"))


@query(f"""WITH {ATOMS} SELECT work_id, idx::BIGINT AS index, {WORDS("text")} AS word_count, length(text) AS character_count, contains(text, '?') AS question_mark_present,
  contains(text, '!') AS exclamation_mark_present, {PRON("text", FIRST_PERSON)} AS first_person_pronoun_count, {PRON("text", SECOND_PERSON)} AS second_person_pronoun_count,
  len(regexp_extract_all(text, '[.,!?;:''"-]')) AS punctuation_count FROM atoms""")
def atom_features(spark, sf):
    return features.atom_features(doc_atoms(spark, sf)).drop("text").withColumn("index", F.col("index").cast("long"))


@query(f"""WITH {ATOMS} SELECT work_id, count(*) AS line_count, round(avg({WORDS("text")}), 6) AS average_words_per_line, count(*) - count(DISTINCT lower(text)) AS repeated_line_count FROM atoms GROUP BY work_id""")
def block_features(spark, sf):
    return features.block_features(doc_atoms(spark, sf), ["work_id"]).withColumn("average_words_per_line", r6("average_words_per_line"))


@query(f"""WITH a AS (SELECT work_id, t AS text FROM (SELECT conv_id AS work_id, trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(13)) AS t FROM conversations) WHERE t <> ''),
 l AS (SELECT work_id, count(*) AS line_count, avg({WORDS("text")}) AS w, avg(contains(text, '?')::INT) AS q, avg({PRON("text", FIRST_PERSON)}) AS f, avg({PRON("text", SECOND_PERSON)}) AS s FROM a GROUP BY work_id),
 b AS (SELECT conv_id AS work_id, count(*) AS block_count, count(*) FILTER (role = 'chorus') AS c, count(*) FILTER (role = 'verse') AS v, count(*) FILTER (role = 'bridge') AS br FROM conversations GROUP BY ALL)
 SELECT work_id, block_count, c AS chorus_count, v AS verse_count, br AS bridge_count, coalesce(line_count, 0) AS line_count, round(coalesce(w, 0), 6) AS average_words_per_line, round(coalesce(q, 0), 6) AS question_mark_density,
  round(coalesce(f, 0), 6) AS first_person_density, round(coalesce(s, 0), 6) AS second_person_density FROM b LEFT JOIN l USING (work_id)""")
def work_features(spark, sf):
    t = turns(spark, sf)
    atoms = t.select("work_id", F.explode(tx.lines(F.col("text"))).alias("text"))
    out = features.work_features(t.select("work_id").distinct(), t, atoms)
    return out.select(*[r6(c).alias(c) if c.endswith(("density", "per_line")) else c for c in out.columns])


# --- topics, splits, ids --------------------------------------------------------------------------------------------

KEYS = f"""tok AS (SELECT doc_id AS id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\b[a-z'']{{4,}}\\b') AS ts FROM documents)),
 kw AS (SELECT id, token, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos)) AS rank FROM tok WHERE token NOT IN ({quoted(TOPIC_STOPWORDS)}) GROUP BY id, token QUALIFY rank <= 6)"""


@query(f"WITH {KEYS} SELECT id, rank, token, n FROM kw")
def topic_keywords(spark, sf):
    return topics.keywords(works(spark, sf))


CLEAN = lambda e: f"trim(regexp_replace(regexp_replace({e}, '\\b(?:{'|'.join(BANNED_TOPIC_WORDS)})\\b', '', 'gi'), '\\s+', ' ', 'g'))"
PROFILE = f"""{KEYS}, ks AS (SELECT d.doc_id AS id, coalesce(k.ks, []) AS ks FROM documents d LEFT JOIN (SELECT id, list(token ORDER BY rank) AS ks FROM kw GROUP BY id) k ON k.id = d.doc_id),
 prof AS (SELECT id AS work_id, {CLEAN("coalesce(nullif(array_to_string(ks[1:3], ', '), ''), 'Document ' || id)")} AS main_theme, {CLEAN("coalesce(nullif(array_to_string(ks[4:6], ', '), ''), 'personal conflict')")} AS emotional_subject,
  {CLEAN("'A narrator works through ' || coalesce(nullif(array_to_string(ks[1:4], ', '), ''), 'a personal situation') || '.'")} AS central_situation,
  {CLEAN(f"coalesce(list_filter(ks, lambda x: x NOT IN ({quoted(IMAGE_STOPWORDS)}))[1], ks[1], 'unspecified')")} AS central_image,
  {CLEAN("'The lyrics work concerns ' || coalesce(nullif(array_to_string(ks, ', '), ''), 'Document ' || id) || '.'")} AS content_only_summary FROM ks)"""


@query(f"WITH {PROFILE} SELECT *, TRUE AS synthetic, 'local-keyword-fallback' AS extractor FROM prof")
def topic_profile(spark, sf):
    return topics.topic_profiles(works(spark, sf))


@query(f"WITH {PROFILE} SELECT work_id, main_theme FROM prof WHERE work_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 'cached' FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)")
def anti_topics(spark, sf):
    """Profiles of works with a good label count as cached; the others are made anew."""
    w = works(spark, sf)
    cached = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("work_id"), *[F.lit("cached").alias(f) for f in topics.FIELDS], F.lit(True).alias("synthetic"), F.lit("cache").alias("extractor"))
    return topics.refresh_topics(w, cached).select("work_id", "main_theme")


DSPLIT = """ds AS (SELECT doc_id AS id, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'target' ELSE 'background' END AS st, lang FROM documents),
 dn AS (SELECT *, row_number() OVER (PARTITION BY st, lang ORDER BY sha256('137' || chr(31) || id::VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY st, lang) AS n FROM ds),
 dsp AS (SELECT id, st, lang, CASE WHEN n >= 3 THEN CASE WHEN i < n - 2 * greatest(1, n // 5) THEN 'train' WHEN i < n - greatest(1, n // 5) THEN 'validation' ELSE 'test' END WHEN n = 2 AND i = 1 THEN 'test' ELSE 'train' END AS split FROM dn)"""


@query(f'WITH {DSPLIT} SELECT id, st AS "set", split FROM dsp')
def split_assign(spark, sf):
    return split.assign_splits(works(spark, sf).select("id", "set", "lang"), ["set", "lang"]).select("id", "set", "split")


@query(f"""WITH {DSPLIT} SELECT split, count(*) AS works, count(*) FILTER (st = 'target') AS target_count, count(*) FILTER (st = 'background') AS background_count FROM dsp GROUP BY split""")
def split_counts(spark, sf):
    return split_assign(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("set") == "target").alias("target_count"), F.count_if(F.col("set") == "background").alias("background_count"))


@query("""SELECT d.doc_id AS id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""")
def semi_filter_tables(spark, sf):
    kept = table(spark, sf, "embeddings").select(F.col("vec_id").alias("work_id"))
    tables = {"works": works(spark, sf).select("id"), "labels": table(spark, sf, "labels")}
    out = hard_negatives.keep_works(tables, kept, {"works": "id", "labels": "doc_id"})
    return out["works"].join(out["labels"], F.col("id") == F.col("doc_id")).select("id", "quality")


# --- vectors --------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
 c AS (SELECT doc_id, sha256(w) AS h, 1 + least(length(w), 12) / 12.0::DOUBLE AS x FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\b[\\w'']+\\b')) AS w FROM t)
  UNION ALL SELECT doc_id, sha1(substr(t, i, 3)), 0.15 FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM t)),
 b AS (SELECT doc_id, ('0x' || substr(h, 1, 2))::INT % 96 AS bucket, sum(CASE WHEN ('0x' || substr(h, 3, 2))::INT % 2 = 0 THEN x ELSE -x END) AS w FROM c GROUP BY ALL)
 SELECT doc_id AS id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) + 0.0 AS value FROM b WHERE abs(w) > 1e-9""")
def hash_embedding(spark, sf):
    e = embed.hash_embedding(works(spark, sf))
    return e.select("id", F.posexplode("vector").alias("bucket", "value")).where("abs(value) > 1e-12").select("id", "bucket", (r6("value") + 0.0).alias("value"))


@query(f"WITH {EMB} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM emb")
def vector_norms(spark, sf):
    return vectors(spark, sf).select("id", r6(vx.norm(F.col("vector"))).alias("norm"))


@query(f"WITH {EMB} SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM emb a JOIN emb b ON b.id = a.id + 1")
def cosine_pairs(spark, sf):
    v = vectors(spark, sf)
    return v.select("id", "vector").join(v.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("vector").alias("_w")), "id").select("id", "other", r6(vx.cosine(F.col("vector"), F.col("_w"))).alias("cosine"))


@query(f"""WITH {EMB}, c AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb) GROUP BY ALL)
 SELECT label, n AS count, pos - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) + 0.0 AS value FROM c""")
def centroids(spark, sf):
    c = vx.centroids(vectors(spark, sf), ["label"])
    return c.select("label", "count", F.posexplode("vector").alias("pos", "value")).select("label", "count", F.col("pos").cast("long").alias("pos"), (r6("value") + 0.0).alias("value"))


@query(f"WITH {RES} SELECT id, generate_subscripts(rv, 1) - 1 AS pos, round(unnest(rv), 6) + 0.0 AS value FROM res")
def residual_vectors(spark, sf):
    r = with_residuals(spark, sf)
    return r.select("id", F.posexplode("residual").alias("pos", "value")).select("id", F.col("pos").cast("long").alias("pos"), (r6("value") + 0.0).alias("value"))


@query(f"""WITH {RES}, c AS (SELECT st, pos, avg(x) AS x, count(*) AS n FROM (SELECT st, unnest(rv) AS x, generate_subscripts(rv, 1) AS pos FROM res WHERE split = 'train') GROUP BY ALL)
 SELECT st AS "set", n AS count, pos - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY st)), 6) + 0.0 AS value FROM c""")
def residual_centroids(spark, sf):
    c = vx.centroids(with_residuals(spark, sf).where("split = 'train'").select("set", F.col("residual").alias("vector")), ["set"])
    return c.select("set", "count", F.posexplode("vector").alias("pos", "value")).select("set", "count", F.col("pos").cast("long").alias("pos"), (r6("value") + 0.0).alias("value"))


# --- scoring and models ---------------------------------------------------------------------------------------------


@query(f'WITH {SIM} SELECT id, kind, st AS "set", split, round(t, 6) AS target_similarity, round(b, 6) AS background_similarity, round(nm, 6) AS near_miss_similarity FROM sims')
def centroid_scores(spark, sf):
    return similarities(spark, sf).select("id", "kind", "set", "split", *[r6(c).alias(c) for c in ("target_similarity", "background_similarity", "near_miss_similarity")])


@query(f"WITH {SC} SELECT model, id, round(score, 6) AS score FROM sc")
def model_scores(spark, sf):
    return scores(spark, sf).select("model", "id", r6("score").alias("score"))


NEAR = f"""{EMB}, nb AS (SELECT e.id, p.id AS neighbour, list_cosine_similarity(e.v, p.v) AS s FROM es e JOIN es p ON p.st = 'target' AND p.split = 'train' AND p.id <> e.id),
 nr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank FROM nb)"""


def raw_neighbours(spark, sf, k):
    v = vectors(spark, sf).withColumn("kind", F.lit("raw"))
    return model.nearest_targets(v, v.where("set = 'target' and split = 'train'"), k)


@query(f"WITH {NEAR} SELECT id, neighbour, round(s, 6) AS similarity FROM nr WHERE rank = 1")
def nearest_neighbors(spark, sf):
    return raw_neighbours(spark, sf, 1).select("id", "neighbour", r6("similarity").alias("similarity"))


@query(f"WITH {NEAR} SELECT id, rank, neighbour, round(s, 6) AS similarity FROM nr WHERE rank <= 5")
def knn_topk(spark, sf):
    return raw_neighbours(spark, sf, 5).select("id", "rank", "neighbour", r6("similarity").alias("similarity"))


@query(f"WITH {NEAR} SELECT CASE WHEN s >= 0.92 THEN 'high' WHEN s >= 0.84 THEN 'moderate' ELSE 'low' END AS overfit_risk, count(*) AS works FROM nr WHERE rank = 1 GROUP BY ALL")
def overfit_risk(spark, sf):
    return raw_neighbours(spark, sf, 1).groupBy(metrics.overfit_risk(F.col("similarity")).alias("overfit_risk")).agg(F.count(F.lit(1)).alias("works"))


def _sides(spark, sf):
    v = vectors(spark, sf)
    return v.where("set = 'target'"), v.where("set = 'background'")


HN = """pr AS (SELECT a.id AS target_id, b.id AS background_id, a.split, list_cosine_similarity(a.v, b.v) AS s FROM es a JOIN es b ON a.st = 'target' AND b.st = 'background' {on}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s DESC, background_id) AS rank FROM pr QUALIFY rank <= 5)"""


@query(f"WITH {EMB}, {HN.format(on='')} SELECT target_id, background_id, rank, round(s, 6) AS similarity FROM rk")
def hard_negatives_per_target(spark, sf):
    return hard_negatives.per_target(*_sides(spark, sf)).select("target_id", "background_id", "rank", r6("similarity").alias("similarity"))


@query(f"WITH {EMB}, {HN.format(on='AND a.split = b.split')} SELECT target_id, background_id, split, rank, round(s, 6) AS similarity FROM rk")
def hard_negatives_split_aware(spark, sf):
    return hard_negatives.per_target(*_sides(spark, sf), split_aware=True).select("target_id", "background_id", "split", "rank", r6("similarity").alias("similarity"))


@query(f"""WITH {EMB}, c AS (SELECT split, pos, avg(x) AS x FROM (SELECT split, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM es WHERE st = 'target') GROUP BY ALL), ce AS (SELECT split, list(x ORDER BY pos) AS c FROM c GROUP BY split),
 k AS (SELECT split, 5 * count(*) AS k FROM es WHERE st = 'target' GROUP BY split), rk AS (SELECT split, id, list_cosine_similarity(v, c) AS s, k, row_number() OVER (PARTITION BY split ORDER BY list_cosine_similarity(v, c) DESC, id) AS rank FROM es JOIN ce USING (split) JOIN k USING (split) WHERE st = 'background')
 SELECT 'target_centroid_' || split AS target_id, id AS background_id, rank, round(s, 6) AS similarity FROM rk WHERE rank <= k""")
def hard_negatives_centroid(spark, sf):
    return hard_negatives.by_centroid(*_sides(spark, sf), split_aware=True).select("target_id", "background_id", "rank", r6("similarity").alias("similarity"))


@query(f"WITH {EMB}, {HN.format(on='')} SELECT background_id, round(max(s), 6) AS max_similarity FROM rk GROUP BY background_id ORDER BY max(s) DESC, background_id LIMIT 20")
def hard_negatives_capped(spark, sf):
    return hard_negatives.selected(hard_negatives.per_target(*_sides(spark, sf)), cap=20).select("background_id", r6("max_similarity").alias("max_similarity"))


QS = """qs AS (SELECT l.doc_id AS id, l.quality = 1 AS act, (length(d.text) % 97)::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"""


def quality_scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.length("text") % 97).cast("double").alias("score"))
    return table(spark, sf, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("actual"), "score")


@query(f"""WITH {QS}, c AS (SELECT count(*) AS n, count(*) FILTER (act AND score >= 48) AS tp, count(*) FILTER (NOT act AND score < 48) AS tn, count(*) FILTER (NOT act AND score >= 48) AS fp, count(*) FILTER (act AND score < 48) AS fn FROM qs)
 SELECT n AS count, tp, tn, fp, fn, round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS false_positive_rate FROM c""")
def eval_metrics(spark, sf):
    out = metrics.evaluate(quality_scores(spark, sf), [], F.col("score") >= 48).drop("roc_auc")
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(f"""WITH {QS} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS roc_auc FROM qs p, qs n WHERE p.act AND NOT n.act""")
def roc_auc(spark, sf):
    return metrics.roc_auc(quality_scores(spark, sf), []).select(r6("roc_auc").alias("roc_auc"))


@query(f"WITH {CANDS} SELECT model, round(th, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cnt")
def threshold_candidates(spark, sf):
    val = scores(spark, sf).where("split = 'validation'")
    return model.threshold_candidates(val, ["model"]).select("model", r6("threshold").alias("threshold"), "tp", "fp")


@query(f"WITH {CANDS} SELECT model, round(th, 6) AS threshold FROM plain")
def choose_threshold(spark, sf):
    val = kept_scores(spark, sf).where("split = 'validation'")
    return model.choose_threshold(val, ["model"]).select("model", r6("threshold").alias("threshold"))


@query(f"WITH {CANDS} SELECT model, round(th, 6) AS threshold FROM strict")
def choose_strict(spark, sf):
    val = kept_scores(spark, sf).where("split = 'validation'")
    return model.choose_strict_threshold(val, ["model"]).select("model", r6("threshold").alias("threshold"))


@query(f"WITH {CANDS} SELECT model, round(th, 6) AS threshold, round(sth, 6) AS similarity_threshold FROM (SELECT * FROM dual UNION ALL SELECT * FROM tight0)")
def dual_gate(spark, sf):
    val = kept_scores(spark, sf).where("split = 'validation'")
    one = lambda m, strict: model.choose_dual_gate(val.where(F.col("model") == m), ["model"], strict)
    out = one("residual_margin_dual_gate", False).unionByName(one("residual_margin_strict_dual_gate", True))
    return out.select("model", r6("threshold").alias("threshold"), r6("similarity_threshold").alias("similarity_threshold"))


CMP_COLS = ("threshold", "similarity_threshold", "roc_auc", "balanced_accuracy", "recall", "false_positive_rate", "accuracy")
CMP_SQL = "model, round(th, 6) AS threshold, round(sth, 6) AS similarity_threshold, round(auc, 6) AS roc_auc, round(ba, 6) AS balanced_accuracy, round(recall, 6) AS recall, round(fpr, 6) AS false_positive_rate, round(acc, 6) AS accuracy"


@query(f"WITH {CANDS} SELECT {CMP_SQL} FROM cmp")
def model_comparison(spark, sf):
    return model.compare_models(kept_scores(spark, sf)).select("model", *[r6(c).alias(c) for c in CMP_COLS])


PICK = f"""o AS (SELECT *, auc >= 0.9 AND ba >= 0.85 AND recall >= 0.85 AND fpr <= 0.15 AS ok FROM cmp),
 pick AS (SELECT * FROM o ORDER BY (ok AND model LIKE 'residual%') DESC, (ok AND model = 'residual_near_miss_contrast_strict') DESC, round(ba, 12) DESC, round(auc, 12) DESC, round(fpr, 12), round(recall, 12) DESC,
  CASE model WHEN 'residual_near_miss_contrast_strict' THEN 0 WHEN 'residual_near_miss_contrast' THEN 1 WHEN 'residual_margin_strict_dual_gate' THEN 2 WHEN 'residual_margin_dual_gate' THEN 3 ELSE 9 END, list_position([{quoted(MODELS)}], model) LIMIT 1)"""


@query(f"WITH {CANDS}, {PICK} SELECT {CMP_SQL} FROM pick")
def model_selection(spark, sf):
    return model.select_model(model.compare_models(kept_scores(spark, sf))).select("model", *[r6(c).alias(c) for c in CMP_COLS])


@query(f"""WITH {SC}, k AS (SELECT unnest(['same_topic_generic_ai_near_miss', 'attempted_lookalike']) AS control_type), g AS (SELECT ctrl, count(*) AS n, count(*) FILTER (score >= 0) AS fp FROM sc WHERE model = 'residual_margin' AND split = 'test' GROUP BY ctrl)
 SELECT control_type, coalesce(n, 0) AS count, coalesce(fp, 0) AS false_positive_count, round(fp / n, 6) AS false_positive_rate, CASE WHEN n IS NULL THEN 'not_available' WHEN fp / n <= 0.15 THEN 'true' ELSE 'false' END AS passed FROM k LEFT JOIN g ON ctrl = control_type""")
def near_miss_gate(spark, sf):
    rows = scores(spark, sf).where("model = 'residual_margin' and split = 'test'")
    return metrics.gate(rows, F.col("score") >= 0).withColumn("false_positive_rate", r6("false_positive_rate"))


@query(f"""WITH {SC} SELECT model, CASE WHEN act AND score < 0 THEN 'false_negative' WHEN NOT act AND score >= 0 THEN 'false_positive' ELSE 'uncertain' END AS kind, id, round(score, 6) AS score FROM sc
 WHERE split = 'test' AND (act AND score < 0 OR NOT act AND score >= 0 OR abs(score) < 0.05)""")
def error_lists(spark, sf):
    s, act = F.col("score"), F.col("actual")
    kind = F.when(act & (s < 0), "false_negative").when(~act & (s >= 0), "false_positive").when(F.abs(s) < 0.05, "uncertain")
    rows = scores(spark, sf).where("split = 'test'").withColumn("kind", kind).where("kind is not null")
    return rows.select("model", "kind", "id", r6("score").alias("score"))


TST = f"""{CANDS}, {PICK}, test AS (SELECT * FROM sc WHERE split = 'test'), {AUC.replace("auc AS (", "tauc AS (").replace("val", "test")},
 tf AS (SELECT model, count(*) FILTER (act AND score >= th AND coalesce(t >= sth, TRUE))::DOUBLE AS tp, count(*) FILTER (NOT act AND score >= th AND coalesce(t >= sth, TRUE))::DOUBLE AS fp, count(*) FILTER (act)::DOUBLE AS p, count(*) FILTER (NOT act)::DOUBLE AS n FROM chosen JOIN test USING (model) GROUP BY model),
 tc AS (SELECT model, auc, {MET} FROM tf JOIN tauc USING (model)),
 ra AS (SELECT s.model AS selected_model, {", ".join(f"(SELECT model FROM {t} WHERE model LIKE '{k}%' ORDER BY round(auc, 12) DESC, round(ba, 12) DESC, list_position([{quoted(MODELS)}], model) LIMIT 1) AS {n}" for t, k, n in (("cmp", "residual", "best_residual_validation"), ("cmp", "raw", "best_raw_validation"), ("tc", "raw", "best_raw_test")))}, s.auc, s.ba, s.fpr, s.recall FROM pick JOIN tc s USING (model)),
 rr AS (SELECT ra.*, selected_model LIKE 'residual%' AND round(ra.auc - r.auc, 12) >= 0 AND round(ra.ba - r.ba, 12) >= 0 AND round(ra.fpr - r.fpr, 12) <= 0 AS residual_beats_raw FROM ra JOIN tc r ON r.model = best_raw_test)"""


def tested_models(spark, sf):
    """Scores, models compared on validation, the same models on test, and the selected one."""
    rows = kept_scores(spark, sf)
    compared = assessment.small(model.compare_models(rows))
    tested = assessment.small(model.evaluate_models(rows.where("split = 'test'"), compared))
    return rows, compared, tested, assessment.small(model.select_model(compared))


@query(f"WITH {TST} SELECT selected_model, best_residual_validation, best_raw_validation, best_raw_test, residual_beats_raw FROM rr")
def residual_vs_raw(spark, sf):
    return assessment.residual_assessment(*tested_models(spark, sf)[1:])


ACC = f"""{TST}, g AS (SELECT k, count(id) AS n, count(*) FILTER (score >= pick.th AND coalesce(t >= pick.sth, TRUE)) AS fp FROM (SELECT unnest([{quoted(CONTROL_TYPES)}]) AS k) CROSS JOIN pick LEFT JOIN test ON ctrl = k AND test.model = pick.model GROUP BY k),
 acc AS (SELECT 'roc_auc' AS criterion, auc >= 0.9 AS met FROM rr UNION ALL SELECT 'balanced_accuracy', ba >= 0.85 FROM rr UNION ALL SELECT 'recall', recall >= 0.85 FROM rr UNION ALL SELECT 'false_positive_rate', fpr <= 0.15 FROM rr
 UNION ALL SELECT CASE k WHEN '{CONTROL_TYPES[0]}' THEN 'same_topic_near_miss_rejection' ELSE 'attempted_lookalike_rejection' END, n > 0 AND fp / greatest(n, 1) <= 0.15 FROM g
 UNION ALL SELECT 'residual_model_selected', selected_model LIKE 'residual%' FROM rr UNION ALL SELECT 'residual_beats_raw_baseline', residual_beats_raw FROM rr)"""


@query(f"WITH {ACC} SELECT criterion, met FROM acc")
def acceptance_criteria(spark, sf):
    return accepted(*tested_models(spark, sf))


def accepted(rows, compared, tested, selected) -> DataFrame:
    one = rows.where("split = 'test'").join(F.broadcast(selected.select("model", "threshold", "similarity_threshold")), "model")
    held_out = tested.join(F.broadcast(selected.select("model")), "model", "left_semi")
    return assessment.acceptance(held_out, metrics.gate(one, model.predicted()), assessment.residual_assessment(compared, tested, selected))


@query(f"""WITH {SC} SELECT model, CASE WHEN act THEN 'target' ELSE 'background' END AS kind, row_number() OVER (PARTITION BY model, act ORDER BY CASE WHEN act THEN -score ELSE score END, id) AS rank, id, round(score, 6) AS score
 FROM sc WHERE split = 'test' AND act = (score >= 0) QUALIFY rank <= 5""")
def most_confident(spark, sf):
    rows = scores(spark, sf).where("split = 'test'")
    return assessment.confident(rows, F.col("score") >= 0, ["model"]).withColumn("score", r6("score"))


@query(f"WITH {EMB}, {HN.format(on='')}, b AS (SELECT background_id, max(s) AS s, count(*) AS n FROM rk GROUP BY ALL) SELECT count(*) AS backgrounds, sum(n)::BIGINT AS pairs, round(avg(s), 6) AS mean_similarity FROM b")
def hard_negative_report(spark, sf):
    return assessment.hard_negative_summary(hard_negatives.per_target(*_sides(spark, sf))).withColumn("mean_similarity", r6("mean_similarity"))


@query("""WITH b AS (SELECT conv_id AS work_id, 'Talk ' || conv_id AS title, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (role = 'user') AS c, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (role = 'assistant') AS d FROM conversations GROUP BY conv_id)
 SELECT work_id, 'all_choruses' AS scope, title || chr(10) || c AS text FROM b WHERE c <> '' UNION ALL SELECT work_id, 'title_plus_chorus', title || chr(10) || c FROM b WHERE c <> '' UNION ALL SELECT work_id, 'bridge_only', d FROM b WHERE d <> ''""")
def extra_scopes(spark, sf):
    """Conversations as works: what users say are choruses, what assistants say bridges."""
    t = turns(spark, sf).withColumn("type", F.when(F.col("type") == "user", "chorus").when(F.col("type") == "assistant", "bridge").otherwise("verse"))
    return parse.extra_scopes(t.select(F.col("work_id").alias("id"), F.concat(F.lit("Talk "), "work_id").alias("title")).distinct(), t)


@query(f"SELECT unnest([{quoted((*controls.BACKGROUND_TYPES, *CONTROL_TYPES))}]) AS control_type, unnest([{', '.join(['4'] * 9)}, 12, 13])::BIGINT AS works, unnest([{', '.join(['24'] * 9)}, 36, 52])::BIGINT AS blocks")
def control_corpus(spark, sf):
    """Generated controls, written as files and parsed again: works and blocks of each type."""
    files = controls.as_files(controls.background_controls(spark).unionByName(controls.hard_controls(spark)), "background")
    made = parse.parse_works(files)
    blocks = parse.parse_blocks(made).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    rows = made.select(F.col("id").alias("work_id"), F.col("metadata.synthetic_control_type").alias("control_type")).join(blocks, "work_id")
    return rows.groupBy("control_type").agg(F.count(F.lit(1)).alias("works"), F.sum("n").alias("blocks"))


LOO = """pool AS (SELECT id, label, st, split, rv AS v FROM res WHERE st = 'target')"""


@query(f"""WITH {RES}, {LOO}, c AS (SELECT h.id, pos, avg(x) AS x FROM pool h JOIN (SELECT id AS oid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM pool) o ON o.oid <> h.id GROUP BY h.id, pos), m AS (SELECT id, list(x ORDER BY pos) AS c FROM c GROUP BY id)
 SELECT id, round(list_cosine_similarity(v, c), 6) AS similarity FROM pool JOIN m USING (id)""")
def leave_one_out(spark, sf):
    t = with_residuals(spark, sf).where("set = 'target'").select("id", F.col("residual").alias("vector"))
    return model.leave_one_out(t).select("id", r6("similarity").alias("similarity"))


@query(f"""WITH {RES}, {PROFILE}, {LOO}, th AS (SELECT pool.*, coalesce(nullif(main_theme, ''), 'unknown') AS theme FROM pool JOIN prof ON work_id = id),
 c AS (SELECT h.theme, pos, avg(x) AS x FROM (SELECT DISTINCT theme FROM th) h JOIN (SELECT theme AS ot, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM th) o ON o.ot <> h.theme GROUP BY h.theme, pos), m AS (SELECT theme, list(x ORDER BY pos) AS c FROM c GROUP BY theme)
 SELECT theme, id, round(list_cosine_similarity(v, c), 6) AS similarity FROM th JOIN m USING (theme)""")
def leave_topic_out(spark, sf):
    """The theme of a vector is the main theme of the document with its number."""
    t = with_residuals(spark, sf).where("set = 'target'").select("id", F.col("residual").alias("vector"))
    docs = works(spark, sf).join(t.select("id"), "id", "left_semi")
    theme = F.coalesce(F.nullif("main_theme", F.lit("")), F.lit("unknown"))
    t = t.join(topics.topic_profiles(docs).select(F.col("work_id").alias("id"), theme.alias("theme")), "id")
    return model.leave_one_out(t, "theme").select(F.col("group").alias("theme"), "id", r6("similarity").alias("similarity"))


@query(f"""WITH {EMB} SELECT count(*) AS works, count(*) FILTER (st = 'target') AS target_count, count(*) FILTER (st = 'background') AS background_count, count(*) FILTER (st = 'background' AND ctrl <> 'generic') AS synthetic_background_count,
  count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS validation_count, count(*) FILTER (split = 'test') AS test_count FROM es""")
def dataset_summary(spark, sf):
    return model.dataset_summary(vectors(spark, sf).withColumn("control_type", F.nullif("control_type", F.lit("generic"))))


@query(f"""WITH {EMB}, bl AS (SELECT id // 6 AS work_id, ['verse', 'chorus', 'bridge', 'intro'][id % 4 + 1] AS type, id % 6 AS index, CASE WHEN (id // 6) % 2 = 0 THEN 'target' ELSE 'background' END AS st, v FROM emb),
 cc AS (SELECT st, type, pos, avg(x) AS x FROM (SELECT st, type, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM bl) GROUP BY ALL), c AS (SELECT st, type, list(x ORDER BY pos) AS c FROM cc GROUP BY ALL),
 f AS (SELECT work_id, type, arg_min(v, index) AS v FROM bl WHERE type <> 'intro' GROUP BY ALL)
 SELECT work_id, type, round(list_cosine_similarity(v, t.c), 6) AS target_similarity, round(coalesce(list_cosine_similarity(v, b.c), 0), 6) AS background_similarity FROM f JOIN c t USING (type) LEFT JOIN c b ON b.type = f.type AND b.st = 'background' WHERE t.st = 'target'""")
def section_scores(spark, sf):
    """Six vectors are the blocks of a work; of a type that it has twice, the first counts."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("verse", "chorus", "bridge", "intro")]), (F.col("id") % 4 + 1).cast("int"))
    rows = vectors(spark, sf).select(F.col("id").alias("owner_id"), F.floor(F.col("id") / 6).alias("work_id"), kinds.alias("block_type"), (F.col("id") % 6).alias("index"), "vector")
    rows = rows.withColumn("set", F.when(F.col("work_id") % 2 == 0, "target").otherwise("background"))
    out = model.section_scores(rows.drop("index"), rows.select(F.col("owner_id").alias("id"), "index"), vx.centroids(rows, ["set", "block_type"]), ("verse", "chorus", "bridge"))
    return out.select("work_id", "type", r6("target_similarity").alias("target_similarity"), r6("background_similarity").alias("background_similarity"))


@query(f"""WITH {SIM}, s AS (SELECT st, id, t FROM sims WHERE kind = 'raw'), r AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY t, id) AS i, count(*) OVER (PARTITION BY st) AS n FROM s)
 SELECT st AS "set", count(*) AS count, round(avg(t), 6) AS mean_similarity, round(max(CASE WHEN i = n // 2 + 1 THEN t END), 6) AS median_similarity FROM r GROUP BY st""")
def similarity_summary(spark, sf):
    rows = similarities(spark, sf).where("kind = 'raw'").select("set", "id", F.col("target_similarity").alias("similarity"))
    return metrics.similarity_summary(rows, ["set"]).select("set", "count", r6("mean_similarity").alias("mean_similarity"), r6("median_similarity").alias("median_similarity"))


# --- leakage --------------------------------------------------------------------------------------------------------

LTOK = "regexp_extract_all(lower({0}), '[a-z0-9'']+')"
LINES = """{n} AS (SELECT * FROM (SELECT {id} AS {k}, generate_subscripts(ls, 1) AS o, trim(unnest(ls), chr(32) || chr(9) || chr(13)) AS line FROM (SELECT {id}, string_split(text, chr(10)) AS ls FROM {t})) WHERE line <> '' AND NOT regexp_matches(line, '^\\[[^\\]]+\\]$'))"""
LEAK = LINES.format(n="cl", id="doc_id", k="id", t="documents") + ", " + LINES.format(n="tl", id="item_id", k="target_id", t="benchmark")
EXACT = f"""{LEAK}, cn AS (SELECT *, array_to_string({LTOK.format("line")}, ' ') AS n FROM cl), tn AS (SELECT *, array_to_string({LTOK.format("line")}, ' ') AS n FROM tl),
 ex AS (SELECT c.id, c.line, t.target_id, t.line AS target_line FROM (SELECT id, n, arg_min(line, o) AS line FROM cn WHERE n <> '' GROUP BY id, n) c JOIN (SELECT target_id, n, arg_min(line, o) AS line FROM tn WHERE n <> '' GROUP BY target_id, n) t USING (n))"""
GRAMS = """{n} AS (SELECT {k}, line, o, array_to_string(g, ' ') AS phrase, array_to_string(ts, ' ') AS n FROM (SELECT {k}, line, o, ts, ts[i:i + s - 1] AS g FROM (SELECT {k}, line, o, ts, s, unnest(range(1, len(ts) - s + 2)) AS i FROM
  (SELECT *, unnest(range(2, least(6, len(ts)) + 1)) AS s FROM (SELECT *, {tok} AS ts FROM {t})))) WHERE len(list_filter(g, lambda x: length(x) >= 4 AND x NOT IN ({stop}))) >= 2)"""
PHRASES = f"""{EXACT}, {GRAMS.format(n="cg", k="id", t="cl", tok=LTOK.format("line"), stop=quoted(LEAK_STOPWORDS))}, {GRAMS.format(n="tg", k="target_id", t="tl", tok=LTOK.format("line"), stop=quoted(LEAK_STOPWORDS))},
 ph AS (SELECT c.id, c.phrase, t.target_id, t.target_line FROM (SELECT DISTINCT id, phrase FROM cg) c JOIN (SELECT target_id, phrase, n, arg_min(line, o) AS target_line FROM tg GROUP BY ALL) t USING (phrase))"""
RUNS = f"""cw AS (SELECT id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id AS id, {LTOK.format("text")} AS ts FROM documents)), tw AS (SELECT target_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS j FROM (SELECT item_id AS target_id, {LTOK.format("text")} AS ts FROM benchmark)),
 hit AS (SELECT id, target_id, i, i - j AS d FROM cw JOIN tw USING (w)), isl AS (SELECT id, target_id, d, i - row_number() OVER (PARTITION BY id, target_id, d ORDER BY i) AS g FROM hit), rn AS (SELECT id, max(r) AS run FROM (SELECT id, count(*) AS r FROM isl GROUP BY id, target_id, d, g) GROUP BY id)"""


def _leak(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")), table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), "text")


@query(f"WITH {EXACT} SELECT * FROM ex")
def leak_exact_lines(spark, sf):
    return leakage.exact_lines(*_leak(spark, sf))


@query(f"WITH {PHRASES} SELECT * FROM ph")
def leak_phrases(spark, sf):
    return leakage.shared_phrases(*_leak(spark, sf))


@query(f"WITH {RUNS} SELECT doc_id AS id, coalesce(run, 0) AS run FROM documents LEFT JOIN rn ON id = doc_id")
def leak_longest_run(spark, sf):
    return leakage.longest_runs(*_leak(spark, sf))


@query(f"""WITH {PHRASES}, {RUNS} SELECT d.doc_id AS id, coalesce(e.n, 0) AS line_matches, coalesce(p.n, 0) AS phrase_matches, r.run AS long_run, coalesce(e.n, 0) = 0 AND coalesce(p.n, 0) = 0 AND r.run IS NULL AS passed FROM documents d
 LEFT JOIN (SELECT id, count(*) AS n FROM ex GROUP BY id) e ON e.id = d.doc_id LEFT JOIN (SELECT id, count(*) AS n FROM ph GROUP BY id) p ON p.id = d.doc_id LEFT JOIN (SELECT * FROM rn WHERE run >= 6) r ON r.id = d.doc_id""")
def leak_verdict(spark, sf):
    return leakage.verdicts(*_leak(spark, sf))


@query(f"""WITH {ACC}, {PHRASES}, {RUNS}, hl AS (SELECT bool_and(met) AS meets, bool_and(met) FILTER (criterion = 'same_topic_near_miss_rejection') AS near, bool_and(met) FILTER (criterion = 'residual_beats_raw_baseline') AS beats FROM acc),
 own AS (SELECT id, t, t - b AS margin FROM sims WHERE kind = 'residual' AND split = 'test'), nbr AS (SELECT e.id, max(list_cosine_similarity(e.vec, p.vec)) AS s FROM vecs e JOIN vecs p ON e.kind = 'residual' AND p.kind = 'residual' AND e.split = 'test' AND p.st = 'target' AND p.id <> e.id GROUP BY e.id),
 lk AS (SELECT d.doc_id AS id, coalesce(e.n, 0) AS ln, coalesce(p.n, 0) AS pn, r.run FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM ex GROUP BY id) e ON e.id = d.doc_id LEFT JOIN (SELECT id, count(*) AS n FROM ph GROUP BY id) p ON p.id = d.doc_id LEFT JOIN (SELECT * FROM rn WHERE run >= 6) r ON r.id = d.doc_id),
 rl AS (SELECT conv_id AS id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id),
 j AS (SELECT s.id, s.model, s.score, p.th, p.sth, o.t, o.margin, n.s, l.ln, l.pn, l.run, l.ln = 0 AND l.pn = 0 AND l.run IS NULL AS ok, coalesce(rl.roles, []) AS roles, hl.* FROM sc s JOIN pick p ON p.model = s.model JOIN own o USING (id) JOIN nbr n USING (id) JOIN lk l USING (id) LEFT JOIN rl USING (id) CROSS JOIN hl WHERE s.split = 'test')
 SELECT id, model, round(score, 6) AS score, round(th, 6) AS threshold, round(margin, 6) AS style_margin, floor((margin + 1) / 2 * 100 + 0.5)::BIGINT AS overall_style_score, CASE WHEN s >= 0.92 THEN 'high' WHEN s >= 0.84 THEN 'moderate' ELSE 'low' END AS overfit_risk,
  ln AS line_matches, pn AS phrase_matches, run AS long_run, ok AND score >= th AND (model NOT LIKE '%dual_gate' OR coalesce(t >= sth, FALSE)) AS target_style,
  array_to_string(list_filter([CASE WHEN NOT meets THEN {quoted([candidates.FAILED_MODEL])} END, CASE WHEN NOT near THEN {quoted([candidates.TOPIC_MODEL])} END, CASE WHEN NOT beats THEN {quoted([candidates.RAW_MODEL])} END,
   CASE WHEN NOT list_contains(roles, 'user') THEN {quoted([candidates.NO_SECTION.format("user")])} END, CASE WHEN NOT list_contains(roles, 'system') THEN {quoted([candidates.NO_SECTION.format("system")])} END, CASE WHEN s >= 0.92 THEN {quoted([candidates.CLOSE])} END, CASE WHEN NOT ok THEN {quoted([candidates.LEAK])} END], lambda x: x IS NOT NULL), '|') AS warnings FROM j""")
def candidate_decision(spark, sf):
    """Vectors of the test split as candidates: the text is the document's of that number, the protected texts are the
    benchmark's, the sections the roles of the conversation of that number; model and health are those of the run."""
    v = both_kinds(spark, sf)
    run = tested_models(spark, sf)
    met = {r.criterion: r.met for r in accepted(*run).collect()}  # eight criteria
    health = {k: F.lit(v) for k, v in (met | {"meets": all(met.values())}).items()}
    wide = model.train_centroids(v)
    scored = candidates.score(v.where("split = 'test'"), wide, run[3], v.where("kind = 'residual' and set = 'target'").select("id", "vector"))
    docs, targets = _leak(spark, sf)
    texts = docs.join(v.where("split = 'test'").select("id").distinct(), "id", "left_semi")
    present = turns(spark, sf).groupBy(F.col("work_id").alias("id")).agg(F.collect_set("type").alias("types"))
    out = candidates.judge(scored, texts, targets, present, ("user", "system"), F.lit(True), health)
    return out.select("id", "model", *[r6(c).alias(c) for c in ("score", "threshold", "style_margin")], "overall_style_score", "overfit_risk", "line_matches", "phrase_matches", "long_run", "target_style", F.array_join("warnings", "|").alias("warnings"))


# --- ingest ---------------------------------------------------------------------------------------------------------


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS n, trim(p_name) AS title, trim(p_brand) AS author, trim(p_type) AS text FROM part WHERE lower(trim(p_brand)) <> 'brand#11' AND trim(p_type) <> ''""")
def dataset_import(spark, sf):
    return readers.import_dataset(table(spark, sf, "part"), "p_partkey", "p_type", "p_name", "p_brand", exclude="Brand#11").withColumn("n", F.col("n").cast("long"))


@query("""WITH c AS (SELECT lang AS experiment_id, count(*) FILTER (source IN ('src0', 'src1')) AS t, count(*) FILTER (source NOT IN ('src0', 'src1')) AS b FROM documents GROUP BY lang)
 SELECT experiment_id, t AS target_works, b AS background_works, t >= 12 AND b >= 50 AS ready, CASE WHEN t < 12 THEN 'The target corpus has ' || t || ' works, 12 are needed.' ELSE '' END || CASE WHEN t < 12 AND b < 50 THEN '|' ELSE '' END || CASE WHEN b < 50 THEN 'The background corpus has ' || b || ' works, 50 are needed.' ELSE '' END AS blockers FROM c""")
def corpus_readiness(spark, sf):
    target = F.col("source").isin("src0", "src1")
    c = table(spark, sf, "documents").groupBy(F.col("lang").alias("experiment_id")).agg(F.count_if(target).alias("target_works"), F.count_if(~target).alias("background_works"))
    c = c.withColumns({"min_target_works": F.lit(12), "min_background_works": F.lit(50), "target_valid": F.lit(True), "background_valid": F.lit(True)})
    return readers.readiness(c).select("experiment_id", "target_works", "background_works", "ready", F.array_join("blockers", "|").alias("blockers"))


@query("""WITH c AS (SELECT lang AS experiment_id, count(*) FILTER (source IN ('src0', 'src1')) AS t, count(*) FILTER (source NOT IN ('src0', 'src1')) AS b FROM documents GROUP BY lang)
 SELECT experiment_id, t >= 12 AND b >= 50 AS ready, bool_and(t >= 12 AND b >= 50) OVER () AS all_ready FROM c""")
def experiment_audit(spark, sf):
    return experiments.audit(corpus_readiness(spark, sf)).select("experiment_id", "ready", "all_ready")


@query("""WITH o AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), n AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
 SELECT user_id, event_id, round(value, 6) AS value FROM n UNION ALL SELECT user_id, event_id, round(value, 6) FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def upsert_by_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    part = lambda k: e.where(F.col("event_type") == k).drop("event_type")
    old = readers.upsert(part("view").limit(0), part("view"), ["user_id"], "event_id")
    return readers.upsert(old, part("purchase"), ["user_id"], "event_id").withColumn("value", r6("value"))


WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BLOCKS = f"""w AS (SELECT 'work_' || substr(sha256('corpus/' || doc_id || '.txt#0:corpus'), 1, 16) AS work_id, trim(text, {WS}) AS text FROM documents WHERE trim(coalesce(text, ''), {WS}) <> ''),
 p AS (SELECT work_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT work_id, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM w)),
 l AS (SELECT * FROM (SELECT work_id, i, generate_subscripts(ls, 1) AS pos, trim(unnest(ls), {WS}) AS t FROM (SELECT work_id, i, string_split(p, chr(10)) AS ls FROM p)) WHERE t <> ''),
 b0 AS (SELECT work_id, i, string_agg(t, chr(10) ORDER BY pos) AS text, row_number() OVER (PARTITION BY work_id ORDER BY i) - 1 AS index FROM l GROUP BY work_id, i),
 b AS (SELECT *, 'block_' || substr(sha256(work_id || chr(31) || index || chr(31) || 'section' || chr(31) || text), 1, 16) AS id FROM b0),
 a0 AS (SELECT l.work_id, b.id AS block_id, row_number() OVER (PARTITION BY l.work_id ORDER BY l.i, pos) - 1 AS index_in_work, row_number() OVER (PARTITION BY l.work_id, l.i ORDER BY pos) - 1 AS index_in_block, t AS text FROM l JOIN b USING (work_id, i))"""


def parsed(spark, sf):
    """documents as text files of a corpus, parsed to works, blocks and atoms."""
    files = table(spark, sf, "documents").select(F.concat(F.lit("corpus/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("value"), F.lit("background").alias("set"))
    made = parse.parse_works(files)
    return made, *parse.blocks_and_atoms(parse.parse_blocks(made))


@query(f"WITH {BLOCKS} SELECT id, work_id, 'section' AS type, index, text FROM b")
def parsed_blocks(spark, sf):
    return parsed(spark, sf)[1].withColumn("index", F.col("index").cast("long"))


@query(f"WITH {BLOCKS} SELECT 'atom_' || substr(sha256(block_id || chr(31) || index_in_block || chr(31) || text), 1, 16) AS id, work_id, block_id, index_in_work, index_in_block, text FROM a0")
def parsed_atoms(spark, sf):
    a = parsed(spark, sf)[2]
    return a.withColumns({c: F.col(c).cast("long") for c in ("index_in_work", "index_in_block")})


@query(f"""WITH {PROFILE}, t AS (SELECT 'work' AS owner_type, doc_id AS owner_id, 'work' AS scope, 'Document ' || doc_id || chr(10) || coalesce(text, '') AS text FROM documents
 {" ".join(f"UNION ALL SELECT 'topic', work_id, '{f}', {f} FROM prof" for f in topics.FIELDS)} UNION ALL SELECT 'topic', work_id, 'combined_topic_profile', {" || chr(10) || ".join(topics.FIELDS)} FROM prof)
 SELECT owner_type, owner_id, scope, sha256('m' || chr(31) || owner_type || chr(31) || owner_id || chr(31) || scope || chr(31) || text) AS text_hash FROM t""")
def embedding_inputs(spark, sf):
    """All texts to embed of documents without blocks, by the hash that caching goes by."""
    none = spark.createDataFrame([], "id long, text string")
    rows = embed.embedding_inputs(works(spark, sf), none, none, topics.topic_profiles(works(spark, sf)))
    return rows.select("owner_type", "owner_id", "scope", tx.content_hash(F.lit("m"), F.col("owner_type"), F.col("owner_id"), F.col("scope"), F.col("text")).alias("text_hash"))


@query("""SELECT doc_id::VARCHAR AS root, doc_id % 5 <> 0 AS present, doc_id % 5 = 1 AS valid, CASE doc_id % 5 WHEN 1 THEN 'licensed' WHEN 2 THEN 'other' WHEN 4 THEN 'licensed' END AS source_type, CASE WHEN doc_id % 5 IN (1, 2) THEN 2 END::INT AS work_count,
 CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END::INT AS issues FROM labels""")
def manifest_rules(spark, sf):
    """A manifest for each label: none, valid, of an unknown source, broken, without an array of works."""
    texts = ['{"sourceType": "licensed", "works": [{}, {}]}', '{"sourceType": "other", "works": [{}, {}]}', "{oops", '{"sourceType": "licensed", "works": 3}']
    value = F.get(F.array(*[F.lit(x) for x in texts]), (F.col("doc_id") % 5 - 1).cast("int"))
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("root"), F.when(F.col("doc_id") % 5 > 0, value).alias("value"))
    return readers.manifest_status(rows).withColumn("issues", F.size("issues"))


@query(f"""WITH {EMB}, {HN.format(on='')}, k AS (SELECT id FROM emb WHERE st = 'target' UNION SELECT background_id FROM rk)
 SELECT 'works' AS "table", (SELECT count(*) FROM k) AS rows UNION ALL SELECT 'splits', (SELECT count(*) FROM k) UNION ALL SELECT 'blocks', (SELECT count(*) FROM conversations WHERE conv_id IN (SELECT id FROM k))
 UNION ALL SELECT 'atoms', (SELECT count(*) FROM labels WHERE doc_id IN (SELECT id FROM k)) UNION ALL SELECT 'topics', (SELECT count(*) FROM documents WHERE doc_id IN (SELECT id FROM k))
 UNION ALL SELECT 'embeddings', (SELECT count(*) FROM k) + (SELECT count(*) FROM conversations WHERE conv_id IN (SELECT id FROM k)) + (SELECT count(*) FROM labels WHERE doc_id IN (SELECT id FROM k)) + (SELECT count(*) FROM documents WHERE doc_id IN (SELECT id FROM k))""")
def mined_tables(spark, sf):
    """Rows of each table behind the mining stage: turns are blocks, labels atoms, documents topics of the vectors' works."""
    v = vectors(spark, sf)
    made = v.select("id", "set")
    blocks = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("work_id"))
    atoms = table(spark, sf, "labels").select(F.concat(F.lit("a"), "doc_id").alias("id"), F.col("doc_id").alias("work_id"))
    profiles = table(spark, sf, "documents").select(F.col("doc_id").alias("work_id"))
    some = F.array(F.lit(1.0))
    owned = lambda df, kind, key, vector: df.select(F.lit(kind).alias("owner_type"), F.col(key).cast("string").alias("owner_id"), F.lit(kind).alias("scope"), vector.alias("vector"))
    embedded = owned(v, "work", "id", F.col("vector")).unionByName(owned(blocks, "block", "id", some)).unionByName(owned(atoms, "atom", "id", some)).unionByName(owned(profiles, "topic", "work_id", some))
    text = lambda df, *cols: df.withColumns({c: F.col(c).cast("string") for c in cols})
    out = mining.mine(text(made, "id"), text(blocks, "work_id"), text(atoms, "work_id"), text(profiles, "work_id"), text(v.select("id", "split"), "id"), embedded, mining.Mining())
    rows = None
    for name in ("works", "splits", "blocks", "atoms", "topics", "embeddings"):
        part = out[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(f"""WITH {EMB}, k AS (SELECT id, v, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS q1, b, c FROM (SELECT e.id, e.v, p.v AS a, q.v AS b, r.v AS c FROM emb e JOIN emb p ON p.id = e.id + 5 JOIN emb q ON q.id = e.id + 6 JOIN emb r ON r.id = e.id + 7)),
 k2 AS (SELECT *, list_transform(b, lambda x, i: x - list_dot_product(b, q1) * q1[i]) AS r2 FROM k), k3 AS (SELECT *, list_transform(r2, lambda x: x / sqrt(list_dot_product(r2, r2))) AS q2 FROM k2),
 k4 AS (SELECT *, list_transform(c, lambda x, i: x - list_dot_product(c, q1) * q1[i] - list_dot_product(c, q2) * q2[i]) AS r3 FROM k3), k5 AS (SELECT *, list_transform(r3, lambda x: x / sqrt(list_dot_product(r3, r3))) AS q3 FROM k4),
 o AS (SELECT 'work' AS owner_type, id::VARCHAR AS owner_id, id AS work_id, NULL AS block_type, v FROM emb UNION ALL SELECT 'block', 'b' || id, id - id % 4, CASE WHEN id % 2 = 0 THEN 'verse' ELSE 'chorus' END, v FROM emb),
 u AS (SELECT owner_type, owner_id, work_id, block_type, list_transform(o.v, lambda x, i: x - list_dot_product(o.v, q1) * q1[i] - list_dot_product(o.v, q2) * q2[i] - list_dot_product(o.v, q3) * q3[i]) AS u FROM o JOIN k5 ON k5.id = work_id)
 SELECT owner_type, owner_id, work_id, block_type, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u) / sqrt(list_dot_product(u, u)), 6) + 0.0 AS value FROM u""")
def residual_joins(spark, sf):
    """Vectors as works, and again as blocks of every fourth work; a work's topics are the fifth to seventh vector
    after it, the last one as the combined profile. Works without all three have no residual, nor have their blocks."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("vector"))
    owned = lambda kind, owner: e.select(F.lit(kind).alias("owner_type"), owner.cast("string").alias("owner_id"), F.lit(kind).alias("scope"), F.concat(F.lit(f"{kind}-"), "n").alias("id"), "vector")
    of = lambda scope, after: e.select((F.col("n") - after).cast("string").alias("owner_id"), F.lit(scope).alias("scope"), F.concat(F.lit(f"{scope}-"), "n").alias("id"), "vector")
    rows = of("emotional_subject", 5).unionByName(of("main_theme", 6)).unionByName(of("combined_topic_profile", 7))
    whole = rows.groupBy("owner_id").count().where("count = 3")
    blocks = e.select(F.concat(F.lit("b"), "n").alias("id"), (F.col("n") - F.col("n") % 4).cast("string").alias("work_id"), F.when(F.col("n") % 2 == 0, "verse").otherwise("chorus").alias("type"))
    out = residual.residuals(owned("work", F.col("n")).unionByName(owned("block", F.concat(F.lit("b"), "n"))), blocks, rows.join(whole, "owner_id", "left_semi"))
    return out.select("owner_type", "owner_id", F.col("work_id").cast("long").alias("work_id"), "block_type", F.posexplode("vector").alias("pos", "value")).withColumns({"pos": F.col("pos").cast("long"), "value": r6("value") + 0.0})


@query("""SELECT 'emb_' || substr(sha256('local-hash-embedding-v1' || chr(31) || 'work' || chr(31) || doc_id || chr(31) || 'work' || chr(31) || sha256(t)), 1, 16) AS id, doc_id::VARCHAR AS owner_id,
 sha256('local-hash-embedding-v1' || chr(31) || 'work' || chr(31) || doc_id || chr(31) || 'work' || chr(31) || t) AS text_hash, doc_id % 2 = 0 AS reused FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def embedding_cache(spark, sf):
    """Embedding records of documents, of which every second one is in the cache, and so are texts that are gone."""
    rows = works(spark, sf).select(F.lit("work").alias("owner_type"), F.col("id").cast("string").alias("owner_id"), F.lit("work").alias("scope"), "text")
    name = embed.PROVIDERS["hash"][0]
    keys = [F.lit(name), F.col("owner_type"), F.col("owner_id"), F.col("scope")]
    hashed = lambda df: df.select(tx.create_id("emb", *keys, F.sha2("text", 256)).alias("id"), "owner_type", "owner_id", "scope", F.lit(name).alias("model"), tx.content_hash(*keys, F.col("text")).alias("text_hash"), F.array(F.lit(-1.0)).alias("vector"))
    gone = rows.withColumn("text", F.concat("text", F.lit(" (an earlier wording)")))
    out = embed.embed(rows, "hash", hashed(rows.where("owner_id % 2 = 0")).unionByName(hashed(gone)))
    return out.select("id", "owner_id", "text_hash", (F.size("vector") == 1).alias("reused"))


LABELS = ("Final Chorus 2", "Verse 1: ", "  BRIDGE", "Pre-Intro!", "12", "Outro / fade 3", "Spoken  Word", "final REFRAIN")


@query(f"""WITH l AS (SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 9 < 8 THEN [{quoted(LABELS)}][p_partkey % 9 + 1] ELSE p_type END AS label FROM part), n AS (SELECT *, regexp_replace(lower(label), '[0-9]+', '', 'g') AS low FROM l),
 m AS (SELECT *, trim(CASE WHEN low LIKE 'final %' THEN substr(low, 7) ELSE low END) AS sec, trim(regexp_replace(trim(low), '[^a-z0-9_]+', '-', 'g'), '-') AS gen FROM n)
 SELECT id, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', '-', 'g'), '-') AS slug, CASE WHEN sec LIKE '%chorus%' THEN 'chorus' WHEN sec LIKE '%verse%' THEN 'verse' WHEN sec LIKE '%bridge%' THEN 'bridge' WHEN sec LIKE '%intro%' THEN 'intro' WHEN sec LIKE '%outro%' THEN 'outro'
  WHEN sec LIKE '%refrain%' THEN 'refrain' WHEN sec = '' THEN 'section' ELSE regexp_replace(sec, '\\s+', '-', 'g') END AS section, CASE WHEN gen = '' THEN 'section' ELSE gen END AS plain FROM m""")
def labels_and_slugs(spark, sf):
    label = F.coalesce(F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_partkey") % 9).cast("int")), F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.slug(F.col("p_name")).alias("slug"), tx.section_label(label).alias("section"), tx.generic_label(label).alias("plain"))


@query(f"""WITH {EMB} SELECT id, 'Work ' || id AS title, st AS "set", split, CASE WHEN label = 1 THEN 'generic_pop' ELSE '' END AS control_type, kind, round(sqrt(list_dot_product(v, v)) * f, 6) AS norm FROM es CROSS JOIN (VALUES ('raw', 1, 1), ('residual', 2, 3)) k(kind, f, every) WHERE id % 5 <> 0 AND id % every = 0""")
def model_vectors(spark, sf):
    """Raw vectors of works that have a split, and residuals (twice the vector) of every third of them."""
    v = vectors(spark, sf)
    made = v.select("id", F.concat(F.lit("Work "), "id").alias("title"), "set", F.struct(F.lit(0).alias("chunk_index"), F.when(F.col("label") == 1, "generic_pop").alias("synthetic_control_type")).alias("metadata"))
    owned = lambda df, key: df.select(F.lit("work").alias("owner_type"), F.lit("work").alias("scope"), F.col("id").alias(key), "vector")
    twice = v.where("id % 3 = 0").withColumn("vector", vx.scale(F.col("vector"), 2.0))
    atoms = owned(v, "owner_id").withColumn("owner_type", F.lit("atom"))
    rows = pipeline.model_vectors(made, v.where("id % 5 <> 0").select("id", "split"), owned(v, "owner_id").unionByName(atoms), owned(twice, "work_id"))
    return rows.select("id", "title", "set", "split", "control_type", "kind", r6(vx.norm(F.col("vector"))).alias("norm"))


def flagship(spark, sf) -> DataFrame:
    """documents to topics, hash embeddings, residuals, centroids, and scored works with their nearest target."""
    w = split.assign_splits(works(spark, sf), ["set"])
    profiles = topics.topic_profiles(w)
    empty = lambda cols: spark.createDataFrame([], cols)
    blocks = empty("id string, work_id long, type string, text string")
    inputs = embed.embedding_inputs(w.withColumn("id", F.col("id").cast("string")), blocks, empty("id string, text string"), profiles)
    emb = embed.embed(inputs)
    res = residual.residuals(emb.where("owner_type = 'work'"), blocks.withColumn("work_id", F.col("work_id").cast("string")), emb.where("owner_type = 'topic'"))
    v = w.select("id", "set", F.lit("generic").alias("control_type"), "split").join(res.select(F.col("work_id").cast("long").alias("id"), "vector"), "id").withColumn("kind", F.lit("residual"))
    v = v.persist()  # centroids, scores and the search for neighbours read it, until the caller clears the cache
    sims = model.centroid_similarities(v)
    near = model.nearest_targets(sims, v.where("set = 'target' and split = 'train'"))
    rows = model.model_scores(sims).where("model = 'residual_margin'").join(near.select("id", "neighbour", "similarity"), "id", "left")
    return rows.select("id", "set", "split", r6("target_similarity").alias("target_similarity"), r6("background_similarity").alias("background_similarity"), r6("score").alias("style_margin"), "neighbour", r6("similarity").alias("neighbour_similarity"), metrics.overfit_risk(F.coalesce("similarity", F.lit(0.0))).alias("overfit_risk"))


QUERIES["style_pipeline"] = flagship
