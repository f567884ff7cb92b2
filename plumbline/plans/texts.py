"""Queries over texts, rankings, duplicates, lookups and merges, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import changes, lookup, resolution
from plumbline.operators import contracts as ct
from plumbline.operators import evaluation as ev
from plumbline.operators import retrieval as rt
from plumbline.sources import store
from plumbline.tables import stored

from .base import Registry
from .spanish import lexical_sql
from .surrogates import table

R = Registry()

FOLD = lambda c: f"strip_accents({c})"
KEY = lambda c: f"trim(regexp_replace(regexp_replace(upper(strip_accents(replace({c}, 'ß', 'SS'))), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

DENSE_SQL = f"""pairs AS (SELECT a.vec_id AS q, b.vec_id AS d, round({COS}, 6) AS cos, a.label AS ql, b.label AS dl FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
dense AS (SELECT 'dense' AS system, q, d, cos, row_number() OVER (PARTITION BY q ORDER BY cos DESC, d) AS pos FROM pairs),
recency AS (SELECT 'recency' AS system, q, d, cos, row_number() OVER (PARTITION BY q ORDER BY d DESC) AS pos FROM pairs),
rankings AS (SELECT * FROM dense WHERE pos <= 30 UNION ALL SELECT * FROM recency WHERE pos <= 30),
judged AS (SELECT DISTINCT q, d, CASE WHEN ql = dl THEN 2 WHEN abs(ql - dl) = 1 THEN 1 ELSE 0 END AS grade FROM rankings JOIN pairs USING (q, d) WHERE (q + d) % 3 <> 0)"""


def dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The queries (ids divisible by 20) against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return rt.dense_topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("d"), F.lit(0).alias("chunk"), F.col("embedding").alias("vector")), k)


def rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first 30 by cosine and by recency of each query, and the grades of what is ranked (two thirds of it)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    newest = e.orderBy(F.desc("vec_id")).limit(31).select(F.col("vec_id").alias("d"))  # a query may be one of them
    recency = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q")).join(F.broadcast(newest), F.col("q") != F.col("d"))
    recency = rt.top_k(recency, "q", [F.desc("d")], 30).select(F.lit("recency").alias("system"), "q", "d", "pos")
    ranked = dense(spark, sf_dir, 30).select(F.lit("dense").alias("system"), "q", "d", "pos").unionByName(recency)
    labels = lambda c, n: e.select(F.col("vec_id").alias(c), F.col("label").alias(n))
    pool = ranked.select("q", "d").distinct().where((F.col("q") + F.col("d")) % 3 != 0).join(labels("q", "ql"), "q").join(labels("d", "dl"), "d")
    return ranked, pool.select("q", "d", F.when(F.col("ql") == F.col("dl"), 2).when(F.abs(F.col("ql") - F.col("dl")) == 1, 1).otherwise(0).alias("grade"))


@R.query(f"WITH {DENSE_SQL} SELECT q, d, cos, pos FROM dense WHERE pos <= 10")
def dense_cosine_topk(spark, sf_dir):
    return dense(spark, sf_dir, 10).select("q", "d", "cos", "pos")


@R.query(f"WITH {DENSE_SQL} SELECT q, d, round(sum(1.0 / (60 + pos)), 6) AS rrf FROM rankings GROUP BY q, d")
def rrf_fusion(spark, sf_dir):
    fused = rt.reciprocal_rank_fusion(rankings(spark, sf_dir)[0], "q", "d")
    return fused.withColumn("rrf", F.round("rrf", 6))


METRIC_SQL = DENSE_SQL + """, ideal AS (SELECT q, sum(CASE WHEN ip <= 25 THEN (pow(2.0, grade) - 1) / log2(ip + 1) END) AS idcg, count(*) FILTER (grade = 2) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, d) AS ip FROM judged) GROUP BY q),
cond AS (SELECT system, q, d, pos, grade, CASE WHEN grade IS NOT NULL THEN count(grade) OVER w END AS cpos, count(*) FILTER (grade = 0) OVER w AS non_above FROM rankings LEFT JOIN judged USING (q, d) WINDOW w AS (PARTITION BY system, q ORDER BY pos)),
m AS (SELECT system, q, round(coalesce(sum(CASE WHEN cpos <= 25 THEN (pow(2.0, grade) - 1) / log2(cpos + 1) END) / nullif(any_value(idcg), 0), 0), 6) AS ndcg,
  round(coalesce(count(*) FILTER (grade = 2 AND cpos <= 30) / nullif(any_value(n_rel), 0), 0), 6) AS recall, round(coalesce(max(CASE WHEN grade = 2 THEN 1.0::DOUBLE / cpos END), 0), 6) AS mrr,
  round(coalesce(sum(CASE WHEN grade = 2 THEN 1 - least(non_above, n_rel)::DOUBLE / n_rel END) / nullif(any_value(n_rel), 0), 0), 6) AS bpref,
  round(coalesce(count(*) FILTER (grade < 2 AND pos <= 30) / nullif(count(*) FILTER (grade IS NOT NULL AND pos <= 30), 0), 0), 6) AS discarded,
  round(coalesce(count(*) FILTER (grade IS NOT NULL AND pos <= 25) / nullif(count(*) FILTER (pos <= 25), 0), 0), 6) AS judged, count(*) AS returned
  FROM cond LEFT JOIN ideal USING (q) GROUP BY system, q)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, judged = rankings(spark, sf_dir)
    return ev.graded_metrics(ranked, judged, ["system"], "q", "d")


@R.query(f"WITH {METRIC_SQL} SELECT system, q, ndcg, recall, mrr, bpref, discarded, judged, returned FROM m")
def ndcg_recall_mrr_bpref(spark, sf_dir):
    return metrics(spark, sf_dir)


@R.query(f"WITH {METRIC_SQL} SELECT system, count(*) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(bpref), 5) AS bpref, round(avg(discarded), 5) AS discarded, round(avg(judged), 5) AS judged, CASE system WHEN 'recency' THEN 1 ELSE 2 END AS place FROM m GROUP BY system")
def ablation_table(spark, sf_dir):
    """The systems beside each other."""
    return ev.ablation(metrics(spark, sf_dir), ["recency", "dense"], ["ndcg", "recall", "mrr", "bpref", "discarded", "judged"])


@R.query(f"WITH {METRIC_SQL} SELECT count(*) AS queries, round(avg(b.ndcg - a.ndcg), 5) AS ndcg_delta, round(avg(b.bpref - a.bpref), 5) AS bpref_delta FROM m a JOIN m b ON a.q = b.q AND b.system = 'dense' AND a.system = 'recency'")
def paired_system_delta(spark, sf_dir):
    m = metrics(spark, sf_dir)
    both = ev.paired(m, "q", "ndcg", "recency", "dense").join(ev.paired(m, "q", "bpref", "recency", "dense").withColumnRenamed("delta", "bpref"), "q")
    return both.agg(F.count("*").alias("queries"), F.round(F.avg("delta"), 5).alias("ndcg_delta"), F.round(F.avg("bpref"), 5).alias("bpref_delta"))


@R.query()
def bootstrap_ci(spark, sf_dir):
    """Interval of the paired difference in nDCG by 1,000 hash-drawn resamples; the draws have no SQL form and are held against plain Python."""
    return ev.bootstrap(ev.paired(metrics(spark, sf_dir), "q", "ndcg", "recency", "dense"), "delta")


# A report is 32 vectors with the texts of the documents of their ids; its question is the report's own number's.
QA_SQL = """WITH f AS (SELECT vec_id // 32 AS report, vec_id AS fragment, embedding, text FROM embeddings JOIN documents ON doc_id = vec_id),
ask AS (SELECT vec_id AS report, embedding AS qe, text AS question FROM embeddings JOIN documents ON doc_id = vec_id),
tok AS (SELECT report, fragment, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS cos, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-záéíóúñü0-9]{3,}')), lambda w: NOT list_contains([STOP], w)) AS qt, list_distinct(regexp_extract_all(lower(text), '[a-záéíóúñü0-9]{3,}')) AS ft FROM f JOIN ask USING (report)),
pr AS (SELECT report, fragment, cos, len(list_intersect(qt, ft)) / greatest(len(qt), 1) AS lexical FROM tok),
rk AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY cos DESC, fragment) AS dp, CASE WHEN lexical > 0 THEN row_number() OVER (PARTITION BY report ORDER BY lexical DESC, fragment) END AS lp, max(cos) OVER (PARTITION BY report) AS best_cos, max(lexical) OVER (PARTITION BY report) AS best_lexical FROM pr),
fused AS (SELECT *, round(1.0 / (60 + dp) + coalesce(1.0 / (60 + lp), 0), 9) AS rrf FROM rk), hy AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY rrf DESC, fragment) AS pos FROM fused)""".replace("STOP", ", ".join(f"'{w}'" for w in rt.STOPWORDS))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(d, "vec_id")
    f = e.select(F.floor(F.col("vec_id") / 32).alias("report"), F.col("vec_id").alias("fragment"), "embedding", "text")
    asked = e.select(F.col("vec_id").alias("report"), F.col("embedding").alias("qe"), F.col("text").alias("question"))
    return f.join(asked, "report").select("report", "fragment", F.round(rt.cosine(F.col("qe"), F.col("embedding")), 6).alias("cos"), rt.question_overlap(F.col("question"), F.col("text")).alias("lexical"))


@R.query(QA_SQL + " SELECT report, fragment, pos, rrf, best_cos, round(best_lexical, 6) AS best_lexical FROM hy WHERE pos <= 8")
def hybrid_fragments(spark, sf_dir):
    """The eight best fragments of each report for its question, with the best of each measure."""
    return rt.hybrid(qa_pairs(spark, sf_dir), "report", "fragment").select("report", "fragment", "pos", "rrf", "best_cos", F.round("best_lexical", 6).alias("best_lexical"))


@R.query(QA_SQL + " SELECT DISTINCT report, best_cos, round(best_lexical, 6) AS best_lexical, best_cos < 0.40::DOUBLE AND best_lexical < 0.34::DOUBLE AS refused FROM hy")
def double_gate_refusal(spark, sf_dir):
    best = qa_pairs(spark, sf_dir).groupBy("report").agg(F.max("cos").alias("best_cos"), F.max("lexical").alias("lexical"))
    return best.select("report", "best_cos", F.round("lexical", 6).alias("best_lexical"), rt.refused(F.col("best_cos"), F.col("lexical")).alias("refused"))


LEXICAL_SQL = lexical_sql("(SELECT item_id AS q, text FROM benchmark)", "(SELECT doc_id AS d, text FROM documents)")


@R.query(f"WITH {LEXICAL_SQL}, o AS (SELECT q, d, round(r / (r + 1), 9) AS score, row_number() OVER (PARTITION BY q ORDER BY round(r / (r + 1), 9) DESC, d) AS pos FROM lx) SELECT * FROM o WHERE pos <= 25")
def cover_density_topk(spark, sf_dir):
    """The lexical mode: passages as queries, whole documents as chunks."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.lit(0).alias("chunk"), "text")
    scores = rt.lexical_scores(queries, rt.postings(chunks, rt.query_terms(queries)))
    return rt.top_k(scores.select("q", "d", F.round("score", 9).alias("score")), "q", [F.desc("score"), F.col("d")], 25)


TOKENS = lambda c: f"list_distinct(list_filter(string_split(lower({KEY(c)}), ' '), lambda w: length(w) >= 3))"


@R.query(f"""WITH qt AS (SELECT item_id, unnest(t) AS w, len(t) AS n FROM (SELECT item_id, {TOKENS('text')} AS t FROM benchmark)), dt AS (SELECT doc_id, unnest({TOKENS('text')}) AS w FROM documents),
s AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS overlap FROM qt JOIN dt USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS pos FROM s) SELECT * FROM r WHERE pos <= 10""")
def lexical_overlap_topk(spark, sf_dir):
    """Share of a passage's words that a document has, ten best documents of each passage."""
    q = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("t"))
    q = q.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("w"))
    s = d.join(q, "w").groupBy("item_id", "doc_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("overlap"))
    return rt.top_k(s, "item_id", [F.desc("overlap"), F.col("doc_id")], 10)


@R.query("""WITH d AS (SELECT doc_id, sha256(text) AS cluster, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS source, n_chars % 7 + doc_id % 5 AS days FROM documents),
c AS (SELECT *, (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT AS complete, -(CASE WHEN days = 0 THEN 9999 ELSE days END) AS fresh FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY complete DESC, fresh DESC, doc_id) AS n, count(*) OVER (PARTITION BY cluster) AS members FROM c) SELECT cluster, doc_id AS canonical, members FROM r WHERE n = 1""")
def exact_duplicate_canonicals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select("doc_id", F.sha2("text", 256).alias("cluster"), F.when(i % 3 != 0, F.col("lang")).alias("lang"), F.when(i % 4 != 0, F.col("source")).alias("source"), (F.col("n_chars") % 7 + i % 5).alias("days"))
    return resolution.canonical(rows, "cluster", ["lang", "source"], "days", "doc_id")


ADS = {
    "address": "CASE p_partkey % 6 WHEN 0 THEN 'Calle ' || NAME || ' 1' || (p_partkey % 40 + 100) || ' Piso ' || (p_partkey % 3) || ' Depto ' || chr(CAST(65 + p_partkey % 2 AS INT)) WHEN 1 THEN 'Calle ' || NAME || ' al 1' || (p_partkey % 40 + 100) WHEN 2 THEN 'calle ' || NAME || ', 1.' || (p_partkey % 40 + 100) || ', Piso ' || (p_partkey % 3) WHEN 3 THEN 'Cálle ' || NAME || ' 1' || (p_partkey % 40 + 100) || ' ' || (p_partkey % 3) || '°' || chr(CAST(65 + p_partkey % 2 AS INT)) WHEN 4 THEN 'Calles ' || NAME || ' 1' || (p_partkey % 40 + 100) ELSE 'Calle ' || NAME || ' sin numero' END".replace("NAME", "split_part(p_name, ' ', 1)"),
    "surface": "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_size + 30 END", "price": "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_retailprice END", "rooms": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size % 3 END",
}


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the role of advertisements: addresses in six ways of writing, streets by the name's first word."""
    key, s = F.col("p_partkey"), lambda c: c.cast("string")
    name, number, floor = F.split("p_name", " ")[0], s(key % 40 + 100), s(key % 3)
    letter = F.when(key % 2 == 0, "A").otherwise("B")
    kinds = [
        F.concat(F.lit("Calle "), name, F.lit(" 1"), number, F.lit(" Piso "), floor, F.lit(" Depto "), letter), F.concat(F.lit("Calle "), name, F.lit(" al 1"), number), F.concat(F.lit("calle "), name, F.lit(", 1."), number, F.lit(", Piso "), floor),
        F.concat(F.lit("Cálle "), name, F.lit(" 1"), number, F.lit(" "), floor, F.lit("°"), letter), F.concat(F.lit("Calles "), name, F.lit(" 1"), number), F.concat(F.lit("Calle "), name, F.lit(" sin numero")),
    ]
    address = kinds[5]
    for i in range(5):
        address = F.when(key % 6 == i, kinds[i]).otherwise(address)
    p = table(spark, sf_dir, "part").select(key.alias("pos"), "p_brand", F.split("p_name", " ")[0].alias("word"), address.alias("address"), F.when(key % 29 != 0, (F.col("p_size") + 30).cast("double")).alias("surface"), F.when(key % 31 != 0, F.col("p_retailprice")).alias("price"), F.when(key % 5 != 0, F.col("p_size") % 3).alias("rooms"))
    unit, specific = tx.whole_unit(F.col("address"))
    # Addresses take long to read and a table of parts is few files, so rows are dealt out first.
    return p.repartition("pos").withColumn("key", tx.block_key(F.col("address"))).withColumns({"street": tx.street_of(F.col("key")), "grams": tx.trigrams(F.col("key")), "unit": unit, "specific": specific})


# The forms of ADS, read off by hand: what a parser has to find in each (`1.1xx` is number 1: the stop parts it).
ADS_SQL = f"""ads AS (SELECT p_partkey AS pos, p_brand, split_part(p_name, ' ', 1) AS word, {ADS["surface"]}::DOUBLE AS surface, {ADS["price"]} AS price, {ADS["rooms"]} AS rooms,
  CASE p_partkey % 6 WHEN 5 THEN 'CALLE ' || upper(split_part(p_name, ' ', 1)) || ' SIN NUMERO' WHEN 4 THEN 'CALLES ' || upper(split_part(p_name, ' ', 1)) || ' 1100' WHEN 2 THEN 'CALLE ' || upper(split_part(p_name, ' ', 1)) || ' 0' ELSE 'CALLE ' || upper(split_part(p_name, ' ', 1)) || ' 1100' END AS key,
  CASE p_partkey % 6 WHEN 0 THEN (p_partkey % 3) || chr(CAST(65 + p_partkey % 2 AS INT)) WHEN 3 THEN (p_partkey % 3) || chr(CAST(65 + p_partkey % 2 AS INT)) WHEN 2 THEN CAST(p_partkey % 3 AS VARCHAR) END AS unit, p_partkey % 6 IN (0, 3) AS specific FROM part)"""
AD_GRAMS = "list_distinct(list_transform(range(1, length('  ' || key || ' ') - 1), lambda i: substring('  ' || key || ' ', i, 3)))"
FUZZY_SQL = f"""{ADS_SQL}, g AS (SELECT *, {AD_GRAMS} AS grams, CASE WHEN key LIKE '%SIN NUMERO' THEN key ELSE trim(regexp_replace(key, ' ?[0-9]+$', '')) END AS street FROM ads),
j AS (SELECT a.p_brand, a.street, a.pos AS a, b.pos AS b, a.key = b.key AS one, round(CASE WHEN a.key = b.key THEN 1.0 ELSE len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))) END, 6) AS sim, a.unit <> b.unit AS other_unit, coalesce(a.unit = b.unit, false) AND a.specific AND b.specific AS outright,
  abs(a.surface - b.surface) AS gap, abs(a.surface - b.surface) / a.surface AS share, coalesce(abs(a.price - b.price) / nullif(a.price, 0) <= 0.05::DOUBLE, false) AS priced, a.rooms IS NULL OR b.rooms IS NULL OR a.rooms = 0 OR b.rooms = 0 OR a.rooms = b.rooms AS rooms_fit
  FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.word = b.word AND a.pos < b.pos),
l AS (SELECT a, b, sim, CASE WHEN coalesce(other_unit, false) THEN NULL WHEN one AND (outright OR (coalesce(gap <= 2, false) AND rooms_fit AND priced)) THEN 'layer1' WHEN sim >= 0.85 AND coalesce(share <= 0.1::DOUBLE, false) AND priced THEN 'layer2' WHEN sim >= 0.45 AND NOT coalesce(share > 0.25, false) THEN 'grey' END AS layer FROM j)"""


def fuzzy(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    return resolution.blocked_pairs(rows, ["p_brand", "word"], "pos", "key", "grams", "surface", "price", "unit", "specific", "rooms", only, blocks=True)


@R.query(f"WITH {FUZZY_SQL} SELECT * FROM l WHERE layer IS NOT NULL")
def blocked_fuzzy_pairs(spark, sf_dir):
    """Blocks are area (brand) and street; in each the layers decide."""
    return fuzzy(stored(ads(spark, sf_dir))).select("a", "b", "sim", "layer")


DECIDED_SQL = f"""WITH {FUZZY_SQL}, p AS (SELECT l.*, p_brand AS "group" FROM l JOIN (SELECT pos, p_brand FROM ads) x ON x.pos = l.a WHERE layer IS NOT NULL),
asked AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY sim DESC, a, b) AS n FROM p WHERE layer = 'grey'),
d AS (SELECT a, b, CASE layer WHEN 'layer1' THEN 'EXACT_ADDR' ELSE 'FUZZY' END AS method FROM p WHERE layer <> 'grey' UNION ALL SELECT a, b, 'LLM' FROM asked WHERE n <= 15 AND (a * 7 + b) % 3 = 0)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a table of verdicts in the judge's place: every third pair is the same, every third undecided."""
    rows = stored(ads(spark, sf_dir))
    pairs = fuzzy(rows)
    questions = resolution.asked(fuzzy(rows, resolution.likest(pairs, "p_brand")), "p_brand")
    m = (F.col("a") * 7 + F.col("b")) % 3
    verdicts = questions.select("a", "b", F.when(m == 0, "mismo").when(m == 1, "distinto").otherwise("no_se").alias("verdict"))
    return resolution.decided(pairs, questions, verdicts)


@R.query(DECIDED_SQL + " SELECT * FROM d")
def judged_duplicate_pairs(spark, sf_dir):
    return decisions(spark, sf_dir).select("a", "b", "method")


@R.query()
def clique_clusters(spark, sf_dir):
    """Greedy complete linkage is sequential by nature; held against a plain version in the tests."""
    edges = decisions(spark, sf_dir)
    clusters = resolution.cliques(edges.select(F.concat_ws("|", "p_brand", "word").alias("block"), "a", "b"))
    return resolution.labelled(clusters, edges)


@R.query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, w, greatest(1, CAST(ceil((len(w) - 10) / 40.0) AS INT)) AS n FROM w),
c AS (SELECT doc_id, unnest(range(0, n)) AS ix, w FROM n) SELECT doc_id, ix, sha256(array_to_string(w[ix * 40 + 1 : ix * 40 + 50], ' ')) AS chunk FROM c""")
def window_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.window_chunks(tx.words(F.col("text")), 50, 10)).alias("ix", "chunk"))
    return d.select("doc_id", "ix", F.sha2("chunk", 256).alias("chunk"))


@R.query()
def sentence_chunks(spark, sf_dir):
    """Look-behind splitting has no counterpart in the SQL engine's expressions."""
    d = table(spark, sf_dir, "documents").withColumn("s", tx.sentences(F.col("text")))
    return d.select("doc_id", F.size("s").alias("sentences"), F.posexplode(tx.packed_chunks(F.col("s"), 120, 180)).alias("ix", "chunk"))


NUMBER = "TRY_CAST(CASE WHEN contains(x, ',') THEN replace(replace(x, '.', ''), ',', '.') WHEN regexp_matches(x, '^[0-9]+([.][0-9]{3})+$') THEN replace(x, '.', '') ELSE x END AS DOUBLE)"


K3 = "lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')"
#: What the JSON of a report holds, stated and not parsed.
ALLOWED_SQL = "[100000.0 + o_orderkey % 1000, 250000.0 + o_orderkey % 1000, 2441.5, 0.31, o_orderkey % 1000, 3.0, 12.25, 31.0, round_even((100000 + o_orderkey % 1000) / 1000, 1), round_even((250000 + o_orderkey % 1000) / 1000, 1), 2.4]::DOUBLE[]"


def report_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and the JSON of a report: amounts as numbers and as text, keys with digits, nested lists."""
    k = F.col("o_orderkey") % 1000
    k3, s = F.lpad(k.cast("string"), 3, "0"), lambda c: c.cast("string")
    data = F.concat(
        F.lit('{"valuacion": {"precio_publicacion_sugerido": {"minimo": '), s(100000 + k), F.lit(', "maximo": "250.'), k3,
        F.lit('"}, "usd_por_m2": "2.441,5", "dispersion": 0.31}, "id 77": null, "propiedad": {"direccion": "Paz '), s(k), F.lit(', piso 3", "flags": [true, 12.25]}}'),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", data.alias("data"), k3.alias("k3"))


@R.query(f"""WITH s AS (SELECT o_orderkey, list_distinct({ALLOWED_SQL}) AS allowed, [250000.0 + o_orderkey % 1000, 12.25, 2.0, 777123.0]::DOUBLE[] AS said FROM orders)
SELECT o_orderkey, len(allowed) AS n_allowed, round(list_sum(allowed), 2) AS total, len(said) AS n_said, len(list_filter(said, lambda n: NOT ((n = floor(n) AND n <= 100) OR (n = floor(n) AND n BETWEEN 1900 AND 2100)) AND len(list_filter(allowed, lambda p: abs(n - p) <= greatest(abs(p) * 0.001::DOUBLE, 0.5))) = 0)) AS n_orphans FROM s""")
def number_trace_orphans(spark, sf_dir):
    """The figures of a text against all that its report's JSON allows."""
    r = report_data(spark, sf_dir)
    said = tx.numbers(F.concat(F.lit("Vale 250."), F.col("k3"), F.lit(" USD, mide 12,25 m2 y no 777.123.")))
    # Generated, so that the JSON is read once and not for each use of its numbers.
    both = F.struct(F.array_distinct(tx.allowed_numbers(F.col("data"))).alias("allowed"), said.alias("said"))
    r = r.select("o_orderkey", F.explode(F.array(both)).alias("x")).select("o_orderkey", "x.allowed", "x.said")
    return r.select("o_orderkey", F.size("allowed").alias("n_allowed"), F.round(F.aggregate("allowed", F.lit(0.0), lambda s, x: s + x), 2).alias("total"), F.size("said").alias("n_said"), F.size(tx.orphans(F.col("said"), F.col("allowed"))).alias("n_orphans"))


@R.query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 250000.0 + o_orderkey % 1000 WHEN 1 THEN 199000.0 + o_orderkey % 1000 END::DOUBLE AS asserted, CASE o_orderkey % 4 WHEN 1 THEN 1 ELSE 0 END AS n_wrong FROM orders""")
def asserted_value_check(spark, sf_dir):
    """Four ways of speaking of a value: the right one, a wrong one, of comparables, of too little and for a square metre."""
    i, k3 = F.col("o_orderkey") % 4, F.col("k3")
    text = F.when(i == 0, F.concat(F.lit("El valor estimado es de USD 250."), k3, F.lit(". Nada más."))).when(i == 1, F.concat(F.lit("El precio sugerido ronda los USD 199."), k3, F.lit(" hoy.")))
    text = text.when(i == 2, F.concat(F.lit("Los comparables tienen un valor de USD 180."), k3, F.lit(" en promedio."))).otherwise(F.concat(F.lit("Tasación: U$S 30.000. El valor medio en dólares 260."), k3, F.lit(", por m2 nada.")))
    r = report_data(spark, sf_dir).select("o_orderkey", ct.asserted_values(text).alias("v"), tx.money_figures(F.col("data")).alias("figures"))
    return r.select("o_orderkey", F.get("v", F.lit(0)).alias("asserted"), F.size(ct.wrong_values(F.col("v"), F.col("figures"))).alias("n_wrong"))


@R.query("SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'no_cite,untraced_number' WHEN 2 THEN 'untraced_number' WHEN 3 THEN 'unknown_cite' ELSE '' END AS problems FROM documents")
def answer_verification(spark, sf_dir):
    """Answers with right, no, wrong and unknown cites, and one that says it has no evidence."""
    i = F.col("doc_id") % 5
    allowed = F.create_map(F.lit("C-01"), F.lit("mide 75 m2 y vale 250.000"), F.lit("C-02"), F.lit("piso 7"))
    none = F.array().cast("array<string>")
    cites = F.when(i == 1, none).when(i == 2, F.array(F.lit(" C-02 "))).when(i == 3, F.array(F.lit("C-09"), F.lit("C-01"))).when(i == 4, none).otherwise(F.array(F.lit("[C-01]")))
    problems = ct.answer_problems(F.lit("Vale 250.000 USD en 2024."), cites, i == 4, allowed)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(problems, ",").alias("problems"))


@R.query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in tx.REASON_CUES.items()) + "], lambda x: x IS NOT NULL)::VARCHAR AS reasons FROM documents")
def reason_cues(spark, sf_dir):
    """Which reasons to leave out a text hints at."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(tx.suggested_reasons(F.col("text")), ", "), F.lit("]")).alias("reasons"))


@R.query("SELECT page_id, sha256('<contenido_externo>' || chr(10) || replace(html || '</contenido_externo>', '</contenido_externo>', '&lt;/contenido_externo&gt;') || chr(10) || '</contenido_externo>') AS wrapped FROM pages")
def wrapped_external_text(spark, sf_dir):
    text = F.concat("html", F.lit("</contenido_externo>"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.wrapped(text), 256).alias("wrapped"))


@R.query("""SELECT p_partkey, 'Departamento' || CASE p_size % 4 WHEN 1 THEN ' · monoambiente' WHEN 0 THEN '' ELSE ' · ' || (p_size % 4) || ' ambientes' END || ' · ' || (p_size + 20) || ' m² · ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' · planta baja' WHEN 1 THEN '' ELSE ' · piso ' || (p_partkey % 3) END || ' · muy bueno'
 || ' · USD ' || replace(format('{:,}', CAST(round_even(p_retailprice * 100 / (p_size + 20) / 100, 0) * 100 AS BIGINT)), ',', '.') || '/m²' AS header FROM part""")
def listing_headers(spark, sf_dir):
    """What stands before each chunk of a listing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    head = tx.header(F.lit("departamento"), size % 4, size + 20, F.col("p_brand"), F.when(k % 3 != 1, k % 3), F.col("p_retailprice") * 100, F.lit("muy_bueno"))
    return table(spark, sf_dir, "part").select("p_partkey", head.alias("header"))


@R.query("""SELECT p_partkey, 'Propiedad · 3 ambientes · ' || (p_size + 20) || ' m² · ' || p_brand || ' · piso 2 · bueno' || chr(10) || 'Buen estado. Al frente. ' || CASE WHEN p_size % 2 = 0 THEN 'Con' ELSE 'Sin' END || ' ascensor. ' || CASE WHEN p_size % 5 = 0 THEN 'A estrenar' ELSE (p_size % 5) || ' años de antigüedad' END || '. Con cochera. Amenities: sum, pileta.' || chr(10) || p_name AS text FROM part""")
def subject_query_text(spark, sf_dir):
    """What a subject is searched by."""
    size = F.col("p_size")
    text = tx.query_text(F.lit(None).cast("string"), F.lit(3), size + 20, F.col("p_brand"), F.lit(2), F.lit("bueno"), F.lit("frente"), size % 2 == 0, size % 5, F.lit(1), F.array(F.lit("sum"), F.lit("pileta")), F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@R.query()
def truncated_texts(spark, sf_dir):
    """The one chunk of a text that is cut at its sentences; look-behind splitting has no SQL here."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(tx.truncated(tx.sentences(F.col("text")), 120), 256).alias("chunk"))


CITE = "CASE doc_id % 3 WHEN 0 THEN substring(text, 5, 20) WHEN 1 THEN ' ' ELSE 'not in any text' END"
FLAT = lambda c: f"regexp_replace(lower(strip_accents({c})), '\\s+', ' ', 'g')"


@R.query(f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE lang END AS v, {CITE} AS cite, text FROM documents)
SELECT doc_id, CASE WHEN v IS NULL THEN NULL WHEN trim(cite) = '' THEN 0.4::DOUBLE WHEN contains({FLAT('text')}, {FLAT('cite')}) THEN 1.0 ELSE 0.0 END AS confidence FROM c""")
def citation_verification(spark, sf_dir):
    i = F.col("doc_id")
    cite = F.when(i % 3 == 0, F.substring("text", 5, 20)).when(i % 3 == 1, " ").otherwise("not in any text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.citation_confidence(F.when(i % 10 != 9, F.col("lang")), cite, F.col("text")).alias("confidence"))


@R.query(f"SELECT doc_id, sha256({KEY('text')}) AS key FROM documents")
def accent_folded_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.key(F.col("text")), 256).alias("key"))


@R.query(f"""WITH idx0 AS (SELECT DISTINCT {KEY('p_type')} AS key, 0 AS priority, 'type ' || p_type AS id FROM part UNION ALL SELECT DISTINCT {KEY('p_brand')}, 1, 'brand ' || p_brand FROM part WHERE p_brand LIKE '%2%' UNION ALL SELECT DISTINCT {KEY('p_name')}, 1, 'name ' || p_name FROM part WHERE p_name LIKE 'red%'),
idx AS (SELECT key, arg_min(id, priority || id) AS id FROM idx0 WHERE key <> '' GROUP BY key),
t AS (SELECT p_partkey, unnest(list_concat([label], list_reverse(string_split(label, ',')))) AS name, unnest(range(0, 1 + len(string_split(label, ',')))) AS place FROM (SELECT p_partkey, p_name || ', ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ', ' || p_type ELSE ', nowhere' END AS label FROM part))
SELECT p_partkey, arg_min(idx.id, place) AS id FROM t JOIN idx ON idx.key = {KEY('name')} GROUP BY p_partkey""")
def label_cascade_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = lambda c, kind: p.select(F.col(c).alias("name"), F.concat(F.lit(kind + " "), F.col(c)).alias("id")).distinct()
    index = lookup.alias_index(named("p_type", "type"), named("p_brand", "brand").where("name like '%2%'").union(named("p_name", "name").where("name like 'red%'")))
    label = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", "), F.col("p_type"))).otherwise(", nowhere"))
    return lookup.cascade(p.select("p_partkey", label.alias("label")), "p_partkey", "label", index)


@R.query(f"""WITH idx0 AS (SELECT DISTINCT {KEY('p_type')} AS key, 'type ' || p_type AS id FROM part UNION SELECT DISTINCT {KEY('p_name')}, 'name ' || p_name FROM part WHERE p_name LIKE '%g%' UNION SELECT DISTINCT {KEY("string_split(p_name, ' ')[1]")}, 'word ' || string_split(p_name, ' ')[1] FROM part),
idx AS (SELECT key, min(id) AS id FROM idx0 GROUP BY key), t AS (SELECT p_partkey, {KEY("'en ' || p_type || ', zona ' || p_name || '.'")} AS text FROM part),
m AS (SELECT p_partkey, id, row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC, instr(' ' || text || ' ', ' ' || key || ' ')) AS n FROM t JOIN idx ON contains(' ' || text || ' ', ' ' || key || ' '))
SELECT p_partkey, id FROM m WHERE n = 1""")
def containment_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = lambda c, kind: p.select(c.alias("name"), F.concat(F.lit(kind + " "), c).alias("id")).distinct()
    index = lookup.alias_index(named(F.col("p_type"), "type").union(named(F.col("p_name"), "name").where("name like '%g%'")).union(named(F.split("p_name", " ")[0], "word")))
    text = F.concat(F.lit("en "), F.col("p_type"), F.lit(", zona "), F.col("p_name"), F.lit("."))
    return lookup.contained(p.select("p_partkey", text.alias("text")), "p_partkey", "text", index)


ADDRESSES = [
    # (form by o_orderkey % 6, its parts: normal, street, number, unit, approximate, block, floor, flat)
    ("'Av. Gral. Paz 1' || (400 + o_orderkey % 500) || ' Piso ' || (o_orderkey % 9)", "'AVENIDA GENERAL PAZ 1' || (400 + o_orderkey % 500) || ' PISO ' || (o_orderkey % 9)", "'AVENIDA GENERAL PAZ'", "'1' || (400 + o_orderkey % 500)", "NULL", "false", "'AVENIDA GENERAL PAZ 1' || ((400 + o_orderkey % 500) // 100) || '00'", "CAST(o_orderkey % 9 AS VARCHAR)", "NULL"),
    ("'Calle Perú al ' || (o_orderkey % 3000) || ' ' || (o_orderkey % 12) || '° B'", "'CALLE PERU AL ' || (o_orderkey % 3000)", "'CALLE PERU'", "CAST(o_orderkey % 3000 AS VARCHAR)", "(o_orderkey % 12) || 'B'", "true", "'CALLE PERU ' || ((o_orderkey % 3000) // 100 * 100)", "CAST(o_orderkey % 12 AS VARCHAR)", "'B'"),
    ("'Pje Güemes ' || (o_orderkey % 900) || ' Departamento C'", "'PASAJE GUEMES ' || (o_orderkey % 900) || ' DEPARTAMENTO C'", "'PASAJE GUEMES'", "CAST(o_orderkey % 900 AS VARCHAR)", "NULL", "false", "'PASAJE GUEMES ' || ((o_orderkey % 900) // 100 * 100)", "NULL", "'C'"),
    ("'Soldado al ' || (o_orderkey % 2000) || ' - 7° Piso \"A\"'", "'SOLDADO AL ' || (o_orderkey % 2000) || ' - 7° PISO \"A\"'", "'SOLDADO'", "CAST(o_orderkey % 2000 AS VARCHAR)", "NULL", "true", "'SOLDADO ' || ((o_orderkey % 2000) // 100 * 100)", "'7'", "'A'"),
    ("'Ugarte ' || (o_orderkey % 2500) || ' - 9°08'", "'UGARTE ' || (o_orderkey % 2500) || ' - 9°08'", "'UGARTE'", "CAST(o_orderkey % 2500 AS VARCHAR)", "NULL", "false", "'UGARTE ' || ((o_orderkey % 2500) // 100 * 100)", "'9'", "'08'"),
    ("'Sta Fe sin numero'", "'SANTA FE SIN NUMERO'", "'SANTA FE SIN NUMERO'", "NULL", "NULL", "false", "'SANTA FE SIN NUMERO'", "NULL", "NULL"),
]


def _by_form(i: int) -> str:
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {n} THEN {f[i]}" for n, f in enumerate(ADDRESSES)) + " END"


@R.query("SELECT o_orderkey, " + ", ".join(f"{_by_form(i)} AS {c}" for i, c in enumerate(("address", "normal", "street", "number", "unit", "approximate", "block", "floor", "flat"))) + " FROM orders")
def address_normaliser(spark, sf_dir):
    """Six ways of writing an address; the SQL states what is in each instead of parsing it."""
    i, s = F.col("o_orderkey"), lambda c: c.cast("string")
    forms = [
        F.concat(F.lit("Av. Gral. Paz 1"), s(400 + i % 500), F.lit(" Piso "), s(i % 9)), F.concat(F.lit("Calle Perú al "), s(i % 3000), F.lit(" "), s(i % 12), F.lit("° B")), F.concat(F.lit("Pje Güemes "), s(i % 900), F.lit(" Departamento C")),
        F.concat(F.lit("Soldado al "), s(i % 2000), F.lit(' - 7° Piso "A"')), F.concat(F.lit("Ugarte "), s(i % 2500), F.lit(" - 9°08")), F.lit("Sta Fe sin numero"),
    ]
    address = forms[5]
    for n in range(5):
        address = F.when(i % 6 == n, forms[n]).otherwise(address)
    a = table(spark, sf_dir, "orders").select("o_orderkey", address.alias("address"))
    floor, flat = tx.floor_and_unit(F.col("address"))
    return a.select("o_orderkey", "address", *[c.alias(n) for n, c in tx.address_parts(F.col("address")).items()], tx.block_key(F.col("address")).alias("block"), floor.alias("floor"), flat.alias("flat"))


@R.query("""WITH a AS (SELECT n_nationkey, -34.60 + n_nationkey * 0.01 AS lat, -58.40 + (n_nationkey % 5) * 0.02 AS lng FROM nation), p AS (SELECT c_custkey, -34.60 + (c_custkey % 250) * 0.0012 AS lat, -58.42 + (c_custkey % 70) * 0.0019 AS lng FROM customer),
d AS (SELECT c_custkey, n_nationkey, CAST(floor(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(a.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(a.lat)) * pow(sin(radians(a.lng - p.lng) / 2), 2))))) AS BIGINT) AS metres FROM p, a)
SELECT c_custkey, n_nationkey, metres FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY metres, n_nationkey) AS n FROM d WHERE metres <= 4000) WHERE n = 1""")
def geo_nearest_area(spark, sf_dir):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    places = table(spark, sf_dir, "nation").select("n_nationkey", (-34.60 + k * 0.01).alias("lat"), (-58.40 + (k % 5) * 0.02).alias("lng"))
    points = table(spark, sf_dir, "customer").select("c_custkey", (-34.60 + (c % 250) * 0.0012).alias("lat"), (-58.42 + (c % 70) * 0.0019).alias("lng"))
    return lookup.nearest(points, "c_custkey", places, "n_nationkey", 4000)


@R.query("""SELECT n_nationkey, n_name AS id FROM nation""")
def suffix_cascade(spark, sf_dir):
    """Card labels such as `Departamento en Venta en X, Capital Federal`: the end of a part names the area."""
    n = table(spark, sf_dir, "nation")
    index = lookup.alias_index(n.select(F.col("n_name").alias("name"), F.col("n_name").alias("id")))
    label = F.concat(F.lit("Departamento en Venta en "), F.lower("n_name"), F.lit(", Capital Federal"))
    return lookup.cascade(n.select("n_nationkey", label.alias("label")), "n_nationkey", "label", index, suffixes=True)


GEO_SQL = """g AS (SELECT c_custkey AS query, o_orderkey AS result_id, CASE o_orderkey % 3 WHEN 0 THEN 'amenity' WHEN 1 THEN 'place' ELSE 'boundary' END AS class, -34.6::DOUBLE + (o_orderkey % 7) * 0.1::DOUBLE AS lat, -58.4::DOUBLE AS lng, (o_orderkey % 10) / 10 AS importance,
  CASE o_orderkey % 4 WHEN 0 THEN 'Avenida Crámer' WHEN 1 THEN 'Perú' WHEN 2 THEN NULL ELSE 'AV CRAMER' END AS road, CAST(o_orderkey % 3 AS VARCHAR) AS house_number, 'Cramer' AS street, '1' AS number FROM orders JOIN customer ON o_custkey = c_custkey)"""


def map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query"), o.alias("result_id"), F.when(o % 3 == 0, "amenity").when(o % 3 == 1, "place").otherwise("boundary").alias("class"), (-34.6 + (o % 7) * 0.1).alias("lat"), F.lit(-58.4).alias("lng"), ((o % 10) / 10).alias("importance"),
        F.when(o % 4 == 0, "Avenida Crámer").when(o % 4 == 1, "Perú").when(o % 4 == 3, "AV CRAMER").alias("road"), (o % 3).cast("string").alias("house_number"), F.lit("Cramer").alias("street"), F.lit("1").alias("number"),
    ).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query")), "query")


@R.query(f"WITH {GEO_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY importance + CASE WHEN house_number = number THEN 10 ELSE 0 END + CASE WHEN road IS NOT NULL THEN 5 ELSE 0 END DESC, result_id) AS n FROM g WHERE lat BETWEEN -35.1 AND -34.2 AND lng BETWEEN -59.1 AND -58.1 AND (road IS NULL OR contains(upper(strip_accents(road)), 'CRAMER'))) SELECT query, result_id, lat, lng FROM r WHERE n = 1")
def geocode_addresses(spark, sf_dir):
    return lookup.geocoded(map_entries(spark, sf_dir), "query", "address")


@R.query(f"WITH {GEO_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY importance DESC, result_id) AS n FROM g WHERE lat BETWEEN -35.1 AND -34.2 AND class IN ('place', 'boundary')) SELECT query, result_id, lat, lng FROM r WHERE n = 1")
def geocode_places(spark, sf_dir):
    return lookup.geocoded(map_entries(spark, sf_dir), "query", "place")


@R.query("""WITH b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders),
m AS (SELECT coalesce(o.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'keep' WHEN o.o_totalprice = b.price AND o.o_orderstatus = b.status THEN 'touch' ELSE 'update' END AS action, o.o_totalprice <> b.price AS moved FROM orders o FULL JOIN b ON o.o_orderkey = b.o_orderkey)
SELECT o_orderkey, action, action = 'insert' OR (action = 'update' AND moved) AS snapshot FROM m""")
def upsert_listing_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    i = F.col("o_orderkey")
    batch = o.select((i + F.when(i % 13 == 0, 100000000).otherwise(0)).alias("o_orderkey"), F.when(i % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(i % 5 == 0, "X").otherwise(F.col("status")).alias("status"))
    mark = lambda df: df.withColumn("hash", changes.content_hash(["price", "status"]))
    return changes.upsert(mark(o), mark(batch), ["o_orderkey"], "hash", "price")


@R.query("""WITH b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 100000000 ELSE 0 END AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderpriority END AS priority FROM orders)
SELECT coalesce(o_orderkey, k) AS listing_id, coalesce(b.price, o_totalprice) AS price, coalesce(b.priority, o_orderpriority) AS priority, CASE WHEN o_orderkey IS NULL THEN DATE '2001-11-05' ELSE DATE '2001-11-04' END AS first_seen,
CASE WHEN k IS NULL THEN DATE '2001-11-04' ELSE DATE '2001-11-05' END AS last_seen, true AS active, (o_orderkey IS NOT NULL)::INT + (k IS NOT NULL AND (o_orderkey IS NULL OR b.price <> o_totalprice))::INT AS snapshots FROM orders FULL JOIN b ON o_orderkey = k""")
def stored_two_days(spark, sf_dir):
    """Two days' batches merged into a store one after the other: the listings that it holds then, with their snapshots."""
    key = F.col("listing_id")
    one = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_totalprice").alias("price"), F.lit("USD").alias("currency"), F.col("o_orderpriority").alias("priority"))
    two = one.select((key + F.when(key % 13 == 0, 100000000).otherwise(0)).alias("listing_id"), F.when(key % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), "currency", F.when(key % 5 == 0, "X").otherwise(F.col("priority")).alias("priority"))
    held = store.Store(spark, store.own_folder(spark), parts=16)
    for batch, day in ((one, "2001-11-04"), (two, "2001-11-05")):
        store.upsert_day(held, batch, ["listing_id"], ["price", "currency", "priority"], day, [F.col("price")])
    seen = held.read("snapshots").groupBy("listing_id").agg(F.count("*").cast("int").alias("snapshots"))
    dates = [F.col(c).cast("date").alias(c) for c in ("first_seen", "last_seen")]
    return held.read("listings").join(seen, "listing_id", "left").select("listing_id", "price", "priority", *dates, "active", F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


@R.query("SELECT s.s_suppkey + CASE WHEN s.s_suppkey % 9 = 0 AND side = 1 THEN 1000000 ELSE 0 END AS s_suppkey, CASE WHEN s.s_suppkey % 9 = 0 THEN CASE WHEN side = 1 THEN 'created' ELSE 'unpublished' END WHEN s.s_suppkey % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM supplier s, (VALUES (0), (1)) v(side) WHERE side = 0 OR s.s_suppkey % 9 = 0")
def inventory_full_refresh(spark, sf_dir):
    i = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    batch = s.select((i + F.when(i % 9 == 0, 1000000).otherwise(0)).alias("s_suppkey"), "s_name", F.when(i % 4 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    mark = lambda df: df.withColumn("hash", changes.content_hash(["s_name", "s_acctbal"]))
    return changes.inventory_refresh(mark(s), mark(batch), ["s_suppkey"], "hash", full=True)


@R.query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'insert' WHEN doc_id % 11 = 0 THEN 'delete' WHEN doc_id % 5 = 0 AND upper(text) <> text THEN 'replace' ELSE 'unchanged' END AS action FROM documents")
def incremental_index_delta(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    cut = lambda df: df.select("doc_id", F.explode(tx.window_chunks(F.split("text", " "), 50, 10)).alias("chunk"))
    old, new = d.where(i % 7 != 0), d.where((i % 11 != 0) | (i % 7 == 0)).withColumn("text", F.when(i % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    return changes.index_delta(cut(old), cut(new), "doc_id", "chunk")


GATE_SQL = """WITH h AS (SELECT user_id, event_type, ts, value, event_id % 40 = 0 AS size, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
g AS (SELECT user_id, event_type, max(value) FILTER (n = 1) AS now, round(quantile_cont(value, 0.5) FILTER (n > 1), 9) AS median, max(value) FILTER (n > 1) - min(value) FILTER (n > 1) AS spread, count(*) FILTER (n > 1) AS earlier, count(DISTINCT size) AS sizes FROM h WHERE n <= 6 GROUP BY ALL),
o AS (SELECT c_custkey AS user_id, 'view' AS event_type, 40.0::DOUBLE AS objective FROM customer WHERE c_custkey % 3 = 0),
v AS (SELECT *, CASE WHEN now IS NULL THEN 'unmeasured' WHEN earlier < 3 OR sizes > 1 THEN 'none' WHEN now < median - greatest(spread, 0.02::DOUBLE) THEN 'worse' ELSE 'ok' END AS verdict, now < objective AS below FROM g FULL JOIN o USING (user_id, event_type))"""


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value", (F.col("event_id") % 40 == 0).alias("size"))
    objectives = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("event_type"), F.lit(40.0).alias("objective"))
    return ev.gate(e, ["user_id", "event_type"], "ts", "value", "size", "event_id", objectives=objectives)


@R.query(GATE_SQL + " SELECT * FROM v")
def component_gate_median(spark, sf_dir):
    return gate_verdicts(spark, sf_dir)


@R.query(GATE_SQL + ", s AS (SELECT count(*) FILTER (verdict <> 'unmeasured') AS measured, count(*) FILTER (verdict = 'worse') AS worse, count(*) FILTER (coalesce(below, false)) AS below FROM v) SELECT *, measured > 0 AND worse = 0 AND below = 0 AS passed FROM s")
def golden_set_gate(spark, sf_dir):
    return ev.golden_gate(gate_verdicts(spark, sf_dir))


@R.query("""WITH p AS (SELECT quality, (n_chars > 1000)::INT AS predicted FROM labels JOIN documents USING (doc_id)) SELECT count(*) FILTER (quality = 1 AND predicted = 1) AS tp, count(*) FILTER (quality = 0 AND predicted = 1) AS fp, count(*) FILTER (quality = 1 AND predicted = 0) AS fn, count(*) FILTER (quality = 0 AND predicted = 0) AS tn,
round(coalesce(count(*) FILTER (quality = 1 AND predicted = 1) / nullif(count(*) FILTER (quality = 1), 0), 1.0), 4) AS recall, round(coalesce(count(*) FILTER (quality = 1 AND predicted = 1) / nullif(count(*) FILTER (predicted = 1), 0), 1.0), 4) AS precision FROM p""")
def confusion_recall_precision(spark, sf_dir):
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", (F.col("n_chars") > 1000).cast("int").alias("predicted"))
    n = lambda q, k: F.count_if((F.col("quality") == q) & (F.col("predicted") == k))
    rate = lambda whole: F.round(F.coalesce(F.try_divide(n(1, 1), whole), F.lit(1.0)), 4)
    return p.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"), rate(F.count_if(F.col("quality") == 1)).alias("recall"), rate(F.count_if(F.col("predicted") == 1)).alias("precision"))


@R.query("""WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, event_type, n, ts AS made, true AS new FROM o WHERE n = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.event_type, o.n, CASE WHEN o.ts - r.made > INTERVAL 1 DAY THEN o.ts ELSE r.made END, o.ts - r.made > INTERVAL 1 DAY FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.n = r.n + 1)
SELECT event_id, user_id FROM r WHERE new""")
def idempotent_requests(spark, sf_dir):
    return changes.idempotent(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 86_400, "event_id").select("event_id", "user_id")


QUERIES, ORACLES = R.queries, R.oracles
