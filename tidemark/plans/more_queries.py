"""Evaluation, vectors, text, sessions and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import evaluation as E
from tidemark.operators import explain as XP
from tidemark.operators import modules as MO
from tidemark.operators import session as N
from tidemark.operators import text as T
from tidemark.operators import vectors as V
from tidemark.plans import params as P
from tidemark.plans.registry import query, table


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), table(spark, sf_dir, "labels")
    return d.join(l.select("doc_id", F.col("quality").alias("label")), "doc_id")


LABELLED = "d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id)), t AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM d)"
# Half-even rounding to 4 places: counts over totals are ratios, so ties are exact only where they are representable.
POINTS = f"""{LABELLED}, r AS (SELECT doc_id, row_number() OVER w AS seq, score, label, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp FROM d WINDOW w AS (ORDER BY score DESC, doc_id)),
pt AS (SELECT doc_id, seq, round_even(fp / n::DOUBLE, 4) AS fpr, round_even(tp / p::DOUBLE, 4) AS tpr FROM r, t WHERE p > 0 AND n > 0)"""


@query(f"WITH {POINTS} SELECT doc_id, seq, fpr, tpr FROM pt")
def roc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_points(labelled(spark, sf_dir), "score", "label", "doc_id").select("doc_id", "seq", "fpr", "tpr")


@query(f"""WITH {POINTS}, s AS (SELECT *, lag(fpr, 1, 0) OVER (ORDER BY seq) AS pf, lag(tpr, 1, 0) OVER (ORDER BY seq) AS pt_ FROM pt)
SELECT round(coalesce(sum((fpr - pf) * (tpr + pt_) / 2), 0.5), 6) AS auc, round(coalesce(arg_min((fpr + 1 - tpr) / 2, (round(abs(fpr - (1 - tpr)), 6), seq)), 0.5), 6) AS eer FROM s""")
def auc_eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.auc_eer(E.roc_points(labelled(spark, sf_dir), "score", "label", "doc_id"))
    return out.select(F.round("auc", 6).alias("auc"), F.round("eer", 6).alias("eer"))


@query("SELECT 0.5::DOUBLE AS auc, 0.5::DOUBLE AS eer")
def single_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).filter("label = 1")
    return E.auc_eer(E.roc_points(rows, "score", "label", "doc_id"))


@query(f"""WITH {LABELLED}, g AS (SELECT score, sum(label) AS pos, count(*) AS a FROM d GROUP BY 1)
SELECT row_number() OVER w AS seq, score, round(sum(a - pos) OVER w / n::DOUBLE + 1e-9, 6) AS fpr, round(sum(pos) OVER w / p::DOUBLE + 1e-9, 6) AS tpr FROM g, t WINDOW w AS (ORDER BY score DESC)""")
def roc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return E.roc_by_score(labelled(spark, sf_dir), "score", "label").select("seq", "score", near("fpr"), near("tpr"))


@query(f"WITH {LABELLED} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM d a, d b WHERE a.label = 1 AND b.label = 0")
def u_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rank_auc(labelled(spark, sf_dir), "score", "label").select(F.round("auc", 6).alias("auc"))


@query(f"""WITH {LABELLED}, b AS (SELECT least(floor(least(score / 4000, 1) * 10), 9) AS bin, least(score / 4000, 1) AS p, label FROM d)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(label), 6) AS rate, round(abs(avg(p) - avg(label)) * count(*) / sum(count(*)) OVER (), 6) AS error FROM b GROUP BY bin""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("p", F.least(F.col("score") / 4000, F.lit(1.0)))
    out = E.calibration_error(rows, "p", "label")
    return out.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("rate", 6).alias("rate"), F.round("error", 6).alias("error"))


@query(f"""WITH {LABELLED}, c AS (SELECT quantile_cont(score, 0.95) AS cut FROM d WHERE label = 0) SELECT round(any_value(cut), 6) AS cut, round(avg(CASE WHEN score <= cut THEN 1.0 ELSE 0.0 END), 6) AS accepted FROM d, c WHERE label = 1""")
def attack_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.acceptance_at(labelled(spark, sf_dir), "score", "label", 0.05).select(F.round("cut", 6).alias("cut"), F.round("accepted", 6).alias("accepted"))


@query("""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, o_custkey, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS fold FROM orders JOIN g USING (o_custkey)""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.group_split(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "fold")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    out = rows.groupBy("event_type").agg(F.avg("value").alias("mean")).join(E.group_quantiles(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95}), "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")])


REPLICATES = 32
BOOTSTRAP = f"""{LABELLED}, h AS (SELECT d.score, d.label, r, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(r // {E.DRAWS} AS VARCHAR)), CAST(r % {E.DRAWS} * 4 + 1 AS INTEGER), 4) AS INTEGER) AS u FROM d, range({REPLICATES}) AS q(r)),
w AS (SELECT score, label, r, {" + ".join(f"(u >= {b})::INTEGER" for b in E.poisson_bounds())} AS w FROM h),
g AS (SELECT r, score, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM w GROUP BY 1, 2),
k AS (SELECT r, p, n, sum(n) OVER (PARTITION BY r ORDER BY score) AS below FROM g),
a AS (SELECT CAST(r AS INTEGER) AS replicate, sum(p * (below - n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM k GROUP BY 1)"""


@query(f"WITH {BOOTSTRAP} SELECT replicate, round(auc, 9) AS auc FROM a")
def bootstrap_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap_auc(labelled(spark, sf_dir), "doc_id", "score", "label", REPLICATES).select("replicate", F.round("auc", 9).alias("auc"))


@query(f"WITH {BOOTSTRAP} SELECT round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.5), 9) AS middle, round(quantile_cont(auc, 0.975), 9) AS high FROM a")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.interval(E.bootstrap_auc(labelled(spark, sf_dir), "doc_id", "score", "label", REPLICATES), "auc")
    return found.select(*[F.round(c, 9).alias(c) for c in ("low", "middle", "high")])


PAIRS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT label, vec_id, list_cosine_similarity(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM v QUALIFY lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) IS NOT NULL)"


@query(f"WITH {PAIRS} SELECT label, vec_id, round(s, 6) AS similarity FROM c")
def consecutive_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similarities(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {PAIRS} SELECT label, round(min(s), 6) AS least, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS spread, count(*) FILTER (s < 0.65) AS jumps, min(s) < 0.6 OR stddev_pop(s) > 0.15 OR count(*) FILTER (s < 0.65) >= 2 AS flickers,
round(least(0.6 * greatest(0, 1 - min(s)), 1), 6) AS score FROM c GROUP BY 1""")
def identity_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.flicker(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("least", "mean", "spread")], "jumps", "flickers", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT label AS series, vec_id AS frame, unnest(range(32)) AS point, embedding FROM embeddings), q AS (SELECT series, frame, point, embedding[2 * point + 1]::DOUBLE AS x, embedding[2 * point + 2]::DOUBLE AS y FROM p),
m AS (SELECT series, lead(x) OVER w - 2 * x + lag(x) OVER w AS dx, lead(y) OVER w - 2 * y + lag(y) OVER w AS dy FROM q WINDOW w AS (PARTITION BY series, point ORDER BY frame))
SELECT series, round(avg(sqrt(dx * dx + dy * dy)), 6) AS jitter, avg(sqrt(dx * dx + dy * dy)) > 0.08 AS jitters FROM m WHERE dx IS NOT NULL GROUP BY 1""")
def landmark_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("series"), F.col("vec_id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("point"), "embedding")
    at = lambda k: F.get("embedding", 2 * F.col("point") + k).cast("double")
    out = V.jitter(e.select("series", "frame", "point", at(0).alias("x"), at(1).alias("y")), "series", "frame")
    return out.select("series", F.round("jitter", 6).alias("jitter"), "jitters")


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) AS i, embedding FROM embeddings), x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM v)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.x, b.x), 9) AS covariance FROM x a JOIN x b USING (vec_id) WHERE a.i >= b.i GROUP BY 1, 2""")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covariance_whole(spark, sf_dir).select("i", "j", F.round("covariance", 9).alias("covariance"))


@query()
def novelty_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.novelty(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def covariance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrounded; the width is found in the data."""
    cov = V.moments(table(spark, sf_dir, "embeddings"), "embedding")[1]
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i + 1)], "i int, j int, covariance double")


@query("""WITH x AS (SELECT label, embedding, 4 * embedding[1]::DOUBLE AS l FROM embeddings), w AS (SELECT label, exp(l - max(l) OVER (PARTITION BY label)) AS w, embedding FROM x),
y AS (SELECT label, w, unnest(range(64)) AS dim, embedding FROM w), z AS (SELECT label, w, dim, embedding[dim + 1]::DOUBLE AS x FROM y)
SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / sum(w), 6) AS mean, round(sqrt(greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)), 0) + 1e-6), 6) AS deviation FROM z GROUP BY 1, 2""")
def attention_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = V.attention_pool(e, "label", "embedding", 4 * F.get("embedding", F.lit(0)))
    return out.select("label", "dim", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


KEYWORDS = "[" + ", ".join(f"'{k}'" for k in ["theble", "erth", "onsh", "the"]) + "]"


@query(f"SELECT page_id, list_filter({KEYWORDS}, lambda k: contains(lower(trim(url)), k))[1] AS keyword FROM pages")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.first_keyword(F.col("url"), ["theble", "erth", "onsh", "the"]).alias("keyword"))


@query("SELECT source, list_filter([" + ", ".join(f"'{k}'" for k in P.CAMERA_KEYWORDS) + "], lambda k: contains(lower(trim(source)), k))[1] AS keyword, 0.0::DOUBLE AS risk FROM documents GROUP BY 1, 2")
def virtual_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.first_keyword(F.col("source"), P.CAMERA_KEYWORDS)
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", found.alias("keyword"), F.when(found.isNotNull(), 0.85).otherwise(0.0).alias("risk"))


HEARD = "c AS (SELECT conv_id, turn, [w for w in regexp_split_to_array(trim(text), '\\s+') if w <> ''] AS w FROM conversations), p AS (SELECT row_number() OVER () AS k, a.conv_id, a.turn, a.w AS a, b.w AS b FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


#: Edit distances row by row, for the pairs of turns that HEARD numbers.
EDITS = f"""WITH RECURSIVE {HEARD},
r(k, i, j, v) AS (SELECT k, 0, CAST(unnest(range(len(b) + 1)) AS INTEGER), CAST(unnest(range(len(b) + 1)) AS INTEGER) FROM p
  UNION ALL SELECT k, i + 1, j, CAST(j + min(t - j) OVER (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING) AS INTEGER) FROM (
    SELECT r.k, r.i, r.j, CASE WHEN r.j = 0 THEN r.i + 1 ELSE least(r.v + 1, lag(r.v) OVER (PARTITION BY r.k ORDER BY r.j) + CASE WHEN lower(p.a[r.i + 1]) = lower(p.b[r.j]) THEN 0 ELSE 1 END) END AS t
    FROM r JOIN p ON p.k = r.k WHERE r.i < len(p.a)))"""


@query(f"""{EDITS}
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 0.0 ELSE 1.0 END ELSE v / len(a)::DOUBLE END, 6) AS wer FROM p JOIN r ON r.k = p.k AND r.i = len(a) AND r.j = len(b)""")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.words(F.col("text")).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("heard"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(C.word_error_rate(F.col("w"), F.col("heard")), 6).alias("wer"))


@query()
def word_error_rate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its older name."""
    return word_error_rate(spark, sf_dir)


@query(f"""{EDITS}, m AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0 ELSE v / len(a)::DOUBLE END AS wer FROM p JOIN r ON r.k = p.k AND r.i = len(a) AND r.j = len(b))
SELECT conv_id, turn, round(wer, 6) AS wer, wer <= {P.PHRASE_WER_HIGH} AS matched, wer > {P.PHRASE_WER_HIGH} AS flagged FROM m""")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("heard"))
    found = c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", T.phrase_match(F.col("text"), F.col("heard"), F.lit(True)).alias("m"))
    return found.select("conv_id", "turn", F.round("m.wer", 6).alias("wer"), "m.matched", "m.flagged")


@query("""WITH h AS (SELECT p_partkey, '#' || printf('%02x%02x%02x', p_partkey * 37 % 256, p_partkey * 91 % 256, p_size * 5 % 256) AS colour, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_size * 5 % 256 AS b FROM part)
SELECT p_partkey, colour, round(r / (r + g + b + 1e-6)::DOUBLE, 6) AS cr, round(g / (r + g + b + 1e-6)::DOUBLE, 6) AS cg, round((0.299 * r + 0.587 * g + 0.114 * b)::DOUBLE, 6) AS luma FROM h""")
def hex_chromaticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.lower(F.lpad(F.hex(c % 256), 2, "0"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), byte(F.col("p_partkey") * 37), byte(F.col("p_partkey") * 91), byte(F.col("p_size").cast("long") * 5)).alias("colour"))
    h = p.withColumn("h", C.hex_chromaticity(F.col("colour")))
    return h.select("p_partkey", "colour", *[F.round(f"h.{c}", 6).alias(c) for c in ("cr", "cg", "luma")])


@query("SELECT conv_id, turn, CAST(len([w for w in regexp_split_to_array(trim(text), '\\s+') if upper(w[1]) IN ('B', 'P', 'M')]) AS BIGINT) AS n FROM conversations")
def bilabial_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.bilabial_count(F.col("text")).alias("n"))


@query("SELECT p_partkey, regexp_extract(s, '_(fake|real)$', 1) AS label, s AS stem FROM (SELECT p_partkey, 'clip_' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || CASE p_partkey % 3 WHEN 0 THEN '_fake' WHEN 1 THEN '_real' ELSE '' END AS s FROM part)")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "_fake").when(F.col("p_partkey") % 3 == 1, "_real").otherwise("")
    path = F.concat(F.lit("/data/set/clip_"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), kind, F.lit(".npy"))
    return table(spark, sf_dir, "part").select("p_partkey", C.label_of_path(path).alias("l")).select("p_partkey", "l.label", "l.stem")


@query("""SELECT page_id, CASE WHEN octet_length(encode(html)) <= 3000 THEN 'accepted' ELSE 'too large' END AS verdict FROM pages""")
def upload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources import io as S

    return S.guarded(table(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("content")), "content", 3000).select("page_id", "verdict")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'view' THEN 'consented' WHEN event_type = 'click' THEN 'bypassed' ELSE 'rejected' END AS consent, event_type <> 'signup' OR octet_length(encode(props)) <= 9 AS fits FROM events")
def message_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources import io as S

    e = table(spark, sf_dir, "events")
    k = S.sidecar(F.col("props"), "struct<k:bigint>")["k"]
    consent = N.consent_state(F.col("event_type") == "view", F.col("event_type") == "click", F.lit(False), F.lit("production"))
    return e.select("event_id", k.alias("k"), consent.alias("consent"), ((F.col("event_type") != "signup") | (F.octet_length("props") <= 9)).alias("fits"))


@query("""WITH s AS (SELECT user_id, min(ts) AS start FROM events GROUP BY 1)
SELECT e.user_id, count(*) AS n FROM events e JOIN s USING (user_id) WHERE e.ts < s.start + INTERVAL 6 DAY GROUP BY 1""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user's first six days; who is admitted at a time is concurrent_admission."""
    e = table(spark, sf_dir, "events")
    first = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("start", F.min("ts").over(first))
    return rows.filter(F.col("ts") < F.col("start") + F.expr("INTERVAL 6 DAYS")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) + 86400.0 * 365 >= epoch(TIMESTAMP '1998-01-01 00:00:00')")
def unexpired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("created_at", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return N.unexpired(o, "created_at", 365 * 86400, F.lit(883612800)).select("o_orderkey")


@query("SELECT doc_id, lower(hex(sha256(text)))::VARCHAR AS digest FROM documents WHERE false UNION ALL SELECT doc_id, sha256(text) FROM documents")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


SECRET, LIGHT_STEPS = "test secret", 7
PADS = [p.hex() for p in N.hmac_pads(SECRET)]
BYTE = "CAST('0x' || substr(h, {at}, 2) AS INTEGER)"
PALETTE = "[" + ", ".join(f"'{c}'" for c in N.COLOURS) + "]"
LIGHT_STEP = f"CASE WHEN {PALETTE}[{{b}} % {len(N.COLOURS)} + 1] = c{{before}} THEN {PALETTE}[({{b}} + 1) % {len(N.COLOURS)} + 1] ELSE {PALETTE}[{{b}} % {len(N.COLOURS)} + 1] END"
#: A table a step: the colour of its byte, or the one after it where that was the last.
LIGHT_SQL = ", ".join([
    f"WITH s0 AS (SELECT c_custkey, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(c_name)))) AS h, '{N.WHITE}' AS c0 FROM customer)",
    *[f"s{i} AS (SELECT *, {LIGHT_STEP.format(b=BYTE.format(at=2 * i + 1), before=i - 1)} AS c{i} FROM s{i - 1})" for i in range(1, LIGHT_STEPS)],
]) + f" SELECT c_custkey, concat_ws(',', {', '.join(f'c{i}' for i in range(LIGHT_STEPS))}) AS sequence FROM s{LIGHT_STEPS - 1}"


@query(LIGHT_SQL)
def light_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.light_sequences(table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_name").alias("nonce")), "nonce", SECRET, LIGHT_STEPS)
    return rows.select("c_custkey", F.array_join(F.transform("sequence", lambda s: s["color"]), ",").alias("sequence"))


@query()
def challenge_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.phrase(F.col("c_custkey")).alias("phrase"))


LIPS = {s: P.TITLES["lips", "", s].replace("'", "''") for s in ("high", "medium")}


@query(f"""WITH e AS (SELECT event_id, value / 500 AS lips, event_id % 30 / 10.0::DOUBLE AS conf, event_id % 7 * 50.0::DOUBLE AS off, event_type <> 'error' AS ok FROM events),
g AS (SELECT event_id, CASE WHEN ok AND (lips >= 0.35 OR (conf >= {P.SYNC_CONF_LEAST} AND off >= 200)) THEN 'high' WHEN ok AND (lips >= 0.18 OR (conf >= {P.SYNC_CONF_LEAST} AND off >= 120)) THEN 'medium' END AS severity FROM e)
SELECT event_id, severity, CASE severity WHEN 'high' THEN '{LIPS["high"]}' ELSE '{LIPS["medium"]}' END AS title FROM g WHERE severity IS NOT NULL""")
def speech_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speech module's findings over windows made of events: lip error by value, sync and offset by id; errors are skipped windows."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "skipped").otherwise("ok")
    found = MO.speech_findings(status, F.col("value") / 500, F.col("event_id") % 30 / 10.0, F.col("event_id") % 7 * 50.0, F.lit(0.0))
    return e.select("event_id", F.explode(found).alias("f")).select("event_id", "f.severity", "f.title")


@query("""WITH c AS (SELECT conv_id, turn, CAST((conv_id * 7 + turn * 13) % 101 AS INTEGER) AS percent, text || CASE WHEN turn % 2 = 0 THEN ' ' || CAST((conv_id * 7 + turn * 13) % 101 AS VARCHAR) || '%' ELSE '' END AS rewritten FROM conversations)
SELECT conv_id, turn, percent, length(rewritten) BETWEEN 20 AND 500 AND contains(rewritten, CAST(percent AS VARCHAR) || '%') AS acceptable FROM c""")
def acceptable_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns might stand as a summary's rewriting: every other one names the risk."""
    percent = ((F.col("conv_id") * 7 + F.col("turn") * 13) % 101).cast("int")
    c = table(spark, sf_dir, "conversations").withColumn("percent", percent)
    c = c.withColumn("rewritten", F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.col("percent").cast("string"), F.lit("%"))).otherwise("")))
    return c.select("conv_id", "turn", "percent", XP.acceptable(F.col("rewritten"), F.col("percent")).alias("acceptable"))
