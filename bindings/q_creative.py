"""Copy, picture and creative-association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.q_funnel import big
from bindings.q_stats import AUC_CI, WEIGHTED_AUC
from bindings.q_triage import FOLDS
from bindings.registry import query
from bindings.sql_boosting import first_tree
from bindings.sql_draws import key_text, poisson_ctes
from bindings.sql_newton import newton_ctes, newton_score
from bindings.sql_tails import rho_p, step_up
from spendlens.functions import images as im
from spendlens.functions import text as tx
from spendlens.operators import creative
from spendlens.session import scratch_path
from spendlens.sinks.pictures import write_files, write_pictures
from spendlens.sources.creatives import read_thumbnails

CONST = {
    "urgency": "|".join(tx.URGENCY_TERMS),
    "price": rf"\d+\s*({tx.CURRENCY_WORDS})",
    "date": rf"\b\d{{1,2}}\s*({tx.MONTH_NAMES})\b",
    "emoji": tx.EMOJI_CLASS,
}


def count(pattern, of="raw"):
    return f"CAST(len(regexp_extract_all({of}, '{pattern}')) AS BIGINT)"


def chars(c):
    return f"CAST(length(raw) - length(replace(raw, '{c}', '')) AS BIGINT)"


TEXT_SQL = {
    "n_chars": "CAST(length(raw) AS BIGINT)",
    "n_words": count(r"\S+"),
    "n_lines": f"CASE WHEN raw = '' THEN 0 ELSE {count(chr(92) + 'n')} + 1 END",
    "n_emoji": count(CONST["emoji"]),
    "n_hashtags": chars("#"),
    "n_mentions": chars("@"),
    "n_exclaim": chars("!"),
    "n_question": chars("?"),
    "caps_ratio": f"coalesce({count(chr(92) + 'p{Lu}')} / nullif({count(chr(92) + 'p{L}')}, 0), 0)",
    "has_urgency": f"CAST(regexp_matches(flat, '{CONST['urgency']}') AS BIGINT)",
    "has_price": f"CAST(regexp_matches(flat, '{CONST['price']}') AS BIGINT)",
    "has_date": f"CAST(regexp_matches(flat, '{CONST['date']}') AS BIGINT)",
}
# every document, plus decorated copies that carry each feature
BODIES = """bodies AS (SELECT doc_id, text AS body FROM documents UNION ALL
    SELECT -1 - doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE
    text || ' Dernières places! #tag @ami 200 DH le 12 août ? 🎉✨' END FROM documents)"""
FLAT = "raws AS (SELECT doc_id, coalesce(body, '') AS raw, strip_accents(lower(coalesce(body, ''))) AS flat FROM bodies)"


def bodies(spark, d):
    docs = tb.load(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    k = F.col("doc_id") % 10
    extra = F.concat("body", F.lit(" Dernières places! #tag @ami 200 DH le 12 août ? 🎉✨"))
    decorated = docs.select(
        (F.lit(-1) - F.col("doc_id")).alias("doc_id"),
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").otherwise(extra).alias("body"),
    )
    return docs.unionByName(decorated)


def _register_text(key, names):
    cols = ", ".join(f"{TEXT_SQL[n]} AS {n}" for n in names)

    @query(key, f"WITH {BODIES}, {FLAT} SELECT doc_id, {cols} FROM raws", dp={"caps_ratio": 9} if "caps_ratio" in names else {})
    def run(spark, d):
        return tx.with_text_features(bodies(spark, d)).select("doc_id", *names)


for i, group in enumerate(
    [["n_chars"], ["n_words"], ["n_lines"], ["n_emoji"], ["n_hashtags", "n_mentions", "n_exclaim", "n_question"],
     ["caps_ratio"], ["has_urgency"], ["has_price"], ["has_date"]]
):
    number = i + 1 if i < 5 else i + 4
    suffix = "symbol_counts" if len(group) > 1 else group[0]
    _register_text(f"txt{number}_{suffix}", group)


@query("txt13_without_accents", f"WITH {BODIES}, {FLAT} SELECT doc_id, md5(flat) AS digest FROM raws")
def txt13(spark, d):
    flat = tx.without_accents(F.coalesce("body", F.lit("")))
    return bodies(spark, d).select("doc_id", F.md5(flat).alias("digest"))


# --- pictures -----------------------------------------------------------------

PIXELS = """px AS (SELECT CAST(vec_id AS VARCHAR) AS ad_id, i, i % 11 AS x, i // 11 AS y,
    least(255, greatest(0, floor((CAST(embedding[(i * 3 + 2) % 64 + 1] AS DOUBLE) + 0.55) * 255))) / 255 AS r,
    least(255, greatest(0, floor((CAST(embedding[(i * 3 + 1) % 64 + 1] AS DOUBLE) + 0.55) * 255))) / 255 AS g,
    least(255, greatest(0, floor((CAST(embedding[(i * 3) % 64 + 1] AS DOUBLE) + 0.55) * 255))) / 255 AS b
    FROM embeddings, (SELECT unnest(generate_series(0, 21)) AS i) s),
lum AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
nb AS (SELECT *, lag(l) OVER h AS lf, lead(l) OVER h AS rt, lag(l) OVER v AS up, lead(l) OVER v AS dn FROM lum
    WINDOW h AS (PARTITION BY ad_id, y ORDER BY x), v AS (PARTITION BY ad_id, x ORDER BY y)),
grad AS (SELECT *, CASE WHEN lf IS NULL THEN rt - l WHEN rt IS NULL THEN l - lf ELSE (rt - lf) / 2 END AS gx,
    CASE WHEN up IS NULL THEN dn - l WHEN dn IS NULL THEN l - up ELSE (dn - up) / 2 END AS gy FROM nb),
feats AS (SELECT ad_id, CAST(11 AS DOUBLE) / 2 AS aspect_ratio, avg(l) AS brightness,
    avg(CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END) AS saturation, stddev_pop(l) AS contrast,
    sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(power(avg(r - g), 2) + power(avg(0.5 * (r + g) - b), 2)) AS colorfulness,
    avg(sqrt(gx * gx + gy * gy)) AS edge_density, avg(CASE WHEN l < 0.25 THEN 1.0 ELSE 0.0 END) AS dark_ratio FROM grad GROUP BY 1)"""


def picture_features(spark, d):
    return im.image_features(tb.pictures(spark, d))


IMG_DP = {f: 6 for f in im.IMAGE_FEATURES}


@query("img1_7_image_features", f"WITH {PIXELS} SELECT * FROM feats", dp=IMG_DP)
def img(spark, d):
    return picture_features(spark, d)


#: Squares of three by three leave 6 or 4 of the 22 pixels to a square; twelfths of a byte are whole for both.
TWELFTHS = {c: f"12 * CAST(sum(CAST(round({c} * 255) AS BIGINT)) AS BIGINT) // count(*) AS {c}" for c in "rgb"}
LUMA_PARTS = [round(w * 10_000) for w in im.LUMA]


@query(
    "img8_block_downscale",
    f"""WITH {PIXELS} SELECT ad_id, CAST(4 AS BIGINT) AS w, CAST(1 AS BIGINT) AS h,
    CAST(sum({" + ".join(f"{w} * {c}" for w, c in zip(LUMA_PARTS, "rgb"))}) AS DOUBLE) / (count(*) * {12 * 255 * 10_000}) AS brightness FROM (
    SELECT ad_id, x // 3 AS sx, y // 3 AS sy, {", ".join(TWELFTHS.values())} FROM px GROUP BY ad_id, x // 3, y // 3) b GROUP BY 1""",
    dp={"brightness": 6},
)
def img8(spark, d):
    """Eleven columns against a limit of four: squares of three by three are averaged, in whole numbers up to the one division."""
    small = im.decoded(tb.pictures(spark, d), max_side=4)
    whole = lambda c, w: F.transform(c, lambda v: F.round(v * (12 * 255)).cast("bigint") * F.lit(w))
    total = sum((F.aggregate(whole(c, w), F.lit(0).cast("bigint"), lambda a, v: a + v) for c, w in zip("rgb", LUMA_PARTS)), F.lit(0))
    return small.select("ad_id", "w", "h", (total / (F.size("r") * (12 * 255 * 10_000))).alias("brightness"))


@query(
    "src5_picture_pixels",
    f"WITH {PIXELS} SELECT ad_id, CAST(11 AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM px GROUP BY 1",
    dp={"r": 6, "g": 6, "b": 6},
)
def src5(spark, d):
    """All pictures as PNG files, read back by the image source; a file that is no picture gives no row."""
    folder = scratch_path(spark, "pictures").removeprefix("file://").removeprefix("file:")
    write_pictures(tb.pictures(spark, d), folder)
    broken = spark.range(1).select(F.lit("broken").alias("ad_id"), F.encode(F.lit("no picture"), "utf-8").alias("content"))
    write_files(broken, folder)
    frames = im.decoded(read_thumbnails(spark, folder))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(c)
    return frames.select("ad_id", "width", "height", total("r"), total("g"), total("b"))


# --- dataset and associations -------------------------------------------------

DATASET = f"""perf AS (SELECT ad_id, min(campaign_id) AS campaign_id, min(ad_name) AS ad_name, sum(spend) AS spend,
    sum(clicks) / sum(impressions) * 100 AS ctr, coalesce(sum(initiate_checkout), 0) / sum(spend) AS icr
    FROM ads_daily WHERE spend > 0 GROUP BY 1 HAVING sum(spend) >= 20),
raws AS (SELECT ad_id AS doc_id, coalesce(body, '') AS raw, strip_accents(lower(coalesce(body, ''))) AS flat FROM creatives),
txt AS (SELECT doc_id, {", ".join(f"{e} AS {n}" for n, e in TEXT_SQL.items())} FROM raws),
{PIXELS},
data AS (SELECT perf.*, object_type, cta, txt.* EXCLUDE (doc_id), feats.* EXCLUDE (ad_id),
    CASE WHEN object_type = 'VIDEO' THEN 1 ELSE 0 END AS is_video, CASE WHEN lower(perf.ad_name) LIKE '%reel%' THEN 1 ELSE 0 END AS is_reel
    FROM perf JOIN creatives c ON c.ad_id = perf.ad_id JOIN txt ON txt.doc_id = c.ad_id LEFT JOIN feats ON feats.ad_id = c.ad_id)"""


def sql(body, extra=""):
    return tb.with_tables(["ads_daily", "creatives"], body, DATASET + (", " + extra if extra else ""))


def data(spark, d):
    return creative.dataset(tb.ads_daily(spark, d), tb.creatives(spark, d), picture_features(spark, d))


FLAGS = ("is_video", "is_reel")
INT_COLS = [f for f in creative.ALL_FEATURES if f != "caps_ratio" and f not in im.IMAGE_FEATURES]


@query(
    "cre1_creative_dataset",
    sql("SELECT ad_id, campaign_id, spend, ctr, icr, object_type, cta, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in INT_COLS)
        + ", caps_ratio, " + ", ".join(im.IMAGE_FEATURES) + " FROM data"),
    dp={"spend": 2, "ctr": 9, "icr": 12, "caps_ratio": 9, **IMG_DP},
)
def cre1(spark, d):
    return data(spark, d).select("ad_id", "campaign_id", "spend", "ctr", "icr", "object_type", "cta", *creative.ALL_FEATURES)


@query("cre1_dataset_status", sql(f"SELECT {big('count(*)')} AS n_ads, 'ok' AS status FROM data"))
def cre1_status(spark, d):
    return creative.dataset_status(data(spark, d))


@query("jn2_performance_creatives", sql("SELECT perf.ad_id, icr, object_type, cta, CAST(length(body) AS BIGINT) AS n FROM perf JOIN creatives c ON c.ad_id = perf.ad_id"), dp={"icr": 12})
def jn2(spark, d):
    joined = creative.with_creative(creative.lifetime_performance(tb.ads_daily(spark, d)), tb.creatives(spark, d))
    return joined.select("ad_id", "icr", "object_type", "cta", F.length("body").alias("n"))


@query("jn7_picture_match", sql("SELECT ad_id, brightness, edge_density FROM data"), dp={"brightness": 6, "edge_density": 6})
def jn7(spark, d):
    return data(spark, d).select("ad_id", "brightness", "edge_density")


def rank_of(x, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2"


LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT campaign_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, CAST({{t}} AS DOUBLE) AS y FROM data" for f in creative.ALL_FEATURES
) + ")"
ASSOC = LONG + """,
big AS (SELECT campaign_id FROM data GROUP BY 1 HAVING count(*) >= 2),
cent AS (SELECT feature, x - avg(x) OVER (PARTITION BY feature, campaign_id) AS x, y - avg(y) OVER (PARTITION BY feature, campaign_id) AS y
    FROM long WHERE campaign_id IN (SELECT campaign_id FROM big)),
rr AS (SELECT feature, x, """ + rank_of("x", "feature") + " AS rx, " + rank_of("y", "feature") + """ AS ry FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
rw AS (SELECT feature, x, """ + rank_of("x", "feature") + " AS rx, " + rank_of("y", "feature") + """ AS ry FROM cent WHERE x IS NOT NULL AND y IS NOT NULL),
raw_rho AS (SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM rr GROUP BY 1 HAVING count(*) >= 20 AND stddev_pop(x) > 0),
in_rho AS (SELECT feature, count(*) AS n_within, corr(rx, ry) AS rho_within FROM rw GROUP BY 1 HAVING count(*) >= 20 AND stddev_pop(x) > 0),
assoc AS (SELECT r.feature, CAST(n AS BIGINT) AS n, rho, rho_within FROM raw_rho r LEFT JOIN in_rho i ON i.feature = r.feature)"""


def assoc_sql(target, body):
    return sql(body, ASSOC.replace("{t}", target))


@query("cre2_associations_ctr", assoc_sql("ctr", "SELECT * FROM assoc"), dp={"rho": 6, "rho_within": 6})
def cre2_ctr(spark, d):
    return creative.associations(data(spark, d), "ctr").select("feature", "n", "rho", "rho_within")


@query("cre2_associations_icr", assoc_sql("icr", "SELECT * FROM assoc"), dp={"rho": 6, "rho_within": 6})
def cre2_icr(spark, d):
    return creative.associations(data(spark, d), "icr").select("feature", "n", "rho", "rho_within")


FULL = f"""tested AS (SELECT r.feature, CAST(n AS BIGINT) AS n, rho, {rho_p('rho', 'n')} AS p_value, rho_within,
    {rho_p('rho_within', 'n_within')} AS p_within FROM raw_rho r LEFT JOIN in_rho i ON i.feature = r.feature),
one AS (SELECT * EXCLUDE (s, q), q AS q_value FROM {step_up('p_value', 'tested')} b),
two AS (SELECT * EXCLUDE (s, q), q AS q_within FROM {step_up('p_within', 'one')} b),
full_ AS (SELECT feature, n, rho, p_value, rho_within, p_within, q_value, coalesce(q_value < 0.05, false) AS significant, q_within,
    coalesce(q_within < 0.05 AND sign(rho_within) = sign(rho), false) AS holds_within FROM two)"""
FULL_DP = {"rho": 6, "rho_within": 6, "p_value": 6, "p_within": 6, "q_value": 6, "q_within": 6}


def full(target):
    return f"(WITH {ASSOC.replace('{t}', target)}, {FULL} SELECT * FROM full_)"


def pair_sql(body, one="ctr", two="icr"):
    """``a`` and ``b``: the associations with two targets, feature by feature."""
    joined = """j AS (SELECT a.feature, a.rho_within AS ctr_effect, a.holds_within AS ctr_robust, b.rho_within AS icr_effect,
    b.holds_within AS icr_robust FROM a JOIN b ON b.feature = a.feature)"""
    return tb.with_tables(["ads_daily", "creatives"], body, f"{DATASET}, a AS {full(one)}, b AS {full(two)}, {joined}")


@query("cre2_associations_full", sql(f"SELECT * FROM {full('ctr')} f"), dp=FULL_DP)
def cre2_full(spark, d):
    return creative.associations(data(spark, d), "ctr")


@query("top4_strongest_features", assoc_sql("ctr", "SELECT feature, rho FROM assoc ORDER BY abs(rho) DESC, feature LIMIT 10"), dp={"rho": 6})
def top4(spark, d):
    return creative.strongest(creative.associations(data(spark, d), "ctr")).select("feature", "rho")


@query(
    "top5_best_worst_ads",
    sql("""(SELECT ad_id, ad_name, ctr, 'best' AS part FROM data ORDER BY ctr DESC, ad_id LIMIT 5) UNION ALL
    (SELECT ad_id, ad_name, ctr, 'worst' FROM data ORDER BY ctr, ad_id LIMIT 5)"""),
    dp={"ctr": 9},
)
def top5(spark, d):
    return creative.best_and_worst(data(spark, d), "ctr")


def both(spark, d):
    frame = data(spark, d)
    return creative.associations(frame, "ctr"), creative.associations(frame, "icr")


@query(
    "jn8_two_targets",
    tb.with_tables(["ads_daily", "creatives"], "SELECT a.feature, a.rho_within AS ctr_effect, b.rho_within AS icr_effect FROM a JOIN b ON b.feature = a.feature",
        f"""{DATASET}, a AS (WITH {ASSOC.replace('{t}', 'ctr')} SELECT * FROM assoc), b AS (WITH {ASSOC.replace('{t}', 'icr')} SELECT * FROM assoc)"""),
    dp={"ctr_effect": 6, "icr_effect": 6},
)
def jn8(spark, d):
    return creative.both_targets(*both(spark, d)).select("feature", "ctr_effect", "icr_effect")


@query("jn8_robust_on_either", pair_sql("SELECT * FROM j WHERE ctr_robust OR icr_robust", two="n_words"), dp={"ctr_effect": 6, "icr_effect": 6})
def jn8_robust(spark, d):
    """The second target is the number of words, with which several features do hold."""
    frame = data(spark, d)
    return creative.robust_on_either(creative.associations(frame, "ctr"), creative.associations(frame, "n_words"))


LABELS = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in creative.PUBLISHED_FEATURES.items())


@query(
    "cre6_inversion_table",
    pair_sql(f"""SELECT label AS "Caractéristique", round(ctr_effect, 3) AS "Effet sur le CTR", round(icr_effect, 3) AS "Effet sur la conversion",
    CASE WHEN ctr_robust THEN 'oui' ELSE '' END AS "Robuste (CTR)", CASE WHEN icr_robust THEN 'oui' ELSE '' END AS "Robuste (conv.)"
    FROM j JOIN (VALUES {LABELS}) l(feature, label) ON l.feature = j.feature"""),
)
def cre6(spark, d):
    return creative.inversion_table(*both(spark, d))


@query(
    "cre7_association_counts",
    sql(f"SELECT {big('count(*)')} AS n_features, {big('count(*) FILTER (significant)')} AS n_significant, {big('count(*) FILTER (holds_within)')} AS n_holding_within FROM {full('icr')} f"),
)
def cre7(spark, d):
    return creative.association_counts(creative.associations(data(spark, d), "icr"))


#: Features known for too few ads are zero throughout, and so take no part in a fit.
USED = ", ".join(f"CASE WHEN (SELECT count({f}) > count(*) * 0.8 FROM data) THEN {f} ELSE 0 END AS {f}" for f in creative.ALL_FEATURES)
N_USED = " + ".join(f"(SELECT CAST(count({f}) > count(*) * 0.8 AS BIGINT) FROM data)" for f in creative.ALL_FEATURES)
LABELLED = f"""lab AS MATERIALIZED (SELECT ad_id, campaign_id, CASE WHEN ctr > (SELECT quantile_cont(ctr, 0.5) FROM data) THEN 1 ELSE 0 END AS y, {USED} FROM data)"""
CV = f"""{LABELLED}, {FOLDS.format(rows="lab")},
cl AS MATERIALIZED (SELECT lab.*, fold FROM lab JOIN gf ON gf.campaign_id = lab.campaign_id),
ct AS MATERIALIZED (SELECT m.fold AS model, y, {", ".join(creative.ALL_FEATURES)} FROM cl JOIN (SELECT DISTINCT fold FROM gf) m ON m.fold <> cl.fold),
{newton_ctes("ct", creative.ALL_FEATURES, steps=12, impute=True)},
units AS MATERIALIZED (SELECT ad_id AS unit, {newton_score("cl", creative.ALL_FEATURES, impute=True)} AS s, y
    FROM cl JOIN nw_fit ON nw_fit.model = fold JOIN nw_scale ON nw_scale.model = fold),
{poisson_ctes("units", key_text("'logistic'", "unit"), 2000)}, {WEIGHTED_AUC.format(keys="")}, ci AS (SELECT {AUC_CI} FROM areas),
auc AS (SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc
    FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM units) x)"""


@query(
    "cre3_logistic_cv",
    sql(f"""SELECT 'logistic' AS evaluation, (SELECT {big('count(*)')} FROM units) AS n, auc, auc_low, auc_high, auc_low > 0.5 AS above_chance, 'ok' AS status,
    {N_USED} AS n_features, (SELECT {big('max(k)')} FROM gf) AS n_splits FROM auc, ci""", CV).replace("WITH ", "WITH RECURSIVE ", 1),
    dp={"auc": 6, "auc_low": 6, "auc_high": 6},
)
def cre3(spark, d):
    return creative.logistic_cv(data(spark, d), "ctr")


@query("cre4_boosted_cv")
def cre4(spark, d):
    return creative.boosted_cv(data(spark, d), "ctr")


TREE_CTES, TREE = first_tree("trows", creative.ALL_FEATURES)


@query(
    "cre4_first_tree",
    sql(TREE, f"{LABELLED}, trows AS MATERIALIZED (SELECT ad_id AS id, * EXCLUDE (ad_id) FROM lab), {TREE_CTES}"),
    dp={"threshold": 9, "gain": 9, "value": 9},
)
def cre4_tree(spark, d):
    return creative.boosted_tree(data(spark, d), "ctr")
