"""Quality, feature, evaluation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.operators import evaluation as E
from tidemark.operators import features as X
from tidemark.operators import models as ML
from tidemark.operators import preparation as P
from tidemark.operators import quality as Q
from tidemark.plans.fixtures import AS_OF
from tidemark.session import scratch
from tidemark.sinks import zones as Z


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(
    "frame_check",
    """SELECT count(*) AS rows, 'l_missing' AS missing_columns, 0::BIGINT AS infinite_values, 0::BIGINT AS null_values, false AS valid
    FROM lineitem""",
)
def frame_check(t):
    return Q.frame_check(t.lineitem, ["l_orderkey", "l_missing"])


_DUP = "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})))"


def _report_sql(table, columns):
    nulls = " + ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END)" for c in columns)
    each = ", ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END) AS null_{c}" for c in columns)
    dup = _DUP.format(t=table)
    return f"""SELECT count(*) AS total_rows, {len(columns)}::BIGINT AS total_columns, {each}, {dup} AS duplicate_rows,
    round(((1 - ({nulls}) / (count(*) * {len(columns)})) + (1 - {dup} / count(*))) / 2, 6) AS quality_score FROM {table}"""


_KR = ["objective_id", "key_result_id", "target_value", "current_value", "status", "progress_percentage", "due_date"]


@query("quality_report", _report_sql("v_key_results", _KR), ("v_key_results",))
def quality_report(t):
    return rounded(Q.quality_report(t.key_results), "quality_score")


_TEXT = ["text", "lang", "source"]


@query(
    "quality_report_texts",
    "WITH texts AS (SELECT text, lang, source FROM documents) " + _report_sql("texts", _TEXT),
)
def quality_report_texts(t):
    """Whole texts; rows are shuffled as digests."""
    return rounded(Q.quality_report(t.documents.select(*_TEXT)), "quality_score")


def _profile_number(c):
    q = ", ".join(f"round(quantile_cont({c}::DOUBLE, {s}), 6) AS {n}" for s, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS "distinct", round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, {q}, max({c})::DOUBLE AS max, count(*) - count({c}) AS nulls FROM events"""


def _profile_other(c):
    return f"""SELECT '{c}', count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) - count({c}) FROM events"""


@query(
    "table_profile",
    "WITH u AS ("
    + " UNION ALL ".join([_profile_number(c) for c in ("event_id", "user_id", "value")] + [_profile_other(c) for c in ("ts", "event_type", "props")])
    + """) SELECT u.*, CASE "column" WHEN 'event_id' THEN 'bigint' WHEN 'user_id' THEN 'bigint' WHEN 'value' THEN 'double'
    WHEN 'ts' THEN 'timestamp_ntz' ELSE 'string' END AS type FROM u""",
)
def table_profile(t):
    """Exact quartiles without gathering a column in one task."""
    return rounded(Q.table_profile(t.events), "mean", "std", "p25", "p50", "p75")


@query(
    "top_values",
    """WITH u AS (SELECT 'event_type' AS "column", event_type AS value FROM events UNION ALL SELECT 'props', props FROM events),
    c AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
    SELECT "column", value, n, rank FROM r WHERE rank <= 10""",
)
def top_values(t):
    return Q.top_values(t.events).withColumn("rank", F.col("rank").cast("bigint"))


def stages(t):
    raw = t.key_results
    done = raw.filter(F.col("progress_percentage").isNotNull())
    final = done.join(t.objectives.select("objective_id", "department"), "objective_id").select(
        "key_result_id", "department", "progress_percentage", "current_value", "due_date"
    )
    return {"raw": raw, "processed": done, "final": final}


def _score(table, width, columns):
    nulls = " + ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END)" for c in columns)
    dup = _DUP.format(t=table)
    return f"((1 - ({nulls}) / (count(*) * {width})) + (1 - {dup} / count(*))) / 2"


_FINAL = ["key_result_id", "department", "progress_percentage", "current_value", "due_date"]
STAGES = f"""done AS (SELECT * FROM v_key_results WHERE progress_percentage IS NOT NULL),
final AS (SELECT {', '.join(_FINAL)} FROM done JOIN v_objectives USING (objective_id)),
s AS (SELECT 'raw' AS stage, count(*) AS record_count, {_score('v_key_results', 7, _KR)} AS q FROM v_key_results
 UNION ALL SELECT 'processed', count(*), {_score('done', 7, _KR)} FROM done
 UNION ALL SELECT 'final', count(*), {_score('final', 5, _FINAL)} FROM final)"""
_LEAST = 0.97


@query(
    "staged_quality",
    f"""WITH {STAGES} SELECT stage, record_count, round(q, 6) AS quality_score,
    CASE WHEN q >= {_LEAST} THEN 'passed' ELSE 'failed' END AS status FROM s""",
    ("v_key_results", "v_objectives"),
)
def staged_quality(t):
    return rounded(Q.staged_quality(stages(t), _LEAST), "quality_score")


@query(
    "quality_alerts",
    f"""WITH {STAGES}, f AS (SELECT concat(stage, ' quality below threshold') AS a FROM s WHERE q < {_LEAST})
    SELECT CASE WHEN count(*) > 0 THEN 'warning' ELSE 'normal' END AS alert_level, coalesce(string_agg(a, '; ' ORDER BY a), '') AS alerts,
    count(*) AS alert_count FROM f""",
    ("v_key_results", "v_objectives"),
)
def quality_alerts(t):
    return Q.quality_alerts(Q.staged_quality(stages(t), _LEAST))


@query(
    "impute",
    """SELECT key_result_id, coalesce(status, (SELECT status FROM v_key_results WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status,
    round(coalesce(progress_percentage, (SELECT avg(progress_percentage) FROM v_key_results)), 6) AS progress_percentage FROM v_key_results""",
    ("v_key_results",),
)
def impute(t):
    k = t.key_results.select("key_result_id", "status", "progress_percentage")
    return rounded(X.impute(k, ["progress_percentage"], ["status"]), "progress_percentage")


@query(
    "label_encode",
    """SELECT event_id, (SELECT count(DISTINCT b.event_type) FROM events b WHERE b.event_type < events.event_type) AS event_type,
    dense_rank() OVER (ORDER BY props) - 1 AS props FROM events""",
)
def label_encode(t):
    return X.label_encode(t.events.select("event_id", "event_type", "props"), ["event_type", "props"])


@query(
    "label_encode_null",
    """SELECT objective_id, CASE WHEN status IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY status NULLS LAST) - 1 END AS status FROM v_objectives""",
    ("v_objectives",),
)
def label_encode_null(t):
    """Null gets code -1."""
    return X.label_encode(t.objectives.select("objective_id", "status"), ["status"], -1)


def _scaled(fn):
    return f"""WITH s AS (SELECT avg(l_quantity) AS mq, {fn}(l_quantity) AS sq, avg(l_discount) AS md, {fn}(l_discount) AS sd FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_discount - md) / sd, 6) AS l_discount FROM lineitem, s"""


def _scale(t, sample):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(X.scale(rows, ["l_quantity", "l_discount"], sample), "l_quantity", "l_discount")


@query("scale_pop", _scaled("stddev_pop"))
def scale_pop(t):
    return _scale(t, False)


@query("scale_sample", _scaled("stddev_samp"))
def scale_sample(t):
    return _scale(t, True)


@query(
    "prepare_features",
    """WITH c AS (SELECT event_id, user_id::DOUBLE AS user_id, value, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type FROM events),
    s AS (SELECT avg(user_id) AS mu, stddev_pop(user_id) AS su, avg(value) AS mv, stddev_pop(value) AS sv, avg(event_type) AS me, stddev_pop(event_type) AS se FROM c)
    SELECT event_id, round((user_id - mu) / su, 6) AS user_id, round((value - mv) / sv, 6) AS value, round((event_type - me) / se, 6) AS event_type FROM c, s""",
)
def prepare_features(t):
    """Impute, encode and scale in one plan."""
    e = t.events.select("event_id", "user_id", "value", "event_type")
    return rounded(X.prepare_features(e, ["event_id"]), "user_id", "value", "event_type")


@query(
    "train_test_split",
    "SELECT doc_id, CASE WHEN substr(md5(concat(doc_id, '-42')), 1, 8) < 'cccccccd' THEN 'train' ELSE 'test' END AS split FROM documents",
)
def train_test_split(t):
    return X.with_split(t.documents.select("doc_id"), ["doc_id"])


@query(
    "confusion_matrix",
    "SELECT y_true, y_pred, count(*) AS n FROM v_binary_labels GROUP BY y_true, y_pred",
    ("v_binary_labels",),
)
def confusion_matrix(t):
    return E.confusion_matrix(t.binary_labels)


PER_CLASS = """k AS (SELECT c AS class, count(CASE WHEN y_true = c THEN 1 END) AS support, count(CASE WHEN y_pred = c THEN 1 END) AS predicted,
  count(CASE WHEN y_true = c AND y_pred = c THEN 1 END) AS hits FROM v_binary_labels, (SELECT DISTINCT y_true AS c FROM v_binary_labels) GROUP BY c),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM k),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)"""


@query(
    "per_class_metrics",
    f"WITH {PER_CLASS} SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f",
    ("v_binary_labels",),
)
def per_class_metrics(t):
    return rounded(E.per_class_metrics(t.binary_labels).drop("hits"), "precision", "recall", "f1")


METRICS = f"""{PER_CLASS}, w AS (SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
  round(sum(r * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1_score FROM f)"""
_FOUR = ["accuracy", "precision", "recall", "f1_score"]


@query("classification_metrics", f"WITH {METRICS} SELECT * FROM w", ("v_binary_labels",))
def classification_metrics(t):
    return rounded(E.classification_metrics(t.binary_labels), *_FOUR)


AUC = """r AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM v_binary_labels),
  auc AS (SELECT round((sum(CASE WHEN y_true = 1 THEN rk ELSE 0 END) - sum(y_true) * (sum(y_true) + 1) / 2.0)
       / (sum(y_true) * sum(1 - y_true)), 6) AS roc_auc FROM r)"""


@query("roc_auc", f"WITH {AUC} SELECT roc_auc FROM auc", ("v_binary_labels",))
def roc_auc(t):
    return rounded(E.roc_auc(t.binary_labels), "roc_auc")


@query(
    "metric_history",
    f"WITH {METRICS} SELECT '{AS_OF}' AS timestamp, 'labels' AS model_name, w.*, CAST(NULL AS DOUBLE) AS roc_auc FROM w",
    ("v_binary_labels",),
)
def metric_history(t):
    """Append a run to the history and read it back."""
    path = scratch(t.spark, "metric_history")
    scores = rounded(E.classification_metrics(t.binary_labels), *_FOUR)
    Z.metric_history(scores, "labels", F.lit(AS_OF)).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


_CELLS = ", ".join(f"count(*) FILTER (y_true = {a} AND y_pred = {b}) AS n_{a}{b}" for a in (0, 1) for b in (0, 1))
_CLASSES = ", ".join(
    f"(SELECT round({c}, 6) FROM f WHERE class = {k}) AS {n}_{k}"
    for k in (0, 1)
    for c, n in (("p", "precision"), ("r", "recall"), ("f1", "f1"))
)


@query(
    "evaluation_json",
    f"""WITH {METRICS}, {AUC}, x AS (SELECT {_CELLS} FROM v_binary_labels)
    SELECT 'labels' AS model_name, w.*, auc.roc_auc, x.*, {_CLASSES} FROM w, auc, x""",
    ("v_binary_labels",),
)
def evaluation_json(t):
    """The whole result as a JSON document, read back."""
    path = scratch(t.spark, "evaluation_json")
    E.evaluation(t.binary_labels).withColumn("model_name", F.lit("labels")).write.json(path)
    part = "struct<precision: DOUBLE, recall: DOUBLE, f1: DOUBLE>"
    read = t.spark.read.schema(
        "model_name STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1_score DOUBLE, roc_auc DOUBLE, "
        f"confusion_matrix array<array<BIGINT>>, per_class map<STRING, {part}>"
    ).json(path)
    return rounded(
        read.select(
            "model_name",
            *_FOUR,
            "roc_auc",
            *[F.col("confusion_matrix")[a][b].alias(f"n_{a}{b}") for a in (0, 1) for b in (0, 1)],
            *[F.col("per_class")[str(c)][m].alias(f"{m}_{c}") for c in (0, 1) for m in ("precision", "recall", "f1")],
        ),
        *_FOUR, "roc_auc", *[f"{m}_{c}" for c in (0, 1) for m in ("precision", "recall", "f1")],
    )


_CUT = "TIMESTAMP '1998-01-01 00:00:00'"
_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_CAT = ["l_returnflag", "l_linestatus"]
NUMERIC = (
    "n AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, avg({c}) FILTER (l_shipdate < {_CUT}) AS rm, stddev_samp({c}) FILTER (l_shipdate < {_CUT}) AS rs,
        avg({c}) FILTER (l_shipdate >= {_CUT}) AS cm, stddev_samp({c}) FILTER (l_shipdate >= {_CUT}) AS cs FROM lineitem"""
        for c in _NUM
    )
    + "), d AS (SELECT *, abs(cm - rm) / rs AS md, abs(cs - rs) / rs AS sd FROM n)"
)
CATEGORICAL = (
    "u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, l_shipdate < {_CUT} AS old FROM lineitem" for c in _CAT)
    + """), s AS (SELECT feature, v, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM u GROUP BY feature, v),
    tt AS (SELECT feature, sum(r) AS rt, sum(c) AS ct FROM s GROUP BY feature),
    e AS (SELECT s.feature, coalesce(sum(abs(r / rt - c / ct)) FILTER (r > 0 AND c > 0), 0) AS dd, count(*) FILTER (r > 0 AND c > 0) AS k
          FROM s JOIN tt ON s.feature = tt.feature GROUP BY s.feature)"""
)


def sides(t):
    rows = t.lineitem.select("l_shipdate", *_NUM, *_CAT)
    cut = F.expr(_CUT.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    return rows.filter(F.col("l_shipdate") < cut), rows.filter(F.col("l_shipdate") >= cut)


@query(
    "drift_numeric",
    f"""WITH {NUMERIC} SELECT feature, round(rm, 6) AS reference_mean, round(rs, 6) AS reference_std, round(cm, 6) AS current_mean,
    round(cs, 6) AS current_std, round(md, 6) AS mean_drift, round(sd, 6) AS std_drift, md > 0.5 OR sd > 0.5 AS drift_detected FROM d""",
)
def drift_numeric(t):
    d = E.drift_numeric(*sides(t), _NUM)
    return rounded(
        d, "reference_mean", "reference_std", "current_mean", "current_std", "mean_drift", "std_drift"
    )


@query(
    "drift_categorical",
    f"WITH {CATEGORICAL} SELECT feature, round(dd, 6) AS distribution_drift, k AS common_categories, dd > 0.3 AS drift_detected FROM e",
)
def drift_categorical(t):
    return rounded(E.drift_categorical(*sides(t), _CAT), "distribution_drift")


@query(
    "drift_overall",
    f"""WITH {NUMERIC}, {CATEGORICAL}, a AS (SELECT md > 0.5 OR sd > 0.5 AS f FROM d UNION ALL SELECT dd > 0.3 FROM e)
    SELECT count(*) AS total_features, count(*) FILTER (f) AS drifted_features, round(count(*) FILTER (f) / count(*), 6) AS drift_percentage,
    CASE WHEN count(*) FILTER (f) / count(*) > 0.5 THEN 'high' WHEN count(*) FILTER (f) / count(*) > 0.2 THEN 'medium' ELSE 'low' END AS drift_severity FROM a""",
)
def drift_overall(t):
    old, new = sides(t)
    both = E.drift_overall(E.drift_numeric(old, new, _NUM), E.drift_categorical(old, new, _CAT))
    return rounded(both, "drift_percentage")


@query(
    "category_overlap",
    f"""SELECT DISTINCT l_returnflag FROM lineitem WHERE l_shipdate < {_CUT} AND l_returnflag IS NOT NULL
    INTERSECT SELECT l_returnflag FROM lineitem WHERE l_shipdate >= {_CUT}""",
)
def category_overlap(t):
    return E.category_overlap(*sides(t), "l_returnflag")


def labelled(t):
    docs = t.documents.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return t.labels.join(docs, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", F.col("toxic").cast("double").alias("toxic"),
        F.col("quality").cast("double").alias("quality"),
    )


def estimator(trees=ML.TREES):
    return ML.forest(["n_chars", "toxic"], ["lang", "source"], "quality", trees)


@query("train_forest")
def train_forest(t):
    """Train on four fifths of the labelled documents, score the rest."""
    rows = X.with_split(labelled(t), ["doc_id"])
    model = estimator().fit(rows.filter(F.col("split") == "train").drop("split"))
    scored = ML.score(model, rows.filter(F.col("split") == "test").drop("split"), "quality")
    return scored.select("doc_id", "y_true", "y_pred", "score")


@query("batch_predict")
def batch_predict(t):
    """Save two versions, load the newest by number, score all documents."""
    folder = scratch(t.spark, "models")
    rows = labelled(t)
    ML.save_version(estimator(20).fit(rows), folder, 9)
    ML.save_version(estimator(40).fit(rows), folder, 10)
    model = ML.load_newest(t.spark, folder)
    docs = t.documents.select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.lit(0.0).alias("toxic"),
    )
    return ML.score(model, docs).select("doc_id", "y_pred", "score")


@query("champion_challenger")
def champion_challenger(t):
    """A model of half the rows against one of all rows."""
    rows = X.with_split(labelled(t), ["doc_id"], 0.5)
    old = rows.filter(F.col("split") == "train").drop("split")
    new = rows.filter(F.col("split") == "test").drop("split")
    first = estimator(20).fit(old)
    folder = scratch(t.spark, "champion_challenger")
    ML.save_version(first, folder, 1)
    _, replaced, before, after = ML.update_if_better(first, estimator(20), old, new, "quality", folder)
    return new.agg(
        F.lit(replaced).alias("replaced"), F.lit(before).alias("accuracy_before"),
        F.lit(after).alias("accuracy_after"), F.count(F.lit(1)).alias("new_rows"),
    )


@query("cross_validate")
def cross_validate(t):
    return ML.fold_summary(ML.cross_validate(labelled(t), estimator(20), "quality", ["doc_id"], 5))


_FOLD = "CAST('0x' || substr(md5(concat(doc_id, '-42')), 1, 8) AS BIGINT) % 5"
_ROWS = f"""r AS (SELECT {_FOLD} AS fold, d.n_chars::DOUBLE AS n_chars, l.toxic::DOUBLE AS toxic, lang, source
    FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT unnest(range(5)) AS out)"""


def _codes_sql(c):
    """Rows of each training set with the code of their text; nulls get the code after the last."""
    return f"""{c}_codes AS (SELECT out, {c}, count(*) AS n, dense_rank() OVER (PARTITION BY out ORDER BY {c}) - 1 AS code
    FROM r, k WHERE fold <> out AND {c} IS NOT NULL GROUP BY out, {c})"""


def _fold_rows(t):
    made = estimator()
    return ML.fold_rows(labelled(t), made, ["doc_id"], 5), made


def _full(c):
    if c in ("n_chars", "toxic"):
        return f"SELECT out, fill, coalesce({c}, fill) AS x FROM r JOIN (SELECT out, avg({c}) AS fill FROM r, k WHERE fold <> out GROUP BY out) f ON fold <> out"
    last = f"(SELECT out, max(code) + 1 AS fill FROM {c}_codes GROUP BY out)"
    return f"SELECT f.out, fill::DOUBLE AS fill, coalesce(code, fill)::DOUBLE AS x FROM r JOIN {last} f ON fold <> f.out LEFT JOIN {c}_codes z ON z.out = f.out AND z.{c} = r.{c}"


@query(
    "fold_statistics",
    f"WITH {_ROWS}, {_codes_sql('lang')}, {_codes_sql('source')} "
    + " UNION ALL ".join(
        f"""SELECT out::INT AS fold, '{c}' AS feature, round(any_value(fill), 6) AS fill, round(avg(x), 6) AS mean,
        round(stddev_samp(x), 6) AS std FROM ({_full(c)}) GROUP BY out"""
        for c in ("n_chars", "toxic", "lang", "source")
    ),
)
def fold_statistics(t):
    """What the training set beside each fold says of each column, all from one scan."""
    rows, made = _fold_rows(t)
    return rounded(P.fit(rows, made.numbers, made.categories, 5).statistics(t.spark), "fill", "mean", "std")


@query(
    "fold_dictionary",
    f"WITH {_ROWS}, "
    + ", ".join(map(_codes_sql, ("lang", "source")))
    + " "
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, out::INT AS fold, n, code FROM {c}_codes""" for c in ("lang", "source")),
)
def fold_dictionary(t):
    """Code and rows of each text in the training set beside each fold."""
    rows, made = _fold_rows(t)
    each = F.posexplode(F.arrays_zip("counts", "codes")).alias("fold", "z")
    words = P.dictionary(rows, made.categories, 5).select("column", "value", each)
    return words.select("column", "value", "fold", F.col("z.counts").alias("n"), F.col("z.codes").alias("code")).filter("n > 0")
