"""Registered queries for metrics, curves and threshold rules (inventory H, I, J6)
over the ``scored`` fixture, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.operators import curves, metrics
from raresift.plans.catalog import R, register, rounded
from raresift.sources import fixtures as fx

COST_FP, COST_FN = 1.0, 5.0
KEY = 12

# ---------------------------------------------------------------- oracle text


def _cum_sql(src: str = "scored", group_cols: tuple[str, ...] = (), float32: bool = False) -> list[tuple[str, str]]:
    g = ", ".join(group_cols)
    gsel = g + ", " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    s = "CAST(CAST(score AS FLOAT) AS DOUBLE)" if float32 else "CAST(score AS DOUBLE)"
    st = (
        f"SELECT {gsel}{s} AS threshold, count_if(label = 1) AS pos, count_if(label <> 1) AS neg "
        f"FROM {src} GROUP BY ALL"
    )
    run = f"OVER ({part}ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cum = (
        f"SELECT {gsel}threshold, pos, neg, CAST(sum(pos) {run} AS BIGINT) AS tp, "
        f"CAST(sum(neg) {run} AS BIGINT) AS fp, CAST(sum(pos) OVER ({part}) AS BIGINT) AS \"P\", "
        f"CAST(sum(neg) OVER ({part}) AS BIGINT) AS \"N\", "
        f"row_number() OVER ({part}ORDER BY threshold DESC) AS idx, count(*) OVER ({part}) AS nt FROM st"
    )
    return [("st", st), ("cum", cum)]


F1_KEY = 'coalesce(2 * tp / nullif(tp + fp + "P", 0), 0)'
COST_KEY = (
    f'CASE WHEN "P" > 0 THEN CAST({COST_FP} * fp * "P" + {COST_FN} * ("P" - tp) * (tp + fp) AS DOUBLE) / (tp + fp) '
    f"ELSE CAST({COST_FP} * fp AS DOUBLE) / (tp + fp) END"
)
YOUDEN_KEY = '(CAST(tp AS HUGEINT) * greatest("N", 1) - CAST(fp AS HUGEINT) * greatest("P", 1))'


YOUDEN_VALUE = 'coalesce(tp / nullif("P", 0), 0) - coalesce(fp / nullif("N", 0), 0)'
COST_VALUE = (
    f"{COST_FP} * (1 - tp / (tp + fp)) + {COST_FN} * "
    f'(1 - CASE WHEN "P" > 0 THEN tp / "P" ELSE 1.0 END)'
)


def _sel_sql(method: str, group_cols: tuple[str, ...]) -> str:
    """Chosen (t, tp_t, fp_t) per group."""
    g = ", ".join(group_cols)
    gsel = g + ", " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    if method in ("pr_curve", "cost_based", "roc_curve"):
        src = "cum"
        if method == "roc_curve":
            src = (
                f'(SELECT {gsel}threshold, tp, fp, "P", "N" FROM cum UNION ALL '
                f"SELECT {gsel}'inf'::DOUBLE, 0, 0, \"P\", \"N\" FROM cum WHERE idx = 1)"
            )
        order = {
            "pr_curve": f"{F1_KEY} DESC, threshold ASC",
            "cost_based": f"{COST_KEY} ASC, threshold ASC",
            "roc_curve": f"{YOUDEN_KEY} DESC, threshold DESC",
        }[method]
        return (
            f"SELECT {gsel}threshold AS t, tp AS tp_t, fp AS fp_t FROM ("
            f"SELECT *, row_number() OVER ({part}ORDER BY {order}) AS rn FROM {src}) WHERE rn = 1"
        )
    if method == "percentile":
        return (
            f"SELECT {gsel}q.t, coalesce(max(CASE WHEN c.threshold >= q.t THEN c.tp END), 0) AS tp_t, "
            f"coalesce(max(CASE WHEN c.threshold >= q.t THEN c.fp END), 0) AS fp_t FROM cum c JOIN "
            f"(SELECT {gsel}quantile_cont(score, 0.99) AS t FROM src GROUP BY ALL) q "
            + (f"USING ({g}) " if g else "ON TRUE ")
            + "GROUP BY ALL"
        )
    t = 0.5
    return (
        f"SELECT {gsel}{t} AS t, coalesce(max(CASE WHEN threshold >= {t} THEN tp END), 0) AS tp_t, "
        f"coalesce(max(CASE WHEN threshold >= {t} THEN fp END), 0) AS fp_t FROM cum GROUP BY ALL"
    )


def eval_sql(
    method: str, src: str = "scored", group_cols: tuple[str, ...] = (), label: str | None = None, raw: bool = False
) -> str:
    R = (lambda e: f"({e})") if raw else globals()["R"]
    g = ", ".join(group_cols)
    gsel = g + ", " if g else ""
    summ = (
        f'SELECT {gsel}sum(CAST(neg AS DOUBLE) * (2 * tp - pos)) AS auc_num, sum(pos * tp / (tp + fp)) AS ap_num, '
        f'max("P") AS "P", max("N") AS "N" FROM cum GROUP BY ALL'
    )
    extra = [("src", f"SELECT * FROM {src}")] + _cum_sql("src", group_cols) + [("summ", summ), ("sel", _sel_sql(method, group_cols))]
    join = f"JOIN sel USING ({g})" if g else "CROSS JOIN sel"
    tag = f"'{label}' AS metric, " if label else ""
    body = (
        f"SELECT {gsel}{tag}"
        f'{R("(tp_t + (\"N\" - fp_t)) / (\"P\" + \"N\")")} AS accuracy, '
        f'{R("CASE WHEN \"P\" > 0 AND \"N\" > 0 THEN auc_num / (2.0 * \"P\" * \"N\") END")} AS roc_auc, '
        f'{R("CASE WHEN \"P\" > 0 THEN ap_num / \"P\" ELSE 0.0 END")} AS pr_auc, '
        f'{R("coalesce(2 * tp_t / nullif(2 * tp_t + fp_t + (\"P\" - tp_t), 0), 0)")} AS f1_score, '
        f'{R("coalesce(tp_t / nullif(tp_t + fp_t, 0), 0)")} AS precision, '
        f'{R("coalesce(tp_t / nullif(\"P\", 0), 0)")} AS recall, '
        f'{R("CAST(t AS DOUBLE)")} AS selected_threshold '
        f"FROM summ {join}"
    )
    names = [src] if src in fx.CTES else []
    return fx.with_ctes(names, body, extra)


def _scored(spark, sf):
    return fx.scored(spark, sf)


# ---------------------------------------------------------------- curves


@register(
    "pr_curve",
    fx.with_ctes(
        ["scored"],
        f'SELECT threshold, {R("tp / (tp + fp)")} AS precision, '
        f'{R("CASE WHEN \"P\" > 0 THEN tp / \"P\" ELSE 1.0 END")} AS recall FROM cum',
        _cum_sql(),
    ),
)
def q_pr_curve(spark, sf):
    return rounded(curves.pr_curve(_scored(spark, sf)))


@register(
    "pr_curve_saved",
    fx.with_ctes(
        ["scored"],
        f'SELECT threshold, {R("tp / (tp + fp)")} AS precision, '
        f'{R("CASE WHEN \"P\" > 0 THEN tp / \"P\" ELSE 1.0 END")} AS recall FROM cum '
        "UNION ALL SELECT 1.0, 1.0, 0.0",
        _cum_sql(),
    ),
)
def q_pr_curve_saved(spark, sf):
    return rounded(curves.pr_curve(_scored(spark, sf), closing_point=True))


_ROC_BODY = (
    "SELECT threshold, {fpr} AS fpr, {tpr} AS tpr FROM ("
    "SELECT *, lead(pos) OVER (ORDER BY threshold DESC) AS pn, lead(neg) OVER (ORDER BY threshold DESC) AS nn "
    "FROM cum) WHERE {keep} UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0"
)


@register(
    "roc_curve",
    fx.with_ctes(
        ["scored"],
        _ROC_BODY.format(
            fpr=R('fp / "N"'), tpr=R('tp / "P"'), keep="idx = 1 OR idx = nt OR pn <> pos OR nn <> neg"
        ),
        _cum_sql(),
    ),
)
def q_roc_curve(spark, sf):
    return rounded(curves.roc_curve(_scored(spark, sf)))


@register(
    "roc_curve_all_points",
    fx.with_ctes(["scored"], _ROC_BODY.format(fpr=R('fp / "N"'), tpr=R('tp / "P"'), keep="TRUE"), _cum_sql()),
)
def q_roc_curve_all(spark, sf):
    return rounded(curves.roc_curve(_scored(spark, sf), drop_intermediate=False))


@register(
    "cost_curve",
    fx.with_ctes(
        ["scored"],
        f'SELECT threshold, {R(f"{COST_FP} * (1 - tp / (tp + fp)) + {COST_FN} * (1 - CASE WHEN \"P\" > 0 THEN tp / \"P\" ELSE 1.0 END)")} '
        "AS cost_metric FROM cum",
        _cum_sql(),
    ),
)
def q_cost_curve(spark, sf):
    return rounded(curves.cost_curve(_scored(spark, sf), COST_FP, COST_FN))


@register(
    "pr_curve_by_experiment",
    fx.with_ctes(
        ["scored_groups"],
        f'SELECT model, oversampling, threshold, {R("tp / (tp + fp)")} AS precision, '
        f'{R("CASE WHEN \"P\" > 0 THEN tp / \"P\" ELSE 1.0 END")} AS recall FROM cum',
        _cum_sql("scored_groups", ("model", "oversampling")),
    ),
)
def q_pr_curve_groups(spark, sf):
    g = ["model", "oversampling"]
    return rounded(curves.pr_curve(fx.scored_groups(spark, sf), group_cols=g))


# ---------------------------------------------------------------- threshold rules


@register(
    "best_threshold_f1",
    fx.with_ctes(
        ["scored"],
        f"SELECT threshold, {R(F1_KEY)} AS value FROM cum ORDER BY {F1_KEY} DESC, threshold ASC LIMIT 1",
        _cum_sql(),
    ),
)
def q_best_f1(spark, sf):
    return rounded(curves.best_threshold_f1(_scored(spark, sf)))


@register(
    "best_threshold_youden",
    fx.with_ctes(
        ["scored"],
        f"SELECT threshold, {R(YOUDEN_VALUE)} AS value FROM ("
        'SELECT threshold, tp, fp, "P", "N" FROM cum UNION ALL '
        "SELECT 'inf'::DOUBLE, 0, 0, \"P\", \"N\" FROM cum WHERE idx = 1) "
        f"ORDER BY {YOUDEN_KEY} DESC, threshold DESC LIMIT 1",
        _cum_sql(),
    ),
)
def q_best_youden(spark, sf):
    return rounded(curves.best_threshold_youden(_scored(spark, sf)))


@register(
    "best_threshold_cost",
    fx.with_ctes(
        ["scored"],
        f"SELECT threshold, {R(COST_VALUE)} AS value FROM cum ORDER BY {COST_KEY} ASC, threshold ASC LIMIT 1",
        _cum_sql(),
    ),
)
def q_best_cost(spark, sf):
    return rounded(curves.best_threshold_cost(_scored(spark, sf), cost_fp=COST_FP, cost_fn=COST_FN))


@register(
    "threshold_percentile",
    fx.with_ctes(["scored"], f"SELECT {R('quantile_cont(score, 0.99)')} AS threshold FROM scored"),
)
def q_percentile(spark, sf):
    return rounded(curves.threshold_percentile(_scored(spark, sf), 99))


@register(
    "threshold_percentile_by_experiment",
    fx.with_ctes(
        ["scored_groups"],
        f"SELECT model, oversampling, {R('quantile_cont(score, 0.9)')} AS threshold FROM scored_groups GROUP BY ALL",
    ),
)
def q_percentile_groups(spark, sf):
    return rounded(
        curves.threshold_percentile(fx.scored_groups(spark, sf), 90, group_cols=["model", "oversampling"])
    )


# ---------------------------------------------------------------- metrics


@register(
    "confusion_counts",
    fx.with_ctes(
        ["scored"],
        "SELECT count_if(label = 1 AND score >= 0.5) AS tp, count_if(label <> 1 AND score >= 0.5) AS fp, "
        "count_if(label <> 1 AND score < 0.5) AS tn, count_if(label = 1 AND score < 0.5) AS fn, "
        "count(*) AS n FROM scored",
    ),
)
def q_confusion(spark, sf):
    from raresift.operators.relational import apply_threshold

    return metrics.confusion_counts(apply_threshold(_scored(spark, sf), 0.5))


_REPORT_SQL = (
    "SELECT model, oversampling, tp, fp, tn, fn, "
    f"{R('(tp + tn) / (tp + fp + tn + fn)')} AS accuracy, {R('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, "
    f"{R('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, "
    f"{R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1_score FROM ("
    "SELECT model, oversampling, count_if(label = 1 AND score >= 0.5) AS tp, count_if(label <> 1 AND score >= 0.5) AS fp, "
    "count_if(label <> 1 AND score < 0.5) AS tn, count_if(label = 1 AND score < 0.5) AS fn FROM scored_groups GROUP BY ALL)"
)


@register("classification_report_by_experiment", fx.with_ctes(["scored_groups"], _REPORT_SQL))
def q_report(spark, sf):
    from raresift.operators.relational import apply_threshold

    df = apply_threshold(fx.scored_groups(spark, sf), 0.5)
    return rounded(metrics.classification_report(df, group_cols=["model", "oversampling"]))


@register(
    "total_cost",
    fx.with_ctes(
        ["scored"],
        f"SELECT {R(f'count_if(label <> 1 AND CAST(score AS FLOAT) >= 0.5) * {COST_FP} + count_if(label = 1 AND CAST(score AS FLOAT) < 0.5) * {COST_FN}')} AS cost FROM scored",
    ),
)
def q_total_cost(spark, sf):
    return rounded(metrics.total_cost(_scored(spark, sf), COST_FP, COST_FN))


_SUMM = (
    'SELECT {g}{auc} AS roc_auc, {ap} AS pr_auc FROM (SELECT {g}sum(CAST(neg AS DOUBLE) * (2 * tp - pos)) AS a, '
    'sum(pos * tp / (tp + fp)) AS b, max("P") AS "P", max("N") AS "N" FROM cum GROUP BY ALL)'
)


@register(
    "ranking_metrics",
    fx.with_ctes(
        ["scored"],
        _SUMM.format(
            g="", auc=R('CASE WHEN "P" > 0 AND "N" > 0 THEN a / (2.0 * "P" * "N") END'),
            ap=R('CASE WHEN "P" > 0 THEN b / "P" ELSE 0.0 END'),
        ),
        _cum_sql(),
    ),
)
def q_ranking(spark, sf):
    cum = curves.cumulative_table(_scored(spark, sf))
    return rounded(metrics.ranking_summary(cum).select("roc_auc", "pr_auc"))


@register(
    "ranking_metrics_by_experiment",
    fx.with_ctes(
        ["scored_groups"],
        _SUMM.format(
            g="model, oversampling, ", auc=R('CASE WHEN "P" > 0 AND "N" > 0 THEN a / (2.0 * "P" * "N") END'),
            ap=R('CASE WHEN "P" > 0 THEN b / "P" ELSE 0.0 END'),
        ),
        _cum_sql("scored_groups", ("model", "oversampling")),
    ),
)
def q_ranking_groups(spark, sf):
    g = ["model", "oversampling"]
    cum = curves.cumulative_table(fx.scored_groups(spark, sf), group_cols=g)
    return rounded(metrics.ranking_summary(cum, g).select(*g, "roc_auc", "pr_auc"))


def _eval_query(method):
    def q(spark, sf):
        return rounded(metrics.evaluate(_scored(spark, sf), method=method, cost_fp=COST_FP, cost_fn=COST_FN))

    return q


for _m in ("pr_curve", "cost_based", "roc_curve", "percentile", "default"):
    register(f"evaluate_{_m}", eval_sql(_m))(_eval_query(_m))


# experiment matrix: one metrics row per (model, oversampling, threshold method)
_MATRIX_METHODS = ("pr_curve", "cost_based", "percentile", "default")


def experiment_matrix_sql(raw: bool = False) -> str:
    parts = []
    for m in _MATRIX_METHODS:
        q = eval_sql(m, "scored_groups", ("model", "oversampling"), label=m, raw=raw)
        parts.append(f"SELECT * FROM ({q})")
    return " UNION ALL ".join(parts)


@register("experiment_matrix", experiment_matrix_sql())
def q_matrix(spark, sf):
    from raresift.operators.select import experiment_matrix

    return rounded(
        experiment_matrix(
            fx.scored_groups(spark, sf),
            methods=_MATRIX_METHODS,
            group_cols=["model", "oversampling"],
            cost_fp=COST_FP,
            cost_fn=COST_FN
        )
    )


def _metric_query(metric):
    def q(spark, sf):
        g = ["model", "oversampling"]
        return rounded(metrics.evaluate_metric(fx.scored_groups(spark, sf), metric, COST_FP, COST_FN, group_cols=g))

    return q


_H10_SQL = {
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "cost": f"fp * {COST_FP} + fn * {COST_FN}",
}
for _m, _e in _H10_SQL.items():
    register(
        f"evaluate_metric_{_m}",
        fx.with_ctes(
            ["scored_groups"],
            f"SELECT model, oversampling, {R(_e)} AS value FROM (SELECT model, oversampling, "
            "count_if(label = 1 AND CAST(score AS FLOAT) >= 0.5) AS tp, count_if(label <> 1 AND CAST(score AS FLOAT) >= 0.5) AS fp, "
            "count_if(label = 1 AND CAST(score AS FLOAT) < 0.5) AS fn FROM scored_groups GROUP BY ALL)",
        ),
    )(_metric_query(_m))

register(
    "evaluate_metric_prauc",
    fx.with_ctes(
        ["scored_groups"],
        _SUMM.format(g="model, oversampling, ", auc="0.0", ap=R('CASE WHEN "P" > 0 THEN b / "P" ELSE 0.0 END'))
        .replace("0.0 AS roc_auc, ", "")
        .replace(" AS pr_auc", " AS value"),
        _cum_sql("scored_groups", ("model", "oversampling"), float32=True),
    ),
)(_metric_query("prauc"))
