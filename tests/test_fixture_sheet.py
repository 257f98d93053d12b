"""Fixture tests on a small label sheet with the shipped CSV's layout.

The fixture has quoted multi-line texts, doubled quotes, ``Neutro``, padded and
mixed-case values, a missing removal flag and a removed row (FIXTURES.md F3).
"""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from aspectra.functions.aspects import detect_aspects
from aspectra.functions.labels import encode_labels
from aspectra.operators import clean, reports, weights
from aspectra.schema import LABELS, NARROW_LEXICON, WIDE_LEXICON
from aspectra.sources import io

HEADER = "review_id,review_text,logistica_sentimento,produto_sentimento,atendimento_sentimento,preco_sentimento,to_remove"
ROWS = [
    ("a1", "Chegou rápido, produto ótimo.", "Positivo", "Positivo", "", "", "Não"),
    ("a2", "Entrega atrasou\nmas o vendedor respondeu \"rápido\".", "Negativo", "", "Positivo", "", "Não"),
    ("a3", "PREÇO alto, péssima descrição.", "", " negativo ", "", "Negativo", "Não"),
    ("a4", "Linha um\nlinha dois\nlinha três", "Neutro", "", "", "", "Não"),
    ("a5", "Não recomendo, quebrou.", "", "Negativo", "Negativo", "", " Sim "),
    ("a6", "ok", "", "", "", "", ""),
    ("a7", "Pagou R$50 de frete; R$ 50 não casa.", "Positivo", "", "", "Positivo", "não"),
]


def _cell(v: str, always_quote: bool) -> str:
    if always_quote or any(ch in v for ch in ',"\n'):
        return '"' + v.replace('"', '""') + '"'
    return v


@pytest.fixture(scope="module")
def sheet_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("sheet") / "rotulacao.csv"
    lines = [HEADER] + [",".join([r[0], _cell(r[1], True), *[_cell(v, False) for v in r[2:]]]) for r in ROWS]
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


@pytest.fixture(scope="module")
def sheet(spark, sheet_path):
    return io.read_label_sheet(spark, sheet_path, io.SHEET_SCHEMA)


def test_multiline_quoted_read(sheet):
    rows = {r.review_id: r for r in sheet.collect()}
    assert len(rows) == len(ROWS)
    assert rows["a2"].review_text == ROWS[1][1]
    assert rows["a4"].review_text.count("\n") == 2


def test_source_fallback(spark, sheet_path):
    df = io.read_label_sheet(spark, [sheet_path + ".missing", sheet_path], io.SHEET_SCHEMA)
    assert df.count() == len(ROWS)


def test_drop_removed_keeps_missing_flag(sheet):
    kept = {r.review_id for r in clean.drop_removed(sheet).collect()}
    assert kept == {"a1", "a2", "a3", "a4", "a6", "a7"}


def test_encode_labels(sheet):
    enc = {r.review_id: r.labels for r in sheet.select("review_id", encode_labels(sheet.columns).alias("labels")).collect()}
    assert enc["a1"] == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert enc["a3"] == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]  # padded, mixed case
    assert enc["a4"] == [0.0] * 8  # Neutro sets no bit
    assert enc["a6"] == [0.0] * 8


def test_drop_unlabelled(sheet):
    # unquoted empty fields read back as null (as pandas' NaN), so a6 has no label at all
    kept = {r.review_id for r in clean.drop_unlabelled(sheet).collect()}
    assert kept == {"a1", "a2", "a3", "a4", "a5", "a7"}


def test_class_weights_formula(sheet):
    df = clean.drop_removed(sheet)
    df = df.withColumn("labels", encode_labels(df.columns))
    rows = df.select("labels").collect()
    n = len(rows)
    counts = [sum(r.labels[i] for r in rows) for i in range(8)]
    raw = [math.sqrt(n / (c + 1)) for c in counts]
    expect = [x / min(raw) for x in raw]
    got = {r.label_idx: r.weight for r in weights.class_weights(df).collect()}
    assert [round(got[i], 9) for i in range(8)] == [round(x, 9) for x in expect]
    assert min(got.values()) == pytest.approx(1.0)


def test_class_share_fixed_order(sheet):
    df = clean.drop_removed(sheet)
    out = reports.class_counts(df.withColumn("labels", encode_labels(df.columns))).orderBy("label_idx").collect()
    assert [r.label for r in out] == list(LABELS)
    assert all(r.n >= 0 for r in out)


PY_SENTENCES = [
    "Chegou rápido, produto ótimo.", "PREÇO alto, péssima descrição.", "ÓTIMO atendimento da loja",
    "Pagou R$50 de frete", "R$ 50 apenas", "sem nada a declarar", "Descrição errada e ENTREGA demorada",
    "produto_bom não é produto", "açúcar e café", "Custo-benefício excelente", None,
]


@pytest.mark.parametrize("lexicon", [WIDE_LEXICON, NARROW_LEXICON], ids=["wide", "narrow"])
def test_lexicon_parity_with_python_re(spark, lexicon):
    """Spark's (?iU) patterns agree with Python's Unicode ``re`` on accents, case and word edges."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(PY_SENTENCES)], "i int, text string")
    got = {r.i: r.a for r in df.select("i", detect_aspects("text", lexicon).alias("a")).collect()}
    for i, s in enumerate(PY_SENTENCES):
        expect = [] if s is None else [a for a, toks in lexicon.items()
                                       if re.search(r"\b(" + "|".join(toks) + r")\b", s, re.IGNORECASE)]
        assert got[i] == expect, (s, got[i], expect)


def test_narrow_default(spark):
    df = spark.createDataFrame([("nada aqui",), (None,)], "text string")
    out = [r.a for r in df.select(detect_aspects("text", NARROW_LEXICON, default=("produto",)).alias("a")).collect()]
    assert out == [["produto"], ["produto"]]


def test_export_csv_exact_roundtrip(spark, sheet, tmp_dir):
    path = f"{tmp_dir}/export"
    io.write_export_csv(sheet, path, exact=True)
    text = "".join(open(f, encoding="utf-8").read() for d in ("header", "lines")
                   for f in sorted(__import__("glob").glob(f"{path}/{d}/part-*")))
    whole = f"{tmp_dir}/export.csv"
    with open(whole, "w", encoding="utf-8") as f:
        f.write(text)
    back = io.read_label_sheet(spark, whole, io.SHEET_SCHEMA)
    a = sorted((r.review_id, r.review_text) for r in sheet.collect())
    b = [(r.review_id, r.review_text) for r in back.collect()]
    assert a == sorted(b)
    assert text.splitlines()[0] == HEADER
    assert '"Entrega atrasou\nmas o vendedor respondeu ""rápido""."' in text


def test_export_csv_parallel_roundtrip(spark, sheet, tmp_dir):
    path = f"{tmp_dir}/export-par"
    io.write_export_csv(sheet.repartition(3), path)
    back = io.read_label_sheet(spark, path, io.SHEET_SCHEMA)
    norm = lambda df: sorted(tuple("" if v is None else v for v in r) for r in df.collect())
    assert norm(back) == norm(sheet)


def test_label_state_json_roundtrip(spark, sheet):
    st = reports.label_state(clean.drop_removed(sheet))
    js = st.select("review_id", F.to_json("state").alias("j"))
    from aspectra.functions.labels import parse_label_state

    back = js.select("review_id", parse_label_state("j").alias("state"))
    a = sorted((r.review_id, tuple(sorted(r.state.categories.items())), r.state.toRemove) for r in st.collect())
    b = sorted((r.review_id, tuple(sorted(r.state.categories.items())), r.state.toRemove) for r in back.collect())
    assert a == b


def test_distribution_report(sheet):
    from aspectra.plans.jobs import distribution_report

    rep = distribution_report(sheet)
    assert rep.n_rows == 7 and rep.n_retained == 6
    flags = {r.value: r.n for r in rep.flag_counts.collect()}
    assert flags == {"não": 5, "sim": 1}  # a6 has no flag: dropped, as value_counts drops NaN
    classes = {r.label: r.n for r in rep.classes.collect()}
    assert classes["Logística_Pos"] == 2 and classes["Produto_Neg"] == 1 and classes["Preço_Pos"] == 1
    assert rep.total_labels.first().total_labels == sum(classes.values())
    assert rep.unlabelled.first().unlabelled == 1  # a6
    dist = {(r.sentiment_column, r.value): r.n for r in rep.sentiments.collect()}
    assert dist[("logistica_sentimento", "Neutro")] == 1
    assert dist[("produto_sentimento", "negativo")] == 1  # stripped, case kept for display


def test_train_and_score_from_sheet(spark, sheet):
    from aspectra.plans.jobs import score_texts, train_from_sheet

    model, w = train_from_sheet(sheet, max_iter=5)
    assert w.count() == 8
    texts = spark.createDataFrame([("t1", "Chegou rápido, produto ótimo."), ("t2", None)], "review_id string, text string")
    out = score_texts(model, texts).collect()
    assert len(out) == 2
    for r in out:
        assert len(r.probs) == 8 and len(r.y_pred) == 8
        # Never both polarities of one aspect
        assert all(r.y_pred[2 * k] + r.y_pred[2 * k + 1] <= 1 for k in range(4))
        assert (len(r.detected) > 0) != (r.fallback is not None)


def test_compare_with_trained_model(spark, sheet, tmp_dir):
    from aspectra.operators.predictors import ScoreRegexPredictor, TrainedModelPredictor
    from aspectra.plans.compare import compare_models
    from aspectra.plans.jobs import train_from_sheet

    model, _ = train_from_sheet(sheet, max_iter=5)
    preds = {"Baseline: Review Score": ScoreRegexPredictor(lexicon=NARROW_LEXICON),
             "Fine-Tuned": TrainedModelPredictor(model)}
    res = compare_models(sheet, preds, test_size=1.0)  # evaluate on every retained row of the tiny sheet
    m = {r.model: r for r in res.metrics.collect()}
    assert set(m) == set(preds)
    assert all(0.0 <= getattr(r, k) <= 1.0 for r in m.values() for k in ("f1_micro", "f1_macro", "exact_match"))
    assert res.per_class.count() == 16

    from aspectra.plans.jobs import comparison_report

    out = f"{tmp_dir}/metrics"
    rep = comparison_report(sheet, preds, "Fine-Tuned", out_path=out, test_size=1.0)
    gains = rep.gains.collect()
    assert [(g.baseline, g.model) for g in gains] == [("Baseline: Review Score", "Fine-Tuned")]
    f1 = {r.model: r.f1_macro for r in rep.metrics.collect()}
    expect = (f1["Fine-Tuned"] - f1["Baseline: Review Score"]) / max(f1["Baseline: Review Score"], 0.001) * 100
    assert gains[0].gain_pct == pytest.approx(expect)
    assert rep.chart.count() == 6 + 8
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2


def test_pandas_missing_markers_read_as_null(spark, tmp_dir):
    p = f"{tmp_dir}/na.csv"
    with open(p, "w", encoding="utf-8") as f:
        f.write(HEADER + "\n")
        f.write('b1,"texto NA ok",NA,null,None,Positivo,nan\n')
        f.write('b2,"NA",Negativo,,N/A,,Não\n')
    df = io.read_label_sheet(spark, p, io.SHEET_SCHEMA)
    rows = {r.review_id: r for r in df.collect()}
    assert rows["b1"].logistica_sentimento is None and rows["b1"].produto_sentimento is None
    assert rows["b1"].atendimento_sentimento is None and rows["b1"].to_remove is None
    assert rows["b1"].review_text == "texto NA ok" and rows["b2"].review_text is None
    kept = io.read_label_sheet(spark, p, io.SHEET_SCHEMA, na_values=())
    assert {r.review_id: r.logistica_sentimento for r in kept.collect()}["b1"] == "NA"


def test_weights_array_in_label_order(sheet):
    df = clean.drop_removed(sheet)
    df = df.withColumn("labels", encode_labels(df.columns))
    w = weights.class_weights(df)
    alpha = weights.weights_array(w).first().alpha
    assert alpha == [r.weight for r in w.orderBy("label_idx").collect()]


def test_unfitted_pipeline_fits(spark, sheet):
    from aspectra.operators import train

    df = clean.drop_removed(sheet).select(F.coalesce("review_text", F.lit("")).alias("text"),
                                          encode_labels(sheet.columns).alias("labels"))
    df = train.label_weight_columns(df.select("text", F.get("labels", 0).alias("y0"), F.get("labels", 3).alias("y3")),
                                    ["y0", "y3"])
    model = train.multilabel_pipeline(["y0", "y3"], "text", max_iter=3).fit(df)
    out = train.predict_multilabel(model, df, ["y0", "y3"])
    assert out.count() == df.count() and len(out.first().probs) == 2


def test_export_json_sink_roundtrip(spark, sheet, tmp_dir):
    path = f"{tmp_dir}/export-json"
    io.write_export_json(sheet, path)
    back = spark.read.json(path)
    assert sorted(r.review_id for r in back.collect()) == sorted(r.review_id for r in sheet.collect())
    assert {r.review_id: r.review_text for r in back.collect()}["a2"] == ROWS[1][1]


def test_exact_export_of_many_rows_is_ordered_part_files(spark, tmp_dir):
    path, n = f"{tmp_dir}/many", 20_000
    df = spark.range(n).select(F.format_string("%06d", (F.col("id") * 7919) % n).alias("review_id"),
                               F.lit("t").alias("review_text"), *[F.lit("").alias(c) for c in io.export_columns(None)[2:]])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of a small table
    try:
        io.write_export_csv(df, path, exact=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(__import__("glob").glob(f"{path}/lines/part-*"))
    assert len(files) > 1
    ids = [line.split(",")[0] for f in files for line in open(f, encoding="utf-8")]
    assert ids == sorted(ids) and len(ids) == n
