"""Aspect schema: labels, aspects, lexicons, thresholds and quotas.

Everything here is a parameter with the reference workflow's values as defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference workflow's values for results
# to agree.  Label order is part of the contract (even index = positive,
# odd index = negative of the same aspect).
# ---------------------------------------------------------------------------
LABELS = (
    "Logística_Pos", "Logística_Neg",
    "Produto_Pos", "Produto_Neg",
    "Atend_Pos", "Atend_Neg",
    "Preço_Pos", "Preço_Neg",
)
ASPECTS = ("logistica", "produto", "atendimento", "preco")
THRESHOLDS = {
    "Logística_Pos": 0.50, "Logística_Neg": 0.50,
    "Produto_Pos": 0.55, "Produto_Neg": 0.45,
    "Atend_Pos": 0.30, "Atend_Neg": 0.45,
    "Preço_Pos": 0.25, "Preço_Neg": 0.30,
}
DEFAULT_THRESHOLD = 0.5
# display names used by the labelling tool's stored categories
CATEGORY_NAMES = {
    "logistica": "Logística",
    "produto": "Produto",
    "atendimento": "Atendimento",
    "preco": "Preço",
}
SENTIMENTS = ("positivo", "negativo", "neutro")
QUOTA_ORDER = ("preco", "atendimento", "logistica", "produto")
QUOTAS = {"preco": 30, "atendimento": 30, "logistica": 40, "produto": 40}
SAMPLE_TARGET = 200
SAMPLE_SEED = 42
CAP_SEED = 99
SHUFFLE_SEED = 123
MIN_TEXT_LENGTH = 20
NEGATIVE_SCORES = (1, 2)
POSITIVE_SCORES = (4, 5)
KEEP_FLAG = "Não"
REMOVE_FLAG = "sim"
EMPTY_DISPLAY = "(vazio)"
EMBED_MAX_CHARS = 512
MAX_TOKENS = 128
POLARITY_DEADBAND = 0.02
GAIN_FLOOR = 0.001
FOCAL_GAMMA = 2.0
EARLY_STOP_PATIENCE = 3
MAX_EPOCHS = 20
# reference words whose embeddings form the two polarity centroids
# Reference words of the two polarities.
POSITIVE_WORDS = ("bom", "ótimo", "excelente", "perfeito", "adorei",
                  "amei", "recomendo", "rápido", "qualidade")
NEGATIVE_WORDS = ("ruim", "péssimo", "horrível", "terrível", "atraso",
                  "quebrado", "defeito", "demora", "problema")

# Wide lexicon (sample generation): alternatives inside \b( ... )\b, case-insensitive.
# The workflow's wide lexicon.
WIDE_LEXICON = {
    "logistica": [r"entreg\w*", "prazo", r"atraso\w*", r"atras\w*", r"demor\w*", r"cheg\w*",
                  "frete", r"transport\w*", r"correio\w*", r"envi\w*", "rastreio", r"rastream\w*",
                  r"embalag\w*", "caixa", "pacote", r"extravi\w*", "perder", r"perdid\w*"],
    "produto": ["produto", "qualidade", "material", "acabamento", r"funciona\w*", r"defeito\w*",
                r"quebr\w*", r"estrag\w*", r"danific\w*", "original", "falso", r"falsific\w*",
                "tamanho", "cor", "modelo", "foto", "imagem", r"descri\w*", r"especifica\w*",
                "usado", "novo", "velho", "bom", "ruim", "ótimo", r"péssim\w*", "excelente", "horrível"],
    "atendimento": [r"vendedor\w*", "loja", "atendimento", r"atend\w*", "resposta", r"respond\w*",
                    "contato", r"comunica\w*", "suporte", "ajuda", "solução", "resolver",
                    r"educad\w*", r"grosseir\w*", r"ignor\w*", "descaso", r"reclama\w*"],
    "preco": ["preço", "preco", "valor", "caro", r"barat\w*", "custo", "benefício", "beneficio",
              r"pag\w*", r"cobr\w*", "taxa", "desconto", "promoção", "promocao", "oferta",
              "dinheiro", "reais", r"R\$", r"compens\w*", r"econômic\w*", r"economic\w*"],
}

# Narrow lexicon (score + regex baseline); nothing found -> ["produto"].
NARROW_LEXICON = {
    "logistica": [r"entreg\w*", "prazo", r"atraso\w*", r"atras\w*", r"demor\w*", r"cheg\w*",
                  "frete", r"transport\w*", r"correio\w*", r"envi\w*", "rastreio",
                  r"embalag\w*", "caixa", "pacote", r"extravi\w*"],
    "produto": ["produto", "qualidade", "material", "acabamento", r"funciona\w*", r"defeito\w*",
                r"quebr\w*", r"estrag\w*", r"danific\w*", "original", "falso",
                "tamanho", "cor", "modelo", "foto", "imagem", r"descri\w*"],
    "atendimento": [r"vendedor\w*", "loja", "atendimento", r"atend\w*", "resposta", r"respond\w*",
                    "contato", r"comunica\w*", "suporte", "ajuda", "solução", "resolver",
                    r"educad\w*", r"grosseir\w*", r"ignor\w*", "descaso"],
    "preco": ["preço", "preco", "valor", "caro", r"barat\w*", "custo", "benefício", "beneficio",
              r"pag\w*", r"cobr\w*", "desconto", "promoção", "promocao", "oferta"],
}
NARROW_DEFAULT = ("produto",)

# Test lexicon for the multilingual driver tables (the Portuguese lexicons
# match almost nothing there).  Same form as above.
DRIVER_LEXICON = {
    "logistica": ["für", "mit", r"cheg\w*", r"envi\w*"],
    "produto": ["qui", "pour", r"ción\w*"],
    "atendimento": ["was", r"é\w*"],
    "preco": ["los", "del", "preço"],
}


@dataclass(frozen=True)
class AspectSchema:
    """Aspects, their label pairs and display names, in contract order."""

    aspects: tuple = ASPECTS
    labels: tuple = LABELS
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    default_threshold: float = DEFAULT_THRESHOLD
    category_names: dict = field(default_factory=lambda: dict(CATEGORY_NAMES))

    @property
    def sentiment_columns(self) -> tuple:
        return tuple(f"{a}_sentimento" for a in self.aspects)

    @property
    def n_labels(self) -> int:
        return len(self.labels)

    def pair(self, aspect: str) -> tuple[int, int]:
        i = self.aspects.index(aspect)
        return 2 * i, 2 * i + 1

    def threshold_list(self) -> list[float]:
        return [float(self.thresholds.get(lbl, self.default_threshold)) for lbl in self.labels]


DEFAULT_SCHEMA = AspectSchema()

LABEL_DIM_SCHEMA = T.StructType([
    T.StructField("label_idx", T.IntegerType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("aspect", T.StringType(), False),
    T.StructField("polarity", T.StringType(), False),
    T.StructField("threshold", T.DoubleType(), True),
])


def label_rows(schema: AspectSchema = DEFAULT_SCHEMA, with_thresholds: bool = True) -> list[tuple]:
    """``(label_idx, label, aspect, polarity, threshold)`` of every label."""
    rows = []
    for i, lbl in enumerate(schema.labels):
        thr = schema.thresholds.get(lbl) if with_thresholds else None
        rows.append((i, lbl, schema.aspects[i // 2], "Pos" if i % 2 == 0 else "Neg", None if thr is None else float(thr)))
    return rows


def label_dimension(spark: SparkSession, schema: AspectSchema = DEFAULT_SCHEMA,
                    with_thresholds: bool = True) -> DataFrame:
    """The 8-row label dimension (F6).  Tiny and fixed-size: safe to broadcast."""
    return spark.createDataFrame(label_rows(schema, with_thresholds), LABEL_DIM_SCHEMA)
