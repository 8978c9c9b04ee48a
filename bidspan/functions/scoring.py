"""Score, priority, rank fusion and other numeric rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidspan.functions import classify, dates
from bidspan.functions import text as tx

# --- fixed values: default keywords and weights -------------------------------
KEYWORDS = [
    "obra", "construção", "reforma", "engenharia", "pavimentação", "drenagem", "manutenção predial",
    "infraestrutura", "escola", "hospital", "praça", "urbanização", "terraplenagem", "concreto",
    "cobertura", "elétrica", "hidráulica",
]
DOCUMENT_SHARES = {"projeto": 0.5, "orcamento": 0.35, "edital": 0.15}
BONUS_MODALITIES = ["Concorrência", "Tomada de Preços", "RDC"]
BONUS = 4
RRF_K = 60


@dataclass(frozen=True)
class ScoreConfig:
    keywords: list[str] = field(default_factory=lambda: list(KEYWORDS))
    weight_words: int = 45
    weight_documents: int = 30
    weight_value: int = 17
    min_recommended: int = 60
    bonus_modalities: list[str] = field(default_factory=lambda: list(BONUS_MODALITIES))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur, accents and case ignored."""
    plain = [classify.plain_fold(w) for w in words]
    return tx.let(tx.fold(text), lambda f: sum((F.contains(f, F.lit(w)).cast("int") for w in plain), F.lit(0)))


def value_band(value: Column) -> Column:
    return (
        F.when(value.isNull(), 0.25)
        .when(value >= 1_000_000, 1.0)
        .when(value >= 300_000, 0.75)
        .when(value >= 100_000, 0.5)
        .otherwise(0.25)
    )


def score(
    object_: Column,
    modality: Column,
    value: Column,
    category: Column,
    has_type: dict[str, Column] | None = None,
    config: ScoreConfig = ScoreConfig(),
) -> Column:
    """Adherence 0..100. ``has_type`` maps a document type to a boolean column."""
    words = F.least(F.lit(1.0), keyword_hits(object_, config.keywords) / 3) * config.weight_words
    share = F.lit(0.0)
    for doc_type, weight in DOCUMENT_SHARES.items():
        if has_type and doc_type in has_type:
            share = share + F.when(F.coalesce(has_type[doc_type], F.lit(False)), weight).otherwise(0.0)
    documents = F.least(F.lit(1.0), share) * config.weight_documents
    bonus = F.when(modality.isin(config.bonus_modalities), BONUS).otherwise(0)
    bonus = bonus + F.when(category != classify.OTHER_CATEGORY, BONUS).otherwise(0)
    total = words + documents + value_band(value) * config.weight_value + bonus
    return F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(total).cast("int")))


def score_cut(min_recommended: Column | int, weight_documents: Column | int) -> Column:
    a = min_recommended if isinstance(min_recommended, Column) else F.lit(min_recommended)
    b = weight_documents if isinstance(weight_documents, Column) else F.lit(weight_documents)
    return F.greatest(a - b, F.lit(0))


def priority_class(
    priority: Column, team_status: Column, open_now: Column, score_: Column, min_score: int, accessed_at: Column
) -> Column:
    return (
        F.when(priority | team_status.isin("interessante", "em_analise"), 0)
        .when(open_now & (score_ >= min_score), 1)
        .when(accessed_at.isNotNull(), 2)
        .otherwise(3)
    )


def density(chars: Column, pages: Column) -> Column:
    return F.when(pages > 0, F.round(chars / pages, 1))


def rrf(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    return F.lit(float(weight)) / (F.lit(k) + rank)


def backoff_ms(attempt: Column) -> Column:
    return F.when(attempt <= 2, attempt * 15_000).otherwise(60_000)


def percent(applied: Column, estimated: Column) -> Column:
    return F.when(estimated > 0, F.least(F.lit(100), round_half_up(applied * 100 / estimated)).cast("int"))


def relative_gain(base: Column, candidate: Column) -> Column:
    return F.when(base != 0, (candidate - base) / base)


def due_score(config: ScoreConfig) -> Column:
    return score_cut(config.min_recommended, config.weight_documents)


def bid_priority(now: Column, min_score: int) -> Column:
    """``priority_class`` over the catalogue's own column names."""
    open_now = dates.is_open(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now)
    return priority_class(
        F.col("priority"), F.col("team_status"), open_now, F.col("score"), min_score, F.col("accessed_at")
    )
