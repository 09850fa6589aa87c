"""Semantic scores: a scorer turns clean messages into roberta_score and semantic_model_applied_flag."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module
from importlib.util import find_spec
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import semantic_settings
from ..functions.text import has_semantic_input, semantic_input

#: Checkpoints without a trained classification head, which must not be used for scoring.
UNTRAINED_MODELS = ("xlmr_base_multilingual", "xlm-roberta-base", "FacebookAI/xlm-roberta-base")


class Scorer(Protocol):
    def apply(self, df: DataFrame, config: dict[str, Any]) -> DataFrame: ...


def is_supported(language: Column, languages) -> Column:
    """Whether a language is among those a model knows; "all" and "*" stand for every one."""
    wanted = [x.lower() for x in languages]
    return F.lit(True) if {"all", "*"} & set(wanted) else F.coalesce(F.lower(language).isin(*wanted), F.lit(False))


class NeutralScorer:
    """No model: every score is neutral."""

    def apply(self, df: DataFrame, config: dict[str, Any]) -> DataFrame:
        score = float(semantic_settings(config)["unsupported_language_score"])
        return df.withColumns({"roberta_score": F.lit(score), "semantic_model_applied_flag": F.lit(0).cast("byte")})


class ExpressionScorer:
    """A score computed by a column expression of the clean row, where language and text allow one; for tests and rules."""

    def __init__(self, expression: Callable[[], Column]) -> None:
        self.expression = expression

    def apply(self, df: DataFrame, config: dict[str, Any]) -> DataFrame:
        settings = semantic_settings(config)
        ok = is_supported(F.col("language"), settings["supported_languages"]) & has_semantic_input(F.col("normalized_text"))
        score = F.when(ok, self.expression().cast("float").cast("double")).otherwise(float(settings["unsupported_language_score"]))
        return df.withColumns({"roberta_score": score, "semantic_model_applied_flag": ok.cast("byte")})


class ModelScorer:
    """Scores from a function loaded once in each Python worker: ``load(settings)`` returns texts -> probabilities of class 1."""

    def __init__(self, load: Callable[[dict[str, Any]], Callable[[list[str]], list[float]]]) -> None:
        self.load = load

    def apply(self, df: DataFrame, config: dict[str, Any]) -> DataFrame:
        settings = semantic_settings(config)
        if not settings["enabled"]:
            return NeutralScorer().apply(df, config)
        check_model_name(settings)
        load, size = self.load, int(settings["batch_size"])

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load(settings)
            for texts in batches:
                some = texts[texts.notna()]
                scores = [s for k in range(0, len(some), size) for s in model(some.iloc[k : k + size].tolist())]
                yield pd.Series(scores, index=some.index, dtype="float64").reindex(texts.index)

        text = semantic_input(F.col("normalized_text"))
        ok = is_supported(F.col("language"), settings["supported_languages"]) & (text != "")
        score = predict(F.when(ok, text))
        return df.withColumn("_score", score).withColumns({"roberta_score": F.coalesce("_score", F.lit(float(settings["unsupported_language_score"]))), "semantic_model_applied_flag": F.col("_score").isNotNull().cast("byte")}).drop("_score")


def scorer_for(config: dict[str, Any]) -> Scorer:
    """The scorer that the settings ask for: a model where one is named and enabled, else a neutral one.

    ``loader`` may name another function than ``transformer_loader``, as "module:function".
    """
    settings = semantic_settings(config)
    if not settings["enabled"] or not settings.get("model_name"):
        return NeutralScorer()
    check_model_name(settings)
    if settings.get("loader"):
        module, _, name = settings["loader"].partition(":")
        return ModelScorer(getattr(import_module(module), name))
    absent = [m for m in ("torch", "transformers") if find_spec(m) is None]
    if absent:
        raise ImportError(f"{settings['model_name']} needs {', '.join(absent)}; install them, name a loader or set semantic_adapter.enabled to false")
    return ModelScorer(transformer_loader)


def check_model_name(settings: dict[str, Any]) -> None:
    name = str(settings.get("model_name") or settings.get("selected_model_key") or "")
    if name in UNTRAINED_MODELS:
        raise ValueError(f"{name} has no trained classification head; name a fine-tuned checkpoint")


def pick_device(wanted: str, cuda: bool, mps: bool) -> str:
    """The device asked for, or the best there is."""
    if wanted != "auto":
        return wanted
    return "cuda" if cuda else "mps" if mps else "cpu"


def transformer_loader(settings: dict[str, Any]) -> Callable[[list[str]], list[float]]:
    """Loads a sequence classifier where the optional libraries are installed."""
    import torch
    from transformers import AutoModelForSequenceClassification, AutoTokenizer

    device = pick_device(settings["device"], torch.cuda.is_available(), torch.backends.mps.is_available())
    tokenizer = AutoTokenizer.from_pretrained(settings["model_name"])
    model = AutoModelForSequenceClassification.from_pretrained(settings["model_name"]).to(device).eval()

    def score(texts: list[str]) -> list[float]:
        with torch.no_grad():
            batch = tokenizer(texts, truncation=True, max_length=settings["max_length"], padding=True, return_tensors="pt").to(device)
            return torch.softmax(model(**batch).logits, dim=-1)[:, 1].float().cpu().tolist()

    return score
