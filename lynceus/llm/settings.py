"""Production settings the queries and the pipeline share."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lynceus.llm.base import table


def vocabulary(name: str) -> str:
    """A public tokenizer file; LYNCEUS_TOKENIZERS names another folder that holds such files."""
    folder = os.environ.get("LYNCEUS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_ids(spark, sf):
    """Documents that people marked as good."""
    return table(spark, sf, "labels").where("quality = 1").select("doc_id")


def form_topic(text="text"):
    """A document's topic here is its form: what kind of marks it holds."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "tabular").when(t.contains("@"), "contact").when(t.rlike("[0-9]{3}"), "figures")
        .when(F.length(t) < 1000, "short").otherwise("prose"))
