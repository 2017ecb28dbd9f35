"""Plans as text, with vector literals masked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_VECTOR = re.compile(r"[\[{]\s*-?[0-9][0-9eE.+\-]*(?:\s*,\s*-?[0-9][0-9eE.+\-]*)*\s*[\]}]|array\((?:-?[0-9][0-9eE.+\-]*[DFL]?,?\s*)+\)")


def masked_explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan of ``df`` in a mode of ``explain``; vectors are ``[MASKED_VECTOR]`` and expression ids are gone."""
    jdf = df._jdf.queryExecution()
    text = jdf.explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return mask_plan(text)


def mask_plan(text: str) -> str:
    return _VECTOR.sub("[MASKED_VECTOR]", re.sub(r"#\d+L?", "", text))


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, in the order of the plan's text."""
    return re.findall(r"^\(\d+\) (\w+)", masked_explain(df), re.M)
