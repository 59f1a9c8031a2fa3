"""User extensions: classes run per partition, and native example columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.base import as_col

SUMMARY_CHARS = 200


class Plugin:
    """One output record per page.

    ``initialize`` runs once per partition, ``process`` per page and
    ``shutdown`` at the end of the partition, also after a failure.
    """

    schema = "url string"

    def initialize(self) -> None:
        pass

    def process(self, url: str, page: dict[str, Any]) -> dict[str, Any]:
        raise NotImplementedError

    def shutdown(self) -> None:
        pass


class PluginError(Exception):
    pass


_registry: dict[str, type[Plugin]] = {}


def register(name: str, plugin: type[Plugin]) -> None:
    if not (isinstance(plugin, type) and issubclass(plugin, Plugin)):
        raise PluginError(f"not a plugin: {name}")
    _registry[name] = plugin


def list_plugins() -> list[str]:
    return sorted(_registry)


def apply_plugin(df: DataFrame, name: str, **options: Any) -> DataFrame:
    if name not in _registry:
        raise PluginError(f"unknown plugin: {name}")
    plugin = _registry[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = plugin(**options)
        worker.initialize()
        try:
            for batch in batches:
                records = [worker.process(row["url"], row) for row in batch.to_dict("records")]
                if records:
                    yield pd.DataFrame(records)
        finally:
            worker.shutdown()

    return df.mapInPandas(run, plugin.schema)


def apply_all(df: DataFrame) -> tuple[dict[str, DataFrame], dict[str, Exception]]:
    """Outputs of all plugins that load; the others are named with the error."""
    outputs: dict[str, DataFrame] = {}
    failed: dict[str, Exception] = {}
    for name in list_plugins():
        try:
            outputs[name] = apply_plugin(df, name)
        except Exception as error:
            failed[name] = error
    return outputs, failed


def plugin_custom_fields(url: Column | str, html: Column | str) -> Column:
    return F.struct(
        F.lit("custom_value").alias("custom_field"),
        as_col(url).alias("url"),
        F.coalesce(F.length(as_col(html)), F.lit(0)).alias("content_length"),
    )


def plugin_summary(url: Column | str, html: Column | str) -> Column:
    text = F.coalesce(as_col(html), F.lit(""))
    summary = F.when(
        F.length(text) > SUMMARY_CHARS, F.concat(F.left(text, F.lit(SUMMARY_CHARS)), F.lit("..."))
    ).otherwise(text)
    return F.struct(
        summary.alias("summary"), as_col(url).alias("url"), F.length(summary).alias("summary_length")
    )


def plugin_file_size(url: Column | str, content: Column | str) -> Column:
    return F.struct(
        as_col(url).alias("url"),
        F.coalesce(F.octet_length(as_col(content)), F.lit(0)).alias("file_size"),
        F.lit(True).alias("downloaded"),
    )
