"""Images at remote addresses: fetched once for each address, on the executors, only where a fetcher is given."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.images import fetchable, image_name, usable_download

#: Seconds that one address may take.
TIMEOUT = 30


def http_fetch(url: str) -> bytes:
    """The body at an address; to be passed on where the network may be used."""
    import urllib.request

    with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:  # noqa: S310 - only http(s) gets here
        return answer.read()


def fetched(sources: DataFrame, fetch: Callable[[str], bytes] | None = None, src: str = "src") -> DataFrame:
    """Adds ``name`` and ``content`` of each source; null where nothing usable came.

    Addresses are made distinct and dealt out before they are fetched.  Without ``fetch`` nothing is.
    """
    if fetch is None:
        return sources.withColumn("name", F.lit(None).cast("string")).withColumn("content", F.lit(None).cast("binary"))

    def run(batches):
        for batch in batches:
            out = []
            for url in batch["_url"]:
                try:
                    out.append((url, fetch(url)))
                except Exception:  # noqa: BLE001 - whatever fails at one address, the others go on
                    out.append((url, None))
            yield pd.DataFrame(out, columns=["_url", "content"])

    asked = sources.where(fetchable(F.col(src))).select(F.col(src).alias("_url")).distinct()
    got = asked.repartition("_url").mapInPandas(run, "_url string, content binary").where(usable_download(F.col("_url"), F.col("content")))
    named = got.withColumn("name", image_name(F.col("_url"), F.col("content")))
    return sources.join(named, F.col(src) == F.col("_url"), "left").select(*sources.columns, "name", "content")
