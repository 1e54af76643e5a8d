"""The seam for recognition engines: binary pages in, positioned regions out.

An engine is a function from (name, bytes) to regions (x0, y0, x1, y1, kind, markdown, confidence, vertical).  It is made
once per Python worker, so that a model is loaded once; pages that raise are kept with their error.  Only a fixed engine is
shipped; engines with models or a network register under their own names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Region = tuple[float, float, float, float, str, str, float, bool]
Engine = Callable[[str, bytes], list[Region]]
ENGINES: dict[str, Callable[[], Engine]] = {}
SCHEMA = "name string, regions array<struct<x0:double,y0:double,x1:double,y1:double,kind:string,markdown:string,confidence:double,vertical:boolean>>, error string"


def register(name: str, make: Callable[[], Engine]) -> None:
    ENGINES[name] = make


def _fixed() -> Engine:
    """Four regions of an invoice that name the page's file, for tests of what follows recognition."""
    table = "| 品目 | 数量 | 単価 | 金額 |\n| --- | --- | --- | --- |\n| サンプル品目A | 2 | ¥1,000 | ¥2,000 |\n| サンプル品目B | 1 | ¥5,000 | ¥5,000 |"

    def recognise(name: str, _: bytes) -> list[Region]:
        return [
            (50, 40, 550, 80, "title", "# 請求書", 0.99, False),
            (50, 100, 550, 140, "text", f"株式会社サンプル 御中 (mock page: {name.rsplit('.', 1)[0]})", 0.97, False),
            (50, 160, 550, 320, "table", table, 0.93, False),
            (300, 340, 550, 380, "text", "合計: ¥7,000 (税込)", 0.95, False),
        ]

    return recognise


register("mock", _fixed)


def recognised(pages: DataFrame, engine: str = "mock", attempts: int = 3) -> DataFrame:
    """(name, regions, error) of pages (name, content); a page that fails ``attempts`` times has its error and no regions."""
    make = ENGINES[engine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = make()
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                regions, error = None, None
                for _ in range(attempts):
                    try:
                        regions, error = recognise(name, bytes(content)), None
                        break
                    except Exception as reason:  # a page's failure is a result
                        error = str(reason)[:500]
                rows.append((name, regions, error))
            yield pd.DataFrame(rows, columns=["name", "regions", "error"])

    return pages.select("name", "content").mapInPandas(run, SCHEMA)
