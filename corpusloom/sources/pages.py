"""Documents page by page: rendering by an injected function, text layers into lines, image strips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_rows(files: DataFrame, first: str = "first_page", last: str = "last_page") -> DataFrame:
    """A row for each page of a file's range."""
    return files.withColumn("page", F.explode(F.sequence(first, last)))


def render_pages(pages: DataFrame, renderer: Callable[[bytes, int, int], bytes], dpi: int = 200) -> DataFrame:
    """pages: path, content, page. path, page, image: what the renderer (content, page, dpi) makes of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [renderer(content, int(page), dpi) for content, page in zip(pdf["content"], pdf["page"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "page": pdf["page"], "image": images})

    return pages.select("path", "content", "page").mapInPandas(run, "path string, page int, image binary")


def render_missing(pages: DataFrame, existing: DataFrame, renderer: Callable[[bytes, int, int], bytes], dpi: int = 200) -> DataFrame:
    """path, page, image of all pages: images there are (path, page, image, of this resolution) stay, the others are rendered."""
    known = existing.select("path", F.col("page").cast("int").alias("page"), "image")
    todo = pages.join(known.select("path", "page"), ["path", "page"], "left_anti")
    kept = known.join(pages.select("path", "page"), ["path", "page"], "left_semi")
    return kept.unionByName(render_pages(todo, renderer, dpi))


def _lines(y_tolerance: float, gap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf[pdf["text"].fillna("").str.strip() != ""].copy()
        items["y"] = (items["y0"] + items["y1"]) / 2
        items = items.sort_values(["y", "x0"], ascending=[False, True], kind="stable")
        anchors: list[float] = []
        members: list[list] = []
        for item in items.itertuples():
            # The first line whose own first item is near enough, not the nearest one.
            at = next((k for k, y in enumerate(anchors) if abs(y - item.y) <= y_tolerance), None)
            if at is None:
                anchors.append(item.y)
                members.append([item])
            else:
                members[at].append(item)
        out = []
        for line in members:
            text, end = "", None
            for item in sorted(line, key=lambda i: i.x0):
                text += (" " if end is not None and item.x0 - end > gap else "") + " ".join(item.text.split())
                end = item.x1
            out.append(" ".join(text.split()))
        keys = pdf[["path", "page"]].iloc[0]
        rows = [t for t in out if t]
        return pd.DataFrame({"path": [keys["path"]] * len(rows), "page": [keys["page"]] * len(rows), "line_no": range(len(rows)), "text": rows})

    return run


def text_lines(rects: DataFrame, y_tolerance: float = 4.0, gap: float = 2.0) -> DataFrame:
    """rects: path, page, text, x0, y0, x1, y1. path, page, line_no, text: from top to bottom, by the first item of a line."""
    return rects.groupBy("path", "page").applyInPandas(_lines(y_tolerance, gap), "path string, page int, line_no int, text string")


def crop_rows(image: np.ndarray, white: int = 250, margin: int = 10) -> np.ndarray:
    """Without the rows above and below whose mean is white, but for a margin."""
    means = image.reshape(len(image), -1).mean(1)
    ink = np.flatnonzero(means < white)
    return image if not len(ink) else image[max(0, ink[0] - margin) : ink[-1] + margin + 1]


def stitch(images: list[np.ndarray], pad: int = 20) -> np.ndarray:
    """Cropped images below one another on white, as wide as the widest, pad rows between."""
    cropped = [crop_rows(i) for i in images]
    width = max(i.shape[1] for i in cropped)
    rows = []
    for k, i in enumerate(cropped):
        if k:
            rows.append(np.full((pad, width, *i.shape[2:]), 255, i.dtype))
        rows.append(np.concatenate([i, np.full((len(i), width - i.shape[1], *i.shape[2:]), 255, i.dtype)], axis=1))
    return np.concatenate(rows)
