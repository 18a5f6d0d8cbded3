"""Pieces of text on printed pages: which lie inside a page's margins, by rules of precedence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(margins: Column, side: str, page: Column) -> Column:
    """A margin in percent: that of the page, else that of all pages, else that of even or odd ones, else none. margins: map of a side to a map of such a key to a number."""
    own = F.try_element_at(margins, F.lit(side))
    of = lambda key: F.try_element_at(own, key)
    return F.coalesce(of(page.cast("string")), of(F.lit("all")), of(F.when(page % 2 == 0, "even").otherwise("odd")), F.lit(0.0))


def _edges(margins: Column, prefix: str, page: Column, width: Column, height: Column) -> dict[str, Column]:
    """Places of the four margins in whole units."""
    near = lambda side, size: (share(margins, f"{prefix}{side}_margin", page) * size / 100.0).cast("int")
    far = lambda side, size: (size - share(margins, f"{prefix}{side}_margin", page) * size / 100.0).cast("int")
    return {"left": near("left", width), "right": far("right", width), "top": near("top", height), "bottom": far("bottom", height)}


def inside(rows: DataFrame, margins: str = "margins") -> DataFrame:
    """Pieces (page, left, top, width and height of the page) inside the margins and not inside the inner ones, which leave out what is in the middle. Inner margins that are all nothing leave out nothing."""
    c = F.col

    def within(prefix: str) -> tuple[Column, Callable[[], Column]]:
        e = _edges(c(margins), prefix, c("page"), c("width"), c("height"))
        hit = (c("top") > e["top"]) & (c("top") < e["bottom"]) & (c("left") > e["left"]) & (c("left") < e["right"])
        return hit, lambda: (e["left"] == 0) & (e["top"] == 0) & (e["right"] == c("width")) & (e["bottom"] == c("height"))

    (outer, _), (inner, nothing) = within(""), within("inner_")
    return rows.where(outer & ~(inner & ~nothing()))
