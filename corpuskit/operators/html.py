"""HTML cleaning as Spark jobs.

``clean_html`` is the native form (one Catalyst expression, see
``corpuskit.functions.html``).  ``clean_html_parser`` runs a real HTML
parser per row inside an Arrow-batched pandas UDF, for markup the regex
form cannot follow (``>`` inside attribute values, broken nesting).
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import HIDDEN_ELEMENTS, RAW_ELEMENTS, html_to_text


def clean_html(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, html_to_text(F.col(col)))


class _TextNodes(HTMLParser):
    """Collects stripped, non-empty text nodes outside no-text elements."""

    _SKIP = {*RAW_ELEMENTS, *HIDDEN_ELEMENTS}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._buf: list[str] = []
        self._skipped: list[str] = []  # open elements without text

    def _flush(self) -> None:
        if self._buf:
            text = "".join(self._buf).strip()
            if text:
                self.parts.append(text)
            self._buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in self._SKIP:
            self._skipped.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_endtag(self, tag):
        self._flush()
        if tag == "ruby":  # ends the annotations that it holds
            self._skipped = [t for t in self._skipped if t not in ("rt", "rp")]
        elif tag in self._skipped:
            self._skipped.remove(tag)

    def handle_data(self, data):
        if not self._skipped:
            self._buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()


def parse_text(html: str | None) -> str:
    """Per-row helper: text nodes of one document joined by a space."""
    if not html:
        return ""
    p = _TextNodes()
    p.feed(html)
    p.close()
    p._flush()
    return " ".join(p.parts)


@F.pandas_udf(T.StringType())
def _parse_text_udf(s: pd.Series) -> pd.Series:
    return s.map(parse_text)


def html_to_text_parser(col: Column) -> Column:
    return _parse_text_udf(col)


def clean_html_parser(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, html_to_text_parser(F.col(col)))
