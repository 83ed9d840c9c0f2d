"""Landed HTML pages -> paragraphs and anchors.

Only the tag soup is read in Python, one page at a time inside Spark tasks.
What a paragraph means (scene, credit, speaker, text) is decided by column
expressions in :mod:`turnloom.operators.transcript`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from turnloom import fixed

# --- fixed values: elements without an end tag, and elements whose text is not prose ---
VOID = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param",
    "source", "spacer", "track", "wbr",
))
NOT_PROSE = frozenset(("rp", "rt", "script", "style", "template"))
ITALICS = frozenset(("em", "i"))

_CHUNK_CHARS = 4_000_000


class _Element:
    """A slice of the page's text pieces, and how deep its start tag was nested."""

    __slots__ = ("href", "inside", "start", "end", "hidden", "italics")

    def __init__(self, href: str | None, inside: bool, start: int, hidden: int, italics: int):
        self.href, self.inside, self.start, self.end = href, inside, start, None
        self.hidden, self.italics = hidden, italics


class ElementTexts(HTMLParser):
    """Texts of every ``wanted`` element, in the order of their start tags.

    Tags nest exactly as written: an unclosed element runs on until an ancestor
    closes, and an end tag without a start tag is ignored.
    """

    def __init__(self, wanted: str):
        super().__init__(convert_charrefs=False)
        self.wanted = wanted
        self.found: list[_Element] = []
        self.has_container = False
        self._pieces: list[tuple[str, int, int]] = []  # text, hidden depth, italics depth
        self._open: list[tuple[str, _Element | None]] = []
        self._open_names: Counter[str] = Counter()
        self._hidden = self._italics = 0
        self._container_at: int | None = None

    def read(self, html: str) -> list[_Element]:
        self.feed(html)
        self.close()
        return self.found

    def in_container(self) -> list[_Element]:
        """Elements inside the first content container, or all without one."""
        return [e for e in self.found if e.inside] if self.has_container else self.found

    def full(self, element: _Element) -> str:
        pieces = self._pieces[element.start:element.end]
        return "".join([text for text, hidden, _ in pieces if not hidden])

    def plain(self, element: _Element) -> str:
        """Text outside italics and scripts that open within the element."""
        pieces = self._pieces[element.start:element.end]
        return "".join([
            text for text, hidden, italics in pieces
            if hidden == element.hidden and italics == element.italics])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        attributes = {name: value or "" for name, value in attrs}
        if tag == "div" and not self.has_container and any(
                c in attributes.get("class", "") for c in fixed.CONTAINER_CLASSES):
            self.has_container, self._container_at = True, len(self._open)
        self._shift(tag, 1)
        element = None
        if tag == self.wanted:
            element = _Element(
                attributes.get("href"), self._container_at is not None, len(self._pieces),
                self._hidden, self._italics)
            self.found.append(element)
        self._open.append((tag, element))
        self._open_names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        while self._open_names[tag]:
            name, element = self._open.pop()
            self._open_names[name] -= 1
            if element is not None:
                element.end = len(self._pieces)
            self._shift(name, -1)
            if self._container_at == len(self._open):
                self._container_at = None
            if name == tag:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self._pieces.append((data, self._hidden, self._italics))

    def handle_entityref(self, name: str) -> None:
        self.handle_data(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name: str) -> None:
        code = int(name[1:], 16) if name[:1] in "xX" else int(name)
        try:
            # Codes below 256 are read as Windows-1252 bytes, as browsers do.
            text = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
        except (UnicodeDecodeError, ValueError, OverflowError):
            text = chr(code) if code < 256 else "\N{REPLACEMENT CHARACTER}"
        self.handle_data(text)

    def unknown_decl(self, data: str) -> None:
        if data.upper().startswith("CDATA["):
            self.handle_data(data[len("CDATA["):])

    def _shift(self, tag: str, by: int) -> None:
        self._italics += by if tag in ITALICS else 0
        self._hidden += by if tag in NOT_PROSE else 0


def _extract(
    pages: DataFrame, keys: Sequence[str], html: str, wanted: str, only_container: bool,
    columns: dict[str, str],
) -> DataFrame:
    """One row per wanted element, streamed out in chunks of bounded size."""
    inputs = pages.select(*keys, html)
    schema = T.StructType(
        [inputs.schema[k] for k in keys]
        + [T.StructField("place", T.IntegerType())]
        + [T.StructField(name, T.StringType()) for name in columns.values()])
    names = schema.names
    fields = list(columns)
    read_field = {
        "href": lambda parser, element: element.href, "full": ElementTexts.full, "plain": ElementTexts.plain}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for page in batch.itertuples(index=False, name=None):
                parser = ElementTexts(wanted)
                elements = parser.read(page[-1] or "")
                for place, element in enumerate(parser.in_container() if only_container else elements):
                    values = [read_field[f](parser, element) for f in fields]
                    rows.append((*page[:-1], place, *values))
                    size += sum(len(v) for v in values if v)
                    if size > _CHUNK_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return inputs.mapInPandas(read, schema)


def paragraphs(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """``keys, place, full_text, plain_text`` of the content container's paragraphs.

    ``plain_text`` leaves out italics, which hold stage directions. Nested
    paragraphs each get their own row, and the outer one includes their text.
    """
    return _extract(pages, keys, html, "p", True, {"full": "full_text", "plain": "plain_text"})


def paragraph_arrays(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """``keys, paragraphs``: the same paragraphs in order, one row per page."""
    inputs = pages.select(*keys, html)
    one = T.StructType([T.StructField("full_text", T.StringType()), T.StructField("plain_text", T.StringType())])
    schema = T.StructType([inputs.schema[k] for k in keys] + [T.StructField("paragraphs", T.ArrayType(one))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for page in batch.itertuples(index=False, name=None):
                parser = ElementTexts("p")
                parser.read(page[-1] or "")
                texts = [{"full_text": parser.full(x), "plain_text": parser.plain(x)} for x in parser.in_container()]
                rows.append((*page[:-1], texts))
                size += sum(len(x["full_text"]) + len(x["plain_text"]) for x in texts)
                if size > _CHUNK_CHARS:
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=schema.names)

    return inputs.mapInPandas(read, schema)


def anchors(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """``keys, place, href, text`` of every anchor with a target."""
    found = _extract(pages, keys, html, "a", False, {"href": "href", "full": "text"})
    return found.filter("href is not null")


# --- in SQL ---

_FIELDS = {
    "a": {"href": lambda parser, x: x.href, "text": ElementTexts.full},
    "p": {"full_text": ElementTexts.full, "plain_text": ElementTexts.plain},
}


class PageElements:
    """``page_elements(html, kind)``: the rows of :func:`anchors` (kind 'a') or :func:`paragraphs` ('p')."""

    @staticmethod
    def analyze(html: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in _FIELDS:
            raise ValueError(f"page_elements knows the kinds {sorted(_FIELDS)}")
        fields = [T.StructField(name, T.StringType()) for name in _FIELDS[kind.value]]
        return AnalyzeResult(T.StructType([T.StructField("place", T.IntegerType()), *fields]))

    def eval(self, html: str, kind: str) -> Iterator[tuple]:
        parser = ElementTexts(kind)
        elements = parser.read(html or "")
        for place, element in enumerate(parser.in_container() if kind == "p" else elements):
            if kind == "p" or element.href is not None:
                yield (place, *(read(parser, element) for read in _FIELDS[kind].values()))


def register_functions(spark: SparkSession) -> None:
    """Make ``page_elements`` known to SQL: ``SELECT ... FROM pages, LATERAL page_elements(html, 'a')``."""
    spark.udtf.register("page_elements", F.udtf(PageElements, useArrow=True))
