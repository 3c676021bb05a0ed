"""XML sources S1-S3 (and the writers used to derive XML from tables).

Articles and ground truth are scanned alike.  A text scan with ``lineSep='</article>'`` (``'>'`` for ground truth, whose
elements are often self-closing and matter by their attributes alone) is splittable and gives each task its records in file order; a small state machine in the task walks over them, knows comments, CDATA
sections, processing instructions and quoted attributes, joins records that such a section cut in two, and hands
each complete ``<article>`` element (self-closing ones too) to the parser.  Every element gives one row: an element
that does not parse gives a row with its fragment and the error.  ``on_error='raise'`` (default, like the
reference) fails the job on it; ``'quarantine'`` leaves it out of the result, and ``rejected_articles`` returns it.
A comment or CDATA section that holds ``</article>`` and runs over the end of a split is an error too (read such a
file with a larger ``spark.sql.files.maxPartitionBytes``).

Text extraction (S2): ``lead`` (reference parity) is the leading text of every element in the order in which the
elements end, tails are never read; ``full`` is every text node in document order.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</article>"
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<\?|<article(?=[\s>/])")
_CLOSE = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
_START_TAG = re.compile(r"<article(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")

SCAN_SCHEMA = ("article_id string, title string, published_at string, article_text string, url string, "
               "hyperpartisan string, bias string, labeled_by string, fragment string, error string")


def lead_text(element: ET.Element) -> str:
    """The leading texts of all elements under ``element`` (itself included) in the order in which they end."""
    last_first, stack = [], [element]
    while stack:
        e = stack.pop()
        last_first.append(e.text or "")
        stack.extend(e)
    return "".join(reversed(last_first))


class ArticleScanner:
    """Elements from the records of one file, fed in order; ``finish`` reports what is left open."""

    def __init__(self):
        self.text, self.at, self.depth, self.start = "", 0, 0, 0

    def feed(self, record: str) -> Iterator[str]:
        """Complete elements once this record, which an end tag followed, is read."""
        self.text += record
        while True:
            m = _TOKEN.search(self.text, self.at)
            if m is None:
                break
            if m.group() in _CLOSE:
                close = self.text.find(_CLOSE[m.group()], m.end())
                if close < 0:  # the section goes on: the end tag was part of it
                    self.at = m.start()
                    self.text += END
                    return
                self.at = close + len(_CLOSE[m.group()])
                continue
            tag = _START_TAG.match(self.text, m.start())
            if tag is None:
                yield self.text[m.start():] + END
                self._drop(len(self.text))
                return
            if self.depth == 0:
                self.start = m.start()
            self.at = tag.end()
            if tag.group().endswith("/>"):
                if self.depth == 0:
                    yield self.text[self.start: self.at]
                    self._drop(self.at)
            else:
                self.depth += 1
        if self.depth == 0:
            self._drop(len(self.text))
            return
        self.depth -= 1
        self.text += END
        self.at = len(self.text)
        if self.depth == 0:
            yield self.text[self.start:]
            self._drop(self.at)

    def _drop(self, upto: int) -> None:
        self.text, self.at, self.depth, self.start = self.text[upto:], 0, 0, 0

    def finish(self) -> Iterator[str]:
        """An element or section still open when the records end."""
        if self.depth or self.at < len(self.text) and _TOKEN.match(self.text, self.at):
            yield self.text[self.start if self.depth else self.at:]
        self._drop(len(self.text))


class TagScanner:
    """Start tags of article elements, as self-closing elements, from records that a ``>`` followed."""

    def __init__(self):
        self.text, self.at = "", 0

    def feed(self, record: str) -> Iterator[str]:
        self.text += record + ">"
        while m := _TOKEN.search(self.text, self.at):
            self.at = m.start()
            if m.group() in _CLOSE:
                close = self.text.find(_CLOSE[m.group()], m.end())
                if close < 0:
                    return
                self.at = close + len(_CLOSE[m.group()])
                continue
            tag = _START_TAG.match(self.text, m.start())
            if tag is None:  # a quoted ``>``: the tag goes on
                return
            yield tag.group() if tag.group().endswith("/>") else tag.group()[:-1] + "/>"
            self.at = tag.end()
        self.text, self.at = "", 0

    def finish(self) -> Iterator[str]:
        if _TOKEN.match(self.text, self.at):
            yield self.text[self.at:]
        self.text, self.at = "", 0


def _rows(fragment: str, mode: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(fragment)
    except ET.ParseError as e:
        yield (None,) * 8 + (fragment, str(e))
        return
    for el in root.iter("article"):
        text = lead_text(el) if mode == "lead" else "".join(el.itertext())
        yield (el.get("id"), el.get("title", ""), el.get("published-at", ""), text, el.get("url", ""),
               el.get("hyperpartisan", ""), el.get("bias"), el.get("labeled-by", ""), None, None)


def scan(spark: SparkSession, path: str, mode: str = "lead") -> DataFrame:
    """Every article element with its attributes and text, or its fragment and error (``tags``: attributes alone)."""
    if mode not in ("lead", "full", "tags"):
        raise ValueError("mode must be 'lead', 'full' or 'tags'")
    raw = spark.read.text(path, lineSep=">" if mode == "tags" else END).select("value", F.col("_metadata.file_path").alias("file"))
    names = [part.split()[0] for part in SCAN_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, file = TagScanner() if mode == "tags" else ArticleScanner(), None

        def table(fragments):
            rows = [r for f in fragments for r in _rows(f, mode)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_pydict({n: pa.array(c, pa.string()) for n, c in zip(names, columns)})

        for batch in batches:
            found = []
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    found += scanner.finish()
                    file = name
                found += scanner.feed(value)
            yield table(found)
        yield table(list(scanner.finish()))

    return raw.mapInArrow(run, SCAN_SCHEMA)


def _checked(scanned: DataFrame, columns: list[str], on_error: str) -> DataFrame:
    if on_error == "quarantine":
        return scanned.where("error IS NULL").select(*columns)
    if on_error != "raise":
        raise ValueError("on_error must be 'raise' or 'quarantine'")
    message = F.concat(F.lit("article does not parse: "), F.col("error"), F.lit(" in "), F.substring("fragment", 1, 200))
    first = F.when(F.col("error").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(columns[0]))
    return scanned.select(first.alias(columns[0]), *columns[1:])


def read_articles(spark: SparkSession, path: str, mode: str = "lead", on_error: str = "raise") -> DataFrame:
    """S1 + S2: article_id (null when absent), title, published_at ('' when absent), article_text."""
    return _checked(scan(spark, path, mode), ["article_id", "title", "published_at", "article_text"], on_error)


def read_truth(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """S3: article_id, url, hyperpartisan, bias, labeled_by as strings (id and bias null when absent, the others '')."""
    return _checked(scan(spark, path, "tags"), ["article_id", "url", "hyperpartisan", "bias", "labeled_by"], on_error)


def rejected_articles(spark: SparkSession, path: str, mode: str = "lead") -> DataFrame:
    """(fragment, error) of every element that does not parse (``mode='tags'`` for a ground-truth file)."""
    return scan(spark, path, mode).where("error IS NOT NULL").select("fragment", "error")


# --- writers (derive XML from tables) -------------------------------------------------------

def escape(col: Column, attribute: bool = False) -> Column:
    c = F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;")) if attribute else c


FIRST_WORD = r"^([^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+)"


def article_xml(df: DataFrame, id_col: str = "article_id", title_col: str = "title",
                text_col: str = "article_text", published_col: str | None = None) -> DataFrame:
    """One ``<article>`` element per row: each text line becomes a ``<p>``, its first
    word wrapped in ``<b>`` -- mixed content with tails, like real article markup."""
    paras = F.split(F.col(text_col), "\n", -1)
    para_xml = F.transform(paras, lambda p: F.concat(
        F.lit("<p>"), F.regexp_replace(escape(p), FIRST_WORD, "<b>$1</b>"), F.lit("</p>")))
    pub = escape(F.col(published_col), True) if published_col else F.lit("")
    return df.select(F.concat(
        F.lit('<article id="'), escape(F.col(id_col).cast("string"), True),
        F.lit('" title="'), escape(F.coalesce(F.col(title_col), F.lit("")), True),
        F.lit('" published-at="'), pub, F.lit('">'),
        F.array_join(para_xml, ""), F.lit("</article>")).alias("value"))


def write_articles_xml(df: DataFrame, path: str, **kw) -> str:
    article_xml(df, **kw).write.mode("overwrite").text(path)
    return path


def write_truth_xml(df: DataFrame, path: str) -> str:
    """Ground truth as self-closing ``<article .../>`` rows (Spark XML writer)."""
    out = df.select(F.col("article_id").alias("_id"), F.col("url").alias("_url"),
                    F.col("hyperpartisan").alias("_hyperpartisan"), F.col("bias").alias("_bias"),
                    F.col("labeled_by").alias("_labeled-by"))
    out.write.mode("overwrite").format("xml").option("rootTag", "articles").option("rowTag", "article") \
        .option("attributePrefix", "_").save(path)
    return path
