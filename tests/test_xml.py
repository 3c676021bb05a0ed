"""S1-S3 on hand-written XML (FIXTURES.md §1-2)."""
import os
import tempfile

import pytest

from slantspark.sources import xml as X

ARTICLES = """<?xml version="1.0" encoding="utf-8"?>
<articles>
<article id="1" title="Plain" published-at="2016-01-01"><p>Just a paragraph.</p></article>
<article id="2" title="Mixed"><p>Hello <a>world</a> tail</p><q>one</q><p>two b</p></article>
<article id="x2" title="Entities"><p>a &lt;b&gt; c&#160;d</p></article>
<article title="No id"><p>line one
line two\twith tab</p></article>
<article id="007"><p></p></article>
<section><article id="9" title="Deep"><p>nested</p></article></section>
</articles>
"""

TRUTH = """<?xml version="1.0" encoding="utf-8"?>
<articles>
<article id="1" url="http://a" hyperpartisan="true" bias="left" labeled-by="publisher"/>
<article id="2" url="http://b" hyperpartisan="false" bias="least" labeled-by="publisher"></article>
<article id="3" url="http://c" hyperpartisan="true" labeled-by="publisher"/>
</articles>
"""


def _write(text):
    d = tempfile.mkdtemp(prefix="slant-xml-")
    p = os.path.join(d, "data.xml")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_articles_lead_mode(spark):
    rows = {(r["title"]): r.asDict() for r in X.read_articles(spark, _write(ARTICLES), "lead").collect()}
    assert rows["Mixed"]["article_text"] == "worldHello onetwo b"
    assert rows["Mixed"]["published_at"] == ""
    assert rows["Plain"]["published_at"] == "2016-01-01"
    assert rows["Entities"]["article_id"] == "x2"
    assert rows["Entities"]["article_text"] == "a <b> c d"
    assert rows["No id"]["article_id"] is None
    assert rows["No id"]["article_text"] == "line one\nline two\twith tab"
    assert rows[""]["article_id"] == "007" and rows[""]["article_text"] == ""
    assert rows["Deep"]["article_text"] == "nested"


def test_articles_full_mode(spark):
    rows = {r["title"]: r["article_text"] for r in X.read_articles(spark, _write(ARTICLES), "full").collect()}
    assert rows["Mixed"] == "Hello world tailonetwo b"


def test_truth_scan(spark):
    rows = {r["article_id"]: r.asDict() for r in X.read_truth(spark, _write(TRUTH)).collect()}
    assert rows["1"]["bias"] == "left" and rows["2"]["hyperpartisan"] == "false"
    assert rows["3"]["bias"] is None and rows["3"]["labeled_by"] == "publisher"


HARD = """<?xml version="1.0"?><!-- a comment with <article id="no"> and </article> in it -->
<articles><article id="1"/><article id="2" title="a > b"><p>two</p></article>
<article id="3"/><article id="4"/><article id="5"><![CDATA[x </article> <article id="no"> y]]><p>five</p></article>
<article id="6"><!-- </article> --><p>six<b>in</b>out</p></article><sec><sub><article id='7' title='q"q'>seven</article></sub></sec>
<article id="8"><p>eight</p></article>
</articles>"""


def test_self_closing_cdata_comments_and_nesting(spark):
    rows = {r.article_id: (r.title, r.article_text) for r in X.read_articles(spark, _write(HARD)).collect()}
    assert rows == {"1": ("", ""), "2": ("a > b", "two"), "3": ("", ""), "4": ("", ""), "5": ("", "fivex </article> <article id=\"no\"> y"),
                    "6": ("", "insix"), "7": ('q"q', "seven"), "8": ("", "eight")}
    full = {r.article_id: r.article_text for r in X.read_articles(spark, _write(HARD), "full").collect()}
    assert full["6"] == "sixinout" and full["5"].endswith("yfive")


def test_malformed_articles_raise_or_are_returned(spark):
    text = ARTICLES.replace("Just a paragraph.", "fish & chips").replace("nested", "<open>")
    path = _write(text)
    with pytest.raises(Exception, match="does not parse"):
        X.read_articles(spark, path).collect()
    kept = X.read_articles(spark, path, on_error="quarantine").collect()
    bad = X.rejected_articles(spark, path).collect()
    assert len(kept) == 4 and len(bad) == 2
    assert sorted("fish" in r.fragment for r in bad) == [False, True] and all(r.error for r in bad)


def test_unterminated_sections_and_tags_are_not_lost(spark):
    for text in ('<articles><article id="1">a</article><article id="2"><![CDATA[never closed</article>', '<articles><article id="1">a</article><article id="2',
                 '<articles><article id="1">a</article><!-- open </article>'):
        bad = X.rejected_articles(spark, _write(text)).collect()
        assert len(bad) == 1, text
        assert [r.article_id for r in X.read_articles(spark, _write(text), on_error="quarantine").collect()] == ["1"]


def test_nested_articles_each_give_a_row(spark):
    rows = {r.article_id: r.article_text for r in X.read_articles(spark, _write(
        '<a><article id="1">out<article id="2">in</article>tail</article><article id="3">x</article></a>')).collect()}
    assert rows == {"1": "inout", "2": "in", "3": "x"}


def test_truth_tags_with_quoted_brackets(spark):
    text = "<t><article id='1' url='http://a?x>y' hyperpartisan='true' bias='left'/><!-- <article id='no'/> --><article id='2' bias=''></article></t>"
    rows = {r.article_id: (r.url, r.bias) for r in X.read_truth(spark, _write(text)).collect()}
    assert rows == {"1": ("http://a?x>y", "left"), "2": ("", "")}


def test_one_file_is_read_in_several_splits(spark):
    n = 3000
    arts = "<articles>\n" + "".join(f'<article id="{k}" title="t"><p>text {k} {"x" * 200}</p></article>\n' for k in range(n)) + "</articles>"
    truth = "<articles>\n" + "".join(f'<article id="{k}" url="u" hyperpartisan="true" bias="left" labeled-by="p"/>\n' for k in range(n)) + "</articles>"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for df in (X.read_articles(spark, _write(arts)), X.read_truth(spark, _write(truth))):
            assert df.rdd.getNumPartitions() > 3
            assert sorted(int(r.article_id) for r in df.select("article_id").collect()) == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_deep_nesting_does_not_recurse():
    import xml.etree.ElementTree as ET
    el = ET.fromstring("<article>" + "<p>x" * 3000 + "</p>" * 3000 + "</article>")
    assert X.lead_text(el) == "x" * 3000


def test_lead_text_python_walk():
    import xml.etree.ElementTree as ET
    el = ET.fromstring("<article><p>Hello <a>world</a> tail</p><q>one</q><p>two b</p></article>")
    assert X.lead_text(el) == "worldHello onetwo b"


MERGE_ARTICLES = """<articles>
<article id="1" title="A"><p>one</p></article>
<article id="2" title="B"><p>two</p></article>
<article id="2" title="B again"><p>two bis</p></article>
<article id="3" title="C"><p>three</p></article>
<article id="4"><p>four</p></article>
<article id="5" title="E"><p>five</p></article>
<article id="1.5" title="bad id"><p>x</p></article>
</articles>"""

MERGE_TRUTH = """<articles>
<article id="1" url="u1" hyperpartisan="true" bias="left" labeled-by="publisher"/>
<article id="2" url="u2" hyperpartisan="true" bias="right-center" labeled-by="publisher"></article>
<article id="3" url="u3" hyperpartisan="false" bias="least" labeled-by="publisher"/>
<article id="4" url="u4" hyperpartisan="true" bias="left-center" labeled-by="publisher"/>
<article id="4" url="u4" hyperpartisan="true" bias="left-center" labeled-by="publisher"/>
<article id="5" url="u5" hyperpartisan="true" labeled-by="publisher"/>
<article id="6" url="u6" hyperpartisan="true" bias="right" labeled-by="publisher"/>
</articles>"""


def test_merge_semantics_from_xml(spark):
    from slantspark.operators import prepare as PR
    from slantspark.operators import quality as Q
    arts = X.read_articles(spark, _write(MERGE_ARTICLES))
    truth = X.read_truth(spark, _write(MERGE_TRUTH))
    assert Q.invalid_id_rows(arts).count() == 1                      # '1.5' quarantined, reported
    assert sorted(r[0] for r in Q.distinct_values(truth).collect() if r[0]) == ["least", "left", "left-center",
                                                                               "right", "right-center"]
    merged = PR.merged_articles(arts, truth)
    rows = sorted((r["article_id"], r["bias"]) for r in merged.collect())
    # duplicate article 2 and duplicate label 4 multiply; orphan label 6 and bad id 1.5 drop out
    assert rows == [(1, "left"), (2, "right-center"), (2, "right-center"), (3, "least"), (4, "left-center"),
                    (4, "left-center"), (5, None)]
    rel = sorted((r["article_id"], r["bias"], r["title"]) for r in PR.relabelled(merged).collect())
    assert rel[1][1] == "right" and rel[4][1] == "left" and rel[-1][1] == "" and rel[4][2] == ""
