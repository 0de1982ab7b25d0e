"""Alias edges from all forms of links, in Spark and in the query's SQL."""

import duckdb
import pytest

from tests.llm.test_operators import rows_of
from tidemark.llm import queries, urls

BAD = "http://b.net/es/"
PAGES = [
    ("http://b.net/es/", "", "block"), ("http://b.net/es/x/y", "", "block"), ("http://b.net/q", "", "allow"),
    # relative targets: to the folder, to the query, up, with a base, protocol-relative
    ("http://b.net/es2/a", "<link rel=canonical href=../es/k>", "block"), ("http://t.org/d/e", "<link rel='canonical' href=\"z?b\">", "block"), ("http://t.org/d/z?b", f"<link rel=canonical href={BAD}1>", "block"),
    ("http://q.org/p?a", "<link href='?b' rel='shortlink canonical'>", "block"), ("http://q.org/p?b", f'<meta http-equiv="Refresh" content="0;URL=\'{BAD}2\'">', "block"),
    ("http://base.org/1", "<base href='http://b.net/es/deep/'><link rel=canonical href='3'>", "block"), ("https://c.org/1", "<link rel=canonical href=//b.net/es/4>", "block"),
    ("http://base.org/2", "<base href='../x/'><link rel=canonical href='3'>", "block"), ("http://base.org/x/3", "<link rel=canonical href='//B.NET/es/9'>", "block"),
    # references
    ("http://r.org/1", "<link rel=canonical href='http:&#47;&#x2F;b.net&#47;es&#x2f;5'>", "block"), ("http://r.org/2", "<link rel=canonical href='http://b.net/es/?a=1&amp;b=&#233;&bogus;&#1114112;'>", "block"),
    # the second of two links, a tag with > in a value
    ("http://two.org/1", f"<link rel=canonical href=http://else.org/><link title='a>b' rel=canonical href={BAD}6>", "block"), ("http://else.org/", None, "block"),
    # no links: comments, scripts, cut tags, other rels and schemes
    ("http://n.org/1", f"<!-- <link rel=canonical href={BAD}7> -->", "allow"), ("http://n.org/2", f"<script>'<link rel=canonical href={BAD}8>'</script>", "allow"), ("http://n.org/3", f"<link rel=canonical href={BAD}9", "allow"),
    ("http://n.org/4", f"<link rel=canonicals href={BAD}>", "allow"), ("http://n.org/5", "<link rel=canonical href='mailto:b.net/es/'>", "allow"), ("http://n.org/6", "<link rel=canonical href='#top'><link rel=canonical href=''>", "allow"),
    ("http://n.org/7", f"<meta name=refresh content='0;url={BAD}'>", "allow"), ("http://n.org/8", f"<!-- cut <link rel=canonical href={BAD}>", "allow"), (None, f"<link rel=canonical href={BAD}>", "allow"), ("none", f"<link rel=canonical href={BAD}>", "allow"),
    # dot segments and an explicit allow
    ("http://dots.org/a/./b/../c/..", f"<link rel=canonical href={BAD}>", "block"), ("http://dots.org/a/", None, "block"), ("http://ok.org/1", f"<link rel=canonical href={BAD}ok>", "allow"), ("http://ok.org/2", "<link rel=canonical href='http://b.net/es/ok'><link rel=canonical href='http://x.com/'>", "allow"),
    ("http://b.net/es/ok", "", "block"),
    # white space around and in a target, an empty path, default ports, a refresh without url=, escapes
    ("http://w.org/1", f"<link rel=canonical href='\n\t{BAD}w1 \r\n'>", "block"), ("http://w.org/2", "<link rel='\ncanonical' href='http://b.net\n/es/w2'>", "block"), ("https://e.org", "<link rel=canonical href='http://else.org/'>", "block"),
    ("https://f.org/1", "<link rel=canonical href='https://e.org/'>", "block"), ("https://g.org/1", "<link rel=canonical href='https://E.org:443'>", "block"), ("https://g.org/2", "<link rel=canonical href='https://e.org:80'>", "allow"), ("https://e.org?q", "<link rel=canonical href='https://e.org/'>", "block"),
    ("http://p.org:80/x", f"<link rel=canonical href={BAD}p>", "block"), ("http://p.org/x", None, "block"), ("http://p.org:/x", None, "block"), ("http://z.org/1", f"<meta http-equiv=refresh content='0;{BAD}z'>", "block"), ("http://z.org/2", f"<meta http-equiv=refresh content='3 , &quot;{BAD}z&quot;'>", "block"),
    ("http://z.org/3", "<meta http-equiv=refresh content='5'>", "allow"), ("http://z.org/4", "<meta http-equiv=refresh content='5; url='>", "allow"), ("http://z.org/5", f"<meta http-equiv=refresh content='url = {BAD}z'>", "block"), ("http://u.org/%7ea%2f", f"<link rel=canonical href={BAD}u>", "block"), ("http://u.org/~%61%2F", None, "block"), ("http://u.org/~a/", None, "allow"), ("http://u.org/%zz%", f"<link rel=canonical href={BAD}%>", "block"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("urls")
    spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return str(d)


def test_links_of_all_forms(spark, folder):
    out = {r.page_id: r.verdict for r in queries.op2_url_filters(spark, folder).collect()}
    assert [(PAGES[i][0], v) for i, v in sorted(out.items())] == [(u, v) for u, _, v in PAGES]


def test_sql_says_the_same(spark, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    names = ("page_id", "host", "path", "rule", "verdict")
    sql = c.sql(queries.ORACLES["op2_url_filters"]).df()[list(names)].astype(object)
    want = rows_of(queries.op2_url_filters(spark, folder), *names)
    got = sorted((tuple(None if x != x else x for x in r) for r in sql.itertuples(index=False)), key=repr)
    assert got == want


def test_references(spark):
    texts = ["a&amp;b", "&#65;&#x42;&#128512;", "&#0;&#55296;", "&lt;&gt;&quot;&apos;", "&nope; & &", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(urls.decode_references(F.col("t"))).collect()] == ["a&b", "AB\U0001f600", "��", "<>\"'", "&nope; & &", "", None]
