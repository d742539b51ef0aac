"""HTML entities: the query and its SQL on references of every kind."""

import html
from html.entities import html5

import duckdb

from docquarry.plans.ingest import R


def test_unescaped_text_and_its_sql_on_any_reference(spark, tmp_path):
    texts = [None, "", "&", "&&amp", "a &amp<b &am< &<", "x&ampy &notit; &notin; &lt&gt;", "&amp;amp; &amp;lt;", "xamp; y", "&#65;&#x42&#X43;&#068&#0;&#13;x&#128;&#x9F&#xD800;&#1114112;&#99999999999999999999;", "&#;&#x;&#xg;&#", "a&nbsp;&nbsp;b\n\n\n\nc"]
    texts += [f"[&#{n};]" for n in (*range(1, 161), 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFF, 0x1F600)] + [f"[&{name}z]" for name in html5]
    spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text_md5 for r in R.queries["t01_unescaped_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.sql(f"select page_id, text_md5 from ({R.sql['t01_unescaped_text']})").fetchall())
    assert got == want, [html.unescape(texts[i] or "") for i in got if got[i] != want.get(i)][:5]
