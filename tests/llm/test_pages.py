import hashlib
import struct

import pytest
import zstandard

from lodeweave.llm import html_extraction as html
from lodeweave.llm import url_filters as uf
from lodeweave.llm import warc
from lodeweave.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

URLS = ["http://www.Example.com/en/1", "https://example.com/en/", "https://example.com/en", "http://a.b.net/es/x?y#z", "http://net/fr/", "ftp://x.org/fr/", "no scheme", None, "", "http://com", "http://com/", "http://xcom/", "http://u@EXAMPLE.com:80/en/", "http://example.com?x=/en/", "a://b://example.com/en/"]


def plain(url):
    """Judgement rule by rule."""
    host, path = uf.split_url(url)
    fit = [(len(r), v, r) for v, r in URL_RULES for h, p in [uf.parse_rule(r)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, v, r = max(fit, default=(0, "allow", None))
    return host, path, r, v


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(df, "page_id", "url", URL_RULES).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}
    assert got[0][3] == "allow" and got[1][3] == "block" and got[2][2] == "com/" and got[3][3] == "block"
    rules = spark.createDataFrame([(v, *uf.parse_rule(r)) for v, r in URL_RULES], "verdict string, host string, path string")
    joined = uf.judge_by_join(df, "page_id", "url", rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in joined} == got
    assert uf.judge_urls(df.limit(0), "page_id", "url", URL_RULES).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(name, against_sql):
    against_sql(QUERIES[name], ORACLE_SQL[name])


def test_html_layout():
    out = html.render("<title>t</title><p>one<p>two &amp; <b>three</b><script>x<y</script><ul><li>a<li>b<ol start=4><li>c</ol></ul><div style='display: none'>no<p>no</div><table><tr><th>Name<th>N<tr><td>long name<td>1</table>end<br>x")
    assert out == "one\n\ntwo & three\n\n- a\n- b\n  4. c\n\nName      | N\nlong name | 1\n\nend\nx"


def test_odd_html():
    assert html.render(None) == "" and html.render("") == "" and html.render("<") == "<" and html.render("<!-- open") == ""
    assert html.render("<div>" * 20_000 + "deep") == "deep"
    assert html.render("<p hidden>a<p>b</p></b>c") == "b\n\nc"
    assert html.render("<pre>a\n  b</pre>") == "a\n  b"
    assert html.render("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>") == "wide\na | b"


@pytest.mark.parametrize(("source", "text"), [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds", "so x=2 holds"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>no</style><script>no</script><text>One</text><text>Two <tspan>b</tspan></text>no</svg>c", "a One Two b c"),
    ("<svg><title/><path d='M0'/><text>x</text></svg>y", "x y"),
    ("<svg><text><![CDATA[a<b]]></text><foreignObject><p>in</p></foreignObject></svg>after", "a<b\n\nin\n\nafter"),
    ("<svg><foreignObject><p>in</svg>after", "in\n\nafter"),
    ("<svg/>a<p>b", "a\n\nb"), ("<math/>a", "a"), ("<svg><g><p>broken out", "broken out"), ("<svg><td>no<text>label</svg>b", "label b"),
    ("<map name=m><p>in map</p><area></map>after", "in map\n\nafter"), ("<map>never closed<p>rest", "never closed\n\nrest"),
    ("a<xmp>x <b>&amp;\n  y</xmp>b", "a\n\nx <b>&amp;\n  y\n\nb"), ("<xmp>open", "open"),
    ("<textarea>\nl1 &amp;\n  <b>l2</textarea>b", "l1 &\n  <b>l2\nb"), ("<textarea/>x</textarea>y", "x\ny"),
    ("pick<select><optgroup label=g><option>one<option>two</select>end", "pick\none\ntwo\nend"),
    ("<div hidden><svg><text>no</text></svg><xmp>no</xmp><textarea>no</textarea></div>yes", "yes"),
    ("<table><tr><td><svg><text>1</text></svg><td><math><mi>y</mi></math></table>", "1 | y"),
    ("<svg><style>a{}</style></svg><style>p{}</style>t", "t"),
])
def test_html_of_every_shown_element(source, text):
    assert html.render(source) == text


def test_html_of_all_pages_keeps_every_visible_word(spark):
    """Words between tags, outside hidden elements, in order, are the words of the rendering without layout marks."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages, "page_id", "html").collect()}
    for r in pages.collect():
        rest = re.sub(r"(?is)<!--.*?-->|<(script|style|title|noscript|template)\b.*?</\1\s*>|<[^>]*\bhidden\b[^>]*>.*", " ", r.html)
        import html as h

        for w in re.findall(r"[A-Za-z]{4,}", h.unescape(re.sub(r"<[^>]*>", " ", rest.split("<table")[0]))):
            if "display:none" not in r.html.replace(" ", ""):
                assert w in got[r.page_id]
    assert html.extract(pages.limit(0), "page_id", "html").count() == 0


def test_archives_round_trip(spark, tmp_path):
    big, other = "<p>" + "x" * 2000, "<p>é" + "y" * 995
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u\r\nX: y", other), (8, "u", other), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(df, "page_id", "url", "html", str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for k, _, page in rows:
        data = (page or "").encode()
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert bytes(r.payload) == (data if r.record_type == "response" else b"")
    assert {k: r.refers_to for k, r in got.items()} == {1: 3, 2: 3, 3: None, 4: None, 5: None, 6: None, 7: 8, 8: None, None: 3}
    assert warc.archive_round_trip(df.limit(0), "page_id", "url", "html", str(tmp_path / "none")).count() == 0


def test_dictionary_is_read_from_the_leading_frame():
    samples = [f"<html><head><title>page {i}</title></head><body><p>text {i * 7} of the page</p></body></html>".encode() * 20 for i in range(200)]
    raw = warc.train_dictionary(samples)
    assert raw
    record = warc.record("response", 1, "http://x", samples[3], hashlib.sha1(samples[3]).hexdigest(), None)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record)
    whole = warc.dictionary_frame(raw) + warc.SEPARATOR + frame + warc.SEPARATOR
    assert list(warc.frames(whole)) == [record]
    packed = zstandard.ZstdCompressor().compress(raw)  # the dictionary itself may be compressed
    assert list(warc.frames(warc.dictionary_frame(packed) + frame)) == [record]
    for broken in (whole[:-12], frame[:-3], b"\x00" * 16, struct.pack("<II", warc.DICT_MAGIC, 99) + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.frames(broken))


def test_reading_is_linear_and_keeps_long_records():
    import os
    import time

    raw = warc.train_dictionary([])
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    pages = [os.urandom(3000) for _ in range(8000)] + [os.urandom(1 << 24), b"z" * (1 << 26)]
    records = [warc.record("response", i, "u", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(pages)]
    whole = warc.dictionary_frame(raw) + b"".join(packer.compress(x) + warc.SEPARATOR for x in records)
    began = time.time()
    assert [x == y for x, y in zip(warc.frames(whole), records, strict=True)] == [True] * len(records)
    assert time.time() - began < 10  # 40 MB; handing the rest of the archive to every record takes minutes


def test_archives_of_odd_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(1, None, "<p>" + "long " * 1_000_000), (2, "u", "<p>" + "long " * 1_000_000), (2, "u", "short"), (2, "u", "short"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("key", "payload", "refers_to", "frame", "content", "value")})
    for name, limit in (("a", warc.BROADCAST_ROWS), ("b", 0)):
        warc_rows, warc.BROADCAST_ROWS = warc.BROADCAST_ROWS, limit
        try:
            out = warc.archive_round_trip(df.repartition(2), "page_id", "url", "html", str(tmp_path / name)).collect()
        finally:
            warc.BROADCAST_ROWS = warc_rows
        assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in out) == [("1", 5_000_003, "revisit", 2), ("2", 5, "response", None), ("2", 5, "response", None), ("2", 5_000_003, "response", None), ("None", 0, "response", None)]
    assert all(f.name.endswith(".warc.zst") for f in (tmp_path / "a").iterdir() if f.name.startswith("part-"))
    assert warc.read_archives(str(tmp_path / "nowhere" / "part-*"), spark).count() == 0


def test_bad_records_are_refused():
    good = warc.record("response", 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc", b"abd"), good[:-2], good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
