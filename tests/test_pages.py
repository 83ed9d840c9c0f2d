import json

import pytest
from pyspark.sql import functions as F

from turnloom.operators import transcript
from turnloom.plans import dialogue
from turnloom.sources import files, pages

CURLY = (chr(0x201C), chr(0x201D), chr(0x2026), chr(0xC9))
PAGE = """<p>Outside: not this</p><div class="post-entry">
<p>Written by: A. Person</p><p><em>Scene: The lab.</em></p>
<p>Alpha <i>(quietly)</i>: Hello () there.</p><p><em>They leave.</em></p><p>(Scene: Hall)</p>
<p>Mrs. Beta (off): {0}Wait{2}{1}</p><p>no colon here</p><p>{3}lan: hi</p></div><p>After: not this</p>""".format(*CURLY)


def lines_of(spark, *htmls):
    frame = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    judged = transcript.read_paragraphs(pages.paragraphs(frame, ["page_id"]), ["page_id"])
    found = transcript.dialogue_lines(judged, ["page_id"]).orderBy("page_id", "line").collect()
    numbered = transcript.page_dialogue(pages.paragraph_arrays(frame, ["page_id"]), ["page_id"])
    assert numbered.orderBy("page_id", "line").collect() == found
    return [(r["speaker"], r["text"], r["scene"]) for r in found]


def test_fixture_page(spark):
    assert lines_of(spark, PAGE) == [("Alpha", "Hello  there.", 1), ("Mrs. Beta", '"Wait..."', 2)]


def test_without_a_container_the_whole_page_counts(spark):
    assert lines_of(spark, "<p>Alpha: one</p><div><p>Beta: two</p></div>") == [("Alpha", "one", 0), ("Beta", "two", 0)]


def texts(spark, html):
    frame = spark.createDataFrame([(0, html)], "page_id int, html string")
    return [(r["full_text"], r["plain_text"]) for r in pages.paragraphs(frame, ["page_id"]).orderBy("place").collect()]


@pytest.mark.parametrize("html, wanted", [
    ("<p>a<p>b</p>c</p>d", [("abc", "abc"), ("b", "b")]),
    ("<div><p>a<p>b</div>c", [("ab", "ab"), ("b", "b")]),
    ("<p>a<br>b<br/>c</br></p>", [("abc", "abc")]),
    ("<p>x <em>y</em> z <i>w", [("x y z w", "x  z ")]),
    ("<i><p>in</p></i>", [("in", "in")]),
    ("<p>a<i>b<p>c</p></i>d</p>", [("abcd", "ad"), ("c", "c")]),
    ("<p>a</b></span>b</p>", [("ab", "ab")]),
    ("<p>a<script>var t='</p>';</script>b<!-- c --></p>", [("ab", "ab")]),
    ("<p>&amp;&lt;&eacute;&#233;&#x41;&#150;&nosuch; &copy</p>", [("&<ééA–&nosuch ©",) * 2]),
    ("<p/>a<P>b</P>", [("", ""), ("b", "b")]),
    ("", []),
])
def test_tag_soup(spark, html, wanted):
    assert texts(spark, html) == wanted


def test_links(spark):
    html = ('<a href="/a/#x">Series 1  Episode 1</a><a href="/a">series 1 episode 1 again</a>'
            '<a name="n">Series 1 Episode 9</a><a href="/about">About</a><a href="/b///">SERIES 2 Episode 3 <b>Two</b></a>')
    found = pages.anchors(spark.createDataFrame([(0, html)], "page_id int, html string"), ["page_id"])
    links = lambda limit: [(r["title"], r["url"]) for r in transcript.episode_links(
        found, ["page_id", "place"], limit).orderBy("place").collect()]
    both = [("Series 1 Episode 1", "/a/"), ("SERIES 2 Episode 3 Two", "/b/")]
    assert links(0) == both and links(1) == both[:1] and links(-1) == both[:1]


def test_scene_pieces_match_a_running_count(spark):
    lines = ["#", "a", "b", "#", "#", "c", "d", "#"]
    frame = spark.createDataFrame([(0, lines), (1, []), (2, ["x"])], "k int, l array<string>")
    got = transcript.explode_scenes(frame, ["k"], F.col("l"), lambda l: l == "#")
    assert {tuple(r) for r in got.collect()} == {
        (0, 1, 1, "a"), (0, 1, 2, "b"), (0, 3, 5, "c"), (0, 3, 6, "d"), (2, 0, 0, "x")}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def landed(spark, *htmls):
    return spark.createDataFrame(
        [(i, f"Series 1 Episode {i}", f"/{i}/", h) for i, h in enumerate(htmls)],
        "episode_id long, title string, url string, html string")


GOOD = '<div class="entry"><p>Sheldon: Four pens lie on the desk.</p></div>'


@pytest.mark.parametrize("htmls, message", [
    ([], "no page links"), ([GOOD, "<p>No dialogue</p>"], "holds no dialogue"), ([GOOD, None], "holds no dialogue"),
])
def test_failed_parse_keeps_the_old_output(spark, tmp_path, htmls, message):
    out = tmp_path / "episodes"
    out.mkdir()
    (out / "part-0.json").write_text("existing dataset\n")
    with pytest.raises(ValueError, match=message):
        dialogue.scrape(landed(spark, *htmls), str(out))
    assert [p.name for p in out.iterdir()] == ["part-0.json"]
    assert (out / "part-0.json").read_text() == "existing dataset\n"


def test_successful_parse_writes_all_episodes(spark, tmp_path):
    out = str(tmp_path / "episodes")
    totals = dialogue.scrape(landed(spark, GOOD, GOOD), out).first()
    assert totals.asDict() == {"episodes": 2, "lines": 2, "target_lines": 2}
    back = files.read_episode_lines(spark, out).collect()
    assert len(back) == 2 and all(len(r["lines"]) == 1 for r in back)
    array = tmp_path / "raw.json"
    array.write_text(json.dumps([{"title": r["title"], "url": r["url"], "lines": [l.asDict() for l in r["lines"]]} for r in back]))
    assert {r["title"] for r in files.read_episodes(spark, str(array)).collect()} == {"Series 1 Episode 0", "Series 1 Episode 1"}


def test_the_table_function_gives_the_rows_of_both_readers(spark):
    rows = [(1, '<div class="post-entry"><p>a <i>b</i> c<p>d</div><a href="/x">t <b>u</b></a><a>none</a><a href="">e</a>'), (2, None), (3, ""), (4, "<p>out")]
    table = spark.createDataFrame(rows, "id int, html string")
    pages.register_functions(spark)
    for kind, reader in (("a", pages.anchors), ("p", pages.paragraphs)):
        found = spark.sql(f"SELECT id, e.* FROM {{t}}, LATERAL page_elements(html, '{kind}') e", t=table)
        wanted = reader(table, ["id"])
        assert found.columns == wanted.columns and {tuple(r) for r in found.collect()} == {tuple(r) for r in wanted.collect()}
    with pytest.raises(Exception, match="knows the kinds"):
        spark.sql("SELECT * FROM page_elements('x', 'q')").collect()
