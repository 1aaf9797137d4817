"""Readers on payloads as the boards send them, one test a family; exports."""

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.sources import boards, custom, export, html

GREENHOUSE = {"jobs": [{"id": 7, "title": "Intern", "absolute_url": "https://x/7", "location": {"name": "Paris"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": "2026-01-02T03:04:05-05:00"}]}
PAYLOADS = {
    "greenhouse": (GREENHOUSE, [("7", "Intern", "https://x/7", "Paris", "", "Hi")]),
    "lever": ([{"id": "a", "text": "Dev", "hostedUrl": "u", "createdAt": 1700000000000, "categories": {"allLocations": ["A", "B", "A"], "commitment": "Intern"}, "descriptionPlain": "x", "additionalPlain": "y"}], [("a", "Dev", "u", "A / B", "Intern", "x\ny")]),
    "ashby": (
        {"jobs": [{"id": "1", "title": "t", "isListed": False}, {"id": "2", "title": "u", "isRemote": True}, {"id": "3", "title": "v", "location": "A", "secondaryLocations": [{"locationName": "B"}, {"locationName": "A"}], "descriptionPlain": "", "descriptionHtml": "<b>x</b>"}]},
        [("2", "u", "", "Remote", "", ""), ("3", "v", "", "A / B", "", "x")],
    ),
    "smartrecruiters": ({"totalFound": 2, "content": [{"id": "1", "name": "n", "location": {"city": "c", "country": "ca"}}, {"id": "2", "name": "m", "location": {"remote": True}}]}, [("1", "n", "", "c, ca", "", ""), ("2", "m", "", "Remote", "", "")]),
    "workable": ({"jobs": [{"shortcode": "s", "title": "t", "url": "u", "city": "", "telecommuting": True, "description": "<p>d</p>", "requirements": "r", "benefits": "b"}]}, [("s", "t", "u", "Remote", "", "d\n\nr\nb")]),
    "recruitee": ({"offers": [{"id": 5, "title": "t", "careers_url": "u", "location": "", "city": "c", "country_code": "FR", "published_at": "2024-01-02 03:04:05 UTC"}]}, [("5", "t", "u", "c, FR", "", "")]),
    "bamboohr": ({"result": [{"id": "9", "jobOpeningName": "t", "location": {"city": "", "state": ""}, "atsLocation": {"city": "c", "state": "s"}}]}, [("9", "t", "", "c, s", "", "")]),
    "breezy": ([{"id": "b", "name": "t", "location": {"name": "", "is_remote": True}, "url": "u"}], [("b", "t", "u", "Remote", "", "")]),
    "collage": ({"positions": [{"id": "p", "title": "t", "url": "u", "location": "l", "description": "d"}]}, [("p", "t", "u", "l", "", "d")]),
    "oracle_cloud": ({"items": [{"TotalJobsCount": 1, "requisitionList": [{"Id": "1", "Title": "t", "PrimaryLocation": "Montréal", "PrimaryLocationCountry": "CA", "ShortDescriptionStr": "a", "ExternalQualificationsStr": "<i>b</i>"}]}]}, [("1", "t", "", "Montréal, CA", "", "a b")]),
    "workday": ({"jobPostings": [{"title": "t", "externalPath": "/job/x/R1", "bulletFields": [" "]}, {"title": "u", "externalPath": "/job/y", "locationsText": "L", "bulletFields": ["", "R9"]}]}, [("R1", "t", "/job/x/R1", "", "", ""), ("R9", "u", "/job/y", "L", "", "")]),
    "simplify": ([{"id": "1", "active": True, "is_visible": False, "title": "x"}, {"id": "2", "title": "y", "company_name": "C", "url": "u", "locations": ["A", "B"], "terms": ["Summer 2026"]}], [("2", "y", "u", "A / B", "", "")]),
    "community": ({"listings": [{"id": "", "company_name": "C", "title": "t", "url": "u", "season": "Winter"}, {"id": "2", "company_name": "", "title": "no company"}]}, [("C:t:u", "t", "u", "", "", "")]),
    "themuse": ({"results": [{"id": 3, "name": "t", "locations": [{"name": "A"}], "refs": {"landing_page": "u"}, "contents": "<p>c"}]}, [("3", "t", "u", "A", "", "c")]),
    "quebec-emploi": ({"items": [{"ide_affch": 4, "titre": "t", "nom_ville": "v"}]}, [("4", "t", "", "v", "", "")]),
    "zshah101": ([{"id": "1", "title": "t", "url": "u", "location": "l", "program": "Internship"}, {"id": "2", "title": "t", "program": "coop"}], [("1", "t", "u", "l", "", "")]),
}


def one(spark, payload):
    return spark.createDataFrame([("f", payload)], "file string, payload string")


@pytest.mark.parametrize("platform", sorted(boards.BOARDS))
def test_board(spark, platform):
    payload, want = PAYLOADS[platform]
    sent = spark.createDataFrame([("f", json.dumps(payload)), ("g", "no json"), ("h", None)], "file string, payload string")
    rows = boards.parse_board(sent, platform).collect()
    assert sorted((r["native_id"], r["title"], r["url"], r["location"], r["employment_type"], r["description"]) for r in rows) == sorted(want)
    assert {r["file"] for r in boards.malformed(sent, platform).collect()} == {"g", "h"}


def test_times_and_signals_of_boards(spark):
    (g,) = boards.parse_board(one(spark, json.dumps(GREENHOUSE)), "greenhouse").collect()
    assert g["posted_at"] == datetime(2026, 1, 2, 8, 4, 5)
    (s,) = boards.parse_board(one(spark, json.dumps(PAYLOADS["simplify"][0])), "simplify").collect()
    assert (s["company"], s["terms"], s["degrees"]) == ("C", ["Summer 2026"], [])
    (r,) = boards.parse_board(one(spark, json.dumps(PAYLOADS["recruitee"][0])), "recruitee").collect()
    assert r["posted_at"] == datetime(2024, 1, 2, 3, 4, 5)


def test_pages_details_and_missing_files(spark):
    pages = spark.createDataFrame([("1", 2, "late"), ("1", 1, "early"), ("2", 2, "x")], "native_id string, page int, title string")
    assert {r["native_id"]: r["title"] for r in boards.first_of_pages(pages, "page").collect()} == {"1": "early", "2": "x"}
    rows = spark.createDataFrame([("1", ""), ("2", ""), ("3", "kept")], "native_id string, description string")
    full, told = boards.with_details(rows, spark.createDataFrame([("1", "<p>d</p>")], "native_id string, html string"), rows.limit(2))
    assert {r["native_id"]: r["description"] for r in full.collect()} == {"1": "d", "2": "", "3": "kept"}
    assert {tuple(r) for r in told.collect()} == {("1", True, False), ("2", False, True)}
    files = lambda *f: spark.createDataFrame([(x,) for x in f], "file string")
    assert tuple(boards.fetch_states(files("a", "b"), files("a")).first()) == (2, 1, False)
    whole = spark.createDataFrame([("a", "p"), ("b", None)], "board string, payload string")
    got = boards.fallback(whole, spark.createDataFrame([("a", "q"), ("b", "r")], "board string, payload string"), "board")
    assert {tuple(r) for r in got.collect()} == {("a", "p", False), ("b", "r", True)}
    done = custom.page_completeness(spark.createDataFrame([("a", 1, 3, 2), ("a", 2, 3, 1), ("b", 1, 5, 2), ("c", 1, 2, 1), ("c", 2, 3, 2)], "board string, page int, total long, rows long"))
    assert {r["board"]: r["complete"] for r in done.collect()} == {"a": True, "b": False, "c": False}


def test_markdown_tables(spark):
    md = "| Company | Role | Location | Link |\n|---|---|---|---|\n| **Acme** | Intern | NYC | [go](https://a/1) |\n| ↳ | Dev | SF | [go](https://a/2) |\n| Other | x | y | closed |"
    got = boards.parse_markdown(one(spark, md), "file").orderBy("pos").collect()
    assert [(r["company"], r["title"], r["url"]) for r in got] == [("Acme", "Intern", "https://a/1"), ("Acme", "Dev", "https://a/2")]
    wide = "| Title | Company | D | S | Details | Location | Apply |\n|--|--|--|--|--|--|--|\n| SWE Intern | [A](http://a) | d | | | MTL | [x](https://b/1) |\n| Senior | B | | | | | [x](https://b/2) |"
    assert [tuple(r)[2:] for r in boards.parse_wide_markdown(one(spark, wide), "file").collect()] == [("A", "SWE Intern", "MTL", "https://b/1", "d")]
    headed = "## Firm\n**Locations**: NYC, Chicago\n| Role | Links |\n|--|--|\n| QT | [✅ Summer](https://c/1) [](https://c/2) |\n| Fellowship | [x](https://c/3) |\n## Next\n| SWE | [x](https://d/1) |"
    got = boards.parse_headed_markdown(one(spark, headed), "file").orderBy("url").collect()
    assert [(r["company"], r["title"], r["location"]) for r in got] == [("Firm", "Quantitative Trader Intern — Summer", "NYC, Chicago"), ("Firm", "Quantitative Trader Intern", "NYC, Chicago"), ("Next", "Software Engineer Intern — x", "")]
    cells = '| <a href="h"><strong>Acme</strong></a> | Dev | MTL | $5 | <a href="https://e/1">go</a> | 3d |\n| <a href="h"><strong>B</strong></a> | Dev | SF | <a href="https://e/2">go</a> | new |\n| <a href="h">C</a> | x |'
    text = base64.b64encode(cells.encode()).decode()
    plain = spark.createDataFrame([("f", json.dumps({"encoding": "base64", "content": text[:20] + "\n" + text[20:]}))], "file string, j string").select("file", boards.unwrap_base64(F.col("j")).alias("payload"))
    got = boards.parse_cell_markdown(plain, "file", F.lit("2024-01-10").cast("timestamp")).orderBy("pos").collect()
    assert [(r["company"], r["url"], r["posted_at"]) for r in got] == [("Acme", "https://e/1", datetime(2024, 1, 7)), ("B", "https://e/2", None), ("", None, None)]


def test_html_boards(spark):
    page = """<table class="jv-job-list"><tbody><tr><td class="jv-job-list-name"><a href="/acme/job/o1?x">Dev <b>Intern</b></a></td><td class="jv-job-list-location"> MTL </td></tr>
      <tr onclick="location.href='/acme/job/o2'"><td class="jv-job-list-name">QA</td></tr><tr><td>Show More</td></tr></tbody></table><table><tbody><tr><td class="jv-job-list-name">no</td></tr></tbody></table>"""
    got = html.parse_jobvite(one(spark, page)).orderBy("native_id").collect()
    assert [(r["native_id"], r["title"], r["url"], r["location"], r["whole"]) for r in got] == [("o1", "Dev Intern", "https://jobs.jobvite.com/acme/job/o1?x", "MTL", False), ("o2", "QA", "https://jobs.jobvite.com/acme/job/o2", "", False)]
    bank = '<article id="article-1"><a><span class="noctitle">dev<span class="wb-inv">hidden</span></span></a><span class="jobstudentflag">Student</span><ul><li class="business">Acme</ul></article><article id="article-2"><i class="noctitle">x</i></article><article id="bad"></article>'
    assert [(r["native_id"], r["title"], r["company"], r["location"], r["employment_type"]) for r in html.parse_jobbank(one(spark, bank)).collect()] == [("1", "dev", "Acme", "Canada", "student")]
    item = '<div class="x job_index-content_list_item" id="{0}" data-slug="s{0}"><h2 class="job_index-content_list_item-title">T{0}</h2><p class="job_index-content_list_item_infos-type">{1}</p><div class="job-location-info" data-city="Laval" data-province="QC"></div></div>'
    got = html.parse_espresso(one(spark, item.format(1, "Alternance") + item.format(2, "Temps plein") + item.format(1, "Alternance")), "alternance").collect()
    assert [(r["native_id"], r["company"], r["location"], r["url"]) for r in got] == [("1", "Espresso-Jobs", "Laval, QC, Canada", "https://www.espresso-jobs.com/emploi/1/s1")]


def rows(spark, payload, board):
    return [(r["native_id"], r["title"], r["url"], r["location"]) for r in custom.parse_custom(one(spark, payload), board).collect()]


def test_configured_boards(spark):
    data = {"d": {"jobs": [{"t": "<b>A</b>", "i": 5, "l": [{"c": "X", "n": 1}, {"c": "Y"}], "m": [{"k": "url", "v": "u1"}]}, {"t": "B", "l": {"c": "Z", "p": "QC"}}, {"t": " "}]}}
    fields = {"title": "t", "id": "i", "location": "l", "url": "m[k=url].v"}
    want = [("5", "A", "u1", "X, 1 / Y"), ("B", "B", "https://b/{id}".replace("{id}", "B"), "Z, QC")]
    assert rows(spark, json.dumps(data), custom.Board("json", fields, "d.jobs", url_template="https://b/{id}")) == want
    page = "<script>window.__x = " + json.dumps(data) + "; var y = {}</script>"
    assert rows(spark, page, custom.Board("json", fields, "d.jobs", extract="window.__x =", url_template="https://b/{id}")) == want
    wrapped = "window.__x = JSON.parse(" + json.dumps(json.dumps(data)) + ")"
    assert rows(spark, wrapped, custom.Board("json", fields, "d.jobs", extract="window.__x", url_template="https://b/{id}")) == want
    assert rows(spark, "window.__x = {broken", custom.Board("json", fields, "d.jobs", extract="window.__x")) == []
    rss = "<rss><item><title><![CDATA[A & B]]></title><title>second</title><link>l</link></item><item><title>C &amp; D</title><guid x='1'>g</guid></item></rss>"
    assert rows(spark, rss, custom.Board("rss", {"title": "title", "url": "link", "id": "guid"}, url="https://own")) == [("l", "A & B", "l", ""), ("g", "C & D", "https://own", "")]
    site = "<urlset><url><loc>https://a.org/montreal-qc/data-intern_77?x</loc></url><url><lastmod>1</lastmod></url><url><loc>https://a.org/other/</loc></url></urlset>"
    got = rows(spark, site, custom.Board("sitemap", {"title": "title", "id": "id", "url": "loc", "location": "path2_title"}, row_filter="_"))
    assert got == [("77?x", "Data Intern", "https://a.org/montreal-qc/data-intern_77?x", "Montreal QC")]
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"T","url":"u"},{"@type":"Person"},[{"@type":"JobPosting","title":"S"}]]}</script><script type="application/ld+json">bad</script><script type="application/ld+json">[{"@type":"JobPosting","title":"R"}]</script>'
    assert sorted(rows(spark, ld, custom.Board("jsonld", {"title": "title", "url": "url"}, url="own"))) == [("R", "R", "own", ""), ("S", "S", "own", ""), ("u", "T", "u", "")]
    page = '<ul class="jobs"><li><a href="/j/dev-intern_12">x</a><span class="loc">MTL</span></li><li><a>none</a></li></ul>'
    board = custom.Board("html", {"title": "a::slug(href)", "id": "a::slugid(href)", "url": "a::attr(href)", "location": ".loc"}, row_selector="ul.jobs li", url="https://h/x/")
    assert rows(spark, page, board) == [("12", "Dev Intern", "https://h/j/dev-intern_12", "MTL")]


def files(path):
    return [path / f for f in json.loads((path / export.MANIFEST).read_text())["files"]]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "a,b", "x|y\n z"), ('q"t', None, "\x07ok")], "a string, b string, c string")
    export.write(df, str(tmp_path / "x"), "csv")
    data = b"".join(p.read_bytes() for p in files(tmp_path / "x")).decode()
    assert data.startswith("\ufeffa,b,c\r\n") and "'=1+1,\"a,b\",x|y z\r\n" in data and '"q""t",,ok\r\n' in data
    with pytest.raises(FileExistsError):
        export.write(df, str(tmp_path / "x"), "csv")
    export.write(df, str(tmp_path / "x"), "md", force=True)
    data = "".join(p.read_text() for p in files(tmp_path / "x"))
    assert data.startswith("# Postings\n\n2 postings\n\n| a | b | c |\n") and "| =1+1 | a,b | x\\|y z |" in data
    export.write(df, str(tmp_path / "x"), "json", force=True)
    lines = [json.loads(x) for p in files(tmp_path / "x") for x in p.read_text().splitlines()]
    assert {"a": 'q"t', "b": None, "c": "ok"} in lines and len(list((tmp_path / "x").glob("parts-*"))) == 1
    assert export.read(spark, str(tmp_path / "x")).count() == 2


@pytest.mark.parametrize("step", ["_places", "_switch", "_sweep"])
def test_export_that_breaks_off_leaves_the_old_or_the_new_whole(spark, tmp_path, monkeypatch, step):
    path, first, second = str(tmp_path / "x"), spark.createDataFrame([("old",)], "a string"), spark.createDataFrame([("new",), ("er",)], "a string")
    lines = lambda: sorted(r["value"] for r in export.read(spark, path).collect() if r["value"] not in ("\ufeffa", "a"))
    export.write(first, path, "csv")
    kept = getattr(export, step)

    def broken(*args):
        if step == "_places" and not list((tmp_path / "x").glob("parts-*/_SUCCESS"))[1:]:
            return kept(*args)  # until the new files are written
        raise OSError("broken off")

    monkeypatch.setattr(export, step, broken)
    with pytest.raises(OSError):
        export.write(second, path, "csv", force=True)
    monkeypatch.undo()
    assert lines() == (["er", "new"] if step == "_sweep" else ["old"])
    export.write(first, path, "csv", force=True)
    assert lines() == ["old"] and len(list((tmp_path / "x").glob("parts-*"))) == 1
    with pytest.raises(Exception):  # noqa: B017
        export.write(first.select(F.raise_error(F.lit("x")).alias("a")), path, "csv", force=True)
    assert lines() == ["old"]
    with pytest.raises(FileNotFoundError):
        export.read(spark, str(tmp_path / "none"))
