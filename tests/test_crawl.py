"""Crawls in rounds: retry pass, resume, limits."""

import os

import pytest

from oreweave.plans import crawl as C

SITE = {
    "/": '<a href="/year/1">1</a><a href="/year/2">2</a><a href="/year/3">3</a><a href="/f/a.pdf">a</a>',
    "/year/1": '<a href="/issue/11">x</a><a href="/f/b.pdf?x=1">b</a><a href="/f/a.pdf">again</a>',
    "/year/2": '<a href="/issue/21">x</a><a href="/f/c.pdf">c</a>',
    "/issue/11": '<a href="/year/1">back</a><a href="/f/d.PDF">d</a>',
    "/issue/21": '<a href="/f/e.pdf">e</a>',
}
ROOT = "https://lib.org"


@pytest.fixture
def site(spark):
    rows = [(ROOT + path, html, 1 if path == "/year/2" else 0) for path, html in SITE.items()]
    return spark.createDataFrame(rows, "url string, html string, failures int")


def counted(fetch, asked):
    def pages(rows):
        asked.extend((r.url, r.attempt) for r in rows.collect())
        return fetch(rows)

    return pages


def test_failing_pages_are_tried_once_more_at_the_end(spark, site, tmp_path):
    asked = []
    done = C.Crawl(spark, str(tmp_path), [ROOT + "/"] * 2 + [None]).run(counted(C.stored_site(site), asked))
    got = {r.url.removeprefix(ROOT): (r.attempts, r.fetched) for r in done.collect()}
    assert got == {"": (1, True), "/year/1": (1, True), "/year/2": (2, True), "/year/3": (2, False), "/issue/11": (1, True)} or got == {
        "/": (1, True), "/year/1": (1, True), "/year/2": (2, True), "/year/3": (2, False), "/issue/11": (1, True)}
    assert len(asked) == len(set(asked)) == 7 and {a for _, a in asked[-2:]} == {2}
    crawl = C.Crawl(spark, str(tmp_path))
    links = {r.link.rsplit("/", 1)[-1]: (r.page_url.removeprefix(ROOT).strip("/"), r["round"]) for r in crawl.links().collect()}
    assert links == {"a.pdf": ("", 1), "b.pdf?x=1": ("year/1", 2), "c.pdf": ("year/2", 4), "d.PDF": ("issue/11", 3)}


def test_retried_pages_are_followed_if_asked(spark, site, tmp_path):
    crawl = C.Crawl(spark, str(tmp_path), [ROOT + "/"], C.Limits(retries=2, follow_retried=True))
    got = {r.url.removeprefix(ROOT): r.attempts for r in crawl.run(C.stored_site(site)).collect()}
    assert got["/issue/21"] == 1 and got["/year/3"] == 3 and crawl.links().count() == 5


def test_a_stopped_crawl_asks_for_no_page_twice(spark, site, tmp_path):
    asked = []
    fetch = counted(C.stored_site(site), asked)
    for _ in range(2):
        C.Crawl(spark, str(tmp_path), [ROOT + "/"]).run(fetch, max_rounds=1)
    crawl = C.Crawl(spark, str(tmp_path), [ROOT + "/"])
    crawl._write("pages", 3, fetch(crawl._ask(2)), C.PAGE)  # killed after the pages of round 3
    crawl.run(fetch)
    assert len(asked) == len(set(asked)) == 7 and crawl.links().count() == 4
    assert C.Crawl(spark, str(tmp_path)).run(fetch).count() == 5 and len(asked) == 7


def test_limits_known_links_and_manifest(spark, site, tmp_path):
    known = spark.createDataFrame([(ROOT + "/f/b.pdf?x=1",)], "link string")
    fetch = C.stored_site(site)
    first = C.harvest_links(spark, str(tmp_path / "a"), [ROOT + "/"], fetch, known=known, max_rounds=1)
    whole = C.harvest_links(spark, str(tmp_path / "a"), [ROOT + "/"], fetch, known=known)
    assert first["status"] == "running" and (whole["status"], whole["pages"], whole["retried"], whole["failed"]) == ("completed_degraded", 5, 2, 1)
    lines = [r.value for r in spark.read.text(str(tmp_path / "a" / "links")).collect()]
    assert sorted(line.rsplit("/", 1)[-1] for line in lines) == ["a.pdf", "c.pdf", "d.PDF"]
    few = C.harvest_links(spark, str(tmp_path / "b"), [ROOT + "/"], fetch, C.Limits(pages=2, links=2))
    assert (few["pages"], few["links_written"]) == (2, 2)
    assert C.harvest_links(spark, str(tmp_path / "c"), [], fetch)["pages"] == 0


def test_command_line(spark, tmp_path, capsys):
    from oreweave import cli

    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "offline_fetch.py"))
    seed = ["--seed", ROOT + "/page/1", "--fetch", "offline_fetch:linked_page", "--option", "bad=/page/3"]
    assert cli.main(["--ledger", str(tmp_path / "l"), "crawl", str(tmp_path / "out"), *seed]) == 2
    assert '"pages": 3, "fetched": 2, "retried": 1, "failed": 1' in capsys.readouterr().out
    assert {r.value for r in spark.read.text(str(tmp_path / "out" / "links")).collect()} == {ROOT + "/f/1.pdf", ROOT + "/f/2.pdf"}
