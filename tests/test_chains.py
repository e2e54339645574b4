"""Page chains: order, broken links, cycles."""

import random

from tickwarden.operators import chains
from tickwarden.session import materialized


def walk(pages):
    """(url, next_url) rows to positions and report, link by link."""
    links = {}
    for url, following in pages:
        if url is not None:
            links[url] = max(filter(None, (links.get(url), following)), default=None)
    before = {}
    for url, following in links.items():
        if following in links:
            before[following] = min(before.get(following, url), url)
    ranks, report = {}, {}
    for head in (u for u in links if u not in before):
        url, position = head, 0
        while True:
            ranks[url] = (head, position)
            following = links[url]
            if following not in links or before[following] != url:
                break
            url, position = following, position + 1
        report[head] = [position + 1, following]
    for url in links:
        if url not in ranks:
            ring, at = [url], links[url]
            while at != url:
                ring.append(at)
                at = links[at]
            ranks[url] = (min(ring), None)
            report[min(ring)] = [len(ring), None, "cycle"]
    for head, entry in report.items():
        if len(entry) == 2:
            into = ranks.get(entry[1])
            entry.append("complete" if entry[1] is None else "broken" if into is None else
                         "cycle" if into[0] == head else "joins")
    return (sorted((u, *r) for u, r in ranks.items()),
            sorted((c, n, status, str(following)) for c, (n, following, status) in report.items()))


def ranked(spark, pages):
    df = spark.createDataFrame(pages, "url string, next_url string").repartition(4)
    links = materialized(chains.page_links(df), "test-links")
    ranks = chains.rank_pages(links)
    report = chains.chain_report(links, ranks)
    return (sorted(map(tuple, ranks.select("url", "chain", "position").collect())),
            sorted((r.chain, r.pages, r.status, str(r.next_url)) for r in report.collect()))


def test_links_of_every_kind(spark):
    pages = [("a0", "a1"), ("a1", "a2"), ("a2", None), ("a2", ""),  # complete, landed twice
             ("b0", "b1"), ("b1", "gone"),  # broken
             ("c0", "c1"), ("c1", "c2"), ("c2", "c0"),  # a cycle
             ("d0", "d0"),  # names itself
             ("e0", "a1"),  # joins the first chain
             ("f0", "f1"), ("f1", "f2"), ("f2", "f1"),  # runs into a cycle
             ("g0", None), ("g0", "g1"), ("g1", None),  # continued later
             (None, "a1"), (None, None)]
    random.Random(1).shuffle(pages)
    got = ranked(spark, pages)
    assert got == walk(pages)
    assert {(c, s) for c, _, s, _ in got[1]} >= {
        ("a0", "complete"), ("b0", "broken"), ("c0", "cycle"), ("d0", "cycle"), ("e0", "joins"), ("f0", "cycle"), ("g0", "complete")}


def test_random_links(spark):
    rng = random.Random(2)
    pages = [(f"p{rng.randrange(400)}", rng.choice([None, f"p{rng.randrange(500)}"])) for _ in range(300)]
    assert ranked(spark, pages) == walk(pages)


def test_a_chain_of_ten_thousand_pages_and_many_short_ones(spark):
    pages = [(f"L{i}", f"L{i + 1}" if i < 9_999 else None) for i in range(10_000)]
    pages += [(f"S{i}-{k}", f"S{i}-{k + 1}" if k < 3 else None) for i in range(200) for k in range(4)]
    random.Random(3).shuffle(pages)
    ranks, report = ranked(spark, pages)
    assert [r for r in ranks if r[1] == "L0"] == sorted((f"L{i}", "L0", i) for i in range(10_000))
    assert len(report) == 201 and ("L0", 10_000, "complete", "None") in report


def test_no_pages(spark):
    assert ranked(spark, []) == ([], [])


def test_bars_come_in_the_order_of_the_links(spark):
    pages = spark.createDataFrame(
        [("u1", "A", [{"c": "3"}, {"c": "4"}], None), ("u0", "A", [{"c": "1"}, {"c": "2"}], "u1")],
        "url string, ticker string, results array<map<string,string>>, next_url string")
    ranks = chains.rank_pages(chains.page_links(pages))
    rows = chains.ordered_bars(pages, ranks).orderBy("chain", "position", "index").collect()
    assert [r.bar["c"] for r in rows] == ["1", "2", "3", "4"]
