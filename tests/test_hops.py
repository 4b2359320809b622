"""Robots files, redirects, exact percentiles and provider scans on inline cases."""

from __future__ import annotations

import json
import math
import random
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit
from urllib.robotparser import RobotFileParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hops as H
from tessera.operators import metrics as M
from tessera.sources import files as S

ROBOTS = """# rules
User-agent: other
Disallow: /

User-agent: *
Allow: /public/
Disallow: /p
Disallow: /*.pdf$
Disallow: /q?x=
Disallow:

user-agent: Tess
User-agent: second
Disallow: /mine # ours
Allow: /mine/open
Disallow: /a*b/
"""


def plain_allowed(groups, agent, at):
    own = [r for names, r in groups if any(n != "*" and agent.lower().startswith(n) for n in names)]
    rules = sum(own, []) if own else sum([r for names, r in groups if "*" in names], [])
    best = (0, True)
    for allow, pattern in rules:
        body = re.escape(pattern.rstrip("$")).replace(r"\*", ".*") + ("$" if pattern.endswith("$") else "")
        if re.match(body, at):
            best = max(best, (len(pattern), allow))
    return best[1]


@pytest.mark.parametrize("agent", ["TesseraBot", "Elsebot"])
def test_robots_longest_rule_decides(spark, agent):
    groups = [(["other"], [(False, "/")]), (["*"], [(True, "/public/"), (False, "/p"), (False, "/*.pdf$"), (False, "/q?x=")]), (["tess", "second"], [(False, "/mine"), (True, "/mine/open"), (False, "/a*b/")])]
    paths = ["/", "", "/public/x", "/private", "/x/y.pdf", "/x/y.pdf?z", "/q?x=1", "/q?y=1", "/mine", "/mine/open/1", "/mine/shut", "/axxb/c", "/axxb", "/a.b/"]
    urls = [(f"http://h.example{p}",) for p in paths] + [("http://free.example/p",), ("http://blank.example/p",)]
    rules = H.robots_rules(spark.createDataFrame([("h.example", ROBOTS), ("blank.example", None)], "host string, content string"), agent)
    got = {r.url: r.allowed for r in H.robots_allowed(spark.createDataFrame(urls, "url string"), rules).collect()}
    assert got == {f"http://h.example{p}": plain_allowed(groups, agent, p or "/") for p in paths} | {"http://free.example/p": True, "http://blank.example/p": True}


def test_robots_of_the_standard_parser_where_both_agree(spark):
    text = "User-agent: *\nDisallow: /a\nDisallow: /b/c\n\nUser-agent: x\nDisallow: /z\n"
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    urls = [f"http://h.example/{p}" for p in ("a", "ab", "b", "b/c", "b/cd", "z", "")]
    rules = H.robots_rules(spark.createDataFrame([("h.example", text)], "host string, content string"), "tess")
    got = {r.url: r.allowed for r in H.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == {u: parser.can_fetch("tess", u) for u in urls}


def plain_chain(table, url, most, ok):
    from urllib.parse import urljoin

    at = url
    for n in range(most + 1):
        if at not in table:
            return at, None, n, "not_landed"
        status, location = table[at]
        if status not in H.REDIRECTS:
            return at, status, n, None
        if not (location or "").strip():
            return at, status, n, "redirect_without_location"
        if n >= most:
            return at, status, n, "too_many_redirects"
        target = urljoin(at, location.strip())
        if not ok(target):
            return target, None, n, "redirect_disallowed"
        at = target
    raise AssertionError


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 5, 7])
def test_redirects_end_where_a_walk_ends(spark, most):
    r = random.Random(most)
    urls = [f"http://h{i % 3}.example/p{i}" for i in range(120)]
    table = {}
    for i, u in enumerate(urls):
        k = r.random()
        target = r.choice([f"/p{(i + 3) % 120}", urls[r.randrange(120)], f"//h1.example/p{r.randrange(120)}", "http://bad.example/x", "http://h1.example/never", "", None, " " + urls[(i + 1) % 120]])
        table[u] = (200, None) if k < 0.15 else (404, "ignored") if k < 0.2 else (r.choice(H.REDIRECTS), target)
    table["http://h0.example/loop"] = (302, "loop")
    rows = [(u, *v) for u, v in table.items()]
    got = H.redirect_chains(spark.createDataFrame(rows, "url string, status int, location string"), lambda u: ~F.contains(u, F.lit("bad")), most)
    got = {x.url: (x.final_url, x.status, x.hops, x.fault) for x in got.collect()}
    assert got == {u: plain_chain(table, u, most, lambda x: "bad" not in x) for u in table}


@pytest.mark.parametrize("seed", range(4))
def test_percentiles_equal_numpy(spark, monkeypatch, seed):
    monkeypatch.setattr(M, "FEW", [4096, 10, 3, 1][seed])
    monkeypatch.setattr(M, "PARTS", [1024, 7, 2, 16][seed])
    r = np.random.default_rng(seed)
    values = [r.normal(0, 1, 500), r.integers(0, 5, 400).astype(float), np.concatenate([np.full(300, 7.0), r.exponential(1e6, 50), [-1e300, 1e300]]), np.array([3.5])][seed]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double")
    shares = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    got = M.exact_percentiles(df, "v", shares)
    assert got == pytest.approx([float(np.quantile(values, p)) for p in shares], rel=1e-12)
    assert M.exact_percentiles(df.where("v > 1e305"), "v", [0.5]) == [None]


@pytest.fixture
def provider():
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = parse_qs(urlsplit(self.path).query)
            asked.append((q["q"][0], q.get("limit", [""])[0]))
            if "broken" in q["q"][0]:
                self.send_error(500)
                return
            body = json.dumps({"data": {"results": [{"title": f"{q['q'][0]} {i}", "url": f"http://h.example/{i}", "content": None, "publishedDate": "2024"} for i in range(9)]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search?q={{query}}&limit={{limit}}", asked
    server.shutdown()


def test_search_asks_for_what_the_filter_names(spark, provider):
    url, asked = provider
    S.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("search_results").option("url", url).option("items", "data.results").option("limit", "3").option("domains", "a.example, b.a.example").load()
        found = load().where("query IN ('one', 'two words') AND rank <> 2")
        rows = sorted((r.query, r.rank, r.title, r.snippet) for r in found.collect())
        assert rows == [(q, k, f"{q} site:a.example {k - 1}", None) for q in ("one", "two words") for k in (1, 3)]
        assert sorted(asked) == [("one site:a.example", "3"), ("two words site:a.example", "3")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "rank" in plan.split("BatchScan")[0] and "two words" not in plan.split("BatchScan")[0]  # only rank is left to filter
        assert load().where("query = 'one' AND query = 'two'").count() == 0 and len(asked) == 2
        with pytest.raises(Exception, match="filter on query"):
            load().collect()
        with pytest.raises(Exception, match="500"):
            load().where("query = 'broken'").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
