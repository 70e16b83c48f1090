from __future__ import annotations

import random
import re

from duelframe.llm import line_dedup as L
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, html string, host string, page int, line int, places int"


def pages():
    r = random.Random(9)
    out = []
    for i in range(300):
        host = r.choice(["http://big.example/", "http://big.example/", "HTTPS://Small.Example/a", "//tiny.example", None, "nothing"])
        body = [f"line {r.randrange(6)}", "  menu\t", f"only {i}", "", "every page", "every page"]
        r.shuffle(body)
        out.append((i, host, "<p>" + "</p><p>".join(body) + "</p><script>x='<p>'</script><!-- c\n --><STYLE>s</STYLE>"))
    return [*out, (900, "http://big.example/", None), (901, None, ""), out[3], out[4], (902, "//huge.example/", "<br>".join(f"l{i}" for i in range(30_000)))]


def brute(rows, ratio, least):
    lines = []
    for _, url, html in rows:
        text = re.sub(r"<[^>]*>", "\n", re.sub(L.HIDDEN, "\n", html or ""))
        lines.append([x.strip(L.SPACE) for x in text.split("\n") if x.strip(L.SPACE)])
    hosts = [(m[1].lower() if url and (m := re.match(L.HOST, url)) else "") for _, url, _ in rows]
    out = []
    for (i, _, _), host, own in zip(rows, hosts, lines, strict=True):
        same = [set(x) for h, x in zip(hosts, lines, strict=True) if h == host]
        n = {x: sum(x in s for s in same) for x in set(own)} if len(own) < 1000 else dict.fromkeys(own, 1)
        out.append((i, host, own, [x for x in own if not (n[x] >= least and n[x] > ratio * len(same))]))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "h", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    for ratio in (0.1, 0.3):
        out = L.drop_site_lines(df, ratio=ratio).collect()
        assert sorted(((r["row"]["page_id"], r["host"], list(r["lines"]), list(r["kept"])) for r in out), key=repr) == brute(rows, ratio, L.MIN_PAGES)
    assert out[0]["row"].asDict().keys() == set(df.columns)
    assert L.drop_site_lines(df.limit(0)).count() == 0
    assert spark.range(1).select(F.size(L.visible_lines(F.lit(None).cast("string")))).first()[0] == 0
