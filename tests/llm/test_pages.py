import random
import re

from helpers import rows

from tickloom.llm import html_template, url_templates

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad -->
<div class="ad">Buy {k}</div><div id="sidebar">side</div><article><h1>Title {k}</h1><p><b>First &amp; {k}<br><p>second
  line</p><div class="comments"><p>I say {k}</p></div></article><form><p>Search</p></form><footer>&copy; x</footer></body></html>"""


def test_article_without_furniture(spark):
    data = [(k, f"https://h.example.org/p/{k}", PAGE.format(k=k)) for k in range(6)] + [(10, None, None), (11, "https://h.example.org/x", ""), (12, "https://other.net/", "<p>lone <i>words</i>"), (12, "https://other.net/", "<p>lone <i>words</i>"), (13, "bad", "<div <<p>a&am")]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, text string")
    got = rows(html_template.extract(pages))
    by = {r["page_id"]: r for r in got}
    assert len(got) == 11
    for k in range(6):
        assert by[k]["text"] == f"Title {k}\n\nFirst & {k}\n\nsecond line"
    assert by[10]["text"] == by[11]["text"] == "" and by[12]["text"] == "lone words"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_template.extract(pages.limit(0)).count() == 0


def test_parse_closes_what_html_leaves_open():
    _, blocks = html_template.parse("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><p>f<div>g</div>h")
    assert [b.text for b in blocks] == list("abcdefgh")


def test_rules_and_tree(spark):
    urls = [f"http://a.example.net/{lang}/{k}" for lang in ("es", "fr") for k in range(30)] + ["HTTP://WWW.Example.COM/en/1?x=/es/", "https://example.com/en/1", "x.example.com/en/", None, "https://net/es/1#a", "http://b.net", "://B.com/", "http://c.example.org/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by = {r["page_id"]: r for r in rows(url_templates.judge(pages))}
    assert len(by) == len(urls)
    get = lambda k: tuple(by[60 + k][c] for c in ("host", "path", "rule", "verdict"))
    assert all(by[k]["rule"] == ("net/es/" if k < 30 else "net/fr/") and by[k]["verdict"] == "block" for k in range(60))
    assert get(0) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert get(1) == ("example.com", "/en/1", "example.com/en/", "block")
    assert get(2) == get(3) == ("", "", None, "allow")
    assert get(4) == ("net", "/es/1", "net/es/", "block")
    assert get(5) == ("b.net", "", None, "allow") and get(6) == ("b.com", "/", "com/", "allow") and get(7)[2:] == (None, "allow")
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_templates_carry_labels_to_their_other_addresses(spark):
    rules = (url_templates.UrlRule("h.org", "/shop/1", "block"), url_templates.UrlRule("h.org", "/news/1", "allow"))
    urls = [f"http://h.org/{part}/{k}" for part in ("shop", "news") for k in range(200)] + [f"http://h.org/blog/{c}{k}" for c in "ab" for k in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_templates.judge(pages, rules))
    for r in got:
        assert r["verdict"] == ("block" if r["path"].startswith("/shop/") else "allow")
    assert {r["template"] for r in got} >= {"/shop/{n}", "/news/{n}", "/blog/{any}"}


def brute_tree(pages, rules, children=20, share=0.05, least=5, z=1.96, weight=4.0, purity=0.5):
    """Verdict and template of each (host, path), node by node in plain loops, one segment at a time."""

    def ruled(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    def shape(x):
        if re.fullmatch(r"\d+", x):
            return "{n}"
        if re.fullmatch(r"\d+\.\w{1,5}", x):
            return "{n}." + x.split(".")[1]
        return "{x}" if len(x) >= 8 and re.fullmatch(r"[0-9a-fA-F-]+", x) and re.search(r"\d", x) else x

    rows = [(h, p, tuple(shape(x) for x in p.split("/") if x), ruled(h, p)) for h, p in pages]
    templates, groups = {}, {}
    for k, (h, _, segs, _) in enumerate(rows):
        groups.setdefault((h, ""), []).append((k, segs))
    while groups:
        after = {}
        for (h, template), members in groups.items():
            kids = {}
            for k, left in members:
                if left:
                    kids.setdefault(left[0], []).append((k, left[1:]))
                else:
                    templates[k] = template
            total = sum(map(len, kids.values()))
            token, told = {}, []
            for seg, own in kids.items():
                good, bad = (sum(rows[k][3] == v for k, _ in own) for v in ("allow", "block"))
                if len(kids) > children and len(own) < share * total:
                    token[seg] = "{any}"
                elif good + bad >= least:
                    told.append((good / (good + bad), seg, good, good + bad))
            told.sort()
            branches = []
            for x in told:
                if branches:
                    _, _, g, n = branches[-1][-1]
                    pool = (x[2] + g) / (x[3] + n)
                    if abs(x[2] / x[3] - g / n) <= z * (pool * (1 - pool) * (1 / x[3] + 1 / n)) ** 0.5:
                        branches[-1].append(x)
                        continue
                branches.append([x])
            for b, branch in enumerate(branches):
                for _, seg, _, _ in branch if len(branch) > 1 else ():
                    token[seg] = f"{{like{b}}}"
            for seg, own in kids.items():
                after.setdefault((h, f"{template}/{token.get(seg, seg)}"), []).extend(own)
        groups = after
    labels = [r[3] for r in rows if r[3]]
    prior = labels.count("allow") / len(labels) if labels else 0.5
    sums = {}
    for k, (h, _, _, v) in enumerate(rows):
        s = sums.setdefault((h, templates[k]), [0, 0])
        s[0] += v == "allow"
        s[1] += v == "block"
    out = []
    for k, (h, _, _, v) in enumerate(rows):
        good, bad = sums[h, templates[k]]
        learned = "block" if good + bad >= least and (good + weight * prior) / (good + bad + weight) < purity else "allow"
        out.append((v or learned, templates[k]))
    return out


def test_tree_equals_plain_loops(spark):
    rng = random.Random(6)
    rules = (url_templates.UrlRule("h.org", "/shop/a", "block"), url_templates.UrlRule("h.org", "/news/a", "allow"), url_templates.UrlRule("h.org", "/mix/b", "block"), url_templates.UrlRule("org", "/", "allow"))
    parts = ["shop", "news", "mix", "blog", "x", "y"]
    pages = []
    for _ in range(700):
        host = rng.choice(["h.org", "h.org", "w.h.org", "i.net"])
        depth = rng.randint(0, 5)
        pages.append((host, "/" + "/".join(rng.choice([rng.choice(parts), rng.choice("ab") + str(rng.randint(0, 40)), str(rng.randint(0, 99)), "deadbeef01"]) for _ in range(depth))))
    pages += [("deep.net", "/" + "/".join(["s"] * 300 + [c] * 40)) for c in "pq"] + [("deep.net", "/s/t")]
    frame = spark.createDataFrame([(k, f"http://{h}{p}", "clash", 1) for k, (h, p) in enumerate(pages)], "page_id long, url string, host string, n long")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in rows(url_templates.judge(frame.union(frame), rules))}
    want = brute_tree(pages + pages, rules)
    assert [got[k] for k in range(len(pages))] == want[: len(pages)]


def test_host_path_and_rule_equal_sql(spark):
    import duckdb

    from tickloom.llm.queries import op7_url_filters

    sf_dir = "/root/testdata/sf0.001"
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p in (("www.example.com", "/en/"), ("example.com", "/en/"), ("com", "/"), ("net", "/es/"), ("net", "/fr/")))
    sql = f"""WITH cut_url AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '{sf_dir}/pages.parquet'),
              cut AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut_url)
              SELECT page_id, host, path, CASE {fits} END AS rule FROM cut"""
    got = op7_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule").collect()
    assert sorted(map(tuple, got), key=str) == sorted(duckdb.sql(sql).fetchall(), key=str)
