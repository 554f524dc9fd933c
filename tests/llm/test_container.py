from helpers import rows

from tickloom.llm import html_template

PAGE = """<html><body><nav><a href="/">Home</a></nav><article><h1>Title {k}</h1><p class="lede">Lede {k}</p>
<div class="body"><p>{long}</p><h2>Part {k}</h2><p>{long}</p></div>{more}</article><footer>x</footer></body></html>"""


def test_headings_ledes_and_sections_beside_the_body_stay(spark):
    long = "many words of the text itself " * 40
    data = [(k, f"https://h.example.org/{k}", PAGE.format(k=k, long=long, more=f"<section><h2>End {k}</h2><p>Closing {k}</p></section>" if k == 3 else "")) for k in range(8)]
    data.append((8, "https://h.example.org/8", PAGE.format(k=8, long="short", more="")))
    got = {r["page_id"]: r["text"] for r in rows(html_template.extract(spark.createDataFrame(data, "page_id long, url string, html string")))}
    for k in range(8):
        want = [f"Title {k}", f"Lede {k}", long.strip(), f"Part {k}", long.strip()] + ([f"End {k}", f"Closing {k}"] if k == 3 else [])
        assert got[k] == "\n\n".join(want)
    assert got[8] == "Title 8\n\nLede 8\n\nshort\n\nPart 8\n\nshort"


def pages_of(spark, htmls, host="h.example.org"):
    return spark.createDataFrame([(k, f"https://{host}/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def texts_of(spark, htmls):
    got = {r["page_id"]: r["text"] for r in rows(html_template.extract(pages_of(spark, htmls)))}
    return [got[k] for k in range(len(htmls))]


def site(k, extra=""):
    """A site without telling names: a box of links, a claim on every page, and the text in a plain element."""
    parts = "".join(f"<p>Paragraph {k} {j} with words of its own.</p>" for j in range(k % 4 + 2))
    return f"<html><body><div class=q><p>Ask us anything</p></div><div class=w><p><a href=/x>Go to {k}</a></p><p>or</p></div><div class=e><h2>On {k}</h2>{parts}{extra}</div></body></html>"


def brute_template(htmls, common=0.5, repeated=0.8, least=5):
    """Template tokens of one host from whole occurrence vectors."""
    vectors = {}
    for k, page in enumerate(htmls):
        elements, blocks = html_template.parse(page)
        for e in elements:
            vectors.setdefault((e.role, False), [0] * len(htmls))[k] += 1
        for b in blocks:
            vectors.setdefault((html_template.text_role(elements[b.element], b.text), True), [0] * len(htmls))[k] += 1
    groups = {}
    for token, v in vectors.items():
        groups.setdefault(tuple(v), []).append(token)
    n = len(htmls)
    valid = [(t, sum(x > 0 for x in v)) for v, tokens in groups.items() if len(tokens) > 1 for t in tokens]
    return {r for (r, text), pages in valid if not text and pages >= common * n}, {r for (r, text), pages in valid if text and pages >= repeated * n and n >= least}


def test_template_equals_brute_force_vectors(spark):
    for htmls in ([site(k) for k in range(12)], [site(k) for k in range(3)], [site(1), None, "", site(2), "<p>x</p>"] + [site(3)] * 3):
        got = html_template.deduce(pages_of(spark, htmls)).first()
        assert (set(got["roles"]), set(got["texts"])) == brute_template(htmls)


def test_slots_come_from_the_classes(spark, monkeypatch):
    htmls = [site(k, "<p>Ask us anything</p>" if k == 7 else "") for k in range(11)]
    want = [f"On {k}\n\n" + "\n\n".join(f"Paragraph {k} {j} with words of its own." for j in range(k % 4 + 2)) + ("\n\nAsk us anything" if k == 7 else "") for k in range(11)]
    assert texts_of(spark, htmls) == want
    # with the grouping taken away nothing is of the template: links and claims are no slots apart from the text
    from pyspark.sql import functions as F

    monkeypatch.setattr(html_template, "equivalence_classes", lambda tokens: tokens.withColumn("class", F.monotonically_increasing_id()))
    without = texts_of(spark, htmls)
    assert all("Ask us anything" in t and "Go to" in t for t in without)


def test_names_are_hints_only(spark):
    wrapped = [f"<body><div class='content has-sidebar'><h1>T {k}</h1><p>{'text of the page ' * (20 + k)}</p></div><div class=sidebar>Links {k}</div></body>" for k in range(6)]
    assert texts_of(spark, wrapped) == [f"T {k}\n\n" + ("text of the page " * (20 + k)).strip() for k in range(6)]
    own = [f"<body><article><h1>T {k}</h1><p>{'text of the page ' * 20}</p>{'<section class=discussion><h2>Discussion</h2><p>We find.</p></section>' if k == 2 else ''}</article></body>" for k in range(6)]
    assert texts_of(spark, own)[2].endswith("Discussion\n\nWe find.")
    shares = [f"<body><article><h1>T {k}</h1><div class=share>Tell all {k}</div><p>{'text of the page ' * 20}</p></article></body>" for k in range(6)]
    assert not any("Tell" in t for t in texts_of(spark, shares))
    assert texts_of(spark, ["<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p></article>"]) == ["Let x=1 be so."]


def test_long_class_names_stay_apart():
    names = ["a" * 60 + x for x in "bc"]
    roles = [html_template.parse(f"<div class='{n}'>t</div>")[0][1].role for n in names]
    assert roles[0] != roles[1]


def test_deep_nesting_is_linear(spark):
    import time

    def took(n):
        begun = time.perf_counter()
        html_template.parse("<div>" * n + "text" + "</section></p>" * n)
        return time.perf_counter() - begun

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.02)
    assert texts_of(spark, ["<div>" * 20_000 + "deep text"]) == ["deep text"]


def test_page_listed_twice_does_not_cancel_itself(spark):
    once, twice = ([site(k) for k in range(6)] * m for m in (1, 2))
    again = spark.createDataFrame([(k % 6, f"https://h.example.org/{k % 6}", h) for k, h in enumerate(twice)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in rows(html_template.extract(again))) == sorted((k, t) for k, t in enumerate(texts_of(spark, once)) for _ in range(2))
