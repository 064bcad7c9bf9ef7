"""Main text: pages of known content through the query's operator, in several languages, templates and disturbances."""

import random

import pytest

from mirador.llm import html_text as h

SF = "/root/testdata/sf0.1"
POLISH = "W dawnych czasach mieszkańcy tej doliny budowali domy z kamienia, ponieważ drewna było niewiele, a zimy trwały bardzo długo i przynosiły obfity śnieg, który zasypywał drogi."
CHINESE = "在很久以前,这个山谷里的居民用石头建造房屋,因为木材很少,而冬天非常漫长,大雪常常把道路全部掩埋,人们只能待在家里等待春天的到来,然后重新开始一年的劳作。"
ENGLISH = "In those days the people of the valley built their houses of stone, as there was little wood and the winters were so long that the roads had been covered with snow for most of the year."
GREEK = "Τα παλιά χρόνια οι κάτοικοι της κοιλάδας έχτιζαν τα σπίτια τους με πέτρα, γιατί το ξύλο ήταν λίγο και οι χειμώνες κρατούσαν πολύ, και το χιόνι σκέπαζε συχνά όλους τους δρόμους."
TEXTS = {"pl": POLISH, "zh": CHINESE, "en": ENGLISH, "el": GREEK}
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'
FOOT = '<footer><p>Copyright 2020, all rights reserved.</p><a href="/x">Imprint</a></footer>'


def paragraphs(lang, n=12):
    return [f"{i}. {TEXTS[lang]}" for i in range(n)]


def tagged(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def page(body, lang="pl"):
    return f'<html><head><title>T</title><script>var a = "<p>x</p>";</script></head><body>{MENU}{body}{FOOT}</body></html>'


def cases():
    """(html, main text) in pairs, by name."""
    out = {}
    for lang in TEXTS:
        ps = paragraphs(lang)
        want = " ".join(ps)
        out[lang, "article"] = page(f"<article>{tagged(ps)}</article>"), want
        out[lang, "no article"] = page(f"<div>{tagged(ps)}</div>"), want
        out[lang, "aside in the article"] = page(f"<article>{tagged(ps[:5])}<aside>Read more of this</aside>{tagged(ps[5:])}</article>"), want
        out[lang, "aside last"] = page(f"<article>{tagged(ps)}<aside><p>Related</p></aside></article>"), want
        out[lang, "advert first"] = page(f'<article><div class="ad">Buy now</div>{tagged(ps)}</article>'), want
        out[lang, "comments last"] = page(f'<article>{tagged(ps)}<section class="comments"><p>{TEXTS["en"]}</p></section></article>'), want
        out[lang, "advert after"] = page(f'<article>{tagged(ps)}</article><div class="ad">Buy now</div>'), want
        out[lang, "form around"] = f"<html><body><form action='x'>{MENU}<article>{tagged(ps)}</article>{FOOT}</form></body></html>", want
        out[lang, "form around, no article"] = f"<html><body><form action='x'>{MENU}<div>{tagged(ps)}</div>{FOOT}</form></body></html>", want
        out[lang, "form in the article"] = page(f"<article>{tagged(ps)}<form><label>Your name</label><p>Sign up for our news</p></form></article>"), want
        out[lang, "a linked paragraph"] = page(f"<article>{tagged(ps[:4])}<p><a href='/y'>{ps[4]}</a></p>{tagged(ps[5:])}</article>"), want
        out[lang, "a list of links"] = page(f"<article>{tagged(ps)}<ul>" + "".join(f"<li><a href='/{i}'>More {i}</a></li>" for i in range(4)) + "</ul></article>"), want
        out[lang, "headings"] = page(f"<article><h1>Title</h1>{tagged(ps[:3])}<h2>Part</h2>{tagged(ps[3:])}</article>"), " ".join(["Title", *ps[:3], "Part", *ps[3:]])
        out[lang, "one short paragraph"] = "<html><body><p>Short words.</p></body></html>", "Short words."
        out[lang, "dialog"] = page(f"<div role='dialog'><p>We use cookies, please agree.</p></div><article>{tagged(ps)}</article>"), want
    out["", "formula"] = page("<article><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> here.</p></article>"), "We have x=2 here."
    out["", "only a menu"] = f"<html><body>{MENU}{FOOT}</body></html>", ""
    out["", "only a form"] = f"<html><body>{MENU}<form><label>Name</label><input><p>Send</p></form>{FOOT}</body></html>", ""
    return out


def test_known_pages_through_the_operator(spark):
    found = cases()
    rows = [(i, f"u{i}", html) for i, (html, _) in enumerate(found.values())]
    rows += [(None, "n", None), (None, None, ""), (0, "u0", rows[0][2]), (0, "u0", rows[0][2])]
    df = spark.createDataFrame([(*r, "text", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = h.extract_pages(df).collect()
    want = [(i, f"u{i}", text) for i, (_, text) in enumerate(found.values())]
    want += [(None, "n", ""), (None, None, ""), want[0], want[0]]
    key = lambda x: tuple(map(str, x))
    for a, b in zip(sorted(((r.page_id, r.url, r.text) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a == b, list(found)[a[0]] if a[0] is not None else None
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert h.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_disturbances_change_no_page(spark):
    rng = random.Random(2)
    rows = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(500).collect() if r.html]
    kinds = ['<aside>More of this</aside>', '<div class="ad">Buy now</div>', '<section id="comments"><p>I do not like the way that this was said at all.</p></section>']
    for html in rows:
        want = h.extract(html)
        assert h.extract(html.replace("<body>", "<body><form>", 1).replace("</body>", "</form></body>", 1)) == want
        if "</article>" in html:
            for kind in kinds:
                assert h.extract(html.replace("</article>", f"{kind}</article>", 1)) == want
                assert h.extract(html.replace("</article>", f"</article>{kind}", 1)) == want
            ends = [i + 4 for i in range(len(html)) if html.startswith("</p>", i) and html.find("<article") < i < html.find("</article>")]
            if ends:
                at = rng.choice(ends)
                assert h.extract(html[:at] + kinds[1] + html[at:]) == want


@pytest.mark.parametrize("rules", [h.Rules(stop_low=0.0, stop_high=0.0), h.Rules(most_links=2.0), h.Rules(long=100_000, short=99_999)])
def test_measures_decide_where_nothing_is_marked(rules):
    """Without names and tags that tell, each measure of the first pass changes results."""
    links = "".join(f"<div><a href='/{i}'>Another page of this site that tells of the {i} things of the day and more of it</a></div>" for i in range(6))
    junk = "<div>" + "xk9 zz81 qpq " * 30 + "</div>"
    html = f"<html><body>{links}<div>{ENGLISH}</div><div>{ENGLISH} And more.</div>{junk}</body></html>"
    want = f"{ENGLISH} {ENGLISH} And more."
    assert h.extract(html) == want
    assert h.extract(html, rules) != want


def test_long_pages_take_linear_time():
    import time

    for html in ("<form>" * 3000 + "<p>x</p>" * 3000, "<label>x" * 20_000, "<article>" + "<p>" + POLISH + "</p>" * 2000, "<p><a>x</a></p>" * 30_000):
        began = time.time()
        h.extract(html)
        assert time.time() - began < 10
