"""Operators on rows of their own: media, language, HTML, toxicity, quality."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsight.llm import html_text, language, media, quality_mil, toxicity

from .conftest import CLASH, ODD


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for n in (0, 1, 191, 192, 193, 5000):
        samples = media.payload(bytes(rng.integers(1, 256, n, dtype=np.uint8)))
        assert len(samples) % 192 == 0 and len(samples) >= max(n, 192)
        for adaptive in (False, True):
            data = media.encode_png(samples, adaptive=adaptive)
            assert media.decode_png(data).tobytes() == samples
            for at in (3, 20, len(data) // 2, len(data) - 5):
                bad = bytearray(data)
                bad[at] ^= 1
                with pytest.raises((ValueError, zlib.error)):
                    media.decode_png(bytes(bad))
            with pytest.raises((ValueError, zlib.error)):
                media.decode_png(data[:-14])


def test_png_every_filter():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (9, 192), dtype=np.uint8)
    for kinds in ([0, 1, 2, 3, 4, 2, 1, 4, 3], [2] * 9, [1, 2, 2, 0, 2, 1, 2, 2, 2]):
        raw = np.zeros((9, 193), np.uint8)
        for y, kind in enumerate(kinds):
            raw[y, 0] = kind
            for x in range(192):
                a, b, c = (int(rows[y, x - 3]) if x >= 3 else 0), (int(rows[y - 1, x]) if y else 0), (int(rows[y - 1, x - 3]) if y and x >= 3 else 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                raw[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255
        assert (media.unfilter(raw) == rows).all()


def test_media_of_odd_rows(make):
    out = media.image_features(media.encode_images(make(ODD, **CLASH))).collect()
    assert len(out) == len(ODD)
    for row, odd in zip(out, ODD, strict=True):
        text = (odd[1] if isinstance(odd, tuple) else odd) or ""
        want = media.payload(text.encode())
        assert row["n_bytes"] == len(text.encode()) and row["payload_bytes"] == len(want)
        assert row["payload_sha256"] == hashlib.sha256(want).hexdigest() and row["tail_crc32"] == zlib.crc32(want[-16:])
    assert media.image_features(media.encode_images(make([]))).count() == 0


def test_cosine_hash_is_low_frequency():
    rng = np.random.default_rng(2)
    img = np.repeat(np.repeat(rng.integers(0, 256, (8, 8, 3), dtype=np.uint8), 8, 0), 8, 1)
    near = np.clip(img.astype(int) + rng.integers(-6, 7, img.shape), 0, 255).astype(np.uint8)
    other = np.repeat(np.repeat(rng.integers(0, 256, (8, 8, 3), dtype=np.uint8), 8, 0), 8, 1)
    bits = lambda z: np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(z)), np.uint8))
    assert (bits(img) != bits(near)).sum() <= 6 < 16 <= (bits(img) != bits(other)).sum()


def test_language_held_out_accuracy(spark, sf_dir):
    from pairsight.llm.queries import op3_language

    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    out = op3_language(spark, sf_dir.replace("sf0.001", "sf0.01")).join(docs, "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97 and out["score"].between(0, 1).all()


def test_language_of_odd_rows(make):
    docs = make(ODD, **CLASH)
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    model = language.fit_model(docs)
    out = language.identify(docs, model).collect()
    assert len(out) == len(ODD)
    for row, odd in zip(out, ODD, strict=True):
        text = odd[1] if isinstance(odd, tuple) else odd
        if not text or not any(c.isalpha() for c in text):
            assert row["lang_pred"] == "und" and row["score"] == 0
    assert language.fit_model(make([])) is None and language.identify(make([]), model).count() == 0


def test_languages_beyond_the_sample_bound(make):
    """More languages than sampled rows: each keeps a row, none is left out."""
    from pyspark.sql import functions as F

    docs = make([f"{chr(97 + i // 10) * 3} {chr(97 + i % 10) * 4} zz" for i in range(60)]).withColumn("lang", F.concat(F.lit("x"), F.col("doc_id")))
    model = language.fit_model(docs, settings=language.Settings(rows=10))
    assert len(model.langs) == 60


def test_features_of_many_short_rows_are_dealt_out():
    model = language.Model(language.Sparse.of(language.features([b"the cat", b"der hund"], language.Settings())), ["en", "de"], language.Settings())
    lang, score = model.predict(["the cat", "der hund", None] * 2000)
    assert lang == ["en", "de", "und"] * 2000 and len(score) == 6000


def test_language_hierarchy():
    model = language.Model(language.Sparse.of(language.features([b"the cat and the dog", b"der hund und die katze", b"le chat et le chien", b"el gato y el perro"] * 5, language.Settings())), ["en", "de", "fr", "es"] * 5, language.Settings())
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    assert model.predict(["el perro y el gato"])[0] == ["es"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><b>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad -->
<div class="cookie-banner">We use cookies.</div><article><h1>Head &amp; line</h1><p>First <b>bold</b> part<br>goes   on.
<p>Short.</p><div class="ad">Buy now</div><ul><li>One</li><li>Two &lt;x&gt; &#233;</li></ul><form><input><button>Go</button>Name</form><section class="comments"><p>I agree with this.</p></section></article>
<aside>More stories that are long enough to be taken for text by length alone, are they not?</aside><footer>&copy; me</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Head & line\nFirst bold part goes on.\nShort.\nOne\nTwo <x> é"


def test_html_two_passes_without_article():
    long = "This is the text of the story and it is about what the people of the town did when they had no water for a week, and how all of them got on with it in the end as they do. " * 2
    page = f"<div><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><p>{long}</p><p>Short one.</p><p>{long}</p><div>Copyright Megacorp Widgets Incorporated Holdings International Limited Partners Group 2020</div>"
    got = html_text.main_text(page).split("\n")
    assert got == [long.strip(), "Short one.", long.strip()]


def test_html_wrappers_of_the_article_stay():
    long = "This is the text of the story and it is about what the people of the town did when they had no water for a week, and how all of them got on with it in the end as they do. " * 2
    body = f"<p>{long}</p><p>Short one.</p><p>{long}</p>"
    want = [long.strip(), "Short one.", long.strip()]
    junk = f"<div class='sidebar'><p>We sell what you want to have.</p></div><div id='comments'><p>I am with you on all of this.</p></div>"
    for wrap in ("<div class='content has-sidebar'>{}</div>", "<div class='layout no-sidebar'>{}</div>", "<div class='page-widget'>{}</div>", "<div class='post with-comments'>{}</div>", "<div class='social-enabled'>{}</div>", "<form id='aspnetForm'>{}</form>", "<body class='comments-open'>{}</body>"):
        for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
            assert html_text.main_text(wrap.format(inner + junk)).split("\n") == want, (wrap, inner[:9])
    assert html_text.main_text(f"<article class='post comments-open'>{body}{junk}</article>").split("\n") == want
    # comments as articles, of more text than the story's, stay out
    many = "<div id='comments'>" + f"<article class='comment'><p>{long}</p></article>" * 5 + "</div>"
    assert html_text.main_text(f"<div>{body}</div>{many}").split("\n") == want


def test_html_languages_without_a_word_list():
    nav, foot = "<nav><a href=a>Menu</a></nav>", "<footer>Imprint</footer>"
    texts = {
        "it": "Il paese era rimasto senza acqua per una settimana e tutti gli abitanti si erano messi a scavare un pozzo nella piazza davanti alla chiesa, finché non trovarono quella che cercavano.",
        "fi": "Kylän asukkaat kaivoivat viikon ajan uutta kaivoa kirkon edustalle, koska vanha lähde oli kuivunut eikä vettä riittänyt enää kenellekään. Lopulta he löysivät vettä.",
        "hu": "A falu lakói egy hétig ástak új kutat templomuk előtt, mert régi forrásuk kiszáradt, így senkinek sem jutott elegendő víz, amíg végül mélyebbre ásva találtak eleget.",
        "ru": "Целую неделю жители деревни рыли новый колодец перед церковью, потому что старый источник высох и воды уже не хватало никому, пока наконец они не нашли её.",
        "zh": "村民们花了整整一个星期在教堂前挖掘新的水井，因为原来的泉水已经干涸，谁也没有足够的水可以饮用，直到最后他们终于在更深的地方找到了水，大家都非常高兴，并且一起庆祝了整整三天三夜才各自回家休息。",
        "ja": "村人たちは古い泉が枯れてしまい誰にも十分な水がなくなったため、教会の前で一週間かけて新しい井戸を掘り続け、ついに深いところで水を見つけてみんなで喜び合い、三日三晩にわたって盛大に祝ったということです。",
    }
    for lang, text in texts.items():
        for body in (text, text * 3):
            assert len(body) >= 70
            assert html_text.main_text(f"{nav}<div><p>{body}</p><p>{body}</p></div>{foot}") == f"{body}\n{body}", lang


def test_html_words_in_attributes_and_headings():
    long = "This is the text of the story and it is about what the people of the town did when they had no water for a week, and how all of them got on with it in the end as they do. " * 2
    wrap = "<nav><a href=a>Menu</a></nav><article>{}</article><footer>Imprint</footer>"
    body = f"<h2 id='related-work'>Related work</h2><h2 id=social-impact>Impact</h2><p title='A hidden gem'>{long}</p><section id='notice-and-consent'><p>{long}</p></section>"
    assert html_text.main_text(wrap.format(body)).split("\n") == ["Related work", "Impact", long.strip(), long.strip()]
    assert html_text.main_text(wrap.format(f"<p>{long}</p><div id='comments'><p>{long}</p></div><p hidden>{long}</p><div class='share'>Share <a href=b>there</a></div>")).split("\n") == [long.strip()]
    for mark in ("role='main'", "role=main", 'ROLE="main"'):
        assert html_text.main_text(f"<div><p>Somewhere else.</p></div><div {mark}><p>{long}</p></div>") == long.strip()
    for outer in ('class="layout with-sidebar"', 'class="has-sidebar"', 'class="menu-open wrapper no-sidebar"'):
        assert html_text.main_text(f"<div {outer}><article><p>{long}</p></article></div>") == long.strip()
    # cards marked as articles beside a story that isn't: the rules decide
    cards = "".join(f"<article><a href={i}>A card with a link to page {i}</a></article>" for i in range(9))
    assert html_text.main_text(f"<div>{cards}</div><div><p>{long}</p><p>{long}</p></div>").split("\n") == [long.strip()] * 2


def test_html_block_rules_decide_within_a_marked_article():
    long = "This is the text of the story and it is about what the people of the town did when they had no water for a week, and how all of them got on with it in the end as they do. " * 2
    links = "<ul>" + "".join(f"<li><a href={i}>Another page about something else altogether, number {i} of many more to read</a></li>" for i in range(4)) + "</ul>"
    junk = "Xq zrtp vvkw qlpt ghjk zzxc mnbv qwrt plkj hgfd zxcv bnmm qqwr ttyp lkjh gfds zxvb nmqw rtpl kjhg"
    assert html_text.main_text(f"<article><h1>Title</h1><p>{long}</p><p>{junk}</p><p>{long}</p>{links}</article>").split("\n") == ["Title", long.strip(), junk, long.strip()]
    assert html_text.main_text(f"<article><p>{junk}</p><p>{junk}</p></article>").split("\n") == [junk, junk]


def test_html_work_is_linear():
    import time

    n = 60_000
    for page in ("<b>x " * n, "<div>x" * n, "<b>" * n + "<div>" * n + "</b>" * n, "<div class=menu>x" * n, "<a href=x>y" * n, "<!" * n, "<p a='x" * n, "</div>" * n + "<span class=ad>z</b>" * n, "<article>x" * n):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20, page[:20]


def test_html_broken_markup_and_odd_rows(spark):
    for page in ("<p>open <b>bold", "<article><p>a", "<!-- never closed <p>x</p>", "<script>never closed", "a < b > c", "<p class='x>y", "&am", "<" * 5000, "<div>" * 3000 + "deep", "</p></div>", "<p>a</p>" * 2000):
        html_text.main_text(page)
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>Text</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(df).collect()
    assert len(out) == 5 and [r["n_chars"] for r in out] == [len(r["text"]) for r in out]
    assert out[2]["text"] == "" and out[3]["text"] == "" and out[4]["text"] == "Text"
    assert html_text.extract(df.limit(0)).count() == 0


TOXIC = ["idiot", "moron", "loser"]


def toxic_corpus(n=600):
    rng = np.random.default_rng(4)
    syllables = ["the", "an", "er", "ing", "ou", "re", "st", "th", "ed", "on"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(5, 120)))]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                words.insert(int(rng.integers(len(words))), str(rng.choice(TOXIC)))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_toxicity_finds_words_and_misspellings(make, spark):
    texts, labels = toxic_corpus()
    docs = make(texts)
    table = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels[:450])], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, table)
    got = np.array([r["predicted"] for r in sorted(toxicity.score(docs, model).collect(), key=lambda r: r["doc_id"])])[450:]
    assert (got == labels[450:]).mean() > 0.9
    clean, bad, unseen = model.predict([" ".join(["the", "theer", "anou", "oned"] * 20), " ".join(["the", "theer", "anou", "oned"] * 20 + ["idiot"]), " ".join(["the", "theer", "anou", "oned"] * 20 + ["idiots"])])
    assert bad > clean and unseen > clean


def test_toxicity_of_odd_rows(make, spark):
    docs = make(ODD, **CLASH)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit_model(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(0, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit_model(docs, one)).collect()} == {1}
    both = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit_model(docs, both)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(make([]), toxicity.Constant(0.0)).count() == 0


def test_quality_held_out(spark, sf_dir):
    from pairsight.llm.queries import op9_quality

    big = sf_dir.replace("sf0.001", "sf0.1")
    out = op9_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.97
    assert out.loc[out["quality"] == 1, "predicted"].mean() > 0.98


def test_quality_of_odd_rows(make, spark):
    docs = make(ODD, **CLASH)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = quality_mil.fit_model(docs, labels)
    out = toxicity.score(docs, model, threshold=0.7).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    kept = toxicity.keep_scored(docs, model, threshold=0.7)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in out)


def test_attention_gradient():
    """The written gradient against differences."""
    rng = np.random.default_rng(0)
    s = quality_mil.Settings(hidden=4, gate=3, epochs=0)
    x, first, y = rng.normal(size=(9, 6)), np.array([0, 4, 6]), np.array([1, 0, 1])
    model = quality_mil.Model(x, first, y, s)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    n, weight = np.array([4, 2, 3]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = model._forward(x, first, n)[-1]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).mean())

    grad = model._gradient(x, first, n, y, weight)
    for k, w in model.w.items():
        for i in list(np.ndindex(w.shape))[:6]:
            old = w[i]
            w[i] = old + 1e-5
            up = loss()
            w[i] = old - 1e-5
            down = loss()
            w[i] = old
            assert grad[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), k
