"""Token counts, rules, classifier, secrets, languages and pages against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import secrets
import zlib

import numpy as np
import pytest

from leadsieve.llm import html_text, language_id, quality_model, quality_rules, secret_scan, token_counts
from leadsieve.llm.common import table, tokenizer
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- token counts


def library_count(text):
    return len(tokenizer("byte_bpe_50k.json").encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_librarys(odd):
    rows = token_counts.token_counts(odd, huge=1000, chunk=400, overlap=16).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((x[1] or "").encode()), library_count(x[1])) for x in ODD)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_splices_are_exact_and_widen():
    counter, rng, widened = token_counts.Counter("byte_bpe_50k.json"), random.Random(3), 0
    pieces = ["ab c\n\t 'sé1  　日本 <|endoftext|> 's've  \r\n İ…", "aaaa", "<|endoftext|>", " ", "  ", "\n", "日本", "x"]
    for _ in range(150):
        text = "".join(rng.choice(pieces)[: rng.randint(1, 20)] for _ in range(rng.randint(1, 150)))
        n, w = token_counts.splice(text, counter.offsets, rng.choice([16, 40, 64]), rng.choice([4, 8]))
        widened += w
        assert n == library_count(text) == counter.count(text)
    assert widened


# ---------------------------------------------------------------- quality rules


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(odd, make):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "a b ", "x\n", "a b c a b c\n", "# ", "\x0b", " "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = odd.unionByName(make([(100 + i, t, "en", "s") for i, t in enumerate(texts)]))
    got = quality_rules.measured(df).collect()
    want = sorted(measures(t) for t in [x[1] for x in ODD] + texts)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_thresholds_follow_a_group(make):
    def text(i, symbol):
        return " ".join(f"w{i}x{j}{symbol}" for j in range(60))

    rows = [(i, text(i, "#" if i % 4 else ""), "en", "table") for i in range(200)]  # where symbols are usual
    rows += [(1000 + i, text(i, "#" if i == 7 else ""), "en", "prose") for i in range(200)]
    kept = {r.doc_id for r in quality_rules.quality_rules(make(rows)).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {1007}


def test_small_groups_borrow_and_lengths_count(make):
    def text(i, words, symbols):
        return " ".join(f"w{i}x{j}" + "#" * (j < symbols) for j in range(words))

    rows = [(i, text(i, 60, 30 + i % 20), "en", "table") for i in range(400)]
    rows += [(1000 + i, text(i, 60, 0), "de", "prose") for i in range(400)]
    # the same odd text in a group with many symbols, in one without, and in small ones of either language
    rows += [(2000 + i, text(i, 60, 45), *where) for i, where in enumerate([("en", "table"), ("de", "prose"), ("en", "new"), ("de", "new")])]
    # a tenth of the words: within what chance does to 60 words, not to 2,000
    rows += [(3000, text(1, 60, 6), "de", "prose"), (3001, text(1, 2000, 200), "de", "prose")]
    kept = {r.doc_id for r in quality_rules.quality_rules(make(rows)).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {2001, 2003, 3001}


def test_fences_decide_and_clean_documents_stay(spark):
    from pyspark.sql import functions as F

    docs, labels = (table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    got = quality_rules.quality_rules(docs).where("not base_failed").join(labels.where("quality is not null"), "doc_id")
    clean, bad = F.col("quality") == 1, F.col("quality") == 0
    row = got.agg(*[F.avg(F.when(c, F.col("kept").cast("int"))).alias(n) for c, n in ((clean, "clean"), (bad, "bad"))]).first()
    assert row.clean > 0.99 and row.bad < 0.05


def test_rules_on_odd_and_empty(odd, empty):
    assert [r.kept for r in quality_rules.quality_rules(odd).collect() if r.n_words < 50] == [False] * 9
    assert quality_rules.quality_rules(empty).count() == 0


# ---------------------------------------------------------------- classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality_model.quality_scores(docs, labels).join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        data = bytes(1 + i % 255 for i in range(n))
        chunks = quality_model.chunks_of(data)
        whole = np.zeros((len(chunks) - 1) * quality_model.STRIDE + quality_model.CHUNK, dtype=np.uint8)
        for i, c in enumerate(chunks):
            whole[i * quality_model.STRIDE : i * quality_model.STRIDE + quality_model.CHUNK] = c
        assert whole[:n].tobytes() == data and (n == 0 or len(whole) - n < quality_model.STRIDE + 64 or len(chunks) == 1)


def test_scores_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.quality_scores(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.quality_scores(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert quality_model.quality_scores(empty, labels).count() == 0


# ---------------------------------------------------------------- secrets


def test_base_spans():
    text = "é Token: 'abc.def' secret=abc token: token: abcdefgh ſecret=abcdefg AKIA" + "A" * 16 + " AKIAAAA " + "f" * 30
    spans = secret_scan.base_spans(text)
    assert [(text[s:e], k) for s, k, e in spans] == [("Token: 'abc.def", 0), ("AKIA" + "A" * 16, 1), ("f" * 30, 2)]


def test_secrets_found_and_prose_left(make):
    rng = random.Random(1)
    tokens = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36)) for _ in range(40)]
    plain = ["release-2024-10-31-final", "internationalization2000", "aaaaaaaa11111111aaaaaaaa", "20240131093000-20240131103000", "http/1234567890123456"]
    rows = [(i, f"é some words {t} and more") for i, t in enumerate(tokens)] + [(100 + i, f"words {p} more") for i, p in enumerate(plain * 8)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(make(rows)).collect()}
    assert sum(got[i].n_random for i in range(40)) >= 38
    assert sum(r.n_random for i, r in got.items() if i >= 100) == 0
    found = next(got[i] for i in range(40) if got[i].n_random)
    kind, start, end = found.spans.split(":")
    assert kind == "random" and rows[found.doc_id][1][int(start) : int(end)] == tokens[found.doc_id]


def test_secret_digest_and_redaction(odd, empty, make):
    text = 'x api_key="abcdef123" y ' + "0123456789abcdef" * 2
    row = secret_scan.find_secrets(make([(1, text)])).first()
    assert row.spans == "assign:2:20,hex:24:56" and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    assert secret_scan.redact(make([(1, text)])).first().text == 'x [SECRET]" y [SECRET]'
    assert secret_scan.find_secrets(odd).count() == len(ODD) and secret_scan.find_secrets(empty).count() == 0
    want = [(x[0], "[SECRET]" if x[0] == 7 else x[1]) for x in ODD]  # 7 is one long run of hex digits
    assert sorted(map(str, [(r.doc_id, r.text) for r in secret_scan.redact(odd).collect()])) == sorted(map(str, want))
    assert secret_scan.redact(empty).columns == empty.columns


def test_random_strings_pass_the_battery():
    passed = sum((secret_scan.judge(secrets.token_hex(20) + "0a") or (0, 0))[1] > 20 for _ in range(200))
    assert passed > 190


def test_the_battery_counts_in_the_p_value():
    rng = random.Random(5)
    drawn = "".join(rng.choice(secret_scan._LOWER + secret_scan._DIGITS) for _ in range(32))
    regular = "".join(a + b for a, b in zip("abcdefghijklmnop", "1234567890123456", strict=True))
    bits = secret_scan.evidence(regular, 36)
    assert bits > 40 and 2 * bits - secret_scan.judge(regular)[1] > 20  # unlike words, yet not random
    assert 2 * secret_scan.evidence(drawn, 36) - secret_scan.judge(drawn)[1] < 10


def test_letters_alone_parts_and_tokens_over_a_fixed_span():
    rng = random.Random(3)
    letters = "".join(rng.choice(secret_scan._LOWER + secret_scan._UPPER) for _ in range(40))
    names = ["ThisIsARatherLongNameOfAClassInCode", "SOME_CONSTANT_OF_THE_WHOLE_PROJECT", "some-long-article-about-the-weather-in-may"]
    assert secret_scan.judge(letters)[1] > 50 and all(secret_scan.judge(x)[1] < 20 for x in names)
    drawn = "".join(rng.choice(secret_scan._LOWER + secret_scan._UPPER + secret_scan._DIGITS) for _ in range(32))
    path = "files/of/the/project/by/name/" + drawn + "/some/more/of/the/same/names"
    assert [path[s:e] for s, e, *_ in secret_scan.token_spans(path, [])] == [drawn]
    text = "Zk9QwXb2_" + "0f1e2d3c4b5a69788796a5b4" + "_Lm8Rt2Vy7"
    assert secret_scan.base_spans(text) == [(9, 2, 33)]
    assert [(s, e) for s, e, *_ in secret_scan.token_spans(text, [(9, 2, 33)])] == [(0, len(text))]
    inside = "token=" + drawn
    assert secret_scan.token_spans(inside, secret_scan.base_spans(inside)) == []


def test_long_runs_take_time_in_proportion():
    import time

    def seconds(text):
        start = time.process_time()
        secret_scan.token_spans(text, secret_scan.base_spans(text))
        return time.process_time() - start

    many = "token=" + "a1b2c3.d4e5f6." * 20_000
    assert seconds("x" * 1_000_000) < 20 and seconds("Ab1/" * 250_000) < 20 and seconds(many) < 20


# ---------------------------------------------------------------- languages


def test_only_letters_are_letters(make):
    rows = [(i, "words of the one language here", "en") for i in range(9)] + [(9 + i, "wörter der anderen sprache", "de") for i in range(9)]
    odd = [(100 + i, x, "en") for i, x in enumerate(["½ ²", "Ⅷ", "①", "_ 7", "é", "字"])]
    got = {r.doc_id: r.lang_pred for r in language_id.identify_languages(make(rows + odd)).collect()}
    assert [got[100 + i] == "und" for i in range(6)] == [True] * 4 + [False] * 2


def test_held_out_labels_change_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(language_id, "MOST_TEXTS", 60)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.col("doc_id").cast("string")).otherwise(F.col("lang")))
    draw = [language_id.sample(x, "doc_id", "text", "lang", 300, 20_000) for x in (docs, other, docs.repartition(7))]
    assert draw[0] == draw[1] == draw[2] and len(draw[0][0]) > 20


def test_repeated_rows_are_drawn_once(make):
    rows = [(1, "the same words again", "en")] * 50 + [(i, f"some words {i}", "en") for i in range(2, 8)]
    texts, languages = language_id.sample(make(rows), "doc_id", "text", "lang", 300, 20_000)
    assert len(texts) == len(set(texts)) and set(languages) == {"en"}


def test_languages(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by = collections.Counter((r.lang_pred == "und", r.score) for r in language_id.identify_languages(odd).collect() if r.doc_id in (None, 1, 2, 3))
    assert by == {(True, 0.0): 4}
    assert language_id.identify_languages(empty).count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 8, 40])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert min(int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(n), 2)) >= max(1, code.shape[1] // 4)


# ---------------------------------------------------------------- pages

PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site</a><p>The best site of all, really.</p></header>
<div id="menu"><ul><li><a href=a>One</a></li><li><a>Two</a></ul></div><div class="cookie-notice">We use cookies, and you agree.</div>
<div class="wrap"><div class="col"><h1>Title of it</h1><p>First paragraph with <a href=x>a link</a>
and more text, long enough.<p>Second &lt;one&gt; &nbsp; with 3 < 4 text. It goes on, and on.</div>
<div class="sidebar"><h3>Related</h3><p>Some long paragraph that is in the sidebar, sadly enough.</p></div></div><script>var a = "<p>no</p>";</script>
<form><label>Name</label><input><button>Send</button></form><div id="comments"><article class="comment"><p>I liked this article a lot.</p></article></div>
<footer><p>(c) 2020</p></footer></body></html>"""


def test_page(spark):
    text = html_text.main_text(PAGE, html_text.DEFAULT)
    assert text == "Title of it\nFirst paragraph with a link and more text, long enough.\nSecond <one> with 3 < 4 text. It goes on, and on."


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        scores = [rng.choice([-3, -2, -1, 0, 0.5, 1, 2, 3]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.5, 1, 2])) for _ in range(rng.randint(0, 12))]

        def cost(label):
            return sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, label)) + sum(w for i, j, w in edges if label[i] != label[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html_text.minimum_cut(scores, edges)) - best) < 1e-9


def test_pages_table(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "v", "", ""), (3, "w", "<p>" * 3000 + "deep words here.", ""), (4, "w", "a < b <!-- never closed", "")]
    got = html_text.main_texts(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_texts(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "opening, closing",
    [
        ('<div class="site has-sidebar"><article>', "</article></div>"),
        ('<div id="page" class="header-fixed">', "</div>"),
        ('<main class="no-comments">', "</main>"),
        ('<form action="/x">', "</form>"),
        ('<article><div class="share-wrap">', "</div></article>"),
    ],
)
def test_wrapper_names_do_not_drop_the_article(opening, closing):
    prose = [f"Paragraph {i} tells of the river, the long road, and the town where they met again in spring." for i in range(6)]
    side = '<div class="sidebar"><p>Read this other story, too.</p></div><div class="comments"><article><p>Nice, thanks to all.</p></article></div>'
    page = "<html><body>" + opening + "".join(f"<p>{p}</p>" for p in prose) + closing + side + "</body></html>"
    assert html_text.main_text(page, html_text.DEFAULT) == "\n".join(prose)


@pytest.mark.parametrize("opening", ['section id="related-work"', 'section class="social-history"', 'div class="top"', 'section class="notice-period"'])
def test_sections_of_an_article_may_have_telling_names(opening):
    prose = [f"Paragraph {i} tells of the river, the long road, and the town where they met again in spring." for i in range(11)]
    inner = "".join(f"<p>{p}</p>" for p in prose[4:7])
    links = '<div class="related"><ul><li><a href="/a">Another story</a></li><li><a href="/b">One more</a></li></ul></div>'
    comments = '<div class="comments"><p>I liked it very much, thanks to the author for all of this.</p></div>'
    page = "<article>" + "".join(f"<p>{p}</p>" for p in prose[:4]) + f"<{opening}>{inner}</{opening.split()[0]}>"
    page += "".join(f"<p>{p}</p>" for p in prose[7:]) + links + comments + "</article>"
    assert html_text.main_text(page, html_text.DEFAULT) == "\n".join(prose)


@pytest.mark.parametrize("tag", ["iframe", "select", "video", "noscript", "object", "audio"])
def test_unclosed_elements_do_not_drop_the_rest(tag):
    prose = [f"Paragraph {i} tells of the river, the long road, and the town where they met again in spring." for i in range(4)]
    page = f"<article><p>{prose[0]}</p><{tag} src='x'><p>{prose[1]}</p><p>{prose[2]}</p></article><p>{prose[3]}</p>"
    assert html_text.main_text(page, html_text.DEFAULT).startswith("\n".join(prose[:3]))
