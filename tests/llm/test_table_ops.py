"""Archives, article text, vectors, chats and the pipeline against plain versions."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from triskel.llm import ann, chat, html, warc

# ---------------------------------------------------------------- archives


def test_archives_keep_every_record(spark):
    big = "é" * 600
    pages = [(1, "http://a", big), (2, "http://a", big), (3, None, big), (3, None, big), (4, "u\r\nv", "small"), (5, "x", "small"), (6, "x", None), (None, "n", big), (7, "x", "z" * 3_000_000)]
    pages += [(100 + i, "h", f"page {i} " * 300) for i in range(40)]
    df = spark.createDataFrame([(i, u, h, 9, "k") for i, u, h in pages], "page_id bigint, url string, html string, key int, kind string").repartition(5)
    folder = warc.scratch_archive(spark)
    manifest = warc.write_warc(df, folder, "page_id", "url", "html", roll_bytes=4000, shard_bytes=60_000)
    got = warc.read_warc(spark, folder).collect()
    expected = []
    for i, _, h in pages:
        body = (h or "").encode()
        same = [j for j, _, g in pages if j is not None and (g or "") == (h or "")]
        holder = max(same, default=None)
        revisit = len(body) >= 1000 and holder is not None and (i is None or i < holder)
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", holder if revisit else None, None if revisit else body))
    shown = sorted([(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=str)
    assert shown == sorted(expected, key=str)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages) and manifest.count() > 3
    again = warc.scratch_archive(spark)
    files = {r["name"]: r["sha1"] for r in warc.write_warc(df.repartition(2), again, "page_id", "url", "html", roll_bytes=4000, shard_bytes=60_000).collect()}
    assert files == {r["name"]: r["sha1"] for r in manifest.collect()}


def test_empty_archive(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = warc.scratch_archive(spark)
    warc.write_warc(df, folder, "page_id", "url", "html")
    assert warc.read_warc(spark, folder).count() == 0


# ---------------------------------------------------------------- article text

BODY = "One paragraph that goes on for quite a while, with commas, and says something. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a&amp;b &lt;c&gt; &eacute;&#233;&#x41;</p>", "a&b <c> ééA"),
        ("<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><a href=/>menu</a></nav><article><h1>Head</h1><p>one<br>two <b>three</b>\n\n four<p>five</article><footer>foot</footer></body></html>", "Head one two three four five"),
        (f"<body><div id=menu><a href=1>x</a><a href=2>y</a></div><div class=content><p>{BODY}</p><p>{BODY}</p></div><div class='sidebar'>side</div><div id='comments'><p>{BODY}</p></div></body>", f"{BODY.strip()} {BODY.strip()}"),
        (f"<body><article><p>{BODY}</p><aside>no</aside><form><input><p>no</p></form><p>{BODY}</p><section class='comments'><article><p>no</p></article></section></article></body>", f"{BODY.strip()} {BODY.strip()}"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"),
        ("<article>a<!-- <p>no</p> -->b</article>", "ab"),
        ("plain text only", "plain text only"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
    ],
)
def test_article_text(page, text):
    assert html.main_text(page) == text


LINKS = "<ul>" + "<li><a href=/x>some link</a>" * 30 + "</ul>"


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<div id=content><section>{a5}</section><section>{b3}</section></div>", "{a5} {b3}"),
        ("<div><section>{a3}</section><div><section>{b5}</section></div><section>{c3}</section></div>", "{a3} {b5} {c3}"),
        ("<div>{a3}<blockquote>{b5}</blockquote>{c3}</div>", "{a3} {b5} {c3}"),
        ("<div>{a3}<ul><li>{b1}<li>{b1}<li>{b1}<li>{b1}<li>{b1}</ul>{c1}</div>", "{a3} {b5} {c1}"),
        ("<div>{links}</div><div><section>{a5}</section><section>{b3}</section></div><div>{links}</div>", "{a5} {b3}"),
    ],
)
def test_every_content_container_is_kept_in_page_order(page, wanted):
    blocks = {f"{c}{n}": f"<p>{c} {BODY}</p>" * n for c in "abc" for n in (1, 3, 5)}
    texts = {f"{c}{n}": " ".join([f"{c} {BODY.strip()}"] * n) for c in "abc" for n in (1, 3, 5)}
    assert html.main_text(f"<html><body>{page.format(**blocks, links=LINKS)}</body></html>") == wanted.format(**texts)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><article><p>a<p class='ad'>x<p>b</p><p>c</p></article></body>", "a b c"),
        ("<body><article><ul><li>a<li class=share>x<li>b</li><li>c</li></ul><p>d</p></article></body>", "a b c d"),
        ("<body><main><article><p>a</p><div class='ad'>x</article><p>b</p></main></body>", "a b"),
        ("<body><article><table><tr><td>a<tr class=ad><td>x<td>y<tr><td>b</table><p>c</p></article></body>", "a b c"),
        ("<html><head><title>t</title><body><article><p>a</p></article></body></html>", "a"),
        ("<html><head><title>t</title><article><p>a</p></article></html>", "a"),
        ("<head><meta x>plain text", "plain text"),
        ("<article><p>a</p><b><div class=ad>x</b>y</div><p>b</p></article>", "a b"),
        ("<article><p>a <button><div>x</div></button> b</p><nav><p>x<p>y</nav><p>c</p></article>", "a b c"),
        ("<article><p>a</p><aside><article><p>x</p></article><p>y</p></aside><header>b</header></article>", "a b"),
    ],
)
def test_a_part_that_is_left_out_ends_like_any_element(page, text):
    assert html.main_text(page) == text


NAMES = ["related-work", "discussion", "legal-basis", "search-results", "social-history", "notice"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("root", ["article", "main"])
def test_topics_in_names_do_not_cost_article_text(root, name):
    page = f"<body><{root}><h2 id='{name}'>a</h2><p id={name}>b</p><section id={name} class='{name}'><h3 class='{name}'>c</h3><p>d <a href=x>e</a></p></section><div id={name}><p>f</p></div></{root}></body>"
    assert html.main_text(page) == "a b c d e f"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><div class='entry-header'><h1 class='post-header'>a</h1></div><p>b</p></article>", "a b"),
        ("<article><h2 id=advertising>a</h2><section id='cookie-consent'><p>b</p></section></article>", "a b"),
        ("<body><h2 id=menu>a</h2><p>b</p><section id=related-work><p>c</p></section></body>", "a b c"),
        ("<article><p>a</p><div class='related'>See <a href=1>other text</a> <a href=2>and more</a></div><p>b</p></article>", "a b"),
        ("<article><p>a</p><section class='search'>Find in this text <form><input><button>x</button></form></section><p>b</p></article>", "a b"),
        ("<article><p>a</p><section class='comments discussion'><p>x</p></section><h3 class='social'><a href=1>x</a></h3><p>b</p></article>", "a b"),
        ("<main><p>a</p><div class='header'><div class='social'><a href=1>x</a></div>b</div></main>", "a b"),
    ],
)
def test_parts_are_told_from_topics_by_links_and_forms(page, text):
    assert html.main_text(page) == text


def test_extraction_as_a_table(spark):
    deep = "<div>" * 20_000 + "end"
    rows = [(1, "u", None, "t"), (2, None, "<p>x</p>", "t"), (2, None, "<p>x</p>", "t"), (3, "u", deep, "t"), (4, "u", "<p>" + "word " * 200_000, "t"), (5, "u", '<a href="' * 3000, "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"], r["text"][:5], r["n_chars"]) for r in html.extract_text(df, "html", ["page_id", "url"]).where("page_id < 5").collect())
    assert got == [(1, "", 0), (2, "x", 1), (2, "x", 1), (3, "end", 3), (4, "word ", 999_999)]
    assert html.extract_text(df.limit(0), "html", ["page_id", "url"]).count() == 0


def test_pages_of_the_table_equal_their_articles(spark):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in entry_point.queries()["op4_main_text"](spark, "/root/testdata/sf0.001").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)
        assert r["text"] == " ".join(unescape(re.sub(r"<[^>]*>", " ", article[1])).split())


# ---------------------------------------------------------------- vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, score double").repartition(3)


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[700:720] = x[40]
    df = vectors(spark, [(i, v.tolist(), "q", 0.0) for i, v in enumerate(x)])
    got = {}
    for r in ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    products = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    assert len(got) == 75
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        for _, v, s in found:
            assert s == pytest.approx(products[q, v], rel=1e-12) and v != q
        order = [(-s, v) for _, v, s in found]
        assert order == sorted(order)
        true = sorted((i for i in range(1500) if i != q), key=lambda i: (-products[q, i], i))[:20]
        hits += len(set(true) & {f[1] for f in found})
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (3, [1.0, None]), (4, []), (5, [1.0, 2.0, 3.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = vectors(spark, [(i, v, None, None) for i, v in rows])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 6, 0.5), (0, 3, 6, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 0.5), (20, 3, 6, 0.5)]
    assert ann.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.nearest(df.where("embedding IS NULL"), "vec_id", "embedding", F.lit(True), 20).count() == 0


def test_probing_finds_every_code_in_the_radius():
    codes = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 17, 26, 64):
        for code in codes[:5]:
            assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


# ---------------------------------------------------------------- chats

MARKS = "<|im_end|><|im_start|>assistant ok"
CHATS = [
    (1, 0, "system", "be kind"),
    *[(1, i, "user" if i % 2 else "assistant", f"turn {i} <|im_end|> \\ {'word ' * (i % 7 * 40)}") for i in range(1, 40)],
    (2, 0, None, None),
    (2, 1, "assistant", ""),
    (3, 5, "user", "tie"),
    (3, 5, "assistant", "tie"),
    (3, 5, "assistant", "tie"),
    (4, None, "a\nb\\n<|x", "line\nfeed\\"),
    (4, 0, "assistant", "<|" * 50 + "\\|"),
    (5, 0, "assistant", "huge " * 30_000),
    (5, 1, "user", "after"),
    (5, 2, "assistant", "end"),
    (None, 0, "assistant", "no id"),
]


def chats(spark, rows=CHATS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos string, tokens int").repartition(4)


def test_windows_are_read_back_whole(spark):
    digests = chat.conversation_digests(chat.parse_windows(chat.chat_windows(chats(spark)))).collect()
    assert len(digests) == 6
    for r in digests:
        turns = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in CHATS if c == r["conv_id"]])
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_the_budget_the_system_turn_and_some_history(spark):
    windows = sorted((r for r in chat.parse_windows(chat.chat_windows(chats(spark))).collect() if r["conv_id"] == 1), key=lambda r: r["window_id"])
    assert len(windows) > 2
    for w in windows:
        assert w["n_tokens"] <= chat.BUDGET and w["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        assert w["formatted"].count(chat.START) == w["n_new"] + w["n_repeated"] == w["formatted"].count(chat.END)
        inside = "".join(w["formatted"][s["start"] : s["end"]] for s in w["loss"])
        assert chat.START not in inside and chat.END not in inside
    assert any(w["n_repeated"] > 1 for w in windows[1:]) and windows[0]["n_repeated"] == 0


def test_no_chat(spark):
    assert chat.conversation_digests(chat.parse_windows(chat.chat_windows(chats(spark).limit(0)))).count() == 0


def test_chat_query_has_no_python(spark):
    plan = entry_point.queries()["op10_chat_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------------- pipeline


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with an odd row of each sort, and the benchmark of the smallest table."""
    folder = tmp_path_factory.mktemp("sf")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    prose = documents.where("lang = 'en'").orderBy("n_chars", ascending=False).first()["text"]
    odd = [(9000, None, "en"), (9001, "", None), (9002, "123 !!", "en"), (9003, prose + " the end of it", None), (9003, prose + " the end of it", None), (None, "the and of that with this", "en"), (9004, f"the and {item} of that", "en"), (9005, "the and of that password=abcdef123 with this", "en")]
    more = spark.createDataFrame([(i, t, lang, "odd", len(t or "")) for i, t, lang in odd], documents.schema)
    both = documents.unionByName(more).withColumns({"id": F.lit("clash"), "class_id": F.lit(1), "leaks": F.lit(None).cast("string"), "findings": F.lit(2.5)})
    both.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        kept[name] = corpus_pipeline.materialise(out)
        if name != "packing":
            assert out.columns == docs.columns
            docs = kept[name]

    def ids(name):
        return {r["doc_id"] for r in kept[name].collect()}

    assert not {9000, 9001, 9002} & ids("language_id") and {9003, 9004, 9005, None} <= ids("language_id")
    assert 9003 not in ids("near_dedup") and None in ids("near_dedup")
    assert 9004 in ids("near_dedup") and 9004 not in ids("decontamination") and 9005 in ids("decontamination")
    text = kept["secret_scan"].where("doc_id = 9005").first()
    assert text["text"] == "the and of that [SECRET] with this" and text["n_chars"] == len(text["text"])
    assert kept["packing"].agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    assert ids("packing") == ids("secret_scan")


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_every_dealt_query_is_registered():
    names = set(entry_point.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1, n
    assert json.dumps(sorted(names))
