"""HTML extraction and chat formatting."""

import hashlib
from html import escape

from hypothesis import given, settings, strategies as st

from lanternlog.llm import chat, html_text


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>x</p>';</script></head><body>{before}{article}{after}</body></html>"


def test_article_without_side_matter():
    article = "<article><header><h1>A &amp; B</h1></header><p><b>First&nbsp;words<br><p>in a <a href=x>link</a>ed\n block<p>End.<div class='comments'><p>No!</p></div></article>"
    before = "<nav><ul><li><a href=/>Home<li><a href=/b>B</a></ul></nav><header>Top</header><div class=ad-box>Buy</div><form><p>Search</p></form>"
    after = "<aside><p>Side text of some length, longer than the article.</p></aside><footer>&copy;</footer><div id='cookie-notice'>Cookies</div><!-- x -->"
    assert html_text.main_text(page(article, before, after)) == "A & B First words in a linked block End."


def test_density_without_article_element():
    body = "<div id=wrap><div class=story>" + "<p>Plain words of the story go on and on here.</p>" * 5 + "</div>"
    links = "<div>" + "".join(f"<a href=/{i}>Link {i}</a> " for i in range(30)) + "</div></div>"
    assert html_text.main_text(page(body + links)) == " ".join(["Plain words of the story go on and on here."] * 5)


def test_wrappers_with_names_of_side_matter():
    text = " ".join(["Plain words of the story go on and on here."] * 5)
    story = "<p>Plain words of the story go on and on here.</p>" * 5
    side = "<div class='widget ad'>Buy now</div><div id=comments><p>No!</p></div><form><p>Search</p></form>"
    links = "<div>" + "".join(f"<a href=/{i}>Link {i}</a> " for i in range(30)) + "</div>"
    for open_, close in (
        ("<div class='has-sidebar'>", "</div>"),
        ("<div class='no-sidebar container'>", "</div>"),
        ("<form id=aspnetForm action=/><div>", "</div></form>"),
        ("<form><div class='page has-sidebar'><section id='banner-page'>", "</section></div></form>"),
    ):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", f"<div class=story>{story}</div>"):
            assert html_text.main_text(page(open_ + inner + side + links + close)) == text
            assert html_text.main_text(page(open_ + inner + close, side, links)) == text
    widgets = "".join(f"<div class=elementor-widget-container>{p}</p></div>" for p in story.split("</p>")[:-1])
    assert html_text.main_text(page(f"<div class=story>{widgets}</div>", links, side)) == text
    assert html_text.main_text(page(f"<main><div class=has-sidebar>{story}</div></main>", side)) == text
    assert html_text.main_text(page(f"<article>{story}<div class=comments>{'<p>Another reader has an opinion on this story.</p>' * 4}</div></article>")) == text
    assert html_text.main_text(page(f"<article>{story}</article><div class=comments>{'<p>Another reader has an opinion on this story.</p>' * 30}</div>")) == text
    related = "<div class=related><article>Teaser of another story</article><article>Teaser of a third</article></div>"
    assert html_text.main_text(page(f"<main><article>{story}</article>{related}</main>")) == text
    assert html_text.main_text(page(f"<div class=story>{story}<form><input><p>Subscribe</p></form></div>")) == text
    assert html_text.main_text(page(f"<div class='has-sidebar' style='display:none'>{story}</div><p>Shown.</p>")) == "Shown."


def test_odd_pages(spark):
    long = "<article>" + "<p>word " * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "no tags"), (4, "u", long), (4, "u", long), (5, "u", "<p title='a>b\">x"), (6, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or 0, r["text"][:20], r["n_chars"]) for r in html_text.extract(pages).collect())
    words = len("word " * 20_000) - 1
    assert got[:4] == [(0, "<", 1), (1, "", 0), (2, "", 0), (3, "no tags", 7)]
    assert got[4:6] == [(4, "word word word word ", words)] * 2 and got[7] == (6, "deep", 4)
    assert html_text.extract(pages.limit(0)).count() == 0


@given(st.lists(st.text(max_size=20), max_size=8))
def test_plain_blocks_come_back(blocks):
    blocks = [" ".join(b.replace("\0", "").split()) for b in blocks]
    made = page("<article>" + "".join(f"<p>{escape(b)}</p>" for b in blocks) + "</article>", "<nav>menu</nav>")
    assert html_text.main_text(made) == " ".join(" ".join(blocks).split())


PIECES = st.lists(st.sampled_from(["<", "[", "\\", "|", "<|im_end|>", "<|im_start|>", "</s>", "[/INST]", "<<SYS>>", "s>", "INST]", "\n", "%0A", "a"]), max_size=8).map("".join)


@settings(max_examples=500)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), min_size=1, max_size=5))
def test_chats_round_trip(turns):
    rows = [{"conv_id": 1, "role": r, "text": t} for r, t in turns]
    examples = list(chat.expanded(iter(rows)))
    assert list(chat.parse(examples[-1]["text"])) == turns and [e["closes"] for e in examples] == [False] * (len(examples) - 1) + [True]
    targets = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
    masked = [e for e in examples if e["loss_start"] >= 0]
    assert len(masked) == len(targets)
    for e, i in zip(masked, targets):
        assert list(chat.parse(e["text"])) == turns[: i + 1]
        assert chat.unescape(e["text"][e["loss_start"] : e["loss_end"]]) == turns[i][1]
    assert all(e["text"].count("<|im_start|>") == len(list(chat.parse(e["text"]))) for e in examples)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", ""), (None, 0, "assistant", "x"), (None, None, None, None),
        (2, 0, "system", "only"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (4, 0, "user", "w " * 200_000), (4, 1, "assistant", "</s>" * 50_000),
    ]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn int, role string, text string, example string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(table)).collect()}
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1])):
        own.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(own)
    for c, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.expand(table.limit(0))).count() == 0
